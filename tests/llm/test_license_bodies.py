"""License files and headers that only their whole text tells."""

import random
from importlib import resources

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm.queries")

from tessera.llm import licenses  # noqa: E402


def body(name):
    return resources.files("tessera.llm").joinpath("license_texts", f"{name}.txt").read_text()


def test_bodies(spark):
    rng = random.Random(3)
    code = "\n".join(f"v{rng.randrange(10**6)} = f{rng.randrange(10**6)}(x{rng.randrange(10**6)})" for _ in range(200))
    untitled = lambda name: body(name).split("\n", 2)[2]
    commented = "\n".join("# " + line for line in untitled("MIT").split("\n"))
    rows = [
        (1, "a/LICENSE", "Copyright (c) 2015, Foo Bar. All rights reserved.\n\n" + body("BSD-3-Clause")),
        (2, "b/terms", "Copyright (c) 2015, Foo Bar. All rights reserved.\n\n" + body("BSD-2-Clause")),
        (3, "c/LICENSE", untitled("MIT")),
        (4, "d/COPYING", untitled("ISC")),
        (5, "e/x.py", commented + "\n" + code),
        (6, "f/x.c", "/*\n" + body("BSD-3-Clause") + "*/\n" + code),
        (7, "b/src/y.py", code),
        (8, "g/LICENSE", "Copyright (c) 2015, Foo Bar. All rights reserved."),
        (9, "h/z.py", "# Permission to read this file.\n" + code),
        *((100 + k, f"l{k}/LICENSE", body(name)) for k, name in enumerate(("AGPL-3.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "Apache-2.0", "MPL-2.0", "CC0-1.0", "Unlicense"))),
    ]
    got = {r.doc_id: r for r in licenses.licensed(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()}
    assert [got[i].license for i in range(1, 10)] == ["BSD-3-Clause", "BSD-2-Clause", "MIT", "ISC", "MIT", "BSD-3-Clause", None, "Proprietary", None]
    assert [got[i].license for i in sorted(got) if i >= 100] == ["AGPL-3.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "Apache-2.0", "MPL-2.0", "CC0-1.0", "Unlicense"]
    assert [i for i in range(1, 10) if got[i].license_file] == [1, 2, 3, 4, 8]
    assert got[1].licenses == ["BSD-3-Clause"] and got[7].inherited_license == "BSD-2-Clause" and got[9].licenses is None
