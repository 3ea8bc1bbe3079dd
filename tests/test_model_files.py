"""Model files of any length, of which only the heads may be read."""

import json
import struct

import pytest

from tessera.sources import model_files

LENGTH = (1 << 31) + (1 << 20)


@pytest.fixture
def folder(tmp_path):
    head = json.dumps({"w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}}).encode()
    s = lambda t: struct.pack("<Q", len(t)) + t.encode()
    gguf = b"GGUF" + struct.pack("<IQQ", 3, 1, 1) + s("general.name") + struct.pack("<I", 8) + s("m" * 200_000) + s("t") + struct.pack("<IQIQ", 1, 4, 0, 64)
    for name, data, length in (("small.safetensors", head, 0), ("large.safetensors", head, LENGTH), ("large.gguf", gguf, LENGTH), ("cut.gguf", gguf[:-4], 0)):
        with open(tmp_path / name, "wb") as f:
            f.write((struct.pack("<Q", len(data)) if name.endswith("safetensors") else b"") + data)
            f.truncate(max(length, f.tell()))  # sparse
    return str(tmp_path)


def test_files_over_two_gigabytes(spark, folder):
    got = model_files.tensors(model_files.files(spark, folder, "*.safetensors")).collect()
    assert sorted((r.path.split("/")[-1], r.name, int(r.parameters), r.error) for r in got) == [("large.safetensors", "w", 6, None), ("small.safetensors", "w", 6, None)]
    binary = model_files.files(spark, folder, "*.gguf")
    assert {(r.path.split("/")[-1], r.name, r.error is None) for r in model_files.gguf_tensors(binary).collect()} == {("large.gguf", "t", True), ("cut.gguf", None, False)}
    assert {(r.path.split("/")[-1], r.key, r.value and len(r.value)) for r in model_files.gguf_metadata(binary).collect()} == {("large.gguf", "general.name", 200_002), ("cut.gguf", None, None)}


def test_a_store_that_tasks_cannot_open(spark, folder):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", "file://" + folder)
    got = model_files.tensors(model_files.files(spark, "viewfs://store/in", "*.safetensors")).collect()
    assert sorted((r.path.split("/")[-1], r.name, r.error is None) for r in got) == [("large.safetensors", None, False), ("small.safetensors", "w", True)]
