"""License scans: sparse TF-IDF cosine of statements and license files to templates, then inheritance from the nearest directory.

Everything here is DataFrame expressions. What is looked at is each statement, which is the text around a cue such
as "licensed under", and each whole text with a legal word: the full file, and the comment it begins with. Whole
texts are compared to the licenses' own bodies. Terms are weighted by how rare they are among all statements, or
among all whole texts, of the table.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, documents, written

# How licenses are named in headers, notices and the first lines of license files, each a template.
TEMPLATES = {
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3", "AGPL-3.0 license", "agpl v3 license"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache-2.0 license"),
    "BSD-2-Clause": ("BSD 2-Clause simplified license", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause new license", "BSD-3-Clause", "BSD license redistribution and use in source and binary forms are permitted"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International license", "CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Creative Commons Attribution NonCommercial 4.0 International license", "CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Creative Commons Attribution ShareAlike 4.0 International license", "CC-BY-SA-4.0"),
    "CC0-1.0": ("CC0 1.0 Universal public domain dedication", "CC0-1.0"),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2", "GPL-2.0 license", "gpl v2 license"),
    "GPL-3.0": ("Licensed under the GNU General Public License, version 3", "GPL-3.0 license", "gpl v3 license"),
    "ISC": ("ISC License", "ISC license permission to use copy modify and distribute this software"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0 license", "lgpl v3 license"),
    "MIT": ("Released under the MIT License", "MIT License permission is hereby granted free of charge to any person obtaining a copy of this software"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "MPL-2.0 license"),
    "Proprietary": ("Copyright all rights reserved", "proprietary and confidential all rights reserved"),
    "Unlicense": ("The Unlicense", "This is free and unencumbered software released into the public domain"),
}
# Words that say nothing of a license.
STOP = ["a", "all", "and", "any", "in", "into", "is", "of", "the", "this", "to", "use", "under"]
CUE = r"(?i)licen[sc]e|copyright|all rights reserved|public domain|spdx-"
#: Words of which each license's body has several: a text without any isn't compared as a whole.
LEGAL = rf"{CUE}|warrant(?:y|ies)|permission|redistribut"
#: A line of a comment, or a blank one.
COMMENT = r"^\s*(?:$|#|//|\*|--|;|%)"
#: A statement: up to 40 characters before a cue and 90 after it.
STATEMENT = rf"(?s)[^\n]{{0,40}}(?:{CUE})[^\n]{{0,90}}"
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENSE_FILE = r"(?i)^(?:licen[sc]e|copying|unlicense|notice)(?:[.-].*)?$"
#: Least cosine of a statement to a template; share of a text's words in statements from which on it is a license file.
LEAST, FILE_SHARE = 0.6, 0.9


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def template_weights(spark: SparkSession) -> DataFrame:
    """license, template, term, tf."""
    rows = spark.createDataFrame([(own, k, said) for own, all_ in TEMPLATES.items() for k, said in enumerate(all_)], "license string, template int, words string")
    each = rows.select("license", "template", F.explode(terms(F.col("words"))).alias("term")).where(~F.col("term").isin(STOP))
    return each.groupBy("license", "template", "term").agg(F.count("*").cast("double").alias("tf"))


def body_weights(spark: SparkSession) -> DataFrame:
    """license, template, term, tf of the licenses' bodies, a text file each. The one of AGPL-3.0 is put together from GPL-3.0's."""
    texts = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in resources.files("tessera.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")]
    each = spark.createDataFrame(texts, "license string, words string").select("license", F.lit(0).alias("template"), F.explode(terms(F.col("words"))).alias("term"))
    return each.where(~F.col("term").isin(STOP)).groupBy("license", "template", "term").agg(F.count("*").cast("double").alias("tf"))


def header(text: Column) -> Column:
    """The comment that a text begins with; null if there is none or nothing else."""
    start = F.ltrim(text)
    lines = F.split(text, "\n")
    code = F.array_position(F.transform(lines, lambda line: F.rlike(line, F.lit(COMMENT))), F.lit(False))
    found = (
        F.when(start.startswith("/*"), F.substring_index(start, "*/", 1))
        .when(start.startswith("<!--"), F.substring_index(start, "-->", 1))
        .when(start.startswith('"""'), F.element_at(F.split(start, '"""'), 2))
        .when(code > 1, F.array_join(F.slice(lines, F.lit(1), F.greatest(code - 1, F.lit(1)).cast("int")), "\n"))
    )
    return F.when(F.rlike(found, F.lit(LEGAL)), found)


def matched_whole(texts: DataFrame, least: float = LEAST) -> DataFrame:
    """row, k, license, score of each whole text (row, k, said) that some license's body has a cosine of ``least`` with.

    All terms of a text count in its norm, a term that no body has as one that just this text has. Of equal cosines
    the license first by name counts.
    """
    own = body_weights(texts.sparkSession)
    vocabulary = F.broadcast(own.select("term").distinct().withColumn("in_body", F.lit(True)))  # the bodies' own size
    each = texts.select("row", "k", F.explode(terms(F.col("said"))).alias("term")).where(~F.col("term").isin(STOP))
    tf = written(each.groupBy("row", "k", "term").agg(F.count("*").cast("double").alias("tf")).join(vocabulary, "term", "left"))
    n = texts.count()
    df = tf.where("in_body").groupBy("term").agg(F.count("*").alias("df"))
    idf = lambda d: F.log((1.0 + n) / (1 + d)) + 1
    template = own.join(df, "term", "left").withColumn("idf", idf(F.coalesce("df", F.lit(0)))).withColumn("w", F.col("tf") * F.col("idf"))
    norms = template.groupBy("license", "template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    by_term = template.join(norms, ["license", "template"]).groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("license", (F.col("w") / F.col("norm")).alias("w"))).alias("to"))
    weighed = tf.join(F.broadcast(by_term), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", idf(F.lit(1))))
    norm = weighed.groupBy("row", "k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.select("row", "k", "w", F.explode("to").alias("t")).groupBy("row", "k", F.col("t.license").alias("license")).agg(F.sum(F.col("w") * F.col("t.w")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 9)
    best = dots.join(norm, ["row", "k"]).select("row", "k", "license", score.alias("score")).groupBy("row", "k").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("best"))
    return best.select("row", "k", "best.license", (-F.col("best.low")).alias("score")).where(F.col("score") >= least)


def matched(statements: DataFrame, least: float = LEAST) -> DataFrame:
    """row, k, license, score of each statement (row, k, said) that some template's cosine reaches ``least`` with.

    Vectors are over the templates' terms. A term's weight falls with the number of statements that have it. Of equal
    cosines the license first by name counts.
    """
    own = template_weights(statements.sparkSession)
    vocabulary = F.broadcast(own.select("term").distinct())  # the templates' own size
    tf = statements.select("row", "k", F.explode(terms(F.col("said"))).alias("term")).join(vocabulary, "term").groupBy("row", "k", "term").agg(F.count("*").cast("double").alias("tf"))
    tf = written(tf)
    n = tf.select("row", "k").distinct().count()
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weights = own.join(df, "term", "left").withColumn("idf", F.log((1.0 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1)
    template = weights.withColumn("w", F.col("tf") * F.col("idf"))
    norms = template.groupBy("license", "template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    by_term = template.join(norms, ["license", "template"]).groupBy("term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("license", "template", (F.col("w") / F.col("norm")).alias("w"))).alias("to"))
    weighed = tf.join(F.broadcast(by_term), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = weighed.groupBy("row", "k").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.select("row", "k", "w", F.explode("to").alias("t")).groupBy("row", "k", F.col("t.license").alias("license"), F.col("t.template").alias("template")).agg(F.sum(F.col("w") * F.col("t.w")).alias("dot"))
    score = F.round(F.col("dot") / F.col("norm"), 9)
    best = dots.join(norm, ["row", "k"]).select("row", "k", "license", score.alias("score")).groupBy("row", "k").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("best"))
    return best.select("row", "k", "best.license", (-F.col("best.low")).alias("score")).where(F.col("score") >= least)


def licensed(docs: DataFrame, path: Column, least: float = LEAST, file_share: float | None = None) -> DataFrame:
    """doc_id, path, n_statements, license, score, licenses, license_file, inherited_license, inherited_from, effective_license.

    ``docs``: doc_id, text; other columns don't matter. ``path`` gives each row's path, directories parted by "/".
    A row's license is that of the license body with the best cosine to its whole text or to the comment it begins
    with; where none reaches ``least``, that of its statement with the best cosine (ties: first by name).
    ``licenses`` are those of all of these, but beside a license's body "all rights reserved" alone is no license.
    A file named like a license file licenses its directory, and so does one whose full text reaches ``least`` with a license's body
    and, if ``file_share`` is given, one with at least that share of its words in statements; of several the best cosine counts. A row without a license of its own has that of the nearest directory above
    it, its own first. Null or empty text has no statement; a null path inherits nothing. Repeated rows get
    equal answers. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    said = F.when(F.rlike(text, F.lit(CUE)), F.regexp_extract_all(text, F.lit(STATEMENT), F.lit(0)))
    size = F.when(F.rlike(text, F.lit(CUE)), F.regexp_count(text, F.lit(r"\S+")))
    scan = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), said.alias("said"), size.alias("size"), F.when(F.rlike(text, F.lit(LEGAL)), F.array(text, header(text))).alias("whole")))
    texts = scan.where("whole IS NOT NULL").select("row", F.posexplode("whole").alias("k", "said")).where("said IS NOT NULL")
    bodies = matched_whole(texts, least).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("body"), F.collect_set("license").alias("bodies"), F.max(F.col("k") == 0).alias("full"))
    statements = scan.where("said IS NOT NULL").select("row", F.posexplode("said").alias("k", "said"))
    found = matched(statements, least).groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("best"), F.sort_array(F.collect_set("license")).alias("licenses"), F.count("*").alias("n"))
    own = scan.join(found, "row", "left").join(bodies, "row", "left")
    said_ = F.when(F.col("body").isNull(), F.col("licenses")).otherwise(F.filter("licenses", lambda c: c != "Proprietary"))
    every = F.sort_array(F.array_union(F.coalesce("bodies", F.array().cast("array<string>")), F.coalesce(said_, F.array().cast("array<string>"))))
    own = own.withColumn("best", F.coalesce("body", "best")).withColumn("licenses", F.when(F.col("best").isNotNull(), every))
    in_said = F.aggregate("said", F.lit(0), lambda acc, s: acc + F.regexp_count(s, F.lit(r"\S+")))
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    is_file = F.col("best").isNotNull() & (F.coalesce(F.rlike(name, F.lit(LICENSE_FILE)), F.lit(False)) | F.coalesce("full", F.lit(False)) | (F.lit(False) if file_share is None else in_said >= file_share * F.col("size")))
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    own = written(own.select("row", "doc_id", "path", F.coalesce("n", F.lit(0)).cast("long").alias("n_statements"), F.col("best.license").alias("license"), (-F.col("best.low")).alias("score"), "licenses", F.coalesce(is_file, F.lit(False)).alias("license_file"), folder.alias("folder")))
    grants = own.where("license_file AND folder IS NOT NULL").groupBy("folder").agg(F.min(F.struct((-F.col("score")).alias("low"), "license")).alias("best"))
    grants = bounded(written(grants.select("folder", F.col("best.license").alias("granted"))))
    up = F.split("folder", "/")
    depth = F.sequence(F.lit(0), F.size(up))
    above = own.where("license IS NULL AND folder IS NOT NULL").select("row", F.explode(F.transform(depth, lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(up, F.lit(1), d), "/").alias("folder")))).alias("at")).select("row", "at.depth", "at.folder").distinct()
    nearest = above.join(grants, "folder").groupBy("row").agg(F.max(F.struct("depth", "folder", "granted")).alias("near"))
    both = own.join(nearest, "row", "left")
    return both.select("doc_id", "path", "n_statements", "license", "score", "licenses", "license_file", F.col("near.granted").alias("inherited_license"), F.col("near.folder").alias("inherited_from"), F.coalesce("license", "near.granted").alias("effective_license"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' table has no paths: a document is taken to stand in its language's folder in its source's folder, and is a license file if it says little else."""
    return licensed(documents(spark, sf_dir), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), file_share=FILE_SHARE)
