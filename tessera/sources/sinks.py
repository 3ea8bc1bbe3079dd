"""Results as JSON, CSV, YAML or text files, written by executors; reports as text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Arrays, maps and structs as JSON in their cells."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", "true").csv(path)


def yaml_row(df: DataFrame) -> Column:
    """A row as an item of a YAML list; every value as JSON, which YAML reads."""
    value = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))
    return F.concat(*(F.concat(F.lit("- " if k == 0 else "\n  "), F.lit(f"{c}: "), value(c)) for k, c in enumerate(df.columns)))


def write_yaml(df: DataFrame, path: str) -> None:
    df.select(yaml_row(df).alias("value")).write.mode("overwrite").text(path)


def report(df: DataFrame, title: str) -> DataFrame:
    """One column of lines: a title, then ``name: value`` of each row's columns."""
    lines = F.array(*(F.concat_ws(": ", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns))
    return df.sparkSession.createDataFrame([(title,), ("=" * len(title),)], "line string").union(df.select(F.explode(lines).alias("line")))


def write_json_arrays(rows: DataFrame, json: str, path: str) -> None:
    """Writes each partition as a file that is one JSON array; ``json``: the column of the items' texts. A partition without rows is an empty array."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, opened = None, "["
        for batch in batches:
            items = batch.column(0).to_pylist()
            if not items:
                continue
            whole = items if last is None else [last, *items]
            lines = [x + "," for x in whole[:-1]]
            last = whole[-1]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([opened + lines[0], *lines[1:]])], names=["value"])
                opened = ""
        yield pa.RecordBatch.from_arrays([pa.array([opened + (last or "") + "]"])], names=["value"])

    rows.select(json).mapInArrow(of, "value string").write.text(path)
