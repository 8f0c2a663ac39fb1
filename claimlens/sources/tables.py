"""Report tables as CSV, configurations, and rows in older forms."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header; a byte order mark before the first name does not count, columns are taken by name and cast."""
    raw = spark.read.option("header", True).csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    wanted = [c.strip().split(" ", 1) for c in schema.split(",")]
    return raw.select(*((F.col(f"`{names[n]}`") if n in names else F.lit(None)).cast(t).alias(n) for n, t in wanted))


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header; single is for small tables that must be one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def stacked(frames: list[DataFrame]) -> DataFrame:
    """All rows; the columns are those of all frames in the order in which they are first seen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def config(spark: SparkSession, path: str) -> dict:
    """A mapping from a JSON or YAML file of any file system; anything else is an error."""
    text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        value = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path} is no JSON, and no YAML reader is installed") from e
        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path} holds no mapping")
    return value


def case_key(*columns: str, suffix: str = "_full_audit") -> Column:
    """The first of the columns that is there, without the suffix of a task and what follows it."""
    return F.substring_index(F.coalesce(*columns), suffix, 1)


def answer_text(rows: DataFrame) -> Column:
    """The true answer as JSON, wherever an older row has it: answer, ground_truth.output, output, or the last message; an error if nowhere."""
    def json_of(c: Column, kind: str) -> Column:
        return c if kind == "string" else F.to_json(c, {"ignoreNullFields": "false"})

    kinds = dict(rows.dtypes)
    parts = [json_of(F.col("answer"), kinds["answer"])] if "answer" in kinds else []
    if "ground_truth" in kinds and "output" in rows.schema["ground_truth"].dataType.names:
        parts.append(json_of(F.col("ground_truth.output"), rows.schema["ground_truth"].dataType["output"].dataType.simpleString()))
    if "output" in kinds:
        parts.append(json_of(F.col("output"), kinds["output"]))
    if "messages" in kinds:
        parts.append(F.try_element_at("messages", F.lit(-1))["content"])
    return F.coalesce(*parts, F.raise_error(F.lit("no answer in the row")))
