"""Training logs: JSON records among other lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(lines: DataFrame, schema: str, stages: list[str], column: str = "value") -> DataFrame:
    """The records of the stages: lines that begin with a brace, are whole objects, and name one of the stages."""
    whole = lines.where(F.startswith(F.col(column), F.lit("{")) & F.rtrim(F.col(column)).endswith("}"))
    parsed = whole.select(F.from_json(F.col(column), schema).alias("r")).select("r.*")
    return parsed.where(F.col("stage").isin(stages))


def read(spark: SparkSession, path: str, schema: str, stages: list[str]) -> DataFrame:
    """As records, of text files; without any record the scan is an error when it is read."""
    return records(spark.read.text(path), schema, stages)
