"""Joins in which an absent key is an error that names it, raised where the row is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_all(rows: DataFrame, others: dict[str, DataFrame], key: str) -> DataFrame:
    """rows with a struct column for each of the others (one row for each key), by key; a key of rows that one of them lacks is an error.

    Others may have more keys. A null key is an error like any other. Each other is shuffled once by key, rows stay as they are dealt after the first.
    """
    def add(df: DataFrame, item: tuple[str, DataFrame]) -> DataFrame:
        name, other = item
        right = other.select(F.col(key).alias("_key"), F.struct(*(c for c in other.columns if c != key)).alias("_value"))
        absent = F.raise_error(F.concat(F.lit(f"{name} lacks {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
        joined = df.join(right, F.col(key) == F.col("_key"), "left")
        return joined.withColumn(name, F.when(F.col("_key").isNull(), absent).otherwise(F.col("_value"))).drop("_key", "_value")

    return reduce(add, others.items(), rows)


def in_manifest_order(manifest: DataFrame, cases: DataFrame, key: str, index: str = "sample_index", by: list[str] | None = None) -> DataFrame:
    """The cases that a manifest lists, with the manifest's columns, in the order of its index within each group of `by`; a listed case that is not there is an error."""
    own = [c for c in cases.columns if c not in manifest.columns]
    found = with_all(manifest, {"_case": cases.select(key, *own)}, key)
    return found.select(*manifest.columns, *(F.col(f"_case.{c}").alias(c) for c in own)).orderBy(*(by or []), index)
