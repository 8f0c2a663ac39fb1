"""Bounded samples of labelled documents, for training on the driver."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; rows without a doc_id count as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def sample(documents: DataFrame, labels: DataFrame, label: str, held_out, most: int, balanced: bool = False) -> pd.DataFrame:
    """text, label, weight of at most `most` labelled documents that held_out leaves in, by a hash of doc_id.

    The ids are chosen from the labels alone, so only their documents' texts move. Of repeated labels
    the largest counts, of several texts of one doc_id that with the smallest hash; rows with a null label or doc_id are left out.
    balanced takes up to half from each label; weights then give each label the share that it has among all labels.
    """
    held = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    if balanced:
        ids = held.where("label = 1").orderBy(*order).limit(most // 2).unionByName(held.where("label = 0").orderBy(*order).limit(most - most // 2))
    else:
        ids = held.orderBy(*order).limit(most)
    rows = documents.select(F.col("doc_id").cast("long").alias("_id"), text_of("text").alias("text")).join(F.broadcast(ids), "_id")
    out = rows.groupBy("_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).toPandas().sort_values("_id", ignore_index=True)
    out["weight"] = 1.0
    if balanced:
        n = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect() if r["label"] in (0, 1)}
        for k, whole in n.items():
            some = out["label"] == k
            out.loc[some, "weight"] = (whole / sum(n.values())) / max(some.mean(), 1e-9)
    return out[["text", "label", "weight"]]
