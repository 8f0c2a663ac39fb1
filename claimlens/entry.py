"""The queries of the audit engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import claims as C
from .sql import CLAIMS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{CLAIMS} SELECT label, risk_level, audit_result, count(*) AS n_cases FROM claims GROUP BY ALL")
def risk_label_summary(spark, sf_dir):
    """How many claims fall in each cell of anomaly, risk level and audit result."""
    return C.claims(spark, sf_dir).groupBy("label", "risk_level", "audit_result").agg(F.count("*").alias("n_cases"))


from . import queries_checks, queries_data, queries_eval, queries_ops, queries_pairs  # noqa: E402, F401  (they register their queries)
