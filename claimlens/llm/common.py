"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word separators of every contract (space and U+0009 to U+000D).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one Arrow batch; texts reach 100 kB and more, so batches are short.
ARROW_ROWS = 256


def text_of(col: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """array<string> of the maximal runs outside SPACES; empty for a blank text."""
    bare = trimmed(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, use) -> Column:
    """use(value) with value computed once per row, however often use() names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: Folders of applications for which spark.checkpoint.dir is unset; a running session does not let it be set.
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app in _OWN:
        return _OWN[app]
    if spark.sparkContext.master.startswith("local"):
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
    else:
        _OWN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _OWN[app]


#: Lists that note what stored() writes, innermost last; each thread has its own.
_NOTES: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("notes", default=())


def stored(df: DataFrame, tidy: bool = False) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage.

    With tidy, the driver's JVM is asked to collect its garbage once it is written, upon which Spark deletes the shuffle files of
    plans that nothing refers to any more; files of running jobs and of other threads stay.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if tidy:
        spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for note in _NOTES.get():
        note.append(out)
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Delete what stored() wrote, once no later result needs it."""
    for df in frames:
        if path := getattr(df, "_scratch_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that this thread stores within the block, in a list of the caller's own: drop_stored() of those deletes nobody else's.

    The caller decides what to delete, as results are lazy and read their tables after the block.
    """
    made: list[DataFrame] = []
    mark = _NOTES.set((*_NOTES.get(), made))
    try:
        yield made
    finally:
        _NOTES.reset(mark)


def short(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of few rows, whatever the session sends; nothing is copied. Spark bounds the bytes of a batch."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


@contextmanager
def rows_of_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, Spark sends at most so many rows to Python at once: for rows of megabytes, of which its own limit would buffer many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of a key that may meet in one task; a key of more is dealt to several places.
HOT_ROWS = 10_000
#: Keys are known to be hot by one of so many hash buckets, which bounds what is broadcast whatever the number of hot keys.
BUCKETS = 1 << 16


def with_counted(rows: DataFrame, table: DataFrame, on: list[str], n: str = "n", least: int | None = None) -> DataFrame:
    """rows joined with table (one row for each key, and n, how many rows have it) on columns of both, without a hot task.

    A key of more than HOT_ROWS rows (or `least`) has a copy of its row of table for each so many, and its rows are dealt to the copies by
    their own hash. Which keys these are is told by hash bucket: at most BUCKETS numbers are broadcast, for any number of hot keys; other
    keys of such a bucket are copied as well, which costs some rows and changes nothing. The result is that of the plain inner
    join. table is read twice, so it should be stored; keys are never null.
    """
    most = max(1, HOT_ROWS if least is None else least)
    more = [c for c in table.columns if c not in on]
    bucket = lambda cols: F.pmod(F.xxhash64(*cols), F.lit(BUCKETS))
    hot = F.broadcast(table.where(F.col(n) > most).groupBy(bucket(on).alias("_hot")).agg(F.ceil(F.max(n) / most).cast("int").alias("_places")))
    places = F.coalesce("_places", F.lit(1))
    x = rows.withColumn("_bucket", bucket(on)).join(hot, F.col("_bucket") == F.col("_hot"), "left")
    x = x.select(*rows.columns, F.pmod(F.xxhash64(*rows.columns, F.lit(1)), places).cast("int").alias("_place"))
    y = table.withColumn("_bucket", bucket(on)).join(hot, F.col("_bucket") == F.col("_hot"), "left")
    y = y.select(*(F.col(c).alias(f"_all_{c}") for c in table.columns), F.explode(F.sequence(F.lit(0), places - 1)).alias("_all_place"))
    same = reduce(lambda p, q: p & q, (F.col(c) == F.col(f"_all_{c}") for c in on), F.col("_place") == F.col("_all_place"))
    return x.join(y, same).select(*rows.columns, *(F.col(f"_all_{c}").alias(c) for c in more))


def repeated(df: DataFrame, copies: str, each: int = 1000) -> DataFrame:
    """Each row as often as its column copies says, without that column; made by thousands, so no row carries an array of all its copies."""
    whole = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / each))))
    return whole.withColumn("_j", F.explode(F.sequence(F.lit(1), F.least(F.lit(each), F.col(copies) - F.col("_k") * each)))).drop("_k", "_j", copies)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
