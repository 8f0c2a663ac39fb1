"""JSON lines: strict scan, scan if there, sink; all through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .strict_lines import StrictJsonl


def read(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a JSONL file or glob; a line that is no object of the schema fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def invalid_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """file, line (from 1), text of the lines that are no object of the schema; blank lines are no lines.

    A line's number is how many lines its file has before it. A file may be read in several blocks: lines are counted by block,
    which is one small row each, and numbered within their block by their order there.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    fields = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = F.from_json("value", f"{fields}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    bad = (F.trim("value") != "") & (~F.startswith(F.trim("value"), F.lit("{")) | parsed["_bad"].isNotNull())
    sizes = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return lines.where(bad).join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("place") - F.col("first") + 1).alias("line"), F.col("value").alias("text"))


def read_strict(spark: SparkSession, path: str, schema: StructType | str, keep: bool = False, split: int | None = None) -> DataFrame:
    """As read, in one scan, but a bad line is an error that names its file and number, when the rows are read. keep persists the rows for several uses.

    split: bytes that a task reads at most.
    """
    spark.dataSource.register(StrictJsonl)
    reader = spark.read.format("strict_jsonl").schema(schema)
    out = (reader.option("split", str(split)) if split else reader).load(path)
    return out.persist() if keep else out


def read_first(spark: SparkSession, path: str, schema: StructType | str, n: int, *order: str) -> DataFrame:
    """The first n rows by the given order, as files have none of their own."""
    return read(spark, path, schema).orderBy(*order).limit(n)


def read_shards(spark: SparkSession, folder: str, schema: StructType | str, key: str, shards: str = "rollouts.shard-*.jsonl", whole: str = "rollouts.jsonl") -> DataFrame:
    """The rows of all shards in a folder, or of the one whole file if there are none; a key in two rows is an error, so is no row at all."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{shards}")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    rows = read(spark, f"{folder}/{shards}" if found else f"{folder}/{whole}", schema)
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"), F.count("*").alias("keys")).first()
    if twice["twice"] or not twice["keys"]:
        raise ValueError(f"{folder}: {twice['twice']} keys are there twice, {twice['keys']} in all")
    return rows


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def read_if_there(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """As read; a missing file is an empty table."""
    return read(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def write_one(df: DataFrame, path: str) -> None:
    """One file with one object per line, nulls kept, that takes the place of the old one at once or not at all."""
    df.sparkSession.dataSource.register(StrictJsonl)
    df.write.format("strict_jsonl").mode("overwrite").save(path)


def write(df: DataFrame, path: str, append: bool = False) -> None:
    """One object per line, nulls kept."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def encoded(*columns: str):
    """A row as compact JSON, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def harvest_ids(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, id: distinct matches of pattern in each text file under path."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    ids = F.explode(F.regexp_extract_all("value", F.lit(f"({pattern})"), F.lit(1)))
    return text.select(F.input_file_name().alias("file"), ids.alias("id")).distinct()
