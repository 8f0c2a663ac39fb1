"""Progress events: throughput in windows, sessions, de-duplication; batch or streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.strict_lines import StrictJsonl

LATE = "1 hour"


def event_time(events: DataFrame, late: str = LATE) -> DataFrame:
    """events with ts as TIMESTAMP (watermarks reject TIMESTAMP_NTZ), and a watermark if it streams."""
    out = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return out.withWatermark("ts", late) if events.isStreaming else out


def throughput(events: DataFrame, size: str = "1 day") -> DataFrame:
    """start, event_type, n, total: counts in tumbling windows."""
    g = event_time(events).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n: runs of a user's events that are less than gap apart."""
    g = event_time(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def first_per_key(events: DataFrame, key: str = "event_id") -> DataFrame:
    """One event per key: within the watermark if it streams, the earliest one otherwise."""
    if events.isStreaming:
        return event_time(events).dropDuplicatesWithinWatermark([key])
    rest = [c for c in events.columns if c not in (key, "ts")]
    first = event_time(events).groupBy(key).agg(F.min(F.struct("ts", *rest)).alias("_v"))  # summed up before anything is sent, so no key is hot
    return first.select(*(key if c == key else F.col(f"_v.{c}").alias(c) for c in events.columns))


def running_metrics(records: DataFrame, late: str = LATE) -> DataFrame:
    """stage, n, last_step, mean_loss of training records (ts, stage, global_step, loss): the state so far of each stage, batch or stream."""
    return event_time(records, late).groupBy("stage").agg(F.count("*").alias("n"), F.max("global_step").alias("last_step"), F.avg("loss").alias("mean_loss"))


def flushed(events: DataFrame, path: str, checkpoint: str, each: str = "10 seconds", once: bool = False, key: str | None = None):
    """Writes a stream's rows as files at each interval, or all that is there once; a restart goes on where it stopped and a key is written once."""
    rows = first_per_key(events, key) if key else events
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=each)).start()


def watched(spark, folder: str, schema, pattern: str = "*.json") -> DataFrame:
    """A stream of the JSON lines of files as they appear in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).json(folder)


def followed(spark, path: str, schema, split: int | None = None) -> DataFrame:
    """A stream of the JSON lines of files as they appear and grow; a bad line is an error that names it. A restart goes on behind the last line that was read."""
    spark.dataSource.register(StrictJsonl)
    reader = spark.readStream.format("strict_jsonl").schema(schema)
    return (reader.option("split", str(split)) if split else reader).load(path)
