"""Files: listings, digests, summaries, manifests, and checks of model archives against their manifest."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranged import chunks

#: A header of more bytes is taken for a wrong size.
MOST_HEADER = 256 << 20


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length")


def _each(files: DataFrame, use, columns: str) -> DataFrame:
    """use(path, length) of each file, which gives the values of columns; files are dealt out by size, large and small ones mixed."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length in zip(b["path"].to_pylist(), b["length"].to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([dict(zip(names, (path, *use(path, length)), strict=True))])

    n = max(1, min(files.count(), files.sparkSession.sparkContext.defaultParallelism * 4))
    return files.select("path", "length").repartition(n, F.xxhash64("path")).mapInArrow(run, columns)


def _digest(path: str, length: int) -> tuple[int, str]:
    sha = hashlib.sha256()
    for c in chunks(path):
        sha.update(c)
    return length, sha.hexdigest()


def digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length, sha256 of the files under a folder. A file is read in chunks within one task, so it may be larger than an executor's memory."""
    return _each(listing(spark, folder, pattern), _digest, "path string, length long, sha256 string")


def row_summary(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row: how many rows, and the first and last key by the given order."""
    at = F.struct(*order)
    return rows.agg(F.count("*").alias("rows"), F.min_by(key, at).alias("first"), F.max_by(key, at).alias("last"))


def write_manifest(spark: SparkSession, path: str, payload: dict) -> None:
    """A small JSON file: written beside its place and renamed over the old one, which is there until then."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    place, beside = fs_path(path), fs_path(f"{path}.tmp")
    fs = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    out = fs.create(beside, True)
    try:
        out.write(bytearray((json.dumps(payload, ensure_ascii=False, indent=2) + "\n").encode()))
    finally:
        out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    where = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    where.rename(beside, place, over)


def _header_error(path: str, length: int) -> tuple[str | None, int]:
    """What is wrong with the start of a weights file, eight bytes of a size, then a JSON object of that size; and how many bytes were read."""
    head = b"".join(chunks(path, 0, 8))
    if len(head) < 8:
        return "missing_header_size", len(head)
    size = struct.unpack("<Q", head)[0]
    if not 0 < size <= min(length - 8, MOST_HEADER):
        return "invalid_header_size", 8
    try:
        header = json.loads(b"".join(chunks(path, 8, 8 + size)).decode())
    except ValueError:
        return "invalid_header", 8 + size
    return None if isinstance(header, dict) and header else "empty_header", 8 + size


def header_errors(files: DataFrame) -> DataFrame:
    """path, error (null if none), bytes_read of weights files (path, length): only their headers are read, and none of over MOST_HEADER bytes."""
    return _each(files, _header_error, "path string, error string, bytes_read long")


def lineage_audit(models: DataFrame, files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """model_id, status of a manifest (model_id, parent_model_id, config, weights, archive: paths; their expected hashes and size) against files (path, length, sha256).

    The last finding counts: LOCAL_MISSING, HASH_MISMATCH, SIZE_MISMATCH, INVALID_WEIGHTS, ARCHIVE_MISSING, ARCHIVE_HASH_MISMATCH; INVALID_LINEAGE
    for an unknown parent unless a later one; else VERIFIED.
    """
    f = lambda name: files.select(F.col("path").alias(f"{name}_path"), F.col("length").alias(f"{name}_length"), F.col("sha256").alias(f"{name}_found"))
    x = models
    for name in ("config", "weights", "archive"):
        x = x.join(f(name), F.col(name) == F.col(f"{name}_path"), "left")
    parents = models.select(F.col("model_id").alias("_parent")).distinct()
    x = x.join(parents, F.col("parent_model_id") == F.col("_parent"), "left")
    if errors is not None:
        x = x.join(errors.select(F.col("path").alias("_weights"), F.col("error").alias("_error")), F.col("weights") == F.col("_weights"), "left")
    else:
        x = x.withColumn("_error", F.lit(None).cast("string"))
    missing = F.col("config_path").isNull() | F.col("weights_path").isNull()
    wrong = (F.col("config_found") != F.col("config_sha256")) | (F.col("weights_found") != F.col("weights_sha256"))
    archived = F.col("archive").isNotNull() & F.col("archive_sha256").isNotNull()
    status = (
        F.when(missing, "LOCAL_MISSING").when(archived & F.col("archive_path").isNull(), "ARCHIVE_MISSING").when(archived & (F.col("archive_found") != F.col("archive_sha256")), "ARCHIVE_HASH_MISMATCH")
        .when(F.col("_error").isNotNull(), "INVALID_WEIGHTS").when(F.col("weights_length") != F.col("weights_bytes"), "SIZE_MISMATCH").when(wrong, "HASH_MISMATCH")
        .when(F.col("parent_model_id").isNotNull() & F.col("_parent").isNull(), "INVALID_LINEAGE").otherwise("VERIFIED")
    )
    return x.select("model_id", status.alias("status"))
