"""Final holdouts: complete images, stratified manifests, draws by turns, development sets, overlaps and digests of ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import equal_quotas, round_robin, spread_over_two, stratified

HARD_SPLIT = "test_hard_negative"
#: Digits by which id_digest deals ids out; part of what its digests mean.
HEAD = 3


def first_images(records: DataFrame) -> DataFrame:
    """case_id, image_id, doc_type, image_path: the first record of each image, by its place."""
    return records.groupBy("case_id", "image_id").agg(F.min_by(F.struct("doc_type", "image_path"), "place").alias("_v")).select("case_id", "image_id", "_v.*")


def image_status(cases: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """case_id, image_count, missing_doc_types, missing_paths, complete of cases (case_id, documents): what they should have, and what is there.

    records: case_id, image_id, doc_type, image_path, place; files: path.
    """
    images = first_images(records).join(files.select(F.col("path").alias("image_path"), F.lit(True).alias("_there")).distinct(), "image_path", "left")
    own = images.groupBy("case_id").agg(
        F.count("*").alias("image_count"), F.collect_set("doc_type").alias("_types"), F.sort_array(F.collect_set(F.when(F.col("_there").isNull(), F.col("image_path")))).alias("missing_paths"))
    none = F.array().cast("array<string>")
    x = cases.select("case_id", "documents").join(own, "case_id", "left").withColumns({
        "image_count": F.coalesce("image_count", F.lit(0).cast("bigint")), "missing_paths": F.coalesce("missing_paths", none), "missing_doc_types": F.array_sort(F.array_except("documents", F.coalesce("_types", none)))})
    return x.select("case_id", "image_count", "missing_doc_types", "missing_paths", ((F.size("missing_doc_types") == 0) & (F.size("missing_paths") == 0) & (F.col("image_count") > 0)).alias("complete"))


def split_key(anomalies: str | Column = "anomaly_types") -> Column:
    """The anomalies of a claim as one text, sorted."""
    return F.array_join(F.array_sort(anomalies), ",")


def stratified_manifest(rows: DataFrame, n: int, salt: int | str, order: str = "id") -> DataFrame:
    """sample_index, split, case_id, label, risk_level, audit_result: n rows of each split, evenly over its labels, and within
    a label in proportion to risk and result; numbered in the rows' own order. The hard split leaves out what has no anomaly.
    """
    pool = rows.where(~((F.col("split") == HARD_SPLIT) & (F.col("label") == "none")))
    groups = equal_quotas(pool.groupBy("split", "label").agg(F.count("*").alias("_size")), ["split"], "label", n, "_quota_of_label")
    with_quota = pool.join(F.broadcast(groups.select("split", "label", "_quota_of_label")), ["split", "label"])
    picked = stratified(with_quota, "case_id", ["risk_level", "audit_result"], "_quota_of_label", salt, ["split", "label"])
    index = F.row_number().over(Window.partitionBy("split").orderBy(order)) - 1
    return picked.select(index.alias("sample_index"), "split", "case_id", "label", "risk_level", "audit_result")


def final_holdout(candidates: DataFrame, used: DataFrame, n: int, salt: int | str, strata: list[str]) -> DataFrame:
    """n unused cases of each split, drawn by turns from its strata; all splits in one plan."""
    fresh = candidates.join(used.select("case_id").distinct(), "case_id", "left_anti")
    return round_robin(fresh, "case_id", strata, n, salt, within=["split"])


def validation_target(complete: int) -> int:
    """How many cases each development set gets from so many complete ones; 0 if there are too few."""
    return 800 if complete >= 1600 else 500 if complete >= 1000 else 0 if complete < 600 else complete // 2


def validation_quotas(sizes: dict[str, int], target: int) -> dict[str, int]:
    """Two thirds from the first split, the rest from the second, none over half of its own, filled in order."""
    (a, na), (b, nb) = sizes.items()
    share = round(target * 2 / 3)
    out = {a: min(na // 2, share), b: min(nb // 2, target - share)}
    for k in (a, b):
        out[k] += min(max(0, target - sum(out.values())), sizes[k] // 2 - out[k])
    return out


def development_sets(cases: DataFrame, quotas: dict[str, int], strata: list[str], salt: int | str) -> DataFrame:
    """case_id, split, part (1 or 2): two disjoint sets of each split's quota, drawn by turns from its strata."""
    out = None
    for split, quota in quotas.items():
        part = spread_over_two(cases.where(F.col("split") == split), "case_id", strata, quota, salt).select("case_id", "split", "part")
        out = part if out is None else out.unionByName(part)
    return out


def id_digest(ids: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """by, n, digest: distinct ids of each group and a digest that does not depend on their order or on partitions.

    The ids (UTF-8, each with a line feed) are dealt to buckets by the first HEAD digits of their SHA-256 in hex; a bucket's digest is
    the SHA-256 of its ids in order, and the group's that of its buckets' digests, each as 'head digest' and a line feed, in order.
    No group is one array: only the bucket digests of a group come together.
    """
    head = F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, HEAD)
    each = ids.select(*by, F.col(id_col).cast("string").alias("_id"), head.alias("_head")).where("_id is not null").distinct()
    parts = each.groupBy(*by, "_head").agg(F.count("*").alias("_n"), F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list("_id")), "\n"), F.lit("\n")), 256).alias("_digest"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_head", "_digest"))), lambda x: F.concat(x["_head"], F.lit(" "), x["_digest"], F.lit("\n"))), "")
    return parts.groupBy(*by).agg(F.sum("_n").alias("n"), F.sha2(lines, 256).alias("digest"))


def registry_digest(ids: DataFrame, by: list[str], id_col: str = "id") -> DataFrame:
    """by, n, digest: distinct ids of each group and the SHA-256 of the sorted ids, each with a line feed.

    Ids are sorted where they arrive (spilling if need be) and hashed as a stream, as a SHA-256 can only be made in order: a task holds a batch of a
    group, never the group. For groups that one task should not read, id_digest is made in parallel. Null ids are left out.
    """
    rows = ids.select(*(F.col(c).cast("string").alias(c) for c in by), F.col(id_col).cast("string").alias("_id")).where("_id is not null").distinct()
    order = [F.asc_nulls_first(c) for c in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, sha = None, 0, hashlib.sha256()
        done = lambda: pa.RecordBatch.from_pylist([dict(zip(by, group, strict=True)) | {"n": n, "digest": sha.hexdigest()}], schema=pa.schema([*((c, pa.string()) for c in by), ("n", pa.int64()), ("digest", pa.string())]))
        for b in batches:
            for *own, x in zip(*(b[c].to_pylist() for c in (*by, "_id")), strict=True):
                if own != group:
                    if n:
                        yield done()
                    group, n, sha = own, 0, hashlib.sha256()
                n += 1
                sha.update(f"{x}\n".encode())
        if n:
            yield done()

    return rows.repartition(*by).sortWithinPartitions(*order, "_id").mapInArrow(run, ", ".join([*(f"{c} string" for c in by), "n long", "digest string"]))


def overlap_counts(sets: dict[str, DataFrame], pairs: list[tuple[str, str]], key: str = "case_id") -> DataFrame:
    """pair, n: ids that two named sets share, 0 included."""
    long = None
    for name, df in sets.items():
        part = df.select(F.lit(name).alias("name"), key).distinct()
        long = part if long is None else long.unionByName(part)
    held_by = long.groupBy(key).agg(F.collect_set("name").alias("names")).where(F.size("names") > 1)
    both = held_by.agg(*(F.count_if(F.array_contains("names", a) & F.array_contains("names", b)).alias(f"{a}_vs_{b}") for a, b in pairs))
    return both.select(F.inline(F.array(*(F.struct(F.lit(c).alias("pair"), F.col(c).alias("n")) for c in both.columns))))
