"""Byte ranges of JSON lines, one-file writes, followed folders, and files larger than memory."""

import hashlib
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from claimlens.sources import files, jsonl, strict_lines
from claimlens.streaming import progress


def test_each_line_is_read_by_one_range_wherever_the_cuts_are(tmp_path):
    rng = random.Random(1)
    lines = [b"" if rng.random() < 0.2 else b"x" * rng.randint(1, 30) + str(k).encode() for k in range(60)]
    for end in (b"", b"\n"):
        path = tmp_path / f"f{len(end)}"
        path.write_bytes(b"\n".join(lines) + end)
        size = path.stat().st_size
        for split in (1, 2, 3, 7, 20, 64, 500, 10**6):
            for chunk in (1, 5, 16, 1 << 20):
                got = [x for r in strict_lines.ranges(str(path), 0, size, split) for x in strict_lines.lines_of(r, chunk)]
                assert b"".join(run for _, run in got) == path.read_bytes()
                assert all(path.read_bytes()[at : at + len(run)] == run for at, run in got)


def write_lines(path, n, bad=None):
    path.write_text("".join("\n" if k % 7 == 3 else ('{"a": "no number"}\n' if k == bad else json.dumps({"a": k, "b": {"c": ["é", None]}, "more": 1}) + "\n") for k in range(n)), encoding="utf-8")


SCHEMA = "a long, b struct<c:array<string>>"


def test_strict_scan_in_ranges(spark, tmp_path):
    write_lines(tmp_path / "one.jsonl", 500)
    rows = jsonl.read_strict(spark, f"file://{tmp_path}/one.jsonl", SCHEMA, split=300)
    assert rows.rdd.getNumPartitions() > 20
    assert sorted(r.a for r in rows.collect()) == [k for k in range(500) if k % 7 != 3] and rows.first().b.c == ["é", None]
    write_lines(tmp_path / "two.jsonl", 500, bad=400)
    with pytest.raises(Exception, match=r"two\.jsonl:401: no object of the schema"):
        jsonl.read_strict(spark, f"file://{tmp_path}/*.jsonl", SCHEMA, split=300).collect()
    for text in ('{"a":1}{"a":2}\n', "null\n", "[]\n", '{"a":1\n}\n'):
        (tmp_path / "three.txt").write_text('{"a":0}\n' + text)
        with pytest.raises(Exception, match=r"three\.txt:2:"):
            jsonl.read_strict(spark, f"file://{tmp_path}/three.txt", SCHEMA).collect()
    (tmp_path / "empty.txt").write_text("")
    assert jsonl.read_strict(spark, f"file://{tmp_path}/empty.txt", SCHEMA).count() == 0
    with pytest.raises(Exception, match="none.jsonl"):
        jsonl.read_strict(spark, f"file://{tmp_path}/none.jsonl", SCHEMA).collect()


def test_one_file_is_there_whole_or_as_it_was(spark, tmp_path):
    path = tmp_path / "out.jsonl"
    jsonl.write_one(spark.range(100).repartition(5).select("id", F.lit(None).cast("string").alias("x")), f"file://{path}")
    assert sorted(json.loads(x)["id"] for x in path.read_text().splitlines()) == list(range(100)) and '"x":null' in path.read_text()
    before = path.read_text()
    with pytest.raises(Exception, match="no more"):
        jsonl.write_one(spark.range(100).repartition(5).select(F.when(F.col("id") == 70, F.raise_error(F.lit("no more"))).otherwise(F.col("id")).alias("id")), f"file://{path}")
    assert path.read_text() == before
    jsonl.write_one(spark.range(3), f"file://{path}")
    assert sorted(path.read_text().splitlines()) == ['{"id":0}', '{"id":1}', '{"id":2}'] and [f for f in os.listdir(tmp_path) if f[0] != "."] == ["out.jsonl"]
    with pytest.raises(Exception, match="overwrite"):
        spark.range(3).write.format("strict_jsonl").mode("append").save(f"file://{path}")


def test_followed_files_grow_and_restarts_repeat_nothing(spark, tmp_path):
    folder, got = tmp_path / "in", []
    folder.mkdir()

    def run():
        q = progress.followed(spark, f"file://{folder}", "a long", split=64).writeStream.foreachBatch(lambda df, _: got.extend(r.a for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()

    (folder / "x.jsonl").write_text("".join(f'{{"a":{k}}}\n' for k in range(50)) + '{"a":5')
    run()
    assert sorted(got) == list(range(50))
    with (folder / "x.jsonl").open("a") as f:
        f.write('0}\n{"a":51}\n')
    (folder / "y.jsonl").write_text('{"a":52}\n')
    run()
    assert sorted(got) == list(range(53))
    run()
    assert len(got) == 53


def test_files_larger_than_one_value_can_be(spark, tmp_path):
    """A sparse file of over 2 GB, more than a binary value holds, is digested; of a weights file only the header is read."""
    head = json.dumps({"w": {"shape": [1]}}).encode()
    size = (2 << 30) + 12345
    with (tmp_path / "large.bin").open("wb") as f:
        f.write(struct.pack("<Q", len(head)) + head)
        f.truncate(size)
    listing = files.listing(spark, f"file://{tmp_path}", "*.bin")
    got = files.header_errors(listing).collect()
    assert [(r.error, r.bytes_read) for r in got] == [(None, 8 + len(head))]
    sha = hashlib.sha256(struct.pack("<Q", len(head)) + head)
    left, zeros = size - 8 - len(head), bytes(1 << 24)
    while left:
        sha.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    assert [(r.length, r.sha256) for r in files.digests(spark, f"file://{tmp_path}", "*.bin").collect()] == [(size, sha.hexdigest())]


def test_headers(spark, tmp_path):
    cases = {"a": (b"short", "missing_header_size"), "b": (struct.pack("<Q", 900) + b"{}", "invalid_header_size"), "c": (struct.pack("<Q", 2) + b"[}", "invalid_header"), "d e%41ü": (struct.pack("<Q", 2) + b"{}", "empty_header"), "f": (struct.pack("<Q", 1 << 60) + b"x" * 40, "invalid_header_size")}
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.error for r in files.header_errors(files.listing(spark, f"file://{tmp_path}")).collect()}
    assert got == {name: error for name, (_, error) in cases.items()}
