"""Stored tables: read back as they were, in the configured folder, gone after release()."""

import os

import pytest

from claimlens.operators import storing


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storing, "scratch_root", lambda session: f"file://{tmp_path}")
    monkeypatch.setattr(storing, "_WRITTEN", [])
    return tmp_path


def test_stored_tables_are_whole_and_released(spark, folder):
    df = spark.createDataFrame([(1, "a", [1, 2]), (None, None, None), (1, "a", [1, 2])], "id long, name string, v array<int>")
    out = storing.stored(df)
    empty = storing.stored(df.where("id = 7"))
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert out.schema == df.schema and empty.schema == df.schema and empty.count() == 0
    assert len(os.listdir(folder)) == 2
    storing.release(spark)
    assert os.listdir(folder) == []
    storing.release(spark)


def test_the_folder_is_the_configured_one_or_the_same_own_one(spark, monkeypatch):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    monkeypatch.setattr(storing, "_OWN", {})
    root = storing.scratch_root(spark)
    assert root == (configured.rstrip("/") if configured else storing._OWN[spark.sparkContext.applicationId])
    assert storing.scratch_root(spark) == root
