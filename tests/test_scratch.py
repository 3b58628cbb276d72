"""Stored tables and their removal, in a folder of the test's own."""

import pytest

from ripplework.functions import scratch


def test_stored_and_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "own_folder", lambda _: f"file://{tmp_path}/app")
    held = scratch.stored(spark.range(5).toDF("id"))
    assert held.count() == 5 and list((tmp_path / "app").iterdir())
    scratch.clear(spark)
    assert not (tmp_path / "app").exists()
    with pytest.raises(Exception, match="(?i)exist"):
        held.collect()


def test_folder_of_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch.shared_folder(spark) == (named.rstrip("/") if named else scratch.shared_folder(spark))
    assert spark.sparkContext.applicationId in scratch.own_folder(spark)
