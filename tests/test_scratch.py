"""Intermediate tables: shared where equal, gone at the end of their scope or session."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cartwheel.plans import reports
from cartwheel.scratch import scratch_path, scratch_scope, shared_table
from cartwheel.session import checkpoint_dir
from cartwheel.sources.testviews import shop_tables

SF = "/root/testdata/sf0.001"


def _local(path):
    return path.removeprefix("file:")


def _files(df):
    return {f.rsplit("/", 1)[0] for f in df.inputFiles()}


def test_scope_removes_its_tables_on_success_and_on_failure(spark):
    with scratch_scope(spark):
        outer = scratch_path(spark, "outer")
        spark.range(3).write.parquet(outer)
        with pytest.raises(KeyError), scratch_scope(spark):
            inner = scratch_path(spark, "inner")
            spark.range(3).write.parquet(inner)
            raise KeyError
        assert not os.path.exists(_local(inner)) and os.path.exists(_local(outer))
    assert not os.path.exists(_local(outer))


def test_equal_frames_share_one_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)

    def read():
        return spark.read.parquet(path).where("id > 3")

    with scratch_scope(spark):
        first = shared_table(read(), "t")
        assert _files(shared_table(read(), "t")) == _files(first)
        with scratch_scope(spark):
            assert _files(shared_table(read(), "t")) == _files(first)
        assert _files(shared_table(read().where("id < 9"), "t")) != _files(first)
        assert _files(shared_table(read(), "another")) != _files(first)
        spark.range(20).write.mode("overwrite").parquet(path)  # other files: stored anew
        again = shared_table(read(), "t")
        assert _files(again) != _files(first) and again.count() == 16
    with scratch_scope(spark):
        assert _files(shared_table(read(), "t")) != _files(again)


def test_what_is_not_deterministic_is_not_shared(spark):
    with scratch_scope(spark):
        rows = spark.range(5).select(F.rand().alias("x"))
        assert _files(shared_table(rows, "r")) != _files(shared_table(rows, "r"))


def test_funnel_statements_share_their_tables(spark):
    with scratch_scope(spark):
        t = shop_tables(spark, SF)
        views = _files(reports.funnel_pageviews(t))
        flags = _files(reports.funnel_sessions(t))
        assert len(flags) == 1 and len(views) == 2  # chosen sessions and their views
        assert _files(reports.funnel_counts(t)) == _files(reports.funnel_click_rates(t)) == flags
        assert _files(reports.funnel_pageviews(shop_tables(spark, SF))) == views


PROBE = """
import os, sys
from cartwheel.session import build_session
from __spark_entry__ import queries
spark = build_session("local[2]", shuffle_partitions=2, conf={"spark.checkpoint.dir": sys.argv[1], "spark.ui.enabled": "false"})
for name in ("funnel_counts", "csv_roundtrip", "impute_mode", "drop_duplicates"):
    queries()[name](spark, "/root/testdata/sf0.001").count()
print("held", sum(len(f) for _, _, f in os.walk(sys.argv[1])) > 0)
if sys.argv[2] == "stop":
    spark.stop()
    print("left", sum(len(f) for _, _, f in os.walk(sys.argv[1])))
"""


@pytest.mark.parametrize("end", ["stop", "leave"])
def test_nothing_outlives_the_session(tmp_path, end):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", PROBE, str(tmp_path), end], cwd=root, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "held True" in out.stdout and ("left 0" in out.stdout) == (end == "stop")
    assert [f for _, _, f in os.walk(tmp_path) if f] == []


def test_checkpoint_folder_is_the_sessions_own(spark):
    assert scratch_path(spark, "x").startswith(checkpoint_dir(spark).rstrip("/"))
