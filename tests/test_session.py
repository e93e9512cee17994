"""Session helpers: shared scratch folder and cluster sizing."""

from __future__ import annotations

from souk.session import cluster_conf, ensure_checkpoint_dir, scratch_path


def test_scratch_paths_live_under_the_checkpoint_dir_and_are_unique(spark):
    base = ensure_checkpoint_dir(spark)
    assert base == spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(base.rstrip("/")) and b.startswith(base.rstrip("/"))


def test_checkpoint_dir_is_read_not_overwritten(spark):
    before = spark.conf.get("spark.checkpoint.dir")
    assert ensure_checkpoint_dir(spark) == before


def test_cluster_conf_scales_with_input():
    small = cluster_conf(10 * 1024 ** 2, cores=8)
    big = cluster_conf(100 * 1024 ** 4, cores=8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 16
    assert int(big["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 ** 2)
