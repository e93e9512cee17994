"""SparkSession defaults and the shared scratch location.

Everything in the library is written against the DataFrame API and does not
depend on the session time zone: text dates are parsed into
``TIMESTAMP_NTZ`` (wall-clock time, as the source text means it), and all
durations are computed from those values. The settings below are what we
recommend for a cluster run; the builders work under any session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Recommended settings. AQE re-plans at runtime from real shuffle sizes:
# small join sides become broadcasts only when their materialized size is
# under the threshold, skewed partitions are split, tiny partitions merged.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.ui.enabled": "false",
}


def cluster_conf(input_bytes: int, cores: int,
                 target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Sizing for a large run: partitions of about ``target_partition_bytes``.

    Scans are split into ~256 MB partitions; the initial shuffle partition
    count covers the whole input at that size (at least 2 waves of the
    cores), and AQE merges small ones back to the advisory size and splits
    skewed ones (a partition 5x the median and above 1 GB), so a partition
    fits comfortably in an executor's memory and spills rarely.
    """
    n = max(2 * cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(n),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 ** 3),
    }


def build_session(master: str | None = None, app_name: str = "souk",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the recommended settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared scratch folder (``spark.checkpoint.dir``).

    On a cluster this setting names a shared file system folder and is
    only read here. When it is unset, a local session gets a private folder
    under the system temp dir; any other master raises ``ValueError``.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = _spark_context(spark)
    if not conf_dir and sc is not None:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        master = sc.master if sc is not None else ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="souk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf_dir)
    return conf_dir


def _spark_context(spark: SparkSession):
    """The SparkContext, or None for a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


def session_key(spark: SparkSession) -> tuple:
    """Identity of a running session, stable for its lifetime."""
    sc = _spark_context(spark)
    return (id(spark), sc.applicationId if sc is not None else "")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unique folder name under the shared scratch folder.

    Jobs that write (CSV staging, raw tables, mart exports) use one of
    these per run, so reruns never clobber each other and nothing is
    written to a machine-local folder on a cluster.
    """
    base = ensure_checkpoint_dir(spark)
    sep = "" if base.endswith("/") else "/"
    return f"{base}{sep}souk/{label}-{uuid.uuid4().hex[:12]}"
