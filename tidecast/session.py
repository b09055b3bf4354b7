"""Session helpers: one place for the settings every job relies on.

A caller's settings win: ``ensure_session_defaults`` fills in only what the session does not carry. The
one exception is the time zone, which the queries' wall-clock arithmetic is defined in. Join thresholds
and optimiser rules are left alone: a data-derived join side is broadcast only where Spark's own size
check allows it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Time stamps are stored as UTC wall time (TIMESTAMP_NTZ), and New York local time is derived from it.
TIME_ZONE = "UTC"
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, app: str = "tidecast", cpus: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with the package defaults. Memory and shuffle partitions are set only when asked for by
    ``cpus`` (one machine) or ``extra``; a cluster's own values stay."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {**_DEFAULTS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    if cpus:
        conf |= {"spark.sql.shuffle.partitions": str(2 * cpus), "spark.driver.memory": "8g"}
    conf |= extra or {}
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_session_defaults(spark)


def ensure_session_defaults(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", TIME_ZONE)
    carried = spark.conf.getAll
    for k, v in _DEFAULTS.items():
        if k not in carried:
            spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, written tables and stream state.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint folder). Where neither is set, as in
    tests on one machine, a fresh temporary folder is chosen; on a cluster that raises, as executors
    could not see it.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not _local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="tidecast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for a written intermediate table."""
    return os.path.join(checkpoint_dir(spark), name)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts the plan and survives executors."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
