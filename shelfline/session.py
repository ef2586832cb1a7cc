"""Spark session defaults and the shared checkpoint folder.

Production clusters bring their own session; ``build_session`` is for local
runs, tests and the benchmark.  Library code never creates sessions itself.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every mart relies on: UTC so timestamps (NTZ in the test data) never
# shift, AQE for runtime partition coalescing and skew splitting, ANSI kept on.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "shelfline", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("SHELFLINE_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; create a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS/S3/...)
    and is respected as is.  Only a local master, where one machine runs everything
    (tests, the benchmark), gets a fresh temporary folder without the setting; on a
    cluster a missing setting is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="shelfline-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def cut(df):
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint):
    cuts the lineage of a table that later stages read several times."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
