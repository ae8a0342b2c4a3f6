"""Spark session helpers.

Library code never builds its own session: every operator takes DataFrames
and uses ``df.sparkSession``.  ``get_session`` is for tests, the bench and
the driver entry point only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def _driver_memory() -> str:
    """Half of the machine's memory, at most 16 GB: Python workers and the system need the rest."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError):
        return "4g"
    return f"{max(1, min(16, total // 2 // (1 << 30)))}g"


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app: str = "flowpanel") -> SparkSession:
    master = master or os.environ.get("FLOWPANEL_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FLOWPANEL_DRIVER_MEM") or _driver_memory())
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint directory.

    On a cluster ``spark.checkpoint.dir`` names a shared, reliable folder and is
    used as is; without it this raises.  Only a local master (tests, bench), whose
    executors are threads of this machine, gets a scratch folder of its own.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="flowpanel-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local
