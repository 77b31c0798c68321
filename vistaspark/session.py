"""Session helpers for tests, the bench and scripts (library code never builds a session)."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", partitions: int = 8, app: str = "vistaspark",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A local session configured the way the tests and the bench expect.

    On a cluster the session comes from the launcher; this is only for local runs. The
    checkpoint folder is whatever the environment names (``spark.checkpoint.dir``); only when
    nothing does is a scratch folder chosen (see :func:`checkpoint_dir`).
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; registered with the context.

    On a cluster the launcher sets it to shared storage and we only read it. When it is unset a
    scratch folder is chosen for a session in one process; any other master raises, as each
    executor would write to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir()  # a folder already chosen for this context
    if existing:
        return existing
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {sc.master}")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vistaspark-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()
