"""Local sessions for tests, checks and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

STAGING = "spark.checkpoint.dir"


def ensure_staging(spark: SparkSession) -> None:
    """Give a single-machine session without a staging folder one; a cluster must name its own."""
    master = spark.sparkContext.master
    if spark.conf.get(STAGING, None) is None and (master == "local" or master.startswith("local[")):
        spark.conf.set(STAGING, tempfile.mkdtemp(prefix="staging-"))


def local_session(cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("clientele")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_staging(spark)
    return spark
