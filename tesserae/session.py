"""Session settings that the operators of this package rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results (map keys) or let predicates reach the slide sources.
RUNTIME = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def reachable(spark: SparkSession) -> None:
    """Lets Python workers on this machine import this package, whatever the working directory.

    On a cluster whose machines do not share the folder, ship the package with --py-files.
    """
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if folder not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, folder])


def configure(spark: SparkSession) -> SparkSession:
    reachable(spark)
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local(cores: int = 8, shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tesserae")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
