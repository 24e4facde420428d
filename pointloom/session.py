"""Session factory for local use and tests; on a cluster the caller brings the session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Give this package to the session's Python workers, wherever they run; once per application."""
    context = spark.sparkContext
    if getattr(context, "_pointloom_shipped", False):
        return spark
    home = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pointloom-code-")  # Spark serves the file from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/pointloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    context.addPyFile(path)
    context._pointloom_shipped = True
    return spark


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with adaptive execution, ANSI arithmetic and UTC."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pointloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("POINTLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
