"""A Spark session with the settings the queries rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build(app: str = "kinweave", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session. On a cluster the session comes from spark-submit and this is not used."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new folder's name under spark.checkpoint.dir, which all machines share. Where that is unset, on one machine, a
    temporary one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='kinweave-')}"
    return f"{base.rstrip('/')}/kinweave/{spark.sparkContext.applicationId}/files/{uuid.uuid4().hex}"
