"""Session settings for local work; on a cluster the session comes from outside."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", app: str = "graticule", **conf: str) -> SparkSession:
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=base).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session of one process makes a folder of its own and keeps it; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graticule-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")
