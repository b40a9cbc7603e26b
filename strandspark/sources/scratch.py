"""A place for files that driver and executors both see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names. Only a local session, where driver
    and executors are one process, gets a folder of its own if that is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = tempfile.mkdtemp(prefix="strandspark-")
        spark.conf.set("spark.checkpoint.dir", given)
    return f"{given}/{name}-{uuid.uuid4().hex}"
