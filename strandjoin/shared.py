"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL = "spark.strandjoin.local.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one temporary folder for the session only on a local master without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = spark.conf.get(_LOCAL, None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="strandjoin-")
        spark.conf.set(_LOCAL, where)
    return where


def new_folder(spark: SparkSession, tag: str) -> str:
    """A name, not in use, below the shared folder."""
    return f"{shared_folder(spark)}/strandjoin/{tag}-{uuid.uuid4().hex}"
