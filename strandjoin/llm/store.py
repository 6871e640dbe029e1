"""Shared-folder tables that cut lineage, and small session helpers.

``cut`` writes a DataFrame as Parquet under the folder named by ``spark.checkpoint.dir`` and reads it
back: every executor sees the files, so a lost executor costs a retry and not a recomputation from
the source.  Shuffle files of the write are removed when it ends, which keeps disk use near the
largest single step.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

from ..shared import new_folder
from ..shipping import ship

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new folder in the shared store and return the table that was written."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    with setting(spark, _CLEAN, "true"), setting(spark, "spark.sql.parquet.compression.codec", "zstd"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandjoin_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` once every table derived from them has been written."""
    for df in tables:
        path = getattr(df, "_strandjoin_path", None)
        if path:
            jvm = df.sparkSession._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Arrow batches of at most ``rows`` rows, so that a batch of long texts fits a Python worker; ships the package."""
    ship(spark)
    if int(spark.conf.get(_RECORDS)) > rows:
        spark.conf.set(_RECORDS, str(rows))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns whose names clash with those an operator is about to add."""
    low = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in low]
    return df if len(keep) == len(df.columns) else df.select(*[df[f"`{c}`"] for c in keep])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Internal column names that no column of ``df`` has."""
    low = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-side list as a DataFrame that is a constant of the plan (no RDD behind it)."""
    import json

    from pyspark.sql import functions as F

    made = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1, numPartitions=1).select(F.inline(made))
