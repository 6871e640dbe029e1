"""Sends this package to executors that run its Python code."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the application's Python files, once; an installed copy does no harm."""
    context = spark.sparkContext
    if getattr(context, "_strandjoin_shipped", False):
        return
    top = pathlib.Path(__file__).resolve().parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="strandjoin-")) / f"{top.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(str(target))
    context._strandjoin_shipped = True
