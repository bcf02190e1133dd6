"""This package on the workers: they need no copy of their own."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: str | None = None
_archive: tempfile.TemporaryDirectory | None = None


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each context."""
    global _archive, _shipped
    context = spark.sparkContext
    if _shipped == context.applicationId:
        return
    if _archive is None:
        package = Path(__file__).resolve().parent
        _archive = tempfile.TemporaryDirectory(prefix="studylake-")  # a local mode reads it from there while the process lives
        shutil.make_archive(f"{_archive.name}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(str(next(Path(_archive.name).iterdir())))
    _shipped = context.applicationId


def in_pandas(df: DataFrame, run: Callable, columns: str) -> DataFrame:
    """``df.mapInPandas`` by functions of this package, wherever ``df`` is from."""
    ship(df.sparkSession)
    return df.mapInPandas(run, columns)
