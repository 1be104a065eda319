"""The package sent to executors that may not have it."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python path of the executors' workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_tonearm_shipped", False):
        return
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="tonearm-package-")
    clean = os.path.join(folder, "src")
    shutil.copytree(os.path.join(here, "tonearm"), os.path.join(clean, "tonearm"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "tonearm_package"), "zip", clean))
    sc._tonearm_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
