"""A scratch folder for local sessions that name none; cluster sessions must name one."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from martloom.session import has_scratch, use_scratch


def ensure_scratch(spark: SparkSession) -> None:
    """Hand a folder of this machine to a local session without one; it goes when the program ends."""
    if not has_scratch(spark) and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="martloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        use_scratch(spark, folder)


def with_scratch(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_scratch(spark)
        return query(spark, sf_dir)

    return run
