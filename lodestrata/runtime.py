"""Making this package importable in the Python workers, wherever the session was started from."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Arrow batches go to the workers by size, not by number of rows alone: a batch of very long texts stays this small.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def visible(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the workers' path; on a cluster ship it with ``--py-files`` as well.

    Bounds the bytes of an Arrow batch where the session bounds them less.
    """
    if int(spark.conf.get(_BATCH).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    held = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in held:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *held])
    return spark


def tasks(spark: SparkSession) -> int:
    """Into how many tasks heavy rows are dealt out: the session's shuffle partitions, at least four times its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def on_path(fn: Callable) -> Callable:
    """A query or stage whose workers find this package."""

    @functools.wraps(fn)
    def run(spark, *args):
        return fn(visible(spark), *args)

    return run
