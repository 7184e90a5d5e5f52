"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import let_workers_import
from ..storage import cut, release, shared_dir

__all__ = ["BATCH_ROWS", "NO_ID", "cut", "documents", "hash_unit", "release", "shared_dir", "small_batches", "tasks_for"]

#: Stands for a null id where a key must not be null.
NO_ID = -(1 << 63)
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Before Python runs on executors: workers find the package, and Arrow batches of at most ``BATCH_ROWS`` rows from here on.

    Whole texts make long rows, and each batch is held several times.
    """
    let_workers_import(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tasks_for(df: DataFrame, per_task: int, rows: int) -> int:
    """A partition count in proportion to ``rows``, at least the session's."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows // per_task))


def hash_unit(column, seed: int):
    """A uniform number in [0, 1) from md5 of a key: the same in any SQL engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
