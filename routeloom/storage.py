"""Where loops cut their lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, a temporary folder stands
    in for it; elsewhere rows written to it would be lost, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="routeloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, name: str = "step", replaces: DataFrame | None = None) -> DataFrame:
    """Write and read back: cuts the lineage and gives the optimizer the true size.

    ``replaces`` is a table of an earlier step that nothing reads any more: it is deleted
    once the new one is written.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._routeloom_path = path
    if replaces is not None:
        release(replaces)
    return out


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """A frame that several steps read: as it is if it is a written table, else written."""
    return df if getattr(df, "_routeloom_path", None) else cut(df, name)


def release(table: DataFrame) -> None:
    """Deletes a table that ``cut`` made; any other frame is left alone."""
    path = getattr(table, "_routeloom_path", None)
    if path is not None:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        table._routeloom_path = None


class Log:
    """A table that a loop only adds to: a folder of Parquet, partitioned by step and level, read in one scan."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema = spark, StructType.fromDDL(schema)
        self.columns, self.whole = self.schema.fieldNames(), StructType.fromDDL(f"{schema}, step int, level int")
        self.path, self.parts = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def append(self, rows: DataFrame, step: int, level: int = 0) -> DataFrame:
        """Writes the rows of a step and returns them, read back."""
        rows.select(*self.columns).write.parquet(f"{self.path}/step={step}/level={level}")
        self.parts += 1
        return self.part(step, level)

    def part(self, step: int, level: int = 0) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/step={step}/level={level}")

    def table(self) -> DataFrame:
        """All rows so far, with their step and level."""
        if not self.parts:
            return self.spark.createDataFrame([], self.whole)
        return self.spark.read.schema(self.whole).parquet(self.path)
