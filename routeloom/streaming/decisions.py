"""Search decisions as a stream: totals, windows, sessions and replay from a checkpoint."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..storage import shared_dir


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder, in order of arrival; readers are independent and keep their own offsets."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def totals(events: DataFrame) -> DataFrame:
    """(policy, decisions, solved, seconds): the live table of a run, exact at any point."""
    return events.groupBy("policy").agg(F.count("*").alias("decisions"), F.count_if("solved_after").alias("solved"), F.sum("seconds").alias("seconds"))


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by tumbling window and policy; windows close ``late`` after the newest event."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", size), "policy").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "policy", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class Progress(StatefulProcessor):
    """Per run: decisions so far, the first solving step, and a running mean of the values of its steps."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("progress", "n long, first long, total double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, first, total = self.state.get() if self.state.exists() else (0, -1, 0.0)
        for batch in rows:
            n += len(batch)
            total += float(batch["value"].sum())
            won = batch.loc[batch["solved_after"], "step"]
            if len(won):
                first = int(won.min()) if first < 0 else min(first, int(won.min()))
        self.state.update((n, first, total))
        yield pd.DataFrame({"run": [key[0]], "n": [n], "first_solved": [first], "mean": [total / n if n else 0.0]})

    def close(self) -> None:
        pass


def progress(events: DataFrame) -> DataFrame:
    """(run, n, first_solved, mean) after each batch, with keyed state."""
    return events.groupBy("run").transformWithStateInPandas(Progress(), "run string, n long, first_solved long, mean double", "Update", "None")


def to_sink(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet; the checkpoint replays from the last offset after a loss, each event once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def for_each(stream: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def mark_finished(spark: SparkSession, run: str) -> None:
    """The end of a run's events: whoever reads the folder, early or late, finds the whole backlog and then this mark."""
    fs, place = _folder(spark, f"{run}/_finished")
    fs.create(place, True).close()


def is_finished(spark: SparkSession, run: str) -> bool:
    fs, place = _folder(spark, f"{run}/_finished")
    return fs.exists(place)


def retain(spark: SparkSession, root: str, keep: int = 20) -> list[str]:
    """Deletes all but the last ``keep`` finished runs below a folder (by the time of their mark); returns the names of those deleted."""
    fs, place = _folder(spark, root)
    runs = [s.getPath() for s in fs.listStatus(place) if s.isDirectory()]
    marks = [(fs.getFileStatus(m).getModificationTime(), p.getName(), p) for p in runs if fs.exists(m := spark._jvm.org.apache.hadoop.fs.Path(p, "_finished"))]
    old = sorted(marks, key=lambda m: m[:2])[: max(0, len(marks) - keep)]
    for _, _, p in old:
        fs.delete(p, True)
    return [name for _, name, _ in old]


def final_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there and returns its last result, from a table in the shared folder.

    In mode ``complete`` that is the last batch, else what all batches gave.
    """
    path, batches = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}", {}

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        batches[batch] = f"{path}/batch={batch}"

    query = for_each(stream, keep, checkpoint, mode)
    query.awaitTermination()
    if error := query.exception():
        raise error
    if not batches:
        return stream.sparkSession.createDataFrame([], stream.schema)
    paths = [batches[max(batches)]] if mode == "complete" else list(batches.values())
    return stream.sparkSession.read.schema(stream.schema).parquet(*paths)
