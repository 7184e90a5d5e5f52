"""Incremental job: run events as they arrive, kept once each and summed by day.

    python -m jobs.run_ledger --events PATH --out PATH --checkpoint PATH [--config FILE] [--master local[8]]

``PATH`` is the folder that the files arrive in, or a pattern of files and folders (a table that is
one file needs a pattern, such as ``events.parquet*``).  A file stream takes the files that are new since the last run (its checkpoint knows the others) and
ends when there are none left.  Each batch of files becomes a partition of ``OUT/ledger``, by day;
then the days that it touched, and only those, are summed again from the ledger into ``OUT/daily``:
for each day, policy, seed and expansion budget the runs, those solved within it, and what they spent.
Late events so correct their day; events that come again, in whatever file, count once in their day.

A batch that broke off is taken again under its number and replaces what it left of both tables, so
a run that was killed is started again with the same paths.  If the checkpoint is lost, delete the ledger
as well or not: events that are read again count once.

``curve`` makes the solve-rate curve of all days from the sums, without a look at the events.

Defined results: an event without a time is of the day ``unknown``; of events that repeat an id the
one of the earliest batch counts (in a batch the least by content); events without an id count once for each content.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from routeloom.functions.stats import sample_sd
from routeloom.plans.bindings import runs_of
from routeloom.plans.tables import never
from routeloom.streaming.decisions import for_each

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LEDGER = "key string, policy string, target string, seed int, solved_at int, n_expansions int, elapsed_s double, batch long, day string"
DAILY = "policy string, seed int, budget int, runs long, solved long, expansions long, seconds double, day string"


@dataclass(frozen=True)
class Settings:
    FILE: ClassVar[str] = "run_ledger"
    budgets: tuple[int, ...] = (1, 5, 10, 25, 50, 100)
    files_per_batch: int = 64


def entries(events: DataFrame) -> DataFrame:
    """Events as rows of the ledger, but for the batch."""
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown"))
    content = F.md5(F.to_json(F.struct("ts", "user_id", "event_type", "value", "props")).cast("binary"))
    keyed = runs_of(events.withColumn("key", F.coalesce(F.col("event_id").cast("string"), content)).withColumn("day", day), "key", "day")
    return keyed.select("key", "policy", "target", "seed", "solved_at", "n_expansions", "elapsed_s", "day")


def daily(ledger: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    """The sums of the ledger's days; of rows with a key one counts."""
    row = F.struct("batch", "policy", "target", "seed", "solved_at", "n_expansions", "elapsed_s")
    once = ledger.groupBy("day", "key").agg(F.min(row).alias("r")).select("day", "r.*")
    judged = once.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    return judged.groupBy("day", "policy", "seed", "budget").agg(
        F.count("*").alias("runs"), F.count_if(never(F.col("solved_at")) <= F.col("budget")).alias("solved"),
        F.sum(F.least("n_expansions", "budget")).cast("long").alias("expansions"), F.round(F.sum("elapsed_s"), 6).alias("seconds"),
    )


def run(spark: SparkSession, events: str, out: str, checkpoint: str, settings: Settings = Settings()) -> dict[str, int]:
    """Takes what is new below ``events``; returns the events, batches and days of this run."""
    budgets, seen = tuple(settings.budgets), {"events": 0, "batches": 0, "days": 0}

    def take(rows: DataFrame, batch: int) -> None:
        session = rows.sparkSession
        entries(rows).write.mode("overwrite").partitionBy("day").parquet(f"{out}/ledger/batch={batch}")
        ledger = session.read.schema(LEDGER).parquet(f"{out}/ledger")
        own = ledger.where(F.col("batch") == batch).groupBy("day").count().collect()  # a row for each day of the batch
        known = ledger.where(F.col("day").isin([r.day for r in own]))
        sums = daily(known, budgets).repartition("day")
        sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{out}/daily")
        seen["events"] += sum(r["count"] for r in own)
        seen["batches"] += 1
        seen["days"] += len(own)
        log.info("batch %d: read %d events, wrote %s/daily for %d days", batch, sum(r["count"] for r in own), out, len(own))

    # the folder of the sums is there even if nothing ever arrives
    spark.createDataFrame([], DAILY).write.mode("append").partitionBy("day").parquet(f"{out}/daily")
    # a file's age is no reason to leave it out: archives arrive late
    files = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", settings.files_per_batch).option("maxFileAge", "36500d").parquet(events)
    query = for_each(files, take, checkpoint)
    query.awaitTermination()
    log.info("took %d new events of %s in %d batches", seen["events"], events, seen["batches"])
    return seen


def read(spark: SparkSession, out: str) -> DataFrame:
    """The daily sums as they stand."""
    return spark.read.schema(DAILY).parquet(f"{out}/daily")


def curve(sums: DataFrame) -> DataFrame:
    """(policy, budget, mean, sd, n_seeds): the solve-rate curve of all days, in percent over seeds."""
    seeds = sums.groupBy("policy", "budget", "seed").agg((100.0 * F.sum("solved") / F.sum("runs")).alias("rate"))
    return seeds.groupBy("policy", "budget").agg(F.avg("rate").alias("mean"), sample_sd(F.col("rate")).alias("sd"), F.count("*").alias("n_seeds"))


def work(spark: SparkSession, events: str, out: str, checkpoint: str, settings: Settings) -> None:
    run(spark, events, out, checkpoint, settings)
    curve(read(spark, out)).orderBy("policy", "budget").show(200, False)


if __name__ == "__main__":
    main(__doc__.split("\n")[0], {"events": "the folder of Parquet files of events, or a pattern", "out": "the folder of the ledger", "checkpoint": "the stream's checkpoint"}, Settings, work)
