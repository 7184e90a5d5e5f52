"""Batch job: a policy's training corpus from logged conversations.

    python -m jobs.policy_corpus --conversations PATH --benchmark PATH --out PATH [--config FILE] [--master local[8]]

A user turn and the assistant's turn after it are a decision: the user's first longer words are
the candidates, the first of them the target, and the earliest one that the reply takes up is the
choice.  Decisions whose reply takes up none are dropped, and so are those that show a longer word of
the benchmark (it would leak what the policy is judged by).  Of equal prompts the first pair stays;
deep decisions stay before shallow ones; whole targets are held out for validation.

``OUT/pairs`` has JSON lines (pair_id, prompt, completion) by ``split`` and ``depth``, ``OUT/report``
what each step left.  Every draw is by hash, so a run over the same input gives the same rows, and it
replaces what an earlier run wrote, whole.

Defined results: turns without a conversation, number, role or text are no decisions; of turns that
repeat a conversation, number and role the least text counts; a conversation that goes on after a gap
in its numbers is cut there; empty tables give an empty corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main
from routeloom.functions.scalars import TARGET_PREFIX, render_candidate
from routeloom.operators import corpus as E
from routeloom.storage import cut, release

MESSAGE = "array<struct<role: string, content: string>>"
SCHEMA = f"pair_id string, prompt {MESSAGE}, completion {MESSAGE}, split string, depth int"


@dataclass(frozen=True)
class Settings:
    FILE: ClassVar[str] = "policy_corpus"
    candidates: int = 8
    least_letters: int = 3
    banned_letters: int = 7
    deep: int = 4
    keep_share: float = 0.8
    held_share: float = 0.2
    seed: int = 4
    system: str = "Choose the candidate to expand next."


def decisions(turns: DataFrame, settings: Settings) -> DataFrame:
    """(pair_id, system, user, assistant, depth) of every user turn that an assistant turn follows; no choice in ``assistant`` if none is taken up."""
    whole = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").dropna()
    whole = whole.where(F.col("role").isin("user", "assistant")).groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    words = lambda text: F.split(text, "[^A-Za-z]+")
    asked = whole.where("role = 'user'").select("conv_id", "turn", F.slice(F.filter(words("text"), lambda w: F.length(w) >= settings.least_letters), 1, settings.candidates).alias("words"))
    told = whole.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.transform(words("text"), F.lower).alias("reply"))
    both = asked.where(F.size("words") > 0).join(told, ["conv_id", "turn"])
    depth = F.col("turn").cast("int")
    lines = F.array_join(F.transform("words", lambda w, i: render_candidate(i, w, depth)), "\n")
    choice = F.array_position(F.transform("words", lambda w: F.array_contains("reply", F.lower(w))), True) - 1
    return both.select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.lit(settings.system).alias("system"),
        F.concat(F.lit(TARGET_PREFIX), F.col("words")[0], F.lit("\nFrontier candidates:\n"), lines).alias("user"),
        F.when(choice >= 0, F.format_string('{"choice": %d}', choice)).alias("assistant"), depth.alias("depth"),
    )


def held_out_words(benchmark: DataFrame, settings: Settings) -> DataFrame:
    words = benchmark.select(F.explode(F.split("text", "[^A-Za-z]+")).alias("key"))
    return E.banned_keys(words.where(F.length("key") >= settings.banned_letters).select(F.lower("key").alias("key")))


def run(spark: SparkSession, conversations: str, benchmark: str, out: str, settings: Settings = Settings()) -> dict[str, int]:
    """Writes the corpus below ``out``; returns how many pairs each step left."""
    turns, items = spark.read.parquet(conversations), spark.read.parquet(benchmark)
    log.info("read %s (%d turns) and %s (%d items)", conversations, turns.count(), benchmark, items.count())
    made = cut(decisions(turns, settings), "corpus-decisions")
    n = made.agg(F.count("*").alias("n"), F.count("assistant").alias("answered")).first()
    left = {"decisions": n.n, "answered": n.answered}
    clean = E.drop_shown(made.where("assistant is not null"), held_out_words(items, settings), F.lower)
    first = clean.groupBy("user").agg(F.min_by(F.struct("pair_id", "system", "assistant", "depth"), "pair_id").alias("p"), F.count("*").alias("n"))
    distinct = cut(first.select("p.pair_id", "p.system", "user", "p.assistant", "p.depth", "n"), "corpus-distinct")
    n = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unleaked"), F.count("*").alias("distinct")).first()
    left |= n.asDict()
    limit = -int(-left["distinct"] * settings.keep_share // 1)
    kept = cut(E.keep_deep(distinct.drop("n"), settings.deep, limit, settings.seed) if limit else distinct.drop("n").limit(0), "corpus-kept")
    left["kept"] = kept.count()
    split = E.split_groups(E.group_of(kept), "group", settings.held_share, settings.seed)
    rows = E.as_conversation(split).select("pair_id", "prompt", "completion", F.when(F.col("held"), "validation").otherwise("train").alias("split"), "depth")
    # one exchange by what a partition is named after, however many files it needs
    rows.repartition("split", "depth", F.pmod(F.xxhash64("pair_id"), F.lit(max(1, left["kept"] // 500_000)))).write.mode("overwrite").partitionBy("split", "depth").json(f"{out}/pairs")
    report = spark.createDataFrame([(i, step, n) for i, (step, n) in enumerate(left.items())], "place int, step string, pairs long")
    report.coalesce(1).write.mode("overwrite").json(f"{out}/report")  # a line for each step
    for table in (made, distinct, kept):
        release(table)
    for step, pairs in left.items():
        log.info("%s: %d pairs", step, pairs)
    for r in read(spark, out).groupBy("split", "depth").count().orderBy("split", "depth").collect():
        log.info("wrote %s/pairs/split=%s/depth=%s: %d pairs", out, r.split, r.depth, r["count"])
    return left


def read(spark: SparkSession, out: str) -> DataFrame:
    """The corpus that a run wrote."""
    return spark.read.schema(SCHEMA).json(f"{out}/pairs")


if __name__ == "__main__":
    main(__doc__.split("\n")[0], {"conversations": "Parquet of conv_id, turn, role, text", "benchmark": "Parquet of item_id, text", "out": "the folder of the corpus"}, Settings, run)
