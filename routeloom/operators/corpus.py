"""Corpora of decisions: leak filters, cuts, splits and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import drop_ec_column, first_line, pair_target, shown_candidates
from .frontier import seeded


def banned_keys(*tables: DataFrame) -> DataFrame:
    """(key): of all benchmarks together; forgetting one is the leak."""
    out = tables[0].select("key")
    for t in tables[1:]:
        out = out.unionByName(t.select("key"))
    return out.where("key is not null").distinct()


def drop_targets(pairs: DataFrame, banned: DataFrame, key=lambda c: c) -> DataFrame:
    """Pairs whose target's key is not banned; a target without a key stays."""
    return pairs.withColumn("key", key(pair_target(F.col("user")))).join(banned, "key", "left_anti").drop("key")


def drop_shown(pairs: DataFrame, banned: DataFrame, key=lambda c: c) -> DataFrame:
    """Pairs that show no banned molecule among their candidates (``pair_id`` names a pair)."""
    shown = pairs.select("pair_id", F.explode(shown_candidates(F.col("user"))).alias("mol"))
    leaks = shown.withColumn("key", key(F.col("mol"))).join(banned, "key").select("pair_id").distinct()
    return pairs.join(leaks, "pair_id", "left_anti")


#: Rows that a task of a global order should have at most, on average.
BUCKET_ROWS = 50_000


def rank_globally(rows: DataFrame, key: Column, *ids: str, digits: int | None = None) -> DataFrame:
    """Adds ``place``, the 1-based rank by ``key`` (a hash in hex) and ids, without one task for all rows.

    Rows are dealt by the first hex digits of the key, as many as the count asks for; the counts
    of the buckets before shift each bucket's own ranks.
    """
    if digits is None:
        n, digits = rows.count(), 2
        while n > BUCKET_ROWS << 4 * digits:
            digits += 1
    keyed = rows.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, digits))
    sizes = keyed.groupBy("_bucket").count()
    # a row for each bucket
    shift = F.coalesce(F.sum("count").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("_bucket", shift.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", *ids))
    return keyed.join(before, "_bucket").withColumn("place", own + F.col("_before")).drop("_key", "_bucket", "_before")


def keep_deep(pairs: DataFrame, deep: int, limit: int, seed: int = 0) -> DataFrame:
    """All pairs of depth ``deep`` or more, and a seeded draw of the others up to the limit.

    More than the limit stay if the deep ones alone are more. A null depth counts as shallow.
    """
    is_deep = F.coalesce(F.col("depth") >= deep, F.lit(False))
    counts = pairs.agg(F.count("*").alias("n"), F.count_if(is_deep).alias("deep")).first()
    if not limit or limit >= counts["n"]:
        return pairs
    room = max(0, limit - counts["deep"])
    rest = rank_globally(pairs.where(~is_deep), seeded(seed, "pair_id"), "pair_id").where(F.col("place") <= room).drop("place")
    return pairs.where(is_deep).unionByName(rest)


def split_groups(rows: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """Adds ``held``: whole groups, max(1, floor(n * share)) of them in a seeded order."""
    groups = rows.select(group).distinct()
    n = groups.count()
    held = rank_globally(groups, seeded(seed, group), group).where(F.col("place") <= max(1, int(n * share)))
    return rows.join(held.select(group, F.lit(True).alias("held")), group, "left").na.fill(False, ["held"])


def part_of(rows: DataFrame, offset: int, limit: int, seed: int, *ids: str) -> DataFrame:
    """A slice of the seeded order: consecutive slices make the whole. ``seed_index`` is fixed before slicing."""
    placed = rank_globally(rows, seeded(seed, *ids), *ids).withColumn("seed_index", F.col("place") - 1)
    return placed.where((F.col("seed_index") >= offset) & (F.col("seed_index") < offset + limit)).drop("place")


def as_conversation(pairs: DataFrame) -> DataFrame:
    """Prompt and completion as arrays of (role, content)."""
    message = lambda role, name: F.struct(F.lit(role).alias("role"), F.col(name).alias("content"))
    return pairs.select("*", F.array(message("system", "system"), message("user", "user")).alias("prompt"), F.array(message("assistant", "assistant")).alias("completion"))


def restamp(pairs: DataFrame, system: str) -> DataFrame:
    """A new system text, no annotation column, and an answer without its reason; a missing field is an error."""
    missing = F.col("system").isNull() | F.col("user").isNull() | F.col("assistant").isNull()
    choice = F.get_json_object("assistant", "$.choice")
    answer = F.format_string('{"choice": %s}', choice)
    checked = F.when(missing | choice.isNull(), F.raise_error(F.lit("a pair lacks a field or a choice"))).otherwise(answer)
    return pairs.withColumn("assistant", checked).withColumn("user", drop_ec_column(F.col("user"))).withColumn("system", F.lit(system))


def self_play_pairs(decisions: DataFrame, depths: DataFrame, min_steps: int, max_steps: int) -> DataFrame:
    """Decisions of solved episodes of allowed length, without fallbacks and forced choices; depth -1 if unknown.

    ``decisions`` has episode, step, mol, n_candidates, fallback and solved; ``depths`` has mol and depth.
    """
    sizes = decisions.groupBy("episode").agg(F.count("*").alias("steps"), F.bool_or("solved").alias("won"))
    good = sizes.where(F.col("won") & F.col("steps").between(min_steps, max_steps)).select("episode")
    kept = decisions.join(good, "episode").where(F.col("fallback").isNull() & (F.col("n_candidates") > 1))
    return kept.join(depths.select("mol", "depth"), "mol", "left").na.fill(-1, ["depth"])


def replay_labels(views: DataFrame, trees: DataFrame) -> DataFrame:
    """The labelled candidate of each view: on the route, of the highest remaining cost, the first of equals.

    ``views`` has decision, target, place and mol; ``trees`` has target, mol and cost. The outcome
    of a view without one is ``truncated away`` if the hidden frontier (place null) has one, else ``thread lost``.
    """
    joined = views.join(trees.select("target", "mol", "cost"), ["target", "mol"], "left")
    seen = F.col("place").isNotNull() & F.col("cost").isNotNull()
    out = joined.groupBy("decision", "target").agg(
        F.min_by("place", F.when(seen, F.struct((-F.col("cost")).alias("c"), "place"))).alias("choice"),
        F.count_if(seen).alias("n_on_route"), F.count("place").alias("n_shown"), F.count("*").alias("n_frontier"),
        F.bool_or(F.col("place").isNull() & F.col("cost").isNotNull()).alias("hidden"),
    )
    outcome = F.when(F.col("n_on_route") > 0, "labelled").when(F.col("hidden"), "truncated away").otherwise("thread lost")
    return out.withColumn("outcome", outcome).drop("hidden")


def prompts_in(pairs: DataFrame) -> DataFrame:
    """(system, n): how many prompts a corpus mixes; a warning if more than one."""
    return pairs.groupBy("system").agg(F.count("*").alias("n"))


def group_of(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("group", first_line(F.col("user")))


def first_wins(tables: list[DataFrame], key: str, order: str) -> DataFrame:
    """The union of tables in their order, one row per key: of the first table that has it, its least ``order``."""
    both = None
    for i, t in enumerate(tables):
        t = t.withColumn("_table", F.lit(i))
        both = t if both is None else both.unionByName(t)
    first = F.row_number().over(Window.partitionBy(key).orderBy("_table", order))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_table")
