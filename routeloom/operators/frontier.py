"""Which frontier molecules a decision sees: round-robins and portfolios as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS = ("portfolio", "stratified", "discovery", "seeded_random")


def seeded(seed: Column | int, *keys: str) -> Column:
    """A reproducible shuffle key: md5 of seed and keys, the same in any engine."""
    first = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws(":", first.cast("string"), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def stratify(frontier: DataFrame, inner: list[Column] | None = None) -> DataFrame:
    """Adds ``place``: a round-robin over depths, inside a depth by ``inner`` and then id."""
    within = Window.partitionBy("run", "depth").orderBy(*(inner or []), "id")
    out = frontier.withColumn("turn", F.row_number().over(within))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy("turn", "depth"))).drop("turn")


def interleave(members: DataFrame) -> DataFrame:
    """(run, id, place) from rows (run, member, rank, id): rank by rank over the members, first occurrence wins.

    An id's first occurrence is its least (rank, member), so no merge is needed.
    """
    first = members.groupBy("run", "id").agg(F.min(F.struct("rank", "member")).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy("first", "id"))).drop("first")


def portfolio(frontier: DataFrame) -> DataFrame:
    """(run, id, place): depth round-robin, similarity, precedent and size, interleaved.

    Needs run, id, depth, sim, precedent and heavy; a null score comes last.
    """
    per_run = Window.partitionBy("run")
    ranked = stratify(frontier).select(
        "run", "id", F.col("place").alias("m0"),
        F.row_number().over(per_run.orderBy(F.desc_nulls_last("sim"), "id")).alias("m1"),
        F.row_number().over(per_run.orderBy(F.desc_nulls_last("precedent"), "id")).alias("m2"),
        F.row_number().over(per_run.orderBy(F.asc_nulls_last("heavy"), "id")).alias("m3"),
    )
    members = ranked.select("run", "id", F.explode(F.array(*(F.struct(F.lit(i).alias("member"), F.col(f"m{i}").alias("rank")) for i in range(4)))).alias("x"))
    return interleave(members.select("run", "x.member", "x.rank", "id"))


def select_view(frontier: DataFrame, order: str = "stratified", top_k: int = 20, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """(run, id, place): the ``top_k`` of an order, shown in a seeded order that hides the place.

    The portfolio needs its scores: without them this fails instead of falling back.
    """
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, got {order!r}")
    if order == "portfolio":
        missing = {"sim", "precedent", "heavy"} - set(frontier.columns)
        if missing:
            raise ValueError(f"the portfolio needs {sorted(missing)}")
        placed = portfolio(frontier)
    elif order == "stratified":
        placed = stratify(frontier).select("run", "id", "place")
    else:
        key = F.col("id") if order == "discovery" else seeded(seed, "run", "id")
        placed = frontier.select("run", "id", F.row_number().over(Window.partitionBy("run").orderBy(key, "id")).alias("place"))
    chosen = placed.where(F.col("place") <= top_k)
    if not shuffle:
        return chosen
    n = F.count("*").over(Window.partitionBy("run"))
    chosen = chosen.withColumn("n", n)
    shown = Window.partitionBy("run").orderBy(seeded(F.lit(seed) + F.col("n"), "run", "id"), "id")
    return chosen.select("run", "id", F.row_number().over(shown).alias("place"))


def render_view(lines: DataFrame, order: str) -> DataFrame:
    """(run, text): the lines of each view, and how much it hides; needs run, place, line, n_total."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
    out = lines.groupBy("run").agg(text.alias("text"), F.count("*").alias("shown"), F.max("n_total").alias("n_total"))
    note = F.format_string(f"\n(%d of %d frontier molecules shown, ordered by {order})", "shown", "n_total")
    return out.select("run", F.concat("text", F.when(F.col("shown") < F.col("n_total"), note).otherwise("")).alias("text"))
