"""Evaluation tables over runs (schema ``RUN``): rates, costs, quality and paired tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import known_mean, sample_sd, sign_test


def rate_over_seeds(runs: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """(policy, key, mean, sd, n_seeds): percentages per seed, then over the seeds that have runs.

    ``hits`` has (key); ``runs`` has a boolean column ``hit`` that may depend on it.
    """
    crossed = runs.join(F.broadcast(hits), F.lit(True))  # the axis of a table: a handful of rows
    per_seed = crossed.groupBy("policy", key, "seed").agg((100.0 * F.avg(F.expr("cast(hit_at <= " + key + " as double)"))).alias("rate"))
    return per_seed.groupBy("policy", key).agg(F.avg("rate").alias("mean"), sample_sd(F.col("rate")).alias("sd"), F.count("*").alias("n_seeds"))


def _axis(df: DataFrame, name: str, values: list, kind: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{name} {kind}")


def never(value: Column) -> Column:
    """A missing time counts as after every budget."""
    return F.coalesce(value.cast("double"), F.lit(float("inf")))


def solve_rate_curve(runs: DataFrame, budgets: list[int]) -> DataFrame:
    """Solve rate by expansion budget: mean and deviation over seeds."""
    return rate_over_seeds(runs.withColumn("hit_at", never(F.col("solved_at"))), _axis(runs, "budget", budgets, "int"), "budget")


def efficiency(runs: DataFrame) -> DataFrame:
    """(policy, exp2sol, ceiling, route, reference, ec_percent, seconds, calls, fallbacks) over all runs."""
    routed = F.col("shortest_route").isNotNull()
    return runs.groupBy("policy").agg(
        F.avg("solved_at").alias("exp2sol"), (100.0 * F.avg(F.col("expandable").cast("double"))).alias("ceiling"),
        F.avg("shortest_route").alias("route"), F.avg(F.when(routed, F.col("reference_route"))).alias("reference"),
        (100.0 * known_mean(F.col("ec_fraction"))).alias("ec_percent"), F.sum("elapsed_s").alias("seconds"),
        F.sum("llm_calls").alias("calls"), F.sum("llm_fallbacks").alias("fallbacks"),
    )


def strata(runs: DataFrame) -> DataFrame:
    """(policy, reference_route, solved, runs) by the length of the attested route; 0 means none and is left out."""
    return runs.where("reference_route > 0").groupBy("policy", "reference_route").agg(F.count_if("solved").alias("solved"), F.count("*").alias("runs"))


def time_curve(runs: DataFrame, times: list[float]) -> DataFrame:
    """Solve rate by seconds; ``bound`` marks where the expansion budget cut runs off, so the rate is a lower bound.

    A run whose frontier was empty failed at any time and does not censor.
    """
    cut_off = F.min(F.when(~F.col("solved") & F.col("stopped_because").isin("budget", "time"), F.col("elapsed_s")))
    censor = runs.groupBy("policy").agg(cut_off.alias("censored_at"))
    hit = F.when(F.col("solved"), F.col("elapsed_s"))
    rates = rate_over_seeds(runs.withColumn("hit_at", never(hit)), _axis(runs, "seconds", [float(t) for t in times], "double"), "seconds")
    return rates.join(censor, "policy").withColumn("bound", F.coalesce(F.col("seconds") > F.col("censored_at"), F.lit(False)))


def cost_per_solved(runs: DataFrame) -> DataFrame:
    """What a solved target cost, with all runs charged."""
    sums = runs.groupBy("policy").agg(
        F.count_if("solved").alias("solved"), F.sum("elapsed_s").alias("s"), F.sum("n_expansions").alias("e"), F.sum("llm_calls").alias("calls"),
        F.sum(F.col("llm_input_tokens") + F.col("llm_output_tokens")).alias("tokens"),
    )
    per = lambda c: F.try_divide(F.col(c).cast("double"), F.col("solved"))
    return sums.select(
        "policy", "solved", F.try_divide(F.col("s"), F.col("e")).alias("s_per_expansion"), per("s").alias("s_per_solved"),
        per("e").alias("expansions_per_solved"), "calls", "tokens", per("tokens").alias("tokens_per_solved"),
    )


def route_quality(runs: DataFrame) -> DataFrame:
    """Mean route and its difference to the attested one, on solved runs; no difference where there is no reference."""
    own = runs.where("shortest_route is not null").groupBy("policy").agg(
        F.avg("shortest_route").alias("route"), F.avg("reference_route").alias("reference"), (100.0 * known_mean(F.col("ec_fraction"))).alias("ec_percent")
    )
    has = runs.agg(F.coalesce(F.max("reference_route") > 0, F.lit(False)).alias("has"))
    out = own.join(F.broadcast(has), F.lit(True))  # one row
    return out.select("policy", "route", F.when(F.col("has"), F.col("reference")).alias("reference"), F.when(F.col("has"), F.col("route") - F.col("reference")).alias("delta"), "ec_percent")


def paired(runs: DataFrame, a: str, b: str, budget: int) -> DataFrame:
    """One row: cells (target, seed) that both policies have, who solves them, and the sign test on the discordant ones.

    If a cell has several runs of a policy, its best counts.
    """
    hit = F.coalesce(F.col("solved_at") <= budget, F.lit(False))
    cells = runs.where(F.col("policy").isin(a, b)).groupBy("target", "seed").agg(
        F.max(F.when(F.col("policy") == a, hit)).alias("x"), F.max(F.when(F.col("policy") == b, hit)).alias("y")
    )
    cells = cells.where("x is not null and y is not null")
    out = cells.agg(
        F.count("*").alias("cells"), F.count_if(F.col("x") & F.col("y")).alias("both_solve"), F.count_if(~F.col("x") & ~F.col("y")).alias("neither"),
        F.count_if(F.col("x") & ~F.col("y")).alias("only_first"), F.count_if(~F.col("x") & F.col("y")).alias("only_second"),
    )
    return out.withColumn("p", sign_test(F.least("only_first", "only_second"), F.col("only_first") + F.col("only_second")))


def completeness(runs: DataFrame, expected_targets: int, threshold: float = 95.0) -> DataFrame:
    """Coverage of a partial table: targets and runs against what was asked, flagged if either is short."""
    seeds = runs.select("seed").distinct().count()
    own = runs.groupBy("policy").agg(F.count_distinct("target").alias("targets"), F.count("*").alias("runs"))
    own = own.withColumn("target_percent", 100.0 * F.col("targets") / expected_targets).withColumn("run_percent", 100.0 * F.col("runs") / (expected_targets * max(1, seeds)))
    return own.withColumn("too_partial", F.least("target_percent", "run_percent") < threshold)


def first_solved(decisions: DataFrame, solved_before: DataFrame) -> DataFrame:
    """(run, solved_at): the first step after which the target is solved, 1-based; 0 if it was before any; null if never."""
    first = decisions.groupBy("run").agg(F.min(F.when(F.col("solved_after"), F.col("step") + 1)).alias("at"))
    out = solved_before.join(first, "run", "left")
    return out.select("run", F.when(F.col("solved_before"), 0).otherwise(F.col("at")).alias("solved_at"))


def target_mismatch(runs: DataFrame) -> DataFrame:
    """(source, targets, missing) of result files that lack targets which another file has."""
    everything = runs.select("target").distinct().count()
    return runs.groupBy("source").agg(F.count_distinct("target").alias("targets")).withColumn("missing", F.lit(everything) - F.col("targets")).where("missing > 0")
