"""How much of the attested routes a search gives back, by set relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import jaccard
from ..functions.stats import geometric_mean, upper_median

STEP_OUTCOMES = ("exact", "contains", "partial", "missing", "degenerate")
ROUTE_CLASSES = ("exact", "covers", "shortcut", "partial", "miss")


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _ordinal(names: tuple[str, ...], tests: list[Column]) -> Column:
    out = None
    for i, test in enumerate(tests):
        out = F.when(test, i) if out is None else out.when(test, i)
    return out.otherwise(len(tests))


def _named(names: tuple[str, ...], ordinal: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), (ordinal + 1).cast("int"))


def classify_steps(steps: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(route, step, outcome, n_neighbours, rule_idx) from (route, step, want) and (step, rule_idx, got).

    The best relation of any neighbour counts: exact, contains, partial, missing; among equals the
    lowest rule. A step without wanted molecules is degenerate.
    """
    each = steps.join(neighbours, "step", "left")
    relation = _ordinal(STEP_OUTCOMES, [subset("want", "got") & subset("got", "want"), subset("want", "got"), F.arrays_overlap("want", "got")])
    best = F.min(F.struct(F.coalesce(relation, F.lit(3)).alias("o"), "rule_idx"))
    out = each.groupBy("route", "step", "want").agg(best.alias("b"), F.count("got").alias("n_neighbours"))
    empty = F.size("want") == 0
    return out.select(
        "route", "step", F.when(empty, "degenerate").otherwise(_named(STEP_OUTCOMES, F.col("b.o"))).alias("outcome"), "n_neighbours",
        F.when(~empty & (F.col("b.o") < 3), F.col("b.rule_idx")).alias("rule_idx"),
    )


def step_coverage(classified: DataFrame) -> DataFrame:
    """One row: counts of outcomes, routes all of whose steps are exact, and the upper median of candidates on exact steps."""
    real = classified.where("outcome <> 'degenerate'")
    routes = real.groupBy("route").agg(F.bool_and(F.col("outcome") == "exact").alias("full"), F.count_if(F.col("outcome") != "exact").alias("broken"))
    counts = real.agg(
        F.count("*").alias("steps"), *(F.count_if(F.col("outcome") == o).alias(o) for o in STEP_OUTCOMES[:4]),
        upper_median(F.when(F.col("outcome") == "exact", F.col("n_neighbours"))).alias("median_candidates"),
    )
    total = routes.agg(F.count("*").alias("routes"), F.count_if("full").alias("routes_exact"), F.coalesce(F.max("broken"), F.lit(0)).alias("most_broken"))
    return counts.join(F.broadcast(total), F.lit(True))  # one row each


def classify_routes(found: DataFrame, reference: DataFrame) -> DataFrame:
    """(run, route, class, jaccard) from (run, target, route, mols) and (target, ref): relation of two sets.

    Two empty sets are equal: a one-step route has no intermediate.
    """
    both = found.join(reference, "target")
    same = subset("mols", "ref") & subset("ref", "mols")
    relation = _ordinal(ROUTE_CLASSES, [same, subset("ref", "mols"), subset("mols", "ref"), F.arrays_overlap("ref", "mols")])
    return both.select("run", "route", _named(ROUTE_CLASSES, relation).alias("class"), relation.alias("ordinal"), jaccard(F.col("mols"), F.col("ref")).alias("jaccard"))


def score_runs(classified: DataFrame) -> DataFrame:
    """(run, class, jaccard, n_routes): the best class and the best overlap of a run's routes."""
    out = classified.groupBy("run").agg(F.min("ordinal").alias("o"), F.max("jaccard").alias("jaccard"), F.count("*").alias("n_routes"))
    return out.select("run", _named(ROUTE_CLASSES, F.col("o")).alias("class"), "jaccard", "n_routes")


def built_reference(reference: DataFrame, graph: DataFrame) -> DataFrame:
    """(target, mol, node): the graph's molecule for each reference molecule, by canonical form first, else by key.

    ``reference`` has target, mol and key; ``graph`` has target, mol, key and node.
    """
    exact = reference.join(graph.groupBy("target", "mol").agg(F.min("node").alias("by_mol")), ["target", "mol"], "left")
    by_key = graph.where("key is not null").groupBy("target", "key").agg(F.min("node").alias("by_key"))
    return exact.join(by_key, ["target", "key"], "left").select("target", "mol", F.coalesce("by_mol", "by_key").alias("node"))


def route_plausibility(edges: DataFrame) -> DataFrame:
    """(run, route, per_step): geometric mean of a route's known edge scores; NaN without any."""
    return edges.groupBy("run", "route").agg(F.coalesce(geometric_mean(F.col("score")), F.lit(float("nan"))).alias("per_step"))


def enzymatic_share(steps: DataFrame) -> DataFrame:
    """(run, share): of steps with an annotation; NaN for a run without steps (rxn null)."""
    share = F.avg(F.when(F.col("rxn").isNotNull(), (F.size("ec") > 0).cast("double")))
    return steps.groupBy("run").agg(F.coalesce(share, F.lit(float("nan"))).alias("share"))
