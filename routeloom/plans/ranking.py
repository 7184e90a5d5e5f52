"""Rankings and their figures: coverage at k, reciprocal rank, medians, scorer tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import upper_median
from ..operators.frontier import interleave, seeded, stratify


def ranks(candidates: DataFrame, score: str = "score", ties: Column | str = "rule_idx") -> DataFrame:
    """Adds ``rank`` within ``query``: score down (NaN and null last), then ties."""
    known = F.when(~F.isnan(score), F.col(score))
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last(known), ties)))


def attested_rank(candidates: DataFrame, score: str = "score", ties: Column | str = "rule_idx") -> DataFrame:
    """(query, rank, n): the best rank of an attested candidate, null without one."""
    return ranks(candidates, score, ties).groupBy("query").agg(F.min(F.when(F.col("attested"), F.col("rank"))).alias("rank"), F.count("*").alias("n"))


def random_ties(seed: int, *ids: str) -> Column:
    return seeded(seed, "query", *ids)


def coverage_table(found: DataFrame, ks: tuple[int, ...] = (5, 10, 20), by: tuple[str, ...] = ()) -> DataFrame:
    """Coverage at k, mean reciprocal rank and medians from (query, rank, n).

    Each figure's denominator is named: ``_all`` over all queries, ``_found`` over those that have a
    rank, ``_big`` over those with more than k candidates.
    """
    got = F.col("rank").isNotNull()
    hit = lambda k: F.coalesce(F.col("rank") <= k, F.lit(False))
    share = lambda c: F.avg(c.cast("double"))
    return found.groupBy(*by).agg(
        F.count("*").alias("queries"), F.count("rank").alias("found"),
        F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr_all"), F.avg(1 / F.col("rank")).alias("mrr_found"),
        *(share(hit(k)).alias(f"cov{k}_all") for k in ks), *(share(F.when(got, hit(k))).alias(f"cov{k}_found") for k in ks),
        *(share(F.when(F.col("n") > k, hit(k))).alias(f"cov{k}_big") for k in ks),
        F.percentile("rank", 0.5).alias("median"), upper_median(F.col("rank")).alias("upper_median"),
        F.avg(F.col("rank") / F.col("n")).alias("normalised_rank"),
    )


def candidate_scores(neighbours: DataFrame, closeness: DataFrame) -> DataFrame:
    """Long table (query, rule_idx, scorer, score) of the cheap scorers, higher is better.

    ``neighbours`` has query, rule_idx, molecules, ec, sim, sim_all and prior, and may have
    plausibility (an edge score: the scorer ``enzymatic``, 0 where it is missing); ``closeness``
    has mol and closeness.
    """
    parts = neighbours.select("query", "rule_idx", F.explode("molecules").alias("mol")).join(closeness, "mol", "left").na.fill(0.0, ["closeness"])
    near = parts.groupBy("query", "rule_idx").agg(F.min("closeness").alias("worst"), F.max("closeness").alias("best"))
    wide = neighbours.join(near, ["query", "rule_idx"], "left").na.fill(0.0, ["worst", "best"])
    has_ec = (F.size("ec") > 0).cast("double")
    scorers = {
        "arbitrary": 0.0 - F.col("rule_idx").cast("double"), "template_prior": 0.0 - F.col("prior").cast("double"), "native_similarity": F.col("sim"),
        "native_similarity_all": F.col("sim_all"), "closeness_worst": F.col("worst"), "closeness_best": F.col("best"), "has_ec": has_ec,
        "fewer_precursors": -F.size("molecules").cast("double"), "similarity_x_ec": F.col("sim") * (0.5 + 0.5 * has_ec),
    }
    if "plausibility" in neighbours.columns:
        scorers["enzymatic"] = F.coalesce(F.nanvl(F.col("plausibility").cast("double"), F.lit(None)), F.lit(0.0))
    rows = F.array(*(F.struct(F.lit(n).alias("scorer"), c.alias("score")) for n, c in scorers.items()))
    return wide.select("query", "rule_idx", F.explode(rows).alias("x")).select("query", "rule_idx", "x.scorer", "x.score")


def molecule_scores(profile: DataFrame, profile_n: int = 50, near: float = 0.9, to_target: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(mol, sim, mean3, breadth, precedent, n_rules) from (mol, rule_idx, sim, n_reactions), over each molecule's best rules.

    ``to_target`` (mol, to_target) adds the similarity to the run's target, ``known`` (mol) the flag
    is_known; that flag looks at the answer, so no ordering may use it.
    """
    order = Window.partitionBy("mol").orderBy(F.desc("sim"), "rule_idx")
    whole = profile.groupBy("mol").agg(F.max("n_reactions").alias("precedent"), F.count("*").alias("n_rules"))
    top = profile.withColumn("r", F.row_number().over(order)).where(F.col("r") <= profile_n)
    best = top.groupBy("mol").agg(F.max("sim").alias("sim"), F.avg(F.when(F.col("r") <= 3, F.col("sim"))).alias("mean3"))
    broad = top.join(best.select("mol", F.col("sim").alias("m")), "mol").groupBy("mol").agg(F.count_if((F.col("sim") >= near * F.col("m")) & (F.col("m") > 0)).alias("breadth"))
    out = best.join(broad, "mol").join(whole, "mol")
    if to_target is not None:
        out = out.join(to_target.select("mol", "to_target"), "mol", "left")
    if known is not None:
        out = out.join(known.select("mol", F.lit(True).alias("is_known")).distinct(), "mol", "left").na.fill(False, ["is_known"])
    return out


def frontier_orders(frontier: DataFrame) -> DataFrame:
    """Long table (run, ordering, id, place) of the benchmark orderings of a frontier.

    Needs run, id, depth, sim, mean3, breadth, closeness, precedent, n_rules, heavy and to_target.
    """
    s, c, d, t, m = (F.col(x) for x in ("sim", "closeness", "depth", "to_target", "mean3"))
    up = {"depth_shallow": d, "few_rules": F.col("n_rules"), "small": F.col("heavy"), "far_from_target": t}
    down = {
        "depth_deep": d, "similarity": s, "closeness": c, "many_rules": F.col("n_rules"), "precedent": F.col("precedent"), "sim_mean3": m,
        "sim_breadth": F.col("breadth"), "sim_to_target": t, "sim x mean3": s * m, "sim - simtarget": s - t, "sim x (1-simtarget)": s * (1 - t),
        "sim x close": s * c, "sim - 0.05*depth": s - 0.05 * d, "sim / (1+depth)": s / (1 + d), "sim x deep": s * (1 + 0.2 * d),
    }
    values = [F.struct(F.lit("arbitrary").alias("ordering"), F.lit(0.0).alias("v"))]
    values += [F.struct(F.lit(n).alias("ordering"), v.cast("double").alias("v")) for n, v in up.items()]
    values += [F.struct(F.lit(n).alias("ordering"), (-v.cast("double")).alias("v")) for n, v in down.items()]
    long = frontier.select("run", "id", F.explode(F.array(*values)).alias("x")).select("run", "x.ordering", "id", "x.v")
    order = Window.partitionBy("run", "ordering").orderBy(F.asc_nulls_last("v"), "id")
    single = long.select("run", "ordering", "id", F.row_number().over(order).alias("place"))
    strat = stratify(frontier).select("run", F.lit("stratified").alias("ordering"), "id", "place")
    inner = stratify(frontier, [F.desc_nulls_last("sim")]).select("run", F.lit("sim, depth-strat").alias("ordering"), "id", "place")
    single = single.unionByName(strat).unionByName(inner)
    groups = {
        "portfolio (strat/sim)": ["stratified", "similarity"],
        "portfolio (strat/sim/prec)": ["stratified", "similarity", "precedent"],
        "portfolio (strat/sim/prec/small)": ["stratified", "similarity", "precedent", "small"],
        "portfolio (2x strat/sim/prec)": ["stratified", "stratified[1:]", "similarity", "precedent"],
    }
    entries = [
        F.struct(F.lit(g).alias("g"), F.lit(i).alias("member"), F.lit(n.removesuffix("[1:]")).alias("o"), F.lit(1 if n.endswith("[1:]") else 0).alias("skip"))
        for g, names in groups.items()
        for i, n in enumerate(names)
    ]
    needed = single.where(F.col("ordering").isin(*{n.removesuffix("[1:]") for names in groups.values() for n in names}))
    members = needed.select("run", "ordering", "id", "place", F.explode(F.filter(F.array(*entries), lambda e: e["o"] == F.col("ordering"))).alias("e"))
    members = members.where("place > e.skip").select(F.struct("run", "e.g").alias("run"), "e.member", (F.col("place") - F.col("e.skip")).alias("rank"), "id")
    merged = interleave(members).select("run.run", F.col("run.g").alias("ordering"), "id", "place")
    return single.unionByName(merged)


def route_ranks(routes: DataFrame) -> DataFrame:
    """Long table (run, ranking, route, place) from (run, route, n_steps, ec_coverage, enzymatic); ties keep the order of listing."""
    e = F.coalesce(F.when(~F.isnan("enzymatic"), F.col("enzymatic")), F.lit(-1.0))
    orders = {
        "enumeration": ["route"], "shortest": ["n_steps", F.desc("ec_coverage"), "route"], "enzymatic": [F.desc(e), "route"],
        "ec_coverage": [F.desc("ec_coverage"), "n_steps", "route"],
    }
    wide = routes.select("run", "route", *(F.row_number().over(Window.partitionBy("run").orderBy(*o)).alias(n) for n, o in orders.items()))
    long = F.explode(F.array(*(F.struct(F.lit(n).alias("ranking"), F.col(n).alias("place")) for n in orders))).alias("x")
    return wide.select("run", "route", long).select("run", "x.ranking", "route", "x.place")


def strictest_radius(found: DataFrame) -> DataFrame:
    """Of (step, radius, n): the row of each step's largest radius that has a candidate, null radius if none has."""
    best = found.groupBy("step").agg(F.max_by(F.struct("radius", "n"), F.when(F.col("n") > 0, F.col("radius"))).alias("x"))
    return best.select("step", F.when(F.col("x.n") > 0, F.col("x.radius")).alias("radius"), F.when(F.col("x.n") > 0, F.col("x.n")).alias("n"))
