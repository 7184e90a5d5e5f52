"""Registered queries: evaluation tables, rankings, recovery, enrichment, corpora, learned scores and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalars import first_block, looks_unnamed, parse_choice, ratio, shown_candidates
from ..functions.stats import auc, auc_interval, geometric_mean
from ..operators import completion as C
from ..operators import corpus as E
from ..operators import learned as M
from ..operators.enrich import complete_reactions, label_sink, render_reaction
from ..storage import settled, shared_dir
from ..streaming import decisions as T
from . import bindings as B
from . import ranking as R
from . import recovery as Y
from . import tables as A
from .registry import query

WITH_RUNS = f"WITH {B.RUNS}"
BUDGETS, TIMES = [10, 25, 50, 100], [1.0, 5.0, 10.0]


def _rounded(df, *names, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


# runs


@query(
    f"""{WITH_RUNS}, ps AS (SELECT policy, budget, seed, 100.0::DOUBLE * avg(CASE WHEN solved_at <= budget THEN 1.0 ELSE 0.0 END) AS rate FROM runs, (SELECT unnest([10, 25, 50, 100]) AS budget) GROUP BY ALL)
  SELECT policy, CAST(budget AS INT) AS budget, round(avg(rate), 6) AS mean, round(coalesce(stddev_samp(rate), 0), 6) AS sd, count(*) AS n_seeds FROM ps GROUP BY policy, budget"""
)
def q31_solve_rate_curve(spark, d):
    return _rounded(A.solve_rate_curve(B.runs(spark, d), BUDGETS), "mean", "sd")


@query(
    f"""{WITH_RUNS} SELECT policy, round(avg(solved_at), 6) AS exp2sol, round(100.0::DOUBLE * avg(CAST(expandable AS INT)), 6) AS ceiling, round(avg(shortest_route), 6) AS route,
    round(avg(reference_route) FILTER (WHERE shortest_route IS NOT NULL), 6) AS reference, round(100.0::DOUBLE * avg(ec_known), 6) AS ec_percent, round(sum(elapsed_s), 6) AS seconds,
    CAST(sum(llm_calls) AS BIGINT) AS calls, CAST(sum(llm_fallbacks) AS BIGINT) AS fallbacks FROM runs GROUP BY policy"""
)
def q32_efficiency(spark, d):
    return _rounded(A.efficiency(B.runs(spark, d)), "exp2sol", "ceiling", "route", "reference", "ec_percent", "seconds")


@query(f"{WITH_RUNS} SELECT policy, reference_route, count(*) FILTER (WHERE solved) AS solved, count(*) AS runs FROM runs WHERE reference_route > 0 GROUP BY ALL")
def q33_strata(spark, d):
    return A.strata(B.runs(spark, d))


@query(
    f"""{WITH_RUNS}, ps AS (SELECT policy, t AS seconds, seed, 100.0::DOUBLE * avg(CASE WHEN solved AND elapsed_s <= t THEN 1.0 ELSE 0.0 END) AS rate FROM runs, (SELECT unnest([1.0::DOUBLE, 5.0, 10.0]) AS t) GROUP BY ALL),
  cs AS (SELECT policy, min(elapsed_s) FILTER (WHERE NOT solved AND stopped_because IN ('budget', 'time')) AS c FROM runs GROUP BY policy)
  SELECT ps.policy, seconds, round(avg(rate), 6) AS mean, round(coalesce(stddev_samp(rate), 0), 6) AS sd, count(*) AS n_seeds, round(any_value(c), 6) AS censored_at, coalesce(seconds > any_value(c), false) AS bound
  FROM ps JOIN cs USING (policy) GROUP BY ps.policy, seconds"""
)
def q34_time_curve(spark, d):
    return _rounded(A.time_curve(B.runs(spark, d), TIMES), "mean", "sd", "censored_at")


@query(
    f"""{WITH_RUNS} SELECT policy, count(*) FILTER (WHERE solved) AS solved, round(sum(elapsed_s) / sum(n_expansions), 6) AS s_per_expansion, round(sum(elapsed_s) / nullif(count(*) FILTER (WHERE solved), 0), 6) AS s_per_solved,
    round(sum(n_expansions)::DOUBLE / nullif(count(*) FILTER (WHERE solved), 0), 6) AS expansions_per_solved, CAST(sum(llm_calls) AS BIGINT) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens,
    round(sum(tokens)::DOUBLE / nullif(count(*) FILTER (WHERE solved), 0), 6) AS tokens_per_solved FROM runs GROUP BY policy"""
)
def q35_cost_per_solved(spark, d):
    return _rounded(A.cost_per_solved(B.runs(spark, d)), "s_per_expansion", "s_per_solved", "expansions_per_solved", "tokens_per_solved")


@query(
    f"""{WITH_RUNS} SELECT policy, round(avg(shortest_route), 6) AS route, round(avg(reference_route), 6) AS reference, round(avg(shortest_route) - avg(reference_route), 6) AS delta, round(100.0::DOUBLE * avg(ec_known), 6) AS ec_percent
  FROM runs WHERE shortest_route IS NOT NULL GROUP BY policy"""
)
def q36_route_quality(spark, d):
    return _rounded(A.route_quality(B.runs(spark, d)), "route", "reference", "delta", "ec_percent")


@query(
    f"""{WITH_RUNS}, ce AS (SELECT target, seed, bool_or(coalesce(solved_at <= 25, false)) FILTER (WHERE policy = 'click') AS x, bool_or(coalesce(solved_at <= 25, false)) FILTER (WHERE policy = 'view') AS y FROM runs GROUP BY target, seed),
  ct AS (SELECT count(*) AS cells, count(*) FILTER (WHERE x AND y) AS both_solve, count(*) FILTER (WHERE NOT x AND NOT y) AS neither, count(*) FILTER (WHERE x AND NOT y) AS only_first, count(*) FILTER (WHERE NOT x AND y) AS only_second FROM ce WHERE x IS NOT NULL AND y IS NOT NULL),
  lo AS (SELECT coalesce(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))), 0) AS low FROM (SELECT only_first + only_second AS n, least(only_first, only_second) AS k, unnest(range(0, least(only_first, only_second) + 1)) AS i FROM ct))
  SELECT cells, both_solve, neither, only_first, only_second, round(least(1.0, 2 * low), 6) AS p FROM ct, lo"""
)
def q37_paired_sign_test(spark, d):
    return _rounded(A.paired(B.runs(spark, d), "click", "view", 25), "p")


@query(
    f"""{WITH_RUNS}, sd AS (SELECT count(DISTINCT seed) AS n FROM runs) SELECT policy, count(DISTINCT target) AS targets, count(*) AS runs, round(100.0::DOUBLE * count(DISTINCT target) / 200, 6) AS target_percent,
    round(100.0::DOUBLE * count(*) / (200 * any_value(n)), 6) AS run_percent, least(100.0::DOUBLE * count(DISTINCT target) / 200, 100.0::DOUBLE * count(*) / (200 * any_value(n))) < 95 AS too_partial FROM runs, sd GROUP BY policy"""
)
def q38_partial_coverage(spark, d):
    return _rounded(A.completeness(B.runs(spark, d), 200), "target_percent", "run_percent")


def _decisions(spark, d):
    """Events of a user as decisions in order of time; an event of value over 100 solves, and users 0 to 9 start solved."""
    e = B.table(spark, d, "events")
    from pyspark.sql import Window

    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = e.select(F.col("user_id").alias("run"), step.alias("step"), (F.col("value") > 100).alias("solved_after"), "value", "event_type", "event_id")
    before = e.select(F.col("user_id").alias("run"), (F.col("user_id") < 10).alias("solved_before")).distinct()
    return rows, before


STEPS = "st AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value > 100 AS solved_after, value, event_type, event_id FROM events)"


@query(f"WITH {STEPS} SELECT run, CAST(CASE WHEN run < 10 THEN 0 ELSE min(step) FILTER (WHERE solved_after) + 1 END AS INT) AS solved_at FROM st GROUP BY run")
def q39_first_solved(spark, d):
    return A.first_solved(*_decisions(spark, d))


# rankings


def _candidates(spark, d):
    """Orders as queries, their lines as candidates; a returned line is attested."""
    line = B.table(spark, d, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("rule_idx")).agg(F.max("l_discount").alias("score"), F.max((F.col("l_returnflag") == "R")).alias("attested"))


CANDIDATES = "cd AS (SELECT l_orderkey AS query, l_linenumber AS rule_idx, max(l_discount) AS score, bool_or(l_returnflag = 'R') AS attested FROM lineitem GROUP BY ALL)"
RANKS = f"{CANDIDATES}, rn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rule_idx) AS rank FROM cd), fo AS (SELECT query, min(rank) FILTER (WHERE attested) AS rank, count(*) AS n FROM rn GROUP BY query)"


@query(f"WITH {RANKS} SELECT query, CAST(rank AS INT) AS rank, n FROM fo")
def q41_attested_rank(spark, d):
    return R.attested_rank(_candidates(spark, d))


@query(
    f"""WITH {CANDIDATES}, rn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, md5('9:' || query || ':' || rule_idx)) AS rank FROM cd)
  SELECT query, CAST(min(rank) FILTER (WHERE attested) AS INT) AS rank, count(*) AS n FROM rn GROUP BY query"""
)
def q41_rank_random_ties(spark, d):
    return R.attested_rank(_candidates(spark, d), ties=R.random_ties(9, "rule_idx"))


@query(
    f"""WITH {RANKS} SELECT count(*) AS queries, count(rank) AS found, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr_all, round(avg(1.0::DOUBLE / rank), 6) AS mrr_found,
    round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS cov1_all, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS cov3_all,
    round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rank IS NOT NULL), 6) AS cov1_found, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE rank IS NOT NULL), 6) AS cov3_found,
    round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n > 1), 6) AS cov1_big, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) FILTER (WHERE n > 3), 6) AS cov3_big,
    quantile_cont(CAST(rank AS DOUBLE), 0.5) AS median, CAST((list_sort(list(rank) FILTER (WHERE rank IS NOT NULL)))[1 + count(rank) // 2] AS INT) AS upper_median, round(avg(rank::DOUBLE / n), 6) AS normalised_rank FROM fo"""
)
def q42_coverage_mrr(spark, d):
    """Coverage, reciprocal rank and the three kinds of denominators and medians."""
    out = R.coverage_table(R.attested_rank(_candidates(spark, d)), (1, 3))
    return _rounded(out, *(c for c in out.columns if c[:3] in ("mrr", "cov", "nor")))


def _neighbours(spark, d):
    line, order = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    own = line.groupBy(F.col("l_orderkey").alias("rule_idx")).agg(
        F.array_sort(F.collect_set("l_partkey")).alias("molecules"), F.round(F.avg("l_discount"), 6).alias("sim"), F.max("l_discount").alias("sim_all"), F.min("l_tax").alias("prior"),
        F.when(F.max("l_returnflag") == "R", F.array(F.lit("1.1"))).otherwise(F.array().cast("array<string>")).alias("ec"),
    )
    return own.join(order.select(F.col("o_orderkey").alias("rule_idx"), F.col("o_custkey").alias("query")), "rule_idx")


@query(
    """WITH nb AS (SELECT o_custkey AS query, l_orderkey AS rule_idx, count(DISTINCT l_partkey) AS k, round(avg(l_discount), 6) AS sim, max(l_discount) AS sim_all, min(l_tax) AS prior, CASE WHEN max(l_returnflag) = 'R' THEN 1.0::DOUBLE ELSE 0.0 END AS ec,
    min(1 - p_size / 50.0::DOUBLE) AS worst, max(1 - p_size / 50.0::DOUBLE) AS best FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)
  SELECT query, rule_idx, s.n AS scorer, round(s.v, 6) AS score FROM (SELECT query, rule_idx, unnest([{'n': 'arbitrary', 'v': 0 - rule_idx::DOUBLE}, {'n': 'template_prior', 'v': 0 - prior}, {'n': 'native_similarity', 'v': sim}, {'n': 'native_similarity_all', 'v': sim_all},
    {'n': 'closeness_worst', 'v': worst}, {'n': 'closeness_best', 'v': best}, {'n': 'has_ec', 'v': ec}, {'n': 'fewer_precursors', 'v': -k::DOUBLE}, {'n': 'similarity_x_ec', 'v': sim * (0.5 + 0.5 * ec)},
    {'n': 'enzymatic', 'v': CASE WHEN rule_idx % 3 = 0 THEN 0.0 ELSE 1 - 5 * sim_all END}]) AS s FROM nb)"""
)
def q43_candidate_scorers(spark, d):
    near = B.table(spark, d, "part").select(F.col("p_partkey").alias("mol"), (1 - F.col("p_size") / 50).alias("closeness"))
    plausible = F.when(F.col("rule_idx") % 3 != 0, 1 - 5 * F.col("sim_all"))
    return _rounded(R.candidate_scores(_neighbours(spark, d).withColumn("plausibility", plausible), near), "score")


@query(
    """WITH pf AS (SELECT l_partkey AS mol, l_orderkey AS rule_idx, max(l_discount) AS sim, count(*) AS n_reactions FROM lineitem GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY mol ORDER BY sim DESC, rule_idx) AS r FROM pf), m AS (SELECT mol, max(sim) AS m FROM pf GROUP BY mol)
  SELECT rk.mol, round(max(sim), 6) AS sim, round(avg(sim) FILTER (WHERE r <= 3), 6) AS mean3, count(*) FILTER (WHERE sim >= 0.9::DOUBLE * m AND m > 0 AND r <= 50) AS breadth, CAST(max(n_reactions) AS BIGINT) AS precedent, count(*) AS n_rules
  FROM rk JOIN m ON m.mol = rk.mol GROUP BY rk.mol"""
)
def q44_molecule_scores(spark, d):
    profile = B.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("mol"), F.col("l_orderkey").alias("rule_idx")).agg(F.max("l_discount").alias("sim"), F.count("*").alias("n_reactions"))
    out = R.molecule_scores(profile)
    return _rounded(out, "sim", "mean3").select("mol", "sim", "mean3", "breadth", "precedent", "n_rules")


def _orders_sql() -> str:
    up = {"arbitrary": "0.0", "depth_shallow": "depth", "few_rules": "n_rules", "small": "heavy", "far_from_target": "to_target"}
    down = {
        "depth_deep": "depth", "similarity": "sim", "closeness": "closeness", "many_rules": "n_rules", "precedent": "precedent", "sim_mean3": "mean3", "sim_breadth": "breadth", "sim_to_target": "to_target",
        "sim x mean3": "sim * mean3", "sim - simtarget": "sim - to_target", "sim x (1-simtarget)": "sim * (1 - to_target)", "sim x close": "sim * closeness", "sim - 0.05*depth": "sim - 0.05::DOUBLE * depth",
        "sim / (1+depth)": "sim / (1 + depth)", "sim x deep": "sim * (1 + 0.2::DOUBLE * depth)",
    }
    rows = [f"SELECT run, '{n}' AS ordering, id, row_number() OVER (PARTITION BY run ORDER BY CAST({v} AS DOUBLE) NULLS LAST, id) AS place FROM fx" for n, v in up.items()]
    rows += [f"SELECT run, '{n}', id, row_number() OVER (PARTITION BY run ORDER BY -CAST({v} AS DOUBLE) NULLS LAST, id) FROM fx" for n, v in down.items()]
    for n, inner in (("stratified", "id"), ("sim, depth-strat", "sim DESC NULLS LAST, id")):
        rows.append(f"SELECT run, '{n}', id, row_number() OVER (PARTITION BY run ORDER BY turn, depth) FROM (SELECT *, row_number() OVER (PARTITION BY run, depth ORDER BY {inner}) AS turn FROM fx)")
    groups = {
        "portfolio (strat/sim)": [("stratified", 0), ("similarity", 0)], "portfolio (strat/sim/prec)": [("stratified", 0), ("similarity", 0), ("precedent", 0)],
        "portfolio (strat/sim/prec/small)": [("stratified", 0), ("similarity", 0), ("precedent", 0), ("small", 0)],
        "portfolio (2x strat/sim/prec)": [("stratified", 0), ("stratified", 1), ("similarity", 0), ("precedent", 0)],
    }
    merged = [
        f"SELECT run, '{g}', id, row_number() OVER (PARTITION BY run ORDER BY min(k), id) FROM ("
        + " UNION ALL ".join(f"SELECT run, id, (place - {s}) * 10 + {i} AS k FROM og WHERE ordering = '{n}' AND place > {s}" for i, (n, s) in enumerate(members))
        + ") GROUP BY run, id"
        for g, members in groups.items()
    ]
    fx = "fx AS MATERIALIZED (SELECT *, round(sim * 0.8, 6) AS mean3, n_rules % 5 AS breadth, round(1 - closeness, 6) AS to_target FROM fr)"
    return f"WITH {B.FRONTIER}, {fx}, og AS MATERIALIZED ({' UNION ALL '.join(rows)}) SELECT run, ordering, id, CAST(place AS INT) AS place FROM (SELECT * FROM og UNION ALL {' UNION ALL '.join(merged)})"


@query(_orders_sql())
def q45_frontier_orders(spark, d):
    """All benchmark orderings of the frontiers, portfolios included."""
    front = B.frontier(spark, d).withColumn("mean3", F.round(F.col("sim") * 0.8, 6)).withColumn("breadth", F.col("n_rules") % 5).withColumn("to_target", F.round(1 - F.col("closeness"), 6))
    return R.frontier_orders(front)


@query(
    """WITH rt AS (SELECT o_custkey AS run, o_orderkey AS route, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS ec, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE round(avg(l_discount), 6) END AS en
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey, o_orderstatus)
  SELECT run, 'enumeration' AS ranking, route, CAST(row_number() OVER (PARTITION BY run ORDER BY route) AS INT) AS place FROM rt UNION ALL SELECT run, 'shortest', route, CAST(row_number() OVER (PARTITION BY run ORDER BY n, ec DESC, route) AS INT) FROM rt
  UNION ALL SELECT run, 'enzymatic', route, CAST(row_number() OVER (PARTITION BY run ORDER BY coalesce(en, -1) DESC, route) AS INT) FROM rt UNION ALL SELECT run, 'ec_coverage', route, CAST(row_number() OVER (PARTITION BY run ORDER BY ec DESC, n, route) AS INT) FROM rt"""
)
def q46_route_ranks(spark, d):
    both = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    routes = both.groupBy(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("route"), "o_orderstatus").agg(
        F.count("*").alias("n_steps"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 6).alias("ec_coverage"), F.round(F.avg("l_discount"), 6).alias("e")
    )
    return R.route_ranks(routes.withColumn("enzymatic", F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.col("e"))))


@query(
    """WITH f AS (SELECT o_custkey AS step, month(o_orderdate) AS radius, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders GROUP BY ALL)
  SELECT step, CAST(max(radius) FILTER (WHERE n > 0) AS INT) AS radius, arg_max(n, radius) FILTER (WHERE n > 0) AS n FROM f GROUP BY step"""
)
def q47_radius_ladder(spark, d):
    orders = B.table(spark, d, "orders")
    found = orders.groupBy(F.col("o_custkey").alias("step"), F.month("o_orderdate").alias("radius")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return R.strictest_radius(found)


# recovery

SETS = """
wn AS (SELECT o_custkey AS route, o_orderkey AS step, list_sort(list(DISTINCT l_suppkey % 8) FILTER (WHERE l_returnflag <> 'A')) AS want FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
gt AS (SELECT l_orderkey AS step, l_linestatus AS status, min(l_linenumber) AS rule_idx, list_sort(list(DISTINCT l_suppkey % 8)) AS got FROM lineitem GROUP BY l_orderkey, l_linestatus)"""


def _step_sets(spark, d):
    line, orders = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    mol = F.col("l_suppkey") % 8
    steps = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("step")).agg(
        F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "A", mol))).alias("want")
    )
    got = line.groupBy(F.col("l_orderkey").alias("step"), "l_linestatus").agg(F.min("l_linenumber").alias("rule_idx"), F.array_sort(F.collect_set(mol)).alias("got"))
    return steps, got


CLASSIFIED = f"""{SETS},
rl AS (SELECT wn.route, wn.step, rule_idx, CASE WHEN want = got THEN 0 WHEN len(list_intersect(want, got)) = len(want) THEN 1 WHEN len(list_intersect(want, got)) > 0 THEN 2 ELSE 3 END AS o FROM wn LEFT JOIN gt USING (step) WHERE want IS NOT NULL AND len(want) > 0),
cl AS (SELECT route, step, ['exact', 'contains', 'partial', 'missing'][1 + min(o)] AS outcome, count(*) AS n, CASE WHEN min(o) < 3 THEN min(CASE WHEN o = 0 THEN rule_idx END) END AS r0, arg_min(rule_idx, o * 100 + rule_idx) AS r, min(o) AS o FROM rl GROUP BY route, step
  UNION ALL SELECT route, step, 'degenerate', (SELECT count(*) FROM gt WHERE gt.step = wn.step), NULL, NULL, 4 FROM wn WHERE want IS NULL OR len(want) = 0)"""


@query(f"WITH {CLASSIFIED} SELECT route, step, outcome, n AS n_neighbours, CASE WHEN o < 3 THEN r END AS rule_idx FROM cl")
def q51_step_classes(spark, d):
    return Y.classify_steps(*_step_sets(spark, d))


@query(
    f"""WITH {CLASSIFIED}, re AS (SELECT * FROM cl WHERE outcome <> 'degenerate'), rt AS (SELECT route, bool_and(outcome = 'exact') AS f, count(*) FILTER (WHERE outcome <> 'exact') AS b FROM re GROUP BY route)
  SELECT count(*) AS steps, count(*) FILTER (WHERE outcome = 'exact') AS exact, count(*) FILTER (WHERE outcome = 'contains') AS contains, count(*) FILTER (WHERE outcome = 'partial') AS partial, count(*) FILTER (WHERE outcome = 'missing') AS missing,
    (list_sort(list(n) FILTER (WHERE outcome = 'exact')))[1 + count(*) FILTER (WHERE outcome = 'exact') // 2] AS median_candidates, (SELECT count(*) FROM rt) AS routes, (SELECT count(*) FROM rt WHERE f) AS routes_exact, (SELECT max(b) FROM rt) AS most_broken FROM re"""
)
def q51_step_coverage(spark, d):
    return Y.step_coverage(Y.classify_steps(*_step_sets(spark, d)))


@query(
    """WITH fd AS (SELECT o_custkey AS run, o_orderkey AS route, list_sort(list(DISTINCT l_suppkey % 8)) AS mols FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
  rf AS (SELECT o_custkey AS run, list_sort(list(DISTINCT l_suppkey % 8)) AS ref FROM (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey) JOIN lineitem ON l_orderkey = k GROUP BY o_custkey),
  x AS (SELECT run, len(list_intersect(mols, ref)) AS i, len(mols) AS m, len(ref) AS r FROM fd JOIN rf USING (run)), y AS (SELECT run, CASE WHEN i = m AND i = r THEN 0 WHEN i = r THEN 1 WHEN i = m THEN 2 WHEN i > 0 THEN 3 ELSE 4 END AS o, i::DOUBLE / (m + r - i) AS j FROM x)
  SELECT run, ['exact', 'covers', 'shortcut', 'partial', 'miss'][1 + min(o)] AS class, round(max(j), 6) AS jaccard, count(*) AS n_routes FROM y GROUP BY run"""
)
def q52_route_recovery(spark, d):
    line, orders = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    both = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    found = both.groupBy(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("route")).agg(F.collect_set(F.col("l_suppkey") % 8).alias("mols")).withColumn("target", F.col("run"))
    first = found.groupBy("target").agg(F.min_by("mols", "route").alias("ref"))
    return _rounded(Y.score_runs(Y.classify_routes(found, first)), "jaccard")


@query(
    """WITH g AS (SELECT o_custkey AS target, p_name AS mol, p_brand AS key, p_partkey AS node FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey),
  r AS (SELECT DISTINCT c_custkey AS target, p_name AS mol, p_brand AS key FROM customer JOIN part ON p_partkey = c_custkey)
  SELECT target, mol, coalesce((SELECT min(node) FROM g WHERE g.target = r.target AND g.mol = r.mol), (SELECT min(node) FROM g WHERE g.target = r.target AND g.key = r.key)) AS node FROM r"""
)
def q53_built_reference(spark, d):
    """A part for each customer's reference: by name among the parts it bought, else by brand."""
    part = B.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("mol"), F.col("p_brand").alias("key"))
    bought = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    graph = bought.select(F.col("o_custkey").alias("target"), "mol", "key", F.col("p_partkey").alias("node"))
    wanted = B.table(spark, d, "customer").join(part, F.col("c_custkey") == F.col("p_partkey")).select(F.col("c_custkey").alias("target"), "mol", "key")
    return Y.built_reference(wanted.distinct(), graph)


@query(
    """SELECT o_custkey AS run, o_orderkey AS route, CASE WHEN count(CASE WHEN l_returnflag <> 'A' THEN 1 END) = 0 THEN NULL ELSE round(exp(avg(CASE WHEN l_returnflag <> 'A' THEN ln(greatest(l_discount, 0.0001)) END)), 6) END AS per_step
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""
)
def q54_route_plausibility(spark, d):
    """Geometric means of step scores; unknown ones (flag A) are NaN and left out, and a route of none is null here."""
    both = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = both.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("route"), F.when(F.col("l_returnflag") == "A", float("nan")).otherwise(F.col("l_discount")).alias("score"))
    return _rounded(Y.route_plausibility(edges), "per_step").withColumn("per_step", F.nanvl("per_step", F.lit(None)))


@query("SELECT c_custkey AS run, CASE WHEN count(o_orderkey) = 0 THEN NULL ELSE round(avg(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 0.0 ELSE 1.0 END), 6) END AS share FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def q55_enzymatic_share(spark, d):
    """Share of annotated steps of each customer's orders; null for none."""
    orders = B.table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("rxn"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.array(F.lit("1"))).otherwise(F.array().cast("array<string>")).alias("ec"))
    steps = B.table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("run"), "rxn", "ec")
    return _rounded(Y.enzymatic_share(steps), "share").withColumn("share", F.nanvl("share", F.lit(None)))


@query(
    """WITH s AS (SELECT l_returnflag, l_discount, l_orderkey, l_linenumber, (l_returnflag = 'R') AS y FROM lineitem), g AS (SELECT l_discount AS v, count(*) AS n, count(*) FILTER (WHERE y) AS p FROM s GROUP BY l_discount),
  r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE AS mid FROM g), t AS (SELECT sum(p)::DOUBLE AS p, sum(n - p)::DOUBLE AS q, sum(p * mid) AS rs FROM r),
  a AS (SELECT p, q, (rs - p * (p + 1) / 2) / (p * q) AS a FROM t), e AS (SELECT a, sqrt(greatest((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (q - 1) * (2 * a * a / (1 + a) - a * a)) / (p * q), 0)) AS se FROM a)
  SELECT round(a, 6) AS auc, round(se, 6) AS se, round(a - 1.96::DOUBLE * se, 6) AS low, round(a + 1.96::DOUBLE * se, 6) AS high FROM e"""
)
def q56_auc_interval(spark, d):
    """Area under the curve of the discount for returned lines, with its interval; ranks come from counts by value."""
    from pyspark.sql import Window

    by_value = B.table(spark, d, "lineitem").groupBy(F.col("l_discount").alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("p"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each distinct value
    sums = by_value.withColumn("mid", before + (F.col("n") + 1) / 2).agg(F.sum("p").cast("double").alias("p"), F.sum(F.col("n") - F.col("p")).cast("double").alias("q"), F.sum(F.col("p") * F.col("mid")).alias("rs"))
    out = sums.withColumn("auc", auc(F.col("p"), F.col("q"), F.col("rs")))
    error, low, high = auc_interval(F.col("auc"), F.col("p"), F.col("q"))
    return _rounded(out.select("auc", error.alias("se"), low.alias("low"), high.alias("high")), "auc", "se", "low", "high")


@query(
    """WITH r AS (SELECT p_retailprice + p_partkey / 1000000.0::DOUBLE AS score, CAST(p_size > 25 AS INT) AS label, p_partkey AS id FROM part), b AS (SELECT *, ntile(5) OVER (ORDER BY score, id) - 1 AS bin FROM r)
  SELECT CAST(bin AS INT) AS bin, round(avg(score), 4) AS predicted, round(avg(label), 6) AS observed, count(*) AS n FROM b GROUP BY bin"""
)
def q57_reliability(spark, d):
    rows = B.table(spark, d, "part").select((F.col("p_retailprice") + F.col("p_partkey") / 1000000).alias("score"), (F.col("p_size") > 25).cast("int").alias("label"), F.col("p_partkey").alias("id"))
    out = M.reliability(rows)
    return out.select("bin", F.round("predicted", 4).alias("predicted"), F.round("observed", 6).alias("observed"), "n")


# enrichment and completion


def _equations(spark, d):
    """An order is an equation: its suppliers with quantities make its parts."""
    line = B.table(spark, d, "lineitem")
    term = lambda p, key, n: F.concat(F.lit(""), F.col(n).cast("int").cast("string"), F.lit(f" {p}"), F.col(key), F.lit("@C"))
    sides = line.groupBy(F.col("l_orderkey").alias("o")).agg(
        F.array_join(F.array_sort(F.collect_set(term("S", "l_suppkey", "l_linenumber"))), " + ").alias("l"), F.array_join(F.array_sort(F.collect_set(term("P", "l_partkey", "l_linenumber"))), " + ").alias("r")
    )
    equations = sides.select(F.concat(F.lit("R"), "o").alias("id"), F.concat("l", F.lit(" = "), "r").alias("equation"), F.when(F.col("o") % 3 == 0, "1.1;NOEC;2.2").otherwise("NOEC").alias("classifs"), F.lit("B").alias("is_balanced"))
    parts = B.table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("smiles"))
    order = B.table(spark, d, "orders")
    rules = order.select(F.col("o_orderkey").alias("rule_idx"), F.concat(F.lit("R"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "_R2L__split1").otherwise("_L2R"), F.lit("|R0_L2R")).alias("reaction_id"))
    return rules, equations, parts


@query(
    """WITH s AS (SELECT l_orderkey AS o, string_agg(t, ' + ' ORDER BY k) AS l FROM (SELECT DISTINCT l_orderkey, l_linenumber || ' S' || l_suppkey || '@C' AS k, CASE WHEN l_linenumber = 1 THEN '' ELSE l_linenumber || ' ' END || 'S' || l_suppkey AS t FROM lineitem) GROUP BY o),
  p AS (SELECT l_orderkey AS o, string_agg(t, ' + ' ORDER BY k) AS r FROM (SELECT DISTINCT l_orderkey, l_linenumber || ' P' || l_partkey || '@C' AS k, CASE WHEN l_linenumber = 1 THEN '' ELSE l_linenumber || ' ' END || p_name AS t FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY o)
  SELECT o_orderkey AS rule_idx, CASE WHEN o_orderstatus = 'F' THEN 'R2L' ELSE 'L2R' END AS direction, CASE WHEN o_orderstatus = 'F' THEN r || ' --> ' || l ELSE l || ' --> ' || r END AS equation, CASE WHEN o_orderkey % 3 = 0 THEN '1.1,2.2' ELSE '' END AS ec
  FROM orders JOIN s ON s.o = o_orderkey JOIN p ON p.o = o_orderkey"""
)
def q61_complete_reactions(spark, d):
    out = complete_reactions(*_equations(spark, d), max_per_rule=1)
    return out.select("rule_idx", "direction", render_reaction(F.col("substrates"), F.col("products")).alias("equation"), F.array_join("ec", ",").alias("ec"))


def _role_tables(spark, d):
    """Steps are orders; candidate sources are the customer's other orders of the same priority."""
    line, orders = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey"))
    numbered = line.select(F.col("l_orderkey").alias("rxn"), number.alias("i"), "l_suppkey", "l_partkey")

    def side(key: str):
        ordered = F.sort_array(F.collect_list(F.struct("i", F.col(key).alias("k"))))
        elements = lambda k: F.create_map(F.lit("C"), (k % 5).cast("int"), F.lit("O"), (k % 3).cast("int"))
        return F.transform(ordered, lambda x: F.struct(x["k"].cast("string").alias("key"), F.concat(F.lit("n"), x["k"].cast("string")).alias("name"), elements(x["k"]).alias("elements")))

    sides = numbered.groupBy("rxn").agg(side("l_suppkey").alias("left"), side("l_partkey").alias("right"))
    first = line.groupBy(F.col("l_orderkey").alias("step")).agg(F.min(F.struct("l_linenumber", "l_suppkey", "l_partkey")).alias("f"))
    steps = first.select("step", F.col("f.l_partkey").cast("string").alias("made"), F.col("f.l_suppkey").cast("string").alias("used"), (F.col("f.l_partkey") % 5 - F.col("f.l_suppkey") % 5).cast("int").alias("c"), (F.col("f.l_partkey") % 3 - F.col("f.l_suppkey") % 3).cast("int").alias("o"))
    delta = F.map_filter(F.create_map(F.lit("C"), F.col("c"), F.lit("O"), F.col("o")), lambda _, v: v != 0)
    steps = steps.select("step", "made", "used", delta.alias("delta"))
    own = orders.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("step"))
    other = orders.select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("rxn"))
    pairs = own.join(other, ["o_custkey", "o_orderpriority"]).where("step <> rxn").select("step", "rxn")
    return steps, pairs.withColumn("place", F.col("rxn")), sides


ROLES = """WITH fs AS (SELECT l_orderkey AS step, min({'n': l_linenumber, 's': l_suppkey, 'p': l_partkey}) AS f FROM lineitem GROUP BY l_orderkey),
  pr AS (SELECT a.o_orderkey AS step, b.o_orderkey AS rxn FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.o_orderkey <> b.o_orderkey),
  ln AS (SELECT l_orderkey AS rxn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS i, l_suppkey AS s, l_partkey AS p, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
  sc AS (SELECT pr.step, pr.rxn, true AS agrees, x.i AS i, y.i AS j, x.s AS a, y.p AS b, 2 * x.n AS n FROM pr JOIN ln x ON x.rxn = pr.rxn JOIN ln y ON y.rxn = pr.rxn
    UNION ALL SELECT pr.step, pr.rxn, false, x.i, y.i, x.p, y.s, 2 * x.n FROM pr JOIN ln x ON x.rxn = pr.rxn JOIN ln y ON y.rxn = pr.rxn),
  tt AS (SELECT sc.*, a = f.s AND b = f.p AS exact, b % 5 - a % 5 = f.p % 5 - f.s % 5 AND b % 3 - a % 3 = f.p % 3 - f.s % 3 AS same FROM sc JOIN fs USING (step)),
  bs AS (SELECT *, (1000 * CAST(exact AS INT) + 100 * CAST(same AS INT)) * 100 - n AS score FROM tt WHERE exact OR same)"""


@query(
    f"""{ROLES}
  SELECT step, rxn, agrees, CAST(i AS INT) AS consumed_at, CAST(j AS INT) AS released_at, exact, CAST(score AS INT) AS score FROM bs QUALIFY row_number() OVER (PARTITION BY step ORDER BY score DESC, rxn, agrees DESC, i, j) = 1"""
)
def q62_role_matching(spark, d):
    steps, candidates, sources = _role_tables(spark, d)
    return C.pick_reaction(steps, candidates, sources=sources)


@query(
    f"""{ROLES},
  ch AS (SELECT step, rxn, agrees, i, j, exact FROM bs QUALIFY row_number() OVER (PARTITION BY step ORDER BY score DESC, rxn, agrees DESC, i, j) = 1)
  SELECT step, ch.rxn, string_agg(CASE WHEN ln.i = ch.i THEN f.s WHEN agrees THEN s ELSE p END, ',' ORDER BY ln.i) AS consumed,
    string_agg(CASE WHEN ln.i = ch.j THEN f.p WHEN agrees THEN p ELSE s END, ',' ORDER BY ln.i) AS released, NOT any_value(exact) AS predicted
  FROM ch JOIN ln ON ln.rxn = ch.rxn JOIN fs USING (step) GROUP BY step, ch.rxn"""
)
def q62_completed_equations(spark, d):
    """The picked reaction of each step with the step's own molecules in their roles."""
    steps, candidates, sources = _role_tables(spark, d)
    steps, sources = settled(steps, "steps"), settled(sources, "sources")  # both are read twice
    out = C.complete_equation(C.pick_reaction(steps, candidates, sources=sources), candidates, steps, sources)
    return out.withColumn("consumed", F.array_join("consumed", ",")).withColumn("released", F.array_join("released", ","))


@query(
    """WITH n AS (SELECT DISTINCT o_custkey AS route, o_orderkey AS step, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey END AS key, l_suppkey % 7 AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'),
  m AS (SELECT DISTINCT o_custkey AS route, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey END AS key, l_suppkey % 7 AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
  SELECT route, step, key, name, coalesce(key IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 500), false) OR EXISTS (SELECT 1 FROM m WHERE m.route = n.route AND m.key = n.key) OR (key IS NULL AND EXISTS (SELECT 1 FROM m WHERE m.route = n.route AND m.name = n.name)) AS supplied FROM n"""
)
def q63_supplied(spark, d):
    both = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    keyed = lambda flag, k: both.where(F.col("l_returnflag") == flag).select(F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("step"), F.when(F.col("l_suppkey") % k != 0, F.col("l_suppkey")).alias("key"), (F.col("l_suppkey") % 7).alias("name"))
    sink = B.table(spark, d, "supplier").where("s_acctbal < 500").select(F.col("s_suppkey").alias("key"))
    return C.supplied(keyed("A", 4).distinct(), sink, keyed("R", 5)).select("route", "step", "key", "name", "supplied")


@query(
    """WITH t AS (SELECT l_orderkey AS step, l_linestatus AS side, l_partkey % 3 AS e, l_linenumber AS c, l_partkey % 4 AS k, l_discount < 0.1 AS ok FROM lineitem),
  w AS (SELECT step, bool_and(ok) AS complete FROM t GROUP BY step), s AS (SELECT step, e, coalesce(sum(c * k) FILTER (WHERE side = 'O' AND ok), 0) AS l, coalesce(sum(c * k) FILTER (WHERE side <> 'O' AND ok), 0) AS r FROM t GROUP BY step, e),
  q AS (SELECT step, bool_and(l = r OR e = 0) AS equal FROM s GROUP BY step)
  SELECT o_orderkey AS step, CASE WHEN o_orderstatus = 'F' AND complete AND equal THEN 'yes' WHEN o_orderstatus = 'F' AND complete THEN 'no' ELSE 'unknown' END AS balanced FROM orders LEFT JOIN w ON w.step = o_orderkey LEFT JOIN q ON q.step = o_orderkey"""
)
def q64_balance(spark, d):
    """Whether the two sides of an order (by line status) hold the same atoms, with stoichiometry."""
    line = B.table(spark, d, "lineitem")
    parts = line.select(
        F.col("l_orderkey").alias("step"), F.when(F.col("l_linestatus") == "O", "left").otherwise("right").alias("side"), F.col("l_linenumber").cast("double").alias("coefficient"),
        F.when(F.col("l_discount") < 0.1, F.create_map(F.element_at(F.array(F.lit("H"), F.lit("C"), F.lit("O")), (F.col("l_partkey") % 3 + 1).cast("int")), (F.col("l_partkey") % 4).cast("int"))).alias("elements"),
    )
    certified = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("step"), F.when(F.col("o_orderstatus") == "F", "B").alias("is_balanced"))
    return C.balance(C.side_tally(parts), certified)


@query(
    """WITH s AS (SELECT p_name AS mol, min(p_partkey) AS id FROM part GROUP BY p_name), t AS (SELECT c_mktsegment || c_custkey AS label, p_name AS mol FROM customer JOIN s ON s.id = c_custkey WHERE c_acctbal > 0)
  SELECT s.mol, coalesce(t.label, CASE WHEN p_size > 25 THEN p_brand END, CAST(s.id AS VARCHAR)) AS label FROM s JOIN part ON p_partkey = s.id LEFT JOIN t ON t.mol = s.mol""".replace("p_name AS mol FROM customer JOIN s", "s.mol FROM customer JOIN s")
)
def q65_sink_labels(spark, d):
    """First entry of each name; labelled by a title, else by a brand, else by its number."""
    part = B.table(spark, d, "part")
    sink = part.select(F.col("p_name").alias("mol"), F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("place"))
    first = part.groupBy(F.col("p_name").alias("mol")).agg(F.min("p_partkey").alias("k"))
    customer = B.table(spark, d, "customer")
    titles = first.join(customer, F.col("k") == F.col("c_custkey")).select("mol", F.concat("c_mktsegment", "c_custkey").alias("label"), F.when(F.col("c_acctbal") > 0, "titles").otherwise("unresolved").alias("source"))
    names = part.where("p_size > 25").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("name"))
    return label_sink(sink, titles, names)


# corpora



def _lower(c):
    return F.lower(c)


def _banned(spark, d):
    words = B.table(spark, d, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("key")).where(F.length("key") > 6).select(F.lower("key").alias("key"))
    return E.banned_keys(words, B.table(spark, d, "region").select(F.lower("r_name").alias("key")))


BANNED = "bn AS (SELECT DISTINCT lower(w) AS key FROM (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) > 6 UNION SELECT lower(r_name) FROM region)"


@query(f"WITH {B.PAIRS}, {BANNED} SELECT pair_id, depth FROM pr WHERE lower(target) NOT IN (SELECT key FROM bn)")
def q71_drop_targets(spark, d):
    return E.drop_targets(B.decision_pairs(spark, d), _banned(spark, d), _lower).select("pair_id", "depth")


@query(f"WITH {B.PAIRS}, {BANNED} SELECT pair_id, depth FROM pr WHERE pair_id NOT IN (SELECT pair_id FROM (SELECT pair_id, lower(unnest(words)) AS w FROM pr) WHERE w IN (SELECT key FROM bn))")
def q72_drop_shown(spark, d):
    return E.drop_shown(B.decision_pairs(spark, d), _banned(spark, d), _lower).select("pair_id", "depth")


@query("SELECT pair_id, CAST(n AS INT) AS n_shown, words[1] AS first FROM (SELECT pair_id, len(words) AS n, words FROM (WITH " + B.PAIRS + " SELECT * FROM pr))")
def q72_shown_candidates(spark, d):
    shown = shown_candidates(F.col("user"))
    return B.decision_pairs(spark, d).select("pair_id", F.size(shown).alias("n_shown"), F.get(shown, F.lit(0)).alias("first"))


@query(
    f"""WITH {B.PAIRS}, tg AS (SELECT DISTINCT 'Target molecule: ' || target AS g FROM pr), n AS (SELECT count(*) AS n FROM tg),
  hd AS (SELECT g FROM (SELECT g, row_number() OVER (ORDER BY md5('4:' || g), g) AS p FROM tg) WHERE p <= (SELECT greatest(1, CAST(floor(n * 0.2) AS BIGINT)) FROM n))
  SELECT pair_id, 'Target molecule: ' || target IN (SELECT g FROM hd) AS held FROM pr"""
)
def q73_group_split(spark, d):
    return E.split_groups(E.group_of(B.decision_pairs(spark, d)), "group", 0.2, 4).select("pair_id", "held")


@query(
    f"""WITH {B.PAIRS}, ct AS (SELECT count(*) FILTER (WHERE depth >= 4) AS deep, count(*) AS n FROM pr), sh AS (SELECT pair_id, depth, row_number() OVER (ORDER BY md5('2:' || pair_id), pair_id) AS p FROM pr WHERE depth < 4)
  SELECT pair_id, depth FROM pr WHERE depth >= 4 UNION ALL SELECT pair_id, depth FROM sh WHERE p <= (SELECT greatest(0, CAST(ceil(n * 0.6) AS BIGINT) - deep) FROM ct)"""
)
def q74_keep_deep(spark, d):
    """Deep decisions whole, shallow ones drawn, to three fifths of the corpus."""
    pairs = B.decision_pairs(spark, d)
    limit = -(-pairs.count() * 6 // 10)
    return E.keep_deep(pairs, 4, limit, 2).select("pair_id", "depth")


@query(f"WITH {B.PAIRS}, o AS (SELECT pair_id, row_number() OVER (ORDER BY md5('1:' || pair_id), pair_id) - 1 AS seed_index FROM pr) SELECT pair_id, seed_index FROM o WHERE seed_index >= 20 AND seed_index < 120")
def q75_slice(spark, d):
    """Routes 20 to 119 of the seeded order: the feature is the slice."""
    return E.part_of(B.decision_pairs(spark, d).select("pair_id"), 20, 100, 1, "pair_id").select("pair_id", F.col("seed_index").cast("long").alias("seed_index"))


@query(
    f"""WITH {B.PAIRS} SELECT pair_id, 'system' AS first_role, 'Target molecule: ' || target || chr(10) || 'Frontier candidates:' || chr(10) || coalesce(array_to_string(list_transform(words, lambda w, i: '[' || (i - 1) || '] ' || w || ' | depth=' || i), chr(10)), '') AS user_text,
    '{{"choice": ' || (turn % 3) || '}}' AS completion FROM pr"""
)
def q76_restamp_and_converse(spark, d):
    out = E.as_conversation(E.restamp(B.decision_pairs(spark, d), "new system"))
    return out.select("pair_id", F.col("prompt")[0]["role"].alias("first_role"), F.col("prompt")[1]["content"].alias("user_text"), F.col("completion")[0]["content"].alias("completion"))


@query(
    f"""WITH {STEPS}, sz AS (SELECT run FROM st GROUP BY run HAVING bool_or(solved_after) AND count(*) BETWEEN 10 AND 75)
  SELECT run AS episode, event_id, coalesce((SELECT max(k.p_size) FROM part k WHERE k.p_partkey = event_id AND k.p_size > 20), -1) AS depth FROM st JOIN sz USING (run) WHERE event_type <> 'error' AND CAST(floor(value) AS INT) % 5 > 1"""
)
def q77_self_play(spark, d):
    """Decisions of solved episodes of 10 to 75 steps, without fallbacks and forced choices; unknown depths are -1."""
    rows, _ = _decisions(spark, d)
    rows = rows.select(F.col("run").alias("episode"), "step", F.col("event_id").alias("mol"), (F.floor("value").cast("int") % 5).alias("n_candidates"), F.when(F.col("event_type") == "error", "api_error").alias("fallback"), F.col("solved_after").alias("solved"))
    depths = B.table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("mol"), F.col("p_size").alias("depth"))
    return E.self_play_pairs(rows, depths, 10, 75).select("episode", F.col("mol").alias("event_id"), "depth")


@query(
    """WITH v AS (SELECT l_orderkey AS decision, l_suppkey AS target, l_partkey AS mol, min(CASE WHEN l_linenumber <= 4 THEN l_linenumber END) AS place FROM lineitem GROUP BY ALL),
  j AS (SELECT v.*, CASE WHEN p_size % 3 = 0 THEN p_size END AS cost FROM v LEFT JOIN part ON p_partkey = mol)
  SELECT decision, target, arg_min(place, {'c': -cost, 'p': place}) FILTER (WHERE place IS NOT NULL AND cost IS NOT NULL) AS choice, count(*) FILTER (WHERE place IS NOT NULL AND cost IS NOT NULL) AS n_on_route, count(place) AS n_shown, count(*) AS n_frontier,
    CASE WHEN count(*) FILTER (WHERE place IS NOT NULL AND cost IS NOT NULL) > 0 THEN 'labelled' WHEN bool_or(place IS NULL AND cost IS NOT NULL) THEN 'truncated away' ELSE 'thread lost' END AS outcome FROM j GROUP BY decision, target"""
)
def q78_replay_labels(spark, d):
    line = B.table(spark, d, "lineitem")
    views = line.groupBy(F.col("l_orderkey").alias("decision"), F.col("l_suppkey").alias("target"), F.col("l_partkey").alias("mol")).agg(F.min(F.when(F.col("l_linenumber") <= 4, F.col("l_linenumber"))).alias("place"))
    part = B.table(spark, d, "part").where("p_size % 3 = 0").select(F.col("p_partkey").alias("mol"), F.col("p_size").alias("cost"))
    trees = views.select("target", "mol").distinct().join(part, "mol")
    return E.replay_labels(views, trees)


@query(
    """WITH r AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
  SELECT event_id, CASE event_type WHEN 'view' THEN k WHEN 'click' THEN k WHEN 'purchase' THEN k END AS choice, CASE event_type WHEN 'view' THEN 'best' WHEN 'click' THEN '' WHEN 'purchase' THEN 'x' ELSE '' END AS reason FROM r"""
)
def q79_parse_choice(spark, d):
    """Answers of five kinds: fenced, bare, with text around, a truth value, and broken."""
    k = F.get_json_object("props", "$.k")
    text = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('```json\n{"choice": '), k, F.lit(', "reason": "best"}\n```')))
        .when(F.col("event_type") == "click", F.concat(F.lit('{"choice": "'), k, F.lit('"}')))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('I take {"choice": '), k, F.lit(', "reason": "x"} now')))
        .when(F.col("event_type") == "signup", '{"choice": true}')
        .otherwise('{"choice": ')
    )
    out = B.table(spark, d, "events").select("event_id", parse_choice(text).alias("a"))
    return out.select("event_id", "a.choice", "a.reason")


@query("SELECT p_brand AS brand, count(*) AS n, round(CASE WHEN count(*) FILTER (WHERE p_size > 40) = 0 THEN NULL ELSE count(*) FILTER (WHERE p_size > 25)::DOUBLE / count(*) FILTER (WHERE p_size > 40) END, 6) AS precision, count(*) FILTER (WHERE p_partkey % 2 = 0) AS unnamed, round(exp(avg(ln(greatest(p_retailprice / 10000, 0.0001)))), 6) AS mean FROM part GROUP BY p_brand")
def q80_scalars(spark, d):
    """Ratios with a zero guard, unnamed identifiers, geometric means."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("MNXM"), "p_partkey")).otherwise(F.col("p_name"))
    g = B.table(spark, d, "part").withColumn("name", name).groupBy(F.col("p_brand").alias("brand")).agg(
        F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("a"), F.count_if(F.col("p_size") > 40).alias("b"), F.count_if(looks_unnamed(F.col("name"))).alias("unnamed"), geometric_mean(F.col("p_retailprice") / 10000).alias("mean")
    )
    return g.select("brand", "n", F.round(F.nanvl(ratio(F.col("a"), F.col("b")), F.lit(None)), 6).alias("precision"), "unnamed", F.round("mean", 6).alias("mean"))


@query("SELECT DISTINCT substr(md5(p_name), 1, 14) AS key FROM part WHERE p_size > 5")
def q81_known_keys(spark, d):
    """Distinct first blocks of hashed identifiers; ones of another length are no keys."""
    digest = F.md5(F.col("p_name").cast("binary"))
    full = F.when(F.col("p_size") > 5, F.concat(F.substring(digest, 1, 14), F.lit("-"), F.substring(digest, 15, 10))).otherwise(F.concat(F.substring(digest, 1, 9), F.lit("-N")))
    return B.table(spark, d, "part").select(first_block(full).alias("key")).where("key is not null").distinct()


@query("SELECT parts, count(*) AS n FROM (SELECT string_agg(DISTINCT CAST(l_suppkey % 8 AS VARCHAR), ',' ORDER BY CAST(l_suppkey % 8 AS VARCHAR)) AS parts FROM lineitem GROUP BY l_orderkey) GROUP BY parts")
def q82_distinct_sets(spark, d):
    """Distinct precursor sets with their support."""
    sets = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set((F.col("l_suppkey") % 8).cast("string"))), ",").alias("parts"))
    return sets.groupBy("parts").agg(F.count("*").alias("n"))


@query(
    """WITH u AS (SELECT p_name AS key, p_partkey AS id, 'part' AS source, 0 AS t FROM part WHERE p_size > 25 UNION ALL SELECT p_name, p_partkey, 'rest', 1 FROM part UNION ALL SELECT s_name, s_suppkey, 'supplier', 2 FROM supplier)
  SELECT key, id, source FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY t, id) = 1"""
)
def q82_union_first_wins(spark, d):
    """A union in order where the first occurrence of a key wins."""
    part = B.table(spark, d, "part")
    entry = lambda df, key, id_, source: df.select(F.col(key).alias("key"), F.col(id_).alias("id"), F.lit(source).alias("source"))
    tables = [entry(part.where("p_size > 25"), "p_name", "p_partkey", "part"), entry(part, "p_name", "p_partkey", "rest"), entry(B.table(spark, d, "supplier"), "s_name", "s_suppkey", "supplier")]
    return E.first_wins(tables, "key", "id")


@query(
    """WITH c AS (SELECT p_partkey AS id, (p_partkey % 6 + 1) || '.' || (p_size % 5) || '.-' AS ec, p_name || '__split' || (p_size % 3) AS rid FROM part)
  SELECT id, split_part(ec, '.', 1) || '.' || split_part(ec, '.', 2) AS l2, '' AS l3, regexp_replace(rid, '__split[0-9]+$', '') AS bare FROM c"""
)
def q82_sql_functions(spark, d):
    """The scalar functions called by their SQL names."""
    from ..functions.sql import register

    register(spark)
    B.table(spark, d, "part").createOrReplaceTempView("routeloom_part")
    return spark.sql(
        """SELECT id, ec_level(ec, 2) AS l2, ec_level(ec, 3) AS l3, strip_split(rid) AS bare FROM (SELECT p_partkey AS id, concat(p_partkey % 6 + 1, '.', p_size % 5, '.-') AS ec,
        concat(p_name, '__split', p_size % 3) AS rid FROM routeloom_part)"""
    )


# learned scores


def _sides(spark, d):
    line, order = B.table(spark, d, "lineitem"), B.table(spark, d, "orders")
    both = line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("substrate"), (F.col("l_partkey") % 20).alias("delta"), "l_orderkey", "l_returnflag")
    side = lambda flag, name: both.where(F.col("l_returnflag") == flag).select("substrate", "delta", F.col("l_orderkey").alias(name)).distinct()
    return side("R", "left_id"), side("A", "right_id")


@query(
    """WITH b AS (SELECT o_custkey AS substrate, l_partkey % 20 AS delta, l_orderkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  l AS (SELECT substrate, delta, arg_min(l_orderkey, {'k': md5('6:' || substrate || ':' || delta || ':' || l_orderkey), 'o': l_orderkey}) AS left_id FROM b WHERE l_returnflag = 'R' GROUP BY ALL),
  r AS (SELECT substrate, delta, arg_min(l_orderkey, {'k': md5('6:' || substrate || ':' || delta || ':' || l_orderkey), 'o': l_orderkey}) AS right_id FROM b WHERE l_returnflag = 'A' GROUP BY ALL)
  SELECT substrate, delta, left_id, right_id FROM l JOIN r USING (substrate, delta) QUALIFY row_number() OVER (PARTITION BY substrate ORDER BY md5('6:' || substrate || ':' || delta || ':' || left_id || ':' || right_id), substrate, delta) = 1"""
)
def q83_matched_pairs(spark, d):
    """For each substrate one pair of two worlds with the same change."""
    return M.matched_pairs(*_sides(spark, d), ["substrate", "delta"], ["substrate"], seed=6)


@query(
    """WITH r AS (SELECT l_suppkey AS rule, l_orderkey * 10 + l_linenumber AS id, bool_or(l_discount >= 0.09) AS attested FROM lineitem GROUP BY ALL), n AS (SELECT rule, count(*) FILTER (WHERE attested) AS n FROM r GROUP BY rule),
  k AS (SELECT r.*, n, row_number() OVER (PARTITION BY r.rule, attested ORDER BY md5('8:' || r.rule || ':' || id), id) AS p FROM r JOIN n ON n.rule = r.rule) SELECT rule, id, attested FROM k WHERE attested OR p <= 2 * n"""
)
def q84_attested_and_others(spark, d):
    """Within each rule all attested uses and twice as many others."""
    rows = B.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("rule"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.max(F.col("l_discount") >= 0.09).alias("attested"))
    return M.attested_and_others(rows, 2, 8)


@query("WITH r AS (SELECT l_suppkey AS rule, l_orderkey * 10 + l_linenumber AS id FROM lineitem GROUP BY ALL) SELECT rule, id FROM r QUALIFY row_number() OVER (PARTITION BY rule ORDER BY md5('7:' || rule || ':' || id), id) <= 5")
def q85_capped_uses(spark, d):
    """At most five uses of each rule, whatever their order: the cap is the operator."""
    rows = B.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("rule"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).distinct()
    return M.capped(rows, "rule", 5, 7, "id")


@query()
def q86_learned_scores(spark, d):
    """A boosted model of returned lines, calibrated, with its figures; features carry a planted signal."""
    line = B.table(spark, d, "lineitem")
    rows = line.select(
        F.col("l_orderkey").alias("group"), (F.col("l_quantity") * F.col("l_discount") > 1.2).cast("int").alias("label"), "l_quantity", "l_discount", F.col("l_tax").alias("control"),
    )
    model, calibration, metrics = M.fit(rows, ["l_quantity", "l_discount"], "group", [["control"]], trees=5)
    out = M.score(model, rows)
    return out.groupBy("label").agg(F.avg("score").alias("score"), F.count("*").alias("n")).withColumn("auc", F.lit(metrics["auc"])).withColumn("control", F.lit(metrics["controls"]["control"]))


@query()
def q87_edge_scores(spark, d):
    """Edges of orders to their parts, scored once for each kind by the model of q86; edges without features get 0.5."""
    line = B.table(spark, d, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("group"), (F.col("l_quantity") * F.col("l_discount") > 1.2).cast("int").alias("label"), "l_quantity", "l_discount")
    model = M.train_model(rows, ["l_quantity", "l_discount"], "group", trees=5)
    edges = line.select(F.col("l_orderkey").alias("parent"), F.col("l_partkey").cast("string").alias("molecules"))
    known = line.where("l_tax < 0.07").groupBy(F.col("l_orderkey").alias("parent"), F.col("l_partkey").cast("string").alias("molecules"))
    out = M.score_edges(model, edges, known.agg(F.max("l_quantity").alias("l_quantity"), F.max("l_discount").alias("l_discount")))
    return out.groupBy((F.col("score") == 0.5).alias("fallback")).agg(F.count("*").alias("n"), F.avg("score").alias("score"))


# streams


def _stream(spark, d):
    schema = B.table(spark, d, "events").schema
    copy = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    B.table(spark, d, "events").repartition(4, "event_type").write.parquet(copy)
    return T.read_stream(spark, copy, schema), f"{shared_dir(spark)}/offsets-{uuid.uuid4().hex}"


@query("SELECT event_type AS policy, count(*) AS decisions, count(*) FILTER (WHERE value > 100) AS solved, round(sum(value), 4) AS seconds FROM events GROUP BY event_type")
def q91_stream_totals(spark, d):
    """The live table of a stream of decisions, read to its end: equal to the batch."""
    stream, offsets = _stream(spark, d)
    events = stream.select(F.col("event_type").alias("policy"), (F.col("value") > 100).alias("solved_after"), F.col("value").alias("seconds"))
    return T.final_table(T.totals(events), f"totals_{uuid.uuid4().hex}", offsets).withColumn("seconds", F.round("seconds", 4))


@query("SELECT date_trunc('hour', ts) AS start, event_type AS policy, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q92_stream_windows(spark, d):
    """Tumbling windows of an hour by event time."""
    stream, offsets = _stream(spark, d)
    out = T.final_table(T.windowed(stream.withColumnRenamed("event_type", "policy"), late="1000 days"), f"windows_{uuid.uuid4().hex}", offsets)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "policy", "n", F.round("total", 4).alias("total"))


@query(
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, g"""
)
def q93_sessions(spark, d):
    """Sessions with a gap of half an hour."""
    out = T.sessions(B.table(spark, d, "events"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


