"""The engine's entities over the sample tables.

A part is a molecule and is available if its size is at most 10.  An order with at least two
distinct parts is a reaction that makes its largest part of the others.  A customer's counts
of parts are a fingerprint, an order's are the requirement of a rule, which takes those parts
away and gives the order's suppliers.  Events are runs: their type is the policy, the user
the target, and the number in ``props`` gives seed and outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUN = "all"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.lit(RUN).alias("run"), F.col("p_partkey").alias("mol"), (F.col("p_size") <= 10).alias("available"))


def reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, rxn, parent, child, times)."""
    # moved by order once: its parts are counted and the largest found where they then lie
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rxn"), F.col("l_partkey").alias("child")).repartition("rxn")
    counted = lines.groupBy("rxn", "child").agg(F.count("*").cast("int").alias("times"))
    whole = Window.partitionBy("rxn")
    rows = counted.withColumn("parent", F.max("child").over(whole)).withColumn("n", F.count("*").over(whole)).where("n >= 2 and child <> parent")
    return rows.select(F.lit(RUN).alias("run"), "rxn", "parent", "child", "times")


GRAPH = """
g AS (SELECT l_orderkey AS rxn, l_partkey AS child, CAST(count(*) AS INT) AS times FROM lineitem GROUP BY ALL),
r AS (SELECT rxn, max(child) AS parent FROM g GROUP BY rxn HAVING count(*) >= 2),
e AS MATERIALIZED (SELECT g.rxn, parent, child, times FROM g JOIN r USING (rxn) WHERE child <> parent),
a AS (SELECT p_partkey AS mol FROM part WHERE p_size <= 10)"""


def levels(n: int = 14) -> str:
    """CTEs s0 … sn: solved molecules with their depth, level by level; more levels than the tables need."""
    out = ["s0 AS MATERIALIZED (SELECT mol, 0 AS cost FROM a)"]
    for k in range(1, n + 1):
        out.append(
            f"s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT DISTINCT parent, {k} FROM (SELECT rxn, parent FROM e LEFT JOIN s{k - 1} ON child = mol "
            f"GROUP BY rxn, parent HAVING count(*) = count(mol)) WHERE parent NOT IN (SELECT mol FROM s{k - 1}))"
        )
    return ",\n".join(out)


LAST = "s14"
#: Reactions that reach their molecule at its least depth.
CHOSEN = f"""
c AS MATERIALIZED (SELECT rxn, parent FROM e JOIN {LAST} k ON child = k.mol JOIN {LAST} p ON parent = p.mol WHERE p.cost > 0
  GROUP BY rxn, parent, p.cost HAVING max(k.cost) = p.cost - 1 AND count(*) = (SELECT count(*) FROM e e2 WHERE e2.rxn = e.rxn))"""
SOLVED = f"WITH {GRAPH},\n{levels()}"


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol, coord, n): customers' counts of parts."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    # moved by customer once: the counts are gathered into a row where they then lie
    both = both.select(F.col("o_custkey").alias("mol"), F.col("l_partkey").alias("coord")).repartition("mol")
    return both.groupBy("mol", "coord").agg(F.count("*").alias("n"))


def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_idx, coord, need)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rule_idx"), F.col("l_partkey").alias("coord")).repartition("rule_idx")
    return lines.groupBy("rule_idx", "coord").agg(F.count("*").alias("need"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_idx, native): orders with lines; the native substrate is the order's customer."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rule_idx"), F.col("o_custkey").alias("native"))
    return orders.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rule_idx")), "rule_idx", "left_semi")


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_idx, coord, delta): the order's parts away, its suppliers (as negative coordinates) added."""
    lines = table(spark, sf_dir, "lineitem")
    away = needs(spark, sf_dir).select("rule_idx", "coord", (-F.col("need")).alias("delta"))
    made = lines.groupBy(F.col("l_orderkey").alias("rule_idx"), (-1 - F.col("l_suppkey")).alias("coord")).agg(F.count("*").alias("delta"))
    return away.unionByName(made)


DIVISION = """
f AS (SELECT o_custkey AS mol, l_partkey AS coord, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
q AS (SELECT l_orderkey AS rule_idx, l_partkey AS coord, count(*) AS need FROM lineitem GROUP BY ALL),
z AS (SELECT rule_idx, count(*) AS k FROM q GROUP BY rule_idx),
ok AS MATERIALIZED (SELECT mol, rule_idx FROM f JOIN q USING (coord) JOIN z USING (rule_idx) WHERE n >= need GROUP BY mol, rule_idx, k HAVING count(*) = k)"""


def rule_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_idx, ec) of every order, with lines or without: region.nation.segment of its customer; none for an unspecified priority."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    place = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    code = F.concat_ws(".", F.col("n_regionkey") + 1, F.col("n_nationkey") + 1, F.col("c_mktsegment"))
    coded = place.select(F.col("c_custkey").alias("native"), code.alias("code"))
    known = F.col("o_orderpriority") != "4-NOT SPECIFIED"
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rule_idx"), F.col("o_custkey").alias("native"), known.alias("known"))
    out = orders.join(coded, "native")
    return out.select("rule_idx", F.when(F.col("known"), F.array("code")).otherwise(F.array().cast("array<string>")).alias("ec"))


def runs_of(events: DataFrame, *keep: str) -> DataFrame:
    """The run table, with columns of the events that are kept: an event is a run of its type's policy on its user."""
    k = F.get_json_object("props", "$.k").cast("int")
    e = events.withColumn("k", k)
    steps = F.floor(F.col("value")).cast("int")
    solved = F.col("value") < 60
    return e.select(
        *keep,
        F.col("event_type").alias("policy"), F.col("user_id").cast("string").alias("target"), (F.col("k") % 3).alias("seed"), (F.col("k") % 10 != 0).alias("expandable"),
        solved.alias("solved"), F.least(F.lit(100), steps + 1).alias("n_expansions"), F.when(solved, steps).alias("solved_at"),
        F.when(solved, "solved").when(F.col("k") % 2 == 0, "budget").otherwise("frontier_empty").alias("stopped_because"), (F.col("k") * 3).alias("n_molecules"),
        F.col("k").alias("n_reactions"), F.when(solved, F.col("k") % 5).otherwise(0).alias("n_routes"), F.when(solved, 1 + F.col("k") % 7).alias("shortest_route"),
        (F.col("k") % 6).alias("reference_route"), F.when(F.col("k") % 11 == 0, float("nan")).otherwise((F.col("k") % 11) / 10).alias("ec_fraction"),
        (F.col("value") / 8).alias("elapsed_s"), (F.col("k") % 4).alias("llm_calls"), (F.col("k") * 100).cast("long").alias("llm_input_tokens"),
        (F.col("k") * 7).cast("long").alias("llm_output_tokens"), (F.col("k") % 2).alias("llm_fallbacks"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(table(spark, sf_dir, "events"))


RUNS = """
x AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k, CAST(floor(value) AS INT) AS steps, value < 60 AS ok FROM events),
runs AS (SELECT event_type AS policy, CAST(user_id AS VARCHAR) AS target, k % 3 AS seed, k % 10 <> 0 AS expandable, ok AS solved, least(100, steps + 1) AS n_expansions,
  CASE WHEN ok THEN steps END AS solved_at, CASE WHEN ok THEN 'solved' WHEN k % 2 = 0 THEN 'budget' ELSE 'frontier_empty' END AS stopped_because,
  CASE WHEN ok THEN 1 + k % 7 END AS shortest_route, k % 6 AS reference_route, CASE WHEN k % 11 = 0 THEN NULL ELSE (k % 11) / 10.0::DOUBLE END AS ec_known,
  value / 8 AS elapsed_s, k % 4 AS llm_calls, k * 107 AS tokens, k % 2 AS llm_fallbacks FROM x)"""


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, id, depth, sim, precedent, heavy, …): parts as candidates of their brand's run."""
    lines = table(spark, sf_dir, "lineitem")
    stats = lines.groupBy(F.col("l_partkey").alias("id")).agg(
        F.round(F.avg("l_discount") * 10, 6).alias("sim"), F.count("*").alias("precedent"), F.round(F.avg("l_tax") * 12, 6).alias("closeness"), F.count_distinct("l_suppkey").alias("n_rules")
    )
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("id"), (F.col("p_size") % 7).alias("depth"), F.col("p_retailprice").alias("heavy"))
    return part.join(stats, "id", "left")


FRONTIER = """
st AS (SELECT l_partkey AS id, round(avg(l_discount) * 10, 6) AS sim, count(*) AS precedent, round(avg(l_tax) * 12, 6) AS closeness, count(DISTINCT l_suppkey) AS n_rules
  FROM lineitem GROUP BY l_partkey),
fr AS MATERIALIZED (SELECT p_brand AS run, p_partkey AS id, p_size % 7 AS depth, p_retailprice AS heavy, sim, precedent, closeness, n_rules FROM part LEFT JOIN st ON id = p_partkey)"""


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings as queries (q, v), and those of label 0 as the sink (label, v)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), e.where("label = 0").select(F.col("vec_id").alias("label"), F.col("embedding").alias("v"))


def decision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision pairs: conversations' user turns, each showing the benchmark-sized words of its text as candidates."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    words = F.slice(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: F.length(w) > 2), 1, 5)
    lines = F.array_join(F.transform(words, lambda w, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), w, F.lit(" | depth="), (i + 1).cast("string"), F.lit(" | EC=1,2"))), "\n")
    target = F.coalesce(F.get(words, F.lit(0)), F.lit("none"))
    user = F.concat(F.lit("Target molecule: "), target, F.lit("\nFrontier candidates:\n"), lines)
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.lit("old system").alias("system"), user.alias("user"),
        F.concat(F.lit('{"choice": '), (F.col("turn") % 3).cast("string"), F.lit(', "reason": "x"}')).alias("assistant"), F.col("turn").cast("int").alias("depth"),
    )


PAIRS = """
cv AS (SELECT conv_id || '-' || turn AS pair_id, CAST(turn AS INT) AS depth, turn, list_slice(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: length(w) > 2), 1, 5) AS words
  FROM conversations WHERE role = 'user'),
pr AS MATERIALIZED (SELECT *, coalesce(words[1], 'none') AS target FROM cv)"""
