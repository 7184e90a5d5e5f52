"""Registered queries that write the engine's files and read them again, and those of small operators."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as Z
from ..kernel import MultisetKernel
from ..operators import completion as C
from ..operators import expand as X
from ..operators import graph as G
from ..operators import learned as M
from ..operators.corpus import prompts_in
from ..operators.similarity import native_sets
from ..sources import readers as R
from ..sources import writers as W
from ..storage import shared_dir
from ..streaming import decisions as T
from . import bindings as B
from . import tables as A
from .registry import query
from .search_queries import CODES, OUTCOMES, _cofactors, _outcomes, q02_division


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file at an exact place, on whatever file system the shared folder is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def _lines(df: DataFrame, order: str, path: str) -> str:
    """Text files of the column ``value``, in order from file to file."""
    df.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(path)
    return path


# rule sets


@query(
    """WITH k AS (SELECT n_nationkey AS rule_idx, n_regionkey AS r FROM nation WHERE n_regionkey IN (1, 2, 3)),
  n AS (SELECT rule_idx, coord, sum(v) AS v FROM (SELECT rule_idx, rule_idx % 16 AS coord, r + 1 AS v FROM k UNION ALL SELECT rule_idx, (rule_idx * 3 + 1) % 16, 1 FROM k) GROUP BY ALL)
  SELECT 'need' AS kind, rule_idx, CAST(coord AS INT) AS coord, CAST(v AS INT) AS v, 'T' || rule_idx AS template FROM n
  UNION ALL SELECT 'delta', rule_idx, CAST(rule_idx % 16 AS INT), -1, 'T' || rule_idx FROM k UNION ALL SELECT 'delta', rule_idx, CAST((rule_idx + 5) % 16 AS INT), 2, 'T' || rule_idx FROM k"""
)
def q95_rule_archive(spark, d):
    """An archive of rule arrays (a rule for each of the 25 nations) as tables, cut down to three regions' rules."""
    rows = B.table(spark, d, "nation").orderBy("n_nationkey").collect()
    n, centre, delta = len(rows), np.zeros((len(rows), 16), np.int32), np.zeros((len(rows), 16), np.int32)
    for i, r in enumerate(rows):
        centre[i, i % 16] -= r.n_regionkey + 1
        centre[i, (i * 3 + 1) % 16] -= 1
        delta[i, i % 16], delta[i, (i + 5) % 16] = -1, 2
    path = R.rules_path(_folder(spark, "rules"), "nations", 2, 16)
    with tempfile.TemporaryDirectory() as here:  # the archive is the driver's
        texts = {"template_reaction": np.array([f"T{i}" for i in range(n)]), "smi_sub": np.array([r.n_name for r in rows])}
        np.savez(os.path.join(here, "rules.npz"), ecfp_reaction=delta, ecfp_reaction_center=centre, nb_prod=np.ones(n, np.int32), score=np.ones(n, np.float32), **texts)
        R.convert_rules(spark, os.path.join(here, "rules.npz"), path, rows=10)
    keep = B.table(spark, d, "nation").where("n_regionkey between 1 and 3").select(F.col("n_nationkey").alias("rule_idx"))
    rules, need, change = R.select_rules(R.read_rules(spark, path), keep)
    both = need.select(F.lit("need").alias("kind"), "rule_idx", "coord", F.col("need").alias("v")).unionByName(change.select(F.lit("delta").alias("kind"), "rule_idx", "coord", F.col("delta").alias("v")))
    return both.join(rules.select("rule_idx", "template"), "rule_idx")


# available molecules and names


@query("SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name, 'M' || p_partkey AS mol FROM part")
def q95_sink_lines(spark, d):
    """A sink as lines, some with names, between comments and blanks."""
    part = B.table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.concat(F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit("\t"))).otherwise(""), F.lit("M"), "p_partkey").alias("value"))
    noise = part.where("n % 50 = 0").select("n", F.when(F.col("n") % 100 == 0, "# a comment").otherwise("  ").alias("value"))
    return R.read_sink(spark, _lines(part.unionByName(noise), "n", _folder(spark, "sink"))).select("name", "mol")


@query("SELECT p_name AS name, CASE WHEN p_size > 5 THEN 'InChI=1S/' || p_partkey END AS inchi FROM part")
def q95_sink_table(spark, d):
    """A sink as a table with an InChI column, some of them empty."""
    rows = B.table(spark, d, "part").select(F.col("p_name").alias("Name"), F.when(F.col("p_size") > 5, F.concat(F.lit("InChI=1S/"), "p_partkey")).alias("InChI"))
    path = _folder(spark, "sink")
    rows.write.option("header", True).csv(path)
    return R.read_sink(spark, path).select("name", "inchi")


@query("SELECT 'M' || p_partkey AS id, p_name AS name, p_brand AS smiles FROM part WHERE p_size <= 10")
def q95_compounds(spark, d):
    """Names and structures of the wanted ids from a wide table."""
    part = B.table(spark, d, "part")
    given = {"id": F.concat(F.lit("M"), "p_partkey"), "name": F.col("p_name"), "smiles": F.col("p_brand")}
    path = _folder(spark, "compounds")
    part.select(*(given.get(c.split()[0], F.lit("-")).alias(c.split()[0]) for c in S.COMPOUND.split(", "))).write.option("sep", "\t").option("quote", "").csv(path)
    wanted = part.where("p_size <= 10").select(given["id"].alias("id"))
    return R.read_names(spark, path, wanted).join(R.read_compounds(spark, path, wanted).select("id", "smiles"), "id")


@query(
    """WITH b AS (SELECT 'P' || p_partkey AS smiles, CASE WHEN p_size % 2 = 1 THEN p_name END AS label, CASE WHEN p_size % 2 = 1 THEN 'pubchem' ELSE 'unresolved' END AS source, 0 AS age FROM part WHERE p_size <= 25
    UNION ALL SELECT 'P' || p_partkey, CASE WHEN p_size % 3 > 0 THEN p_brand END, CASE WHEN p_size % 3 > 0 THEN 'pubchem' ELSE 'unresolved' END, 1 FROM part WHERE p_size >= 10)
  SELECT smiles, label, source FROM b QUALIFY row_number() OVER (PARTITION BY smiles ORDER BY source = 'unresolved', age) = 1"""
)
def q95_names_cache(spark, d):
    """Two caches of looked-up names merged, written and read."""
    part = B.table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("smiles"), "p_size", "p_name", "p_brand")

    def cache(rows, hit, label):
        return rows.select("smiles", F.when(hit, F.col(label)).alias("label"), F.when(hit, "pubchem").otherwise("unresolved").alias("source"))

    path = _folder(spark, "names")
    W.write_names(W.merge_names(cache(part.where("p_size <= 25"), F.col("p_size") % 2 == 1, "p_name"), cache(part.where("p_size >= 10"), F.col("p_size") % 3 > 0, "p_brand")), path)
    return R.read_tsv(spark, path, "smiles string, label string, source string", header=True)


# attested pathways and targets


def _pathways(spark, d):
    """A pathway for each region: its nations are reactions that make the region of the nation's name, and of water for odd ones."""
    root = _folder(spark, "pathways")
    nations = B.table(spark, d, "nation").orderBy("n_nationkey").collect()
    for r in B.table(spark, d, "region").collect():
        own = [n for n in nations if n.n_regionkey == r.r_regionkey]
        nodes = [{"id": "c", "type": "compound", "SMILES": r.r_name, "isSource": "true"}, {"id": "w", "type": "compound", "SMILES": "water", "inSink": "true"}]
        edges = []
        for n in own:
            k = n.n_nationkey
            nodes += [{"id": f"r{k}", "type": "reaction", "Rule ID": [f"R{k}"] if k % 2 else f"R{k}", "Diameter": str(2 * r.r_regionkey)}, {"id": f"n{k}", "type": "compound", "SMILES": n.n_name}]
            edges += [("c", f"r{k}"), (f"r{k}", f"n{k}")] + ([(f"r{k}", "w")] if k % 2 else [])
        name = r.r_name.replace(" ", "-")
        graph = {"elements": {"nodes": [{"data": n} for n in nodes], "edges": [{"data": {"source": a, "target": b}} for a, b in edges]}}
        _put(spark, f"{root}/{name}/{name}_v{r.r_regionkey}.json", json.dumps(graph, indent=1))
    return R.read_pathways(spark, f"{root}/*/*.json")


STEPS = """WITH s AS (SELECT replace(r_name, ' ', '-') AS pathway, 'v' || r_regionkey AS variant, 'r' || n_nationkey AS reaction, r_name AS substrate, 2 * r_regionkey AS diameter,
  CASE WHEN n_nationkey % 2 = 1 THEN list_sort([n_name, 'water']) ELSE [n_name] END AS precursors FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(f"{STEPS} SELECT pathway, variant, reaction, substrate, CAST(diameter AS INT) AS diameter, array_to_string(precursors, ',') AS precursors FROM s")
def q96_attested_steps(spark, d):
    """A row for each reaction of the graph files."""
    return R.steps_of(*_pathways(spark, d)).withColumn("precursors", F.array_join("precursors", ","))


@query(f"{STEPS} SELECT pathway, substrate, unnest(precursors) AS precursor FROM s")
def q96_attested_pairs(spark, d):
    """A row for each substrate and precursor."""
    return R.step_pairs(R.steps_of(*_pathways(spark, d)), F.lower)


@query(
    """WITH t AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS line, s_name, s_suppkey % 2 = 1 AS named, 'N' || s_nationkey || '-' || (s_suppkey % 7) AS mol FROM supplier)
  SELECT CASE WHEN named THEN replace(s_name, '#', '_') ELSE 'target' || line END AS name, mol, CAST(line AS INT) AS line FROM t QUALIFY row_number() OVER (PARTITION BY mol ORDER BY line) = 1"""
)
def q96_target_list(spark, d):
    """Targets without repeats; unnamed ones are called by their line."""
    mol = F.concat(F.lit("N"), "s_nationkey", F.lit("-"), F.col("s_suppkey") % 7)
    name = F.when(F.col("s_suppkey") % 2 == 1, F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit("\t"))).otherwise("")
    path = _lines(B.table(spark, d, "supplier").select("s_suppkey", F.concat(name, mol).alias("value")), "s_suppkey", _folder(spark, "targets"))
    return R.read_targets(spark, path).select("name", "mol", F.col("line").cast("int").alias("line"))


# run tables, routes and corpora


@query(
    f"""WITH {B.RUNS} SELECT policy, stopped_because, count(*) AS n, sum(n_expansions) AS expansions, CAST(sum(solved_at) AS BIGINT) AS solved_at, count(*) FILTER (WHERE ec_known IS NULL) AS no_ec,
    sum(CAST(expandable AS INT)) AS expandable, round(sum(elapsed_s), 6) AS elapsed FROM runs GROUP BY ALL"""
)
def q97_run_files(spark, d):
    """Final and partial run tables, one torn file among them, read together."""
    runs = B.runs(spark, d)
    final, partial = _folder(spark, "runs"), _folder(spark, "partial")
    W.write_runs(runs.where("policy <> 'click'"), final)
    W.append_runs(runs.where("policy = 'click' and seed = 0"), partial)
    W.append_runs(runs.where("policy = 'click' and seed <> 0"), partial)
    head = "\t".join(runs.columns)
    _put(spark, f"{partial}/part-torn.csv", f"{head}\n{head}\n\tt9\n")
    out = R.read_runs(spark, [final, partial])
    return out.groupBy("policy", "stopped_because").agg(
        F.count("*").alias("n"), F.sum("n_expansions").alias("expansions"), F.sum("solved_at").alias("solved_at"), F.count_if(F.isnan("ec_fraction")).alias("no_ec"),
        F.sum(F.col("expandable").cast("int")).alias("expandable"), F.round(F.sum("elapsed_s"), 6).alias("elapsed"),
    )


@query(
    """WITH v AS (SELECT * FROM events WHERE value < 3), s AS (SELECT event_type AS source, count(DISTINCT user_id) AS targets FROM v GROUP BY event_type), m AS (SELECT count(DISTINCT user_id) AS n FROM v)
  SELECT source, targets, n - targets AS missing FROM s, m WHERE n > targets"""
)
def q97_target_mismatch(spark, d):
    """Result files that lack targets which another one has."""
    return A.target_mismatch(B.runs(spark, d).where("solved_at < 3").withColumn("source", F.col("policy")))


@query(f"WITH {B.RUNS} SELECT policy, CAST(seed AS INT) AS seed, count(*) AS n, CAST(sum(shortest_route) AS BIGINT) AS steps FROM runs WHERE solved GROUP BY ALL")
def q97_route_files(spark, d):
    """Routes as JSON by policy and seed, read again."""
    path = _folder(spark, "routes")
    W.write_routes(B.runs(spark, d).where("solved").select("policy", "seed", "target", "shortest_route"), path, "policy", "seed")
    back = spark.read.schema("policy string, seed int, target string, shortest_route int").json(path)
    return back.groupBy("policy", "seed").agg(F.count("*").alias("n"), F.sum("shortest_route").alias("steps"))


USER = """u AS (SELECT depth, turn, 'Target molecule: ' || target || chr(10) || 'Frontier candidates:' || chr(10)
  || array_to_string(list_transform(words, lambda w, i: '[' || (i - 1) || '] ' || w || ' | depth=' || i || ' | EC=1,2'), chr(10)) AS user_text FROM pr)"""


@query(f"""WITH {B.PAIRS}, {USER} SELECT user_text, depth, '{{"choice": ' || (turn % 3) || ', "reason": "x"}}' AS assistant FROM u""")
def q97_pair_files(spark, d):
    """A corpus of decision pairs as JSON lines in a total order, read again."""
    path = _folder(spark, "pairs")
    W.write_corpus(B.decision_pairs(spark, d).drop("pair_id"), path, "user", "depth", "assistant")
    return R.read_pairs(spark, path).select(F.col("user").alias("user_text"), "depth", "assistant")


@query(f"WITH {B.PAIRS} SELECT CASE WHEN turn % 2 = 0 THEN 'a' ELSE 'b' END AS system, count(*) AS n FROM pr GROUP BY ALL")
def q97_prompts_in(spark, d):
    """How many system prompts a corpus mixes."""
    return prompts_in(B.decision_pairs(spark, d).withColumn("system", F.when(F.col("depth") % 2 == 0, "a").otherwise("b")))


# molecules and edges


@query(
    """WITH t AS (SELECT p_partkey AS id, string_split(p_name, ' ') AS w, CASE WHEN p_partkey % 2 = 0 THEN [p_brand] ELSE [] END AS more FROM part),
  c AS (SELECT id, w, more, array_to_string(list_sort(list_concat([array_to_string(list_sort(w), '-')], more)), '.') AS canonical FROM t)
  SELECT id, canonical, lower(canonical) AS key, CAST(1 + len(more) AS INT) AS n_parts, CAST(len(w) + len(more) AS BIGINT) AS n_tokens, CAST(len(list_distinct(list_concat(w, more))) AS INT) AS n_kinds FROM c"""
)
def q98_kernel(spark, d):
    """Part names as molecules of word tokens: canonical form, key, components, counts."""
    k = MultisetKernel()
    mol = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("."), "p_brand")).otherwise(""))
    rows = B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), mol.alias("mol"))
    tokens = F.aggregate(F.map_values(k.fingerprint(F.col("mol"), 1 << 20)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("id", k.canonical(F.col("mol")).alias("canonical"), k.key(F.col("mol")).alias("key"), F.size(k.split(F.col("mol"))).alias("n_parts"), tokens.alias("n_tokens"), F.size(k.elements(F.col("mol"))).alias("n_kinds"))


@query("SELECT p_size AS size, count(*) AS n FROM part GROUP BY p_size")
def q98_single_components(spark, d):
    """Molecules of one component pass the check that refuses several."""
    rows = B.table(spark, d, "part").select("p_size", F.replace("p_name", F.lit(" "), F.lit("-")).alias("mol"))
    return X.single(rows, MultisetKernel().split).where("mol is not null").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"))


@query(
    """WITH x AS (SELECT l_orderkey AS id, l_returnflag AS e, count(*) AS b, count(*) FILTER (WHERE l_discount >= 0.05) AS a FROM lineitem GROUP BY ALL)
  SELECT id, coalesce(string_agg(e || ':' || (a - b), ',' ORDER BY e) FILTER (WHERE a <> b), '') AS delta FROM x GROUP BY id"""
)
def q98_element_delta(spark, d):
    """Non-zero differences of two element counts: an order's flags, and those of its discounted lines."""
    lines = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), "l_returnflag").agg(F.count("*").alias("b"), F.count_if(F.col("l_discount") >= 0.05).alias("a"))
    maps = lines.groupBy("id").agg(*(F.map_from_entries(F.collect_list(F.struct("l_returnflag", c))).alias(c) for c in "ab"))
    change = F.array_sort(F.map_entries(Z.element_delta(F.col("b"), F.map_filter("a", lambda _, n: n > 0))))
    return maps.select("id", F.array_join(F.transform(change, lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",").alias("delta"))


@query(
    """WITH r AS (SELECT o_orderkey AS rule_idx, CAST(o_custkey AS VARCHAR) AS native, unnest(['R' || (o_custkey % 100), 'R' || (o_orderkey % 50)]) AS id FROM orders)
  SELECT rule_idx, native FROM r UNION SELECT rule_idx, CAST(s_nationkey AS VARCHAR) FROM r JOIN supplier ON id = 'R' || s_suppkey"""
)
def q98_native_sets(spark, d):
    """A rule's native substrates: its representative and the left sides of its source reactions."""
    ids = F.concat(F.lit("R"), F.col("o_custkey") % 100, F.lit("|R"), F.col("o_orderkey") % 50)
    rules = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("rule_idx"), F.col("o_custkey").cast("string").alias("native"), ids.alias("reaction_id"))
    sources = B.table(spark, d, "supplier").select(F.concat(F.lit("R"), "s_suppkey").alias("reaction_id"), F.col("s_nationkey").cast("string").alias("substrate"))
    return native_sets(rules, sources)


@query("SELECT c_mktsegment AS segment, string_agg(DISTINCT CAST(n_regionkey + 1 AS VARCHAR), ',' ORDER BY CAST(n_regionkey + 1 AS VARCHAR)) AS classes FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment")
def q98_ec_classes(spark, d):
    """The classes of a segment's codes, without the undefined one."""
    place = B.table(spark, d, "customer").join(B.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    codes = place.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.collect_set(F.concat_ws(".", F.col("n_regionkey") + 1, F.col("n_nationkey"))).alias("ec"))
    return codes.select("segment", F.array_join(Z.ec_classes(F.concat("ec", F.array(F.lit("-.7")))), ",").alias("classes"))


@query("SELECT p_brand AS run, p_partkey AS route, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 5, p_size % 3, p_partkey) AS INT) AS place FROM part")
def q98_final_order(spark, d):
    """Routes of a run: short ones first, then those that branch less."""
    rows = B.table(spark, d, "part").select(F.col("p_brand").alias("run"), F.col("p_partkey").alias("route"), (F.col("p_size") % 5).alias("n_steps"), (F.col("p_size") % 3).alias("n_branching"))
    return G.final_order(rows).select("run", "route", "place")


@query(
    """WITH r AS (SELECT o_orderpriority AS policy, l_orderkey AS route, count(*) AS steps, count(*) FILTER (WHERE l_discount < 0.02) AS unresolved, count(*) FILTER (WHERE l_tax >= 0.04) AS predicted,
    count(*) FILTER (WHERE l_quantity <= 5) AS unmet FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
  SELECT policy, count(*) AS routes, CAST(sum(steps) AS BIGINT) AS steps, CAST(sum(unresolved) AS BIGINT) AS unresolved, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(unmet) AS BIGINT) AS unmet,
    count(*) FILTER (WHERE unmet = 0) AS satisfied FROM r GROUP BY policy"""
)
def q98_completion_totals(spark, d):
    """Counts over completed routes by policy."""
    lines = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    steps = lines.select(F.col("o_orderpriority").alias("policy"), F.col("l_orderkey").alias("route"), F.when(F.col("l_discount") >= 0.02, F.col("l_suppkey")).alias("rxn"), (F.col("l_tax") < 0.04).alias("exact"))
    needs = lines.select(F.col("l_orderkey").alias("route"), (F.col("l_quantity") > 5).alias("supplied"))
    return C.completion_totals(steps, needs)


@query(
    """WITH l AS (SELECT o_custkey AS c, o_orderkey AS o, CAST(l_partkey % 8 AS INT) AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  s AS (SELECT c, f, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT c, o, f, count(*) AS n FROM l GROUP BY ALL),
  g AS (SELECT DISTINCT c, o, unnest(range(8)) AS f FROM l),
  v AS (SELECT o, f, coalesce(s.n, 0) AS a, coalesce(p.n, 0) AS b FROM g LEFT JOIN s USING (c, f) LEFT JOIN p USING (c, o, f))
  SELECT o AS rule_idx, string_agg(a, ',' ORDER BY f) || ',' || string_agg(b, ',' ORDER BY f) || ',' || string_agg(b - a, ',' ORDER BY f) AS features FROM v GROUP BY o"""
)
def q98_difference_features(spark, d):
    """The features of an edge from a customer's counts to an order's, folded to eight coordinates."""
    lines = B.table(spark, d, "lineitem").join(B.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    folded = lines.select(F.col("o_custkey").alias("mol"), F.col("o_orderkey").alias("rule_idx"), (F.col("l_partkey") % 8).cast("int").alias("coord"))

    own = folded.groupBy("mol", "coord").agg(F.count("*").alias("n")).groupBy("mol").agg(F.map_from_entries(F.collect_list(F.struct("coord", "n"))).alias("before"))
    made = folded.groupBy("mol", "rule_idx", "coord").agg(F.count("*").alias("n")).groupBy("mol", "rule_idx").agg(F.map_from_entries(F.collect_list(F.struct("coord", "n"))).alias("after"))
    values = F.transform(M.difference_features(F.col("before"), F.col("after"), 8), lambda v: v.cast("long").cast("string"))
    return made.join(own, "mol").select("rule_idx", F.array_join(values, ",").alias("features"))


# expansion


@query(f"WITH {B.DIVISION} SELECT mol, rule_idx FROM ok QUALIFY row_number() OVER (PARTITION BY mol ORDER BY rule_idx) <= 3")
def q98_max_rules(spark, d):
    """The first three applicable rules of each molecule: the cap is the feature."""
    return X.limit_rules(q02_division(spark, d), 3)


@query(
    f"""WITH {B.DIVISION}, {OUTCOMES}, {CODES} SELECT mol, count(*) FILTER (WHERE rule_idx % 7 = 0) AS n_errors, count(*) FILTER (WHERE rule_idx % 7 <> 0 AND coalesce(len(kept), 0) > 0) AS n_outcomes,
    count(*) AS n_prefiltered FROM ok JOIN oc USING (rule_idx) GROUP BY mol"""
)
def q98_failed_rules(spark, d):
    """The report counts rules whose application failed."""
    ranked = q02_division(spark, d)
    outcomes = _outcomes(spark, d).withColumn("error", F.when(F.col("rule_idx") % 7 == 0, "failed"))
    return X.report(ranked, outcomes, None, _cofactors(spark, d), B.rule_codes(spark, d)).select("mol", "n_errors", "n_outcomes", "n_prefiltered")


# streams


def _kept_batches(spark, stream: DataFrame, name: str) -> DataFrame:
    """What a stream in update mode emitted, batch by batch, from a table in the shared folder."""
    path = _folder(spark, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stopped = T.for_each(stream, keep, _folder(spark, "offsets"))
    stopped.awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch int").parquet(f"{path}/batch=*")


@query("SELECT CAST(user_id AS VARCHAR) AS run, count(*) AS n, coalesce(min(event_id) FILTER (WHERE value > 100), -1) AS first_solved, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def q94_progress(spark, d):
    """Keyed state of each run over a stream: decisions, the first solving step, the running mean."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    copy = _folder(spark, "events")
    B.table(spark, d, "events").repartition(3, "event_type").write.parquet(copy)
    stream = T.read_stream(spark, copy, B.table(spark, d, "events").schema)
    events = stream.select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"), "value", (F.col("value") > 100).alias("solved_after"))
    rows = _kept_batches(spark, T.progress(events), "progress")
    last = rows.groupBy("run").agg(F.max_by(F.struct("n", "first_solved", "mean"), "n").alias("x"))
    return last.select("run", "x.n", "x.first_solved", F.round(F.col("x.mean") * F.col("x.n"), 2).alias("total"))


@query(
    """WITH m AS (SELECT date_trunc('day', max(ts)) AS day FROM events), e AS (SELECT * FROM events, m WHERE ts >= day)
  SELECT date_trunc('hour', ts) AS start, event_type AS policy, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL"""
)
def q94_late_events(spark, d):
    """Windows of the last day; what arrives after it, from days before, is too late and is dropped."""
    events = B.table(spark, d, "events")
    day = events.agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("day")).first().day
    copy, last = _folder(spark, "late"), F.col("ts") >= F.lit(day)
    for part in (events.where(last & (F.col("event_id") % 2 == 0)), events.where(last & (F.col("event_id") % 2 == 1)), events.where(~last)):
        part.coalesce(1).write.mode("append").parquet(copy)
    stream = T.read_stream(spark, copy, events.schema).withColumnRenamed("event_type", "policy")
    rows = _kept_batches(spark, T.windowed(stream, late="1 hour"), "windows")
    out = rows.groupBy("start", "policy").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "policy", "x.n", F.round("x.total", 4).alias("total"))
