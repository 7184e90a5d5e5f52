
import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.functions import sql
from routeloom.kernel import MultisetKernel
from routeloom.operators import corpus as E
from routeloom.operators import expand as X
from routeloom.operators import models as L
from routeloom.operators import policy as P
from routeloom.operators.frontier import select_view
from routeloom.plans.diagnostics import clusterability, linkage, silhouette


def test_clusters_of_two_clouds(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (6, 2)), rng.normal(5, 0.1, (4, 2))])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    label = linkage(d, 2)
    assert len(set(label[:6])) == len(set(label[6:])) == 1 and label[0] != label[6]
    assert silhouette(d, label) > 0.9
    rows = spark.createDataFrame([("r", i, [float(v) for v in p]) for i, p in enumerate(x)], "run string, id long, features array<double>")
    best = max(clusterability(rows).collect(), key=lambda r: r.silhouette)
    assert (best.k, best.largest_share) == (2, 0.6)


def test_average_linkage_by_hand():
    """Points 0, 1, 3, 7 on a line: 0 and 1 join, then 3, then 7."""
    x = np.array([0.0, 1.0, 3.0, 7.0])
    d = np.abs(x[:, None] - x[None])
    assert [len(set(linkage(d, k))) for k in (4, 3, 2, 1)] == [4, 3, 2, 1]
    assert linkage(d, 2).tolist() == [0, 0, 0, 1]


def test_several_components_are_refused(spark):
    mols = spark.createDataFrame([("a-b",)], "mol string")
    assert X.single(mols, MultisetKernel().split).count() == 1
    with pytest.raises(Exception, match="one component"):
        X.single(spark.createDataFrame([("a.b",)], "mol string"), MultisetKernel().split).collect()


def test_sql_functions(spark):
    assert "ec_level" in sql.register(spark)
    row = spark.sql("SELECT ec_level('1.14.-.1', 2) a, ec_level('1.14.-.1', 3) b, ec_level('1', 9) c, jaccard(array(), array()) d, binary_tanimoto(NULL, array(1)) e, first_block('ABCDEFGHIJKLMN-X') f, looks_unnamed('MNXM12') g, strip_split('a__split3') h").first()
    assert tuple(row) == ("1.14", "", "", 1.0, 0.0, "ABCDEFGHIJKLMN", True, "a")


def with_graph(front):
    return front.selectExpr("*", "'t' AS target", "4 AS n_molecules", "2 AS n_reactions", "1 AS n_solved")


def test_model_policy_falls_back_to_the_first(spark):
    rows = [("a", 1, 10, 1), ("a", 2, 20, 1), ("b", 1, 30, 0)]
    front = with_graph(spark.createDataFrame(rows, "run string, id long, mol long, depth int").withColumn("closeness", F.lit(0.5)))
    view = {(r.run, r.place): r.mol for r in select_view(front, "stratified", 20, 0).join(front, ["run", "id"]).collect()}
    for answer, place, fallback in (('{"choice": 1}', 2, None), ("?", 1, "unparseable"), ('{"choice": 7}', 1, "out_of_range:7")):
        policy = L.ModelPolicy(L.ScriptedBackend([answer]), L.ToolSurface(closeness=True))
        got = {r.run: r.mol for r in policy(front).collect()}
        assert got == {"a": view["a", place], "b": 30}
        calls = {r.run: r for r in policy.call_log().collect()}
        assert calls["a"].fallback == fallback and calls["b"].fallback == "skipped_single" and not calls["b"].called
        prompt = calls["a"].prompt
        assert prompt.startswith("Target molecule: t\n") and "4 molecules (1 of them solved), 2 reactions" in prompt and "closest_chassis=0.500" in prompt


def test_the_model_sees_plausibility_if_its_tools_do(spark):
    rows = [("a", 1, 10, 1, 0.5, 0.25, 2), ("a", 2, 20, 1, None, None, None)]
    front = with_graph(spark.createDataFrame(rows, "run string, id long, mol long, depth int, per_step double, cumulative double, edges int"))
    view = select_view(front, "discovery", 5, shuffle=False)
    for on in (True, False):
        text = L.prompts_of(front, view, "discovery", L.ToolSurface(plausibility=on)).first().prompt
        assert ("enzymatic=0.500/step (route 0.250 over 2)" in text) == on


def test_caps_and_failures(spark):
    pairs = spark.createDataFrame([("m", i) for i in range(5)] + [("n", 9)], "mol string, rule_idx int")
    assert sorted(map(tuple, X.limit_rules(pairs, 2).collect())) == [("m", 0), ("m", 1), ("n", 9)] and X.limit_rules(pairs, None) is pairs


def test_tables_that_are_replaced_go(spark):
    import os

    from routeloom.storage import cut, release, settled

    first = cut(spark.range(5), "x")
    place = first._routeloom_path.removeprefix("file://")
    assert os.path.isdir(place) and settled(first) is first
    second = cut(first.selectExpr("id + 1 AS id"), "x", first)
    assert not os.path.exists(place) and second.count() == 5
    release(spark.range(1))


def test_global_ranks_in_more_buckets(spark):
    rows = spark.range(300).select(F.col("id").cast("string").alias("pair_id"))
    key = F.md5(F.col("pair_id").cast("binary"))
    one, three = ({r.pair_id: r.place for r in E.rank_globally(rows, key, "pair_id", digits=n).collect()} for n in (1, 3))
    assert one == three and sorted(one.values()) == list(range(1, 301))


def test_counted_tanimoto_clusters(spark):
    rows = spark.createDataFrame([("r", i, [float(x) for x in v]) for i, v in enumerate([[4, 0, 0], [3, 0, 0], [0, 5, 1], [0, 4, 1], [0, 0, 0]])], "run string, id long, features array<double>")
    got = clusterability(rows, ks=(2, 3), metric="tanimoto").collect()
    assert {r.k: r.largest_share for r in got} == {2: 0.6, 3: 0.4} or {r.k for r in got} == {2, 3}
    a, b = np.array([4.0, 0, 0]), np.array([3.0, 0, 0])
    near = (a @ b) / (a @ a + b @ b - a @ b)
    assert got[0].mean_similarity < got[0].mean_nearest <= 1 and near > 0.9


def test_pages_and_retention(spark, tmp_path):
    from routeloom.sources.pages import write_page
    from routeloom.streaming.decisions import is_finished, mark_finished, retain

    routes = spark.createDataFrame([("t<1>", 0, 2, ["a & b", "c"], ["x"]), ("t2", 0, 1, ["d"], [])], "target string, route int, n_steps int, steps array<string>, leaves array<string>")
    write_page(routes, f"file://{tmp_path}/page", "Routes & more")
    page = "".join(open(p).read() for p in sorted((tmp_path / "page").glob("part-*")))
    assert page.startswith("<!doctype html>") and "t&lt;1&gt;" in page and "a &amp; b" in page and page.rstrip().endswith("</html>") and page.index(">t2<") < page.index("t&lt;1&gt;")
    root = f"file://{tmp_path}/runs"
    for i in range(4):
        spark.range(1).write.parquet(f"{root}/run{i}/events")
        if i != 1:
            mark_finished(spark, f"{root}/run{i}")
    assert is_finished(spark, f"{root}/run0") and not is_finished(spark, f"{root}/run1")
    assert sorted(retain(spark, root, keep=1)) == ["run0", "run2"]
    assert sorted(p.name for p in (tmp_path / "runs").iterdir()) == ["run1", "run3"]


def test_chemistry_kernel(spark):
    from routeloom.kernel import ChemistryKernel

    try:
        import rdkit  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="rdkit"):
            ChemistryKernel()
        return
    k = ChemistryKernel()
    row = spark.createDataFrame([("OCC", "CC.O")], "a string, b string").select(k.canonical(F.col("a")).alias("c"), k.split(F.col("b")).alias("s"), k.elements(F.col("a")).alias("e")).first()
    assert row.c == "CCO" and row.s == ["CC", "O"] and row.e == {"C": 2, "O": 1, "H": 6}


def test_observed_control(spark):
    front = spark.createDataFrame([("a", i, i * 10, i) for i in range(1, 6)], "run string, id long, mol long, depth int")
    assert P.with_view(P.depth_first, "stratified", 2)(front).first().mol == 20
    assert P.depth_first(front).first().mol == 50 and P.breadth_first(front).first().mol == 10


def test_completed_equations_and_carriers(spark):
    from routeloom.operators import completion as C

    part = "array<struct<key:string,name:string,elements:map<string,int>>>"
    steps = spark.createDataFrame([(1, "M", "U", {"O": 1})], "step int, made string, used string, delta map<string,int>")
    left, right = [("a", "alcohol", {"C": 1}), ("w", "H2O", {"O": 1})], [(None, "an aldehyde", None), ("b", "acid", {"C": 1, "O": 1})]
    options = spark.createDataFrame([(1, 7, 0, left, right)], f"step int, rxn int, place int, left {part}, right {part}")
    best = C.pick_reaction(steps, options)
    row = C.complete_equation(best, options, steps).first()
    assert (row.consumed, row.released, row.predicted) == (["U", "w"], ["an aldehyde", "M"], True)
    needs = spark.createDataFrame([(1, 1, None, "H2O"), (1, 1, "k", "x"), (1, 1, None, "Acceptor"), (1, 1, "a", "an alcohol")], "route int, step int, key string, name string")
    nothing = spark.createDataFrame([], "route int, key string, name string")
    got = {r.name: r.supplied for r in C.supplied(needs, nothing.select("key"), nothing).collect()}
    assert got == {"H2O": True, "x": False}
