import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from routeloom.sources import readers as R
from routeloom.sources import writers as W
from routeloom.streaming import decisions as T


def write(path, text):
    path.write_text(text)
    return f"file://{path}"


def test_sinks_in_both_formats(spark, tmp_path):
    csv = write(tmp_path / "a.csv", "Name,InChI\nwater,InChI=1S/H2O\nodd,\n")
    assert [(r.name, r.inchi) for r in R.read_sink(spark, csv).orderBy("place").collect()] == [("water", "InChI=1S/H2O"), ("odd", None)]
    txt = write(tmp_path / "b.txt", "# note\nwater\tO\n\nCC\n")
    assert [(r.name, r.mol) for r in R.read_sink(spark, txt).orderBy("place").collect()] == [("water", "O"), (None, "CC")]


def test_targets(spark, tmp_path):
    p = write(tmp_path / "t.txt", "my drug\tA-b\n#x\nc\nb-A\n")
    from routeloom.kernel import MultisetKernel

    got = [(r.name, r.mol) for r in R.read_targets(spark, p, MultisetKernel().canonical).orderBy("line").collect()]
    assert got == [("my_drug", "A-b"), ("target3", "c")]


def test_cofactors_and_wide_tables(spark, tmp_path):
    p = write(tmp_path / "c.tsv", "INCHI_PREFIX\tINCHIKEY_PREFIX\tNAME\nx\tAAAA\tone\ny\t\ttwo\n")
    assert sorted((r.key, r.name) for r in R.read_cofactors(spark, p).collect()) == [("AAAA", "one"), ("y", "two")]
    q = write(tmp_path / "e.tsv", "#c\nR1\t1 A@c = 1 B@c\tref\t1.1\tB\nR2\tEMPTY\tref\t\t\nR3\t1 X = 1 Y\tr\t\tB\n")
    wanted = spark.createDataFrame([("R1",), ("R2",)], "id string")
    assert [r.id for r in R.read_equations(spark, q, wanted).collect()] == ["R1"]


PATHWAY = {
    "elements": {
        "nodes": [
            {"data": {"id": "t", "type": "compound", "SMILES": "T", "isSource": "True", "inSink": "False"}},
            {"data": {"id": "p", "type": "compound", "SMILES": "P", "inSink": "True"}},
            {"data": {"id": "r", "type": "reaction", "Rule ID": ["a", "b"], "EC number": "1.1", "Diameter": "4"}},
        ],
        "edges": [{"data": {"source": "t", "target": "r"}}, {"data": {"source": "r", "target": "p"}}],
    }
}


def test_pathways(spark, tmp_path):
    folder = tmp_path / "violet"
    folder.mkdir()
    (folder / "violet_lab.json").write_text(json.dumps(PATHWAY))
    nodes, edges = R.read_pathways(spark, f"file://{folder}/*.json")
    r = nodes.where("id = 'r'").first()
    assert (r.pathway, r.variant, r.rules, r.ec, r.diameter) == ("violet", "lab", ["a", "b"], ["1.1"], 4)
    steps = R.steps_of(nodes, edges)
    assert [(s.substrate, s.precursors) for s in steps.collect()] == [("T", ["P"])]
    assert R.step_pairs(steps).count() == 1
    bad = json.loads(json.dumps(PATHWAY))
    bad["elements"]["nodes"][1]["data"]["isSource"] = "true"
    (folder / "violet_two.json").write_text(json.dumps(bad))
    with pytest.raises(Exception, match="exactly one source"):
        R.read_pathways(spark, f"file://{folder}/violet_two.json")[0].collect()


def run_rows(spark):
    from routeloom import schema as S

    row = lambda p, t, at: (p, t, 0, True, at is not None, 5, at, "budget", 1, 1, 0, None, 0, float("nan"), 1.5, 0, 0, 0, 0)
    return spark.createDataFrame([row("b", "t2", 3), row("a", "t1", None)], S.RUN)


def test_run_tables_survive_a_tear(spark, tmp_path):
    W.append_runs(run_rows(spark), f"file://{tmp_path}/runs")
    torn = next((tmp_path / "runs").glob("part-*"))
    lines = torn.read_text().splitlines()
    torn.write_text("\n".join([*lines, lines[0], "\t" * 18]) + "\n")
    for c in (tmp_path / "runs").glob(".*.crc"):
        c.unlink()
    got = R.read_runs(spark, f"file://{tmp_path}/runs").orderBy("policy").collect()
    assert [(r.policy, r.solved_at) for r in got] == [("a", None), ("b", 3)] and got[0].ec_fraction != got[0].ec_fraction
    (tmp_path / "x.tsv").write_text("policy\ttarget\na\tb\n")
    with pytest.raises(ValueError, match="lacks"):
        R.read_runs(spark, f"file://{tmp_path}/x.tsv")


def test_equal_tables_give_equal_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string")
    for i, df in enumerate((rows.repartition(3), rows.coalesce(1))):
        W.write_corpus(df, f"file://{tmp_path}/{i}", "k")
    read = lambda i: b"".join(p.read_bytes() for p in sorted((tmp_path / str(i)).glob("part-*")))
    assert read(0) == read(1) and b"\r" not in read(0)
    W.write_runs(run_rows(spark), f"file://{tmp_path}/final")
    text = next((tmp_path / "final").glob("part-*")).read_text().splitlines()
    assert text[1].startswith("a\tt1") and "\tnan\t" in text[1].lower()


def test_name_cache_keeps_misses(spark):
    ddl = "smiles string, label string, source string"
    old = spark.createDataFrame([("a", "", "unresolved"), ("b", "bee", "pubchem")], ddl)
    new = spark.createDataFrame([("a", "ay", "pubchem"), ("b", "", "unresolved"), ("c", "", "unresolved")], ddl)
    assert sorted(tuple(r) for r in W.merge_names(old, new).collect()) == [("a", "ay", "pubchem"), ("b", "bee", "pubchem"), ("c", "", "unresolved")]


def test_rules_from_an_archive(spark, tmp_path):
    np = pytest.importorskip("numpy")
    centre = np.array([[-2, 0, 0], [0, -1, 0]])
    np.savez(tmp_path / "r.npz", ecfp_reaction=np.array([[-2, 1, 0], [0, -1, 3]]), ecfp_reaction_center=centre, template_reaction=np.array(["t0", "t1"]), smi_sub=np.array(["s", "s"]), nb_prod=np.array([1, 2]), score=np.array([0.5, 1.5]))
    out = R.rules_path(f"file://{tmp_path}", "db", 2)
    R.convert_rules(spark, str(tmp_path / "r.npz"), out)
    rules, need, delta = R.read_rules(spark, out)
    assert (rules.count(), sorted(map(tuple, need.collect()))) == (2, [(0, 0, 2), (1, 1, 1)])
    kept = R.select_rules((rules, need, delta), spark.createDataFrame([(1,)], "rule_idx int"))
    assert sorted(map(tuple, kept[2].collect())) == [(1, 1, -1), (1, 2, 3)] and kept[0].first().reaction_id is None


def test_stream_is_replayed_once(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = T.read_stream(spark, f"file://{tmp_path}/in", events.schema)
    for _ in range(2):
        T.to_sink(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/offsets").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == events.count()
    seen = []
    T.for_each(T.totals(stream.selectExpr("event_type as policy", "value > 100 as solved_after", "value as seconds")), lambda df, i: seen.append(df.count()), f"file://{tmp_path}/o2").awaitTermination()
    assert seen and max(seen) == 5


def test_keyed_state(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, False, 2.0), ("a", 1, True, 4.0), ("b", 0, False, 1.0)], "run string, step long, solved_after boolean, value double")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = T.read_stream(spark, f"file://{tmp_path}/in", rows.schema)
        out = T.final_table(T.progress(stream), "progress_table", f"file://{tmp_path}/o", "update")
        assert sorted(map(tuple, out.collect())) == [("a", 2, 1, 3.0), ("b", 1, -1, 1.0)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_an_archive_of_the_real_size(spark, tmp_path):
    """80,000 rules of 1,024 coordinates, read in ranges by tasks, stored and compressed."""
    n, width = 80_000, 1024
    rng = np.random.default_rng(1)
    at = np.arange(n)
    centre, delta = np.zeros((n, width), np.int32), np.zeros((n, width), np.int32)
    centre[at, at % width] = -2
    centre[at, (at * 7 + 1) % width] -= 1
    delta[at, (at * 3) % width] = at % 5 - 2
    texts = {"template_reaction": np.array([f"T{i}" for i in at]), "smi_sub": np.array([f"S{i % 9}" for i in at]), "reaction_id": np.array([f"r{i}|q" for i in at])}
    np.savez(tmp_path / "rules.npz", ecfp_reaction=delta, ecfp_reaction_center=centre, nb_prod=np.ones(n, np.int32), score=rng.random(n).astype(np.float32), **texts)
    own = f"file://{tmp_path}/rules.npz"
    assert R.archived_rules(spark, own, "need").rdd.getNumPartitions() == 16
    R.convert_rules(spark, own, f"file://{tmp_path}/out")
    rules, need, change = R.read_rules(spark, f"file://{tmp_path}/out")
    assert rules.count() == n and rules.where("template = concat('T', rule_idx) and reaction_id = concat('r', rule_idx, '|q') and native = concat('S', rule_idx % 9)").count() == n
    row = need.selectExpr("count(*) n", "sum(need) s", "count(distinct rule_idx) k").first()
    assert (row.s, row.k) == (3 * n, n) and row.n == 2 * n - int((at % width == (at * 7 + 1) % width).sum())
    assert need.where("need = 2 and coord <> rule_idx % 1024").count() == 0
    assert change.selectExpr("sum(delta) s", "count(*) n").first() == (0, int((at % 5 != 2).sum()))
    np.savez_compressed(tmp_path / "small.npz", ecfp_reaction=delta[:1001], ecfp_reaction_center=centre[:1001], nb_prod=np.ones(1001, np.int32), score=np.ones(1001, np.float32), template_reaction=texts["template_reaction"][:1001].astype(object), smi_sub=texts["smi_sub"][:1001])
    packed = str(tmp_path / "small.npz")
    few = R.archived_rules(spark, packed, "need", rows=100)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, need.where("rule_idx < 1001").collect()))
    whole = R.archived_rules(spark, packed, "rules", rows=100, trusted=True)
    assert {r.rule_idx: r.template for r in whole.collect()} == {i: f"T{i}" for i in range(1001)} and whole.where("reaction_id is not null").count() == 0
    with pytest.raises(Exception, match="pickled"):
        R.archived_rules(spark, packed, "rules", rows=100).collect()
    with pytest.raises(Exception, match="table must be"):
        spark.read.format("rule_archive").option("path", packed).option("table", "x").schema("a int").load().collect()


def test_line_numbers_across_splits_and_files(spark, tmp_path):
    texts = ["\n".join(f"line {i}" + "\r" * (i % 3 == 0) + "x" * (i % 50) for i in range(900)), "", "one\n\n\nfour\n", "é" * 3000]
    for i, t in enumerate(texts):
        (tmp_path / f"part-{i}.txt").write_text(t, newline="")
    want = [line.removesuffix("\r") for t in texts if t for line in t.removesuffix("\n").split("\n")]
    name, split = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (split, "2000", "300"):
            spark.conf.set(name, size)
            got = R.numbered_lines(spark, f"file://{tmp_path}")
            assert size == split or got.select(F.spark_partition_id()).distinct().count() > 3
            assert [(r.line, r.value) for r in got.orderBy("line").collect()] == list(enumerate(want, 1))
    finally:
        spark.conf.set(name, split)
