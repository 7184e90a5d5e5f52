import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from routeloom.functions import scalars as S
from routeloom.functions.stats import sign_test
from routeloom.kernel import MultisetKernel
from routeloom.operators import corpus as E
from routeloom.operators import expand as X
from routeloom.operators import frontier as V
from routeloom.operators import learned as L
from routeloom.operators import models as P
from routeloom.operators.prefilter import applicable, distinct_children
from routeloom.operators.similarity import nearest
from routeloom.plans import tables as A
from routeloom.plans.recovery import classify_routes, classify_steps


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_division_with_rules_without_needs_and_empty_molecules(spark):
    fp = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 1, 1)], "mol string, coord int, n int")
    rules = spark.createDataFrame([(0,), (1,), (2,)], "rule_idx int")
    need = spark.createDataFrame([(0, 1, 2), (1, 1, 1), (1, 2, 1)], "rule_idx int, coord int, need int")
    assert sorted(map(tuple, applicable(fp, rules, need).collect())) == [("a", 0), ("a", 1), ("a", 2), ("b", 2)]


def test_children_are_told_apart_by_vector(spark):
    delta = spark.createDataFrame([(0, 1, -1), (1, 1, -1), (2, 1, 1)], "rule_idx int, coord int, delta int")
    pairs = spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("a", 3)], "mol string, rule_idx int")
    assert sorted(map(tuple, distinct_children(delta, pairs).collect())) == [("a", 0, 2), ("a", 2, 1), ("a", 3, 1)]


def test_kernel(spark):
    k = MultisetKernel()
    assert one(spark, k.canonical(F.lit("b-a.c--a"))) == "a-b.a-c"
    assert one(spark, k.split(F.lit("a.a"))) == ["a", "a"]
    assert one(spark, k.apply(F.lit("a-b>>c.d-d"), F.lit("a-b-a"))) == ["a-c.d-d"]
    assert one(spark, k.apply(F.lit("a-a-a>>c"), F.lit("a-b-a"))) == []
    assert one(spark, k.elements(F.lit("a-b.a"))) == {"a": 2, "b": 1}


def expanded(spark, **more):
    ranked = spark.createDataFrame([("m", 5, 1), ("m", 3, 2), ("m", 9, 3)], "mol string, rule_idx int, rank int")
    outcomes = spark.createDataFrame([(5, 0, ["x", "w"]), (5, 1, ["w"]), (3, 0, ["w", "x"]), (3, 1, ["y"]), (9, 0, ["z", "z"])], "rule_idx int, pos int, molecules array<string>")
    cofactors = spark.createDataFrame([("w",)], "mol string")
    ec = spark.createDataFrame([(5, ["1.1"]), (3, ["2.2"]), (9, [])], "rule_idx int, ec array<string>")
    return X.expand(ranked, outcomes, cofactors, ec, **more), X.report(ranked, outcomes, X.expand(ranked, outcomes, cofactors, ec), cofactors, ec)


def test_expansion(spark):
    rows = expanded(spark)[0].orderBy("place").collect()
    assert [(r.molecules, r.rule_idx, r.also, r.ec) for r in rows] == [(["x"], 5, [3], ["1.1", "2.2"]), (["y"], 3, [], ["2.2"]), (["z", "z"], 9, [], [])]
    assert len(expanded(spark, top_n=2)[0].collect()) == 2
    assert {r.rule_idx for r in expanded(spark, require_ec=True)[0].collect()} == {5, 3}
    report = expanded(spark)[1].first()
    assert (report.n_prefiltered, report.n_without_ec, report.n_only_cofactors, report.n_outcomes, report.n_neighbours, report.n_duplicates) == (3, 1, 1, 4, 3, 1)
    with pytest.raises(ValueError):
        X.expand(None, None, require_ec=True)


def test_stratified_view(spark):
    rows = [("r", i, d) for i, d in ((1, 1), (2, 1), (3, 1), (4, 2), (5, 5), (6, 5))]
    df = spark.createDataFrame(rows, "run string, id long, depth int")
    assert [r.id for r in V.select_view(df, "stratified", 4, shuffle=False).orderBy("place").collect()] == [1, 4, 5, 2]
    a, b = (sorted((r.place, r.id) for r in V.select_view(df, "seeded_random", 3, seed=s).collect()) for s in (1, 1))
    assert a == b
    with pytest.raises(ValueError):
        V.select_view(df, "portfolio")
    with pytest.raises(ValueError):
        V.select_view(df, "other")


def test_interleave_equals_a_merge(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for run in range(25):
        orders = [rng.sample(range(9), rng.randint(0, 9)) for _ in range(rng.randint(1, 4))]
        seen = []
        for rank in range(9):
            seen += [o[rank] for o in orders if rank < len(o) and o[rank] not in seen]
        # an id may come twice at one rank: the first member wins
        want[str(run)] = list(dict.fromkeys(x for rank in range(9) for o in orders if rank < len(o) for x in [o[rank]]))
        rows += [(str(run), m, k + 1, x) for m, o in enumerate(orders) for k, x in enumerate(o)]
    got = {}
    for r in V.interleave(spark.createDataFrame(rows, "run string, member int, rank int, id long")).orderBy("run", "place").collect():
        got.setdefault(r.run, []).append(r.id)
    assert got == {k: v for k, v in want.items() if v}


def test_nearest_in_blocks_equals_whole(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(30)]
    q, s = spark.createDataFrame(rows, "q long, v array<double>"), spark.createDataFrame(rows, "label long, v array<double>")
    whole, blocks = (sorted(map(tuple, nearest(q, s, 3, n).collect())) for n in (100, 7))
    assert whole == blocks
    zero = spark.createDataFrame([(1, [0.0, 0.0])], "q long, v array<double>")
    assert nearest(zero, zero.withColumnRenamed("q", "label")).first().sim == 1.0


def test_codes_and_identifiers(spark):
    assert [one(spark, S.ec_level(F.lit(e), k)) for e, k in (("1.14.-.2", 2), ("1.14.-.2", 3), ("1.2", 3), ("1.2.3.4", 4), ("1.2", 5))] == ["1.14", "", "", "1.2.3.4", ""]
    assert one(spark, S.ec_list(F.lit(" 2.1 ;1.1;;2.1"))) == ["1.1", "2.1"] and one(spark, S.ec_list(F.lit("NOEC"))) == []
    assert [tuple(r) for r in one(spark, S.reaction_ids(F.lit("A_R2L__split2| B ||C_L2R")))] == [("A", "R2L"), ("B", "L2R"), ("C", "L2R")]
    assert [tuple(r) for r in one(spark, S.equation_side(F.lit("2 A@c + 0.5 B + junk")))] == [("A", 2.0), ("B", 0.5)]
    assert one(spark, S.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) == 1.0
    assert one(spark, S.map_tanimoto(F.create_map(F.lit(1), F.lit(2)), F.create_map(F.lit(1), F.lit(1), F.lit(2), F.lit(1)))) == pytest.approx(2 / (4 + 2 - 2))
    assert one(spark, S.element_delta(F.create_map(F.lit("C"), F.lit(2)), F.create_map(F.lit("C"), F.lit(2), F.lit("O"), F.lit(1)))) == {"O": 1}
    assert one(spark, S.counted_tanimoto(F.array(F.lit(0), F.lit(0)), F.array(F.lit(0), F.lit(0)))) == 1.0


@pytest.mark.parametrize("text", ['{"choice": 3, "reason": "r"}', '```json\n{"choice": 1}\n```', 'x {"choice": "2"} y', '{"choice": true}', '{"choice": 2.7}', "{", "", '{"reason": 1}', '{"choice": null}', '{"choice": "no"}'])
def test_choices(spark, text):
    got = one(spark, S.parse_choice(F.lit(text)))
    want = {'{"choice": 3, "reason": "r"}': (3, "r"), '```json\n{"choice": 1}\n```': (1, ""), 'x {"choice": "2"} y': (2, ""), '{"choice": 2.7}': (2, "")}
    assert (got.choice, got.reason) == want.get(text, (None, ""))


def test_answers_and_failures(spark):
    prompts = spark.createDataFrame([(str(i), "p", n) for i, n in enumerate([3, 1, 3, 3, 3, 3])], "run string, prompt string, n_candidates int").coalesce(1)
    backend = P.ScriptedBackend([P.Completion('{"choice": 2, "reason": "ok"}', input_tokens=7), '{"choice": 9}', "what?", P.Completion("", refused=True), ConnectionError()])
    out = P.ask(prompts, backend, "s").orderBy("run").collect()
    assert [(r.choice, r.fallback) for r in out] == [
        (2, None), (0, "skipped_single"), (0, "out_of_range:9"), (0, "unparseable"), (0, "refusal"), (0, "api_error:ConnectionError"),
    ]
    assert [r.called for r in out] == [True, False, True, True, True, True] and (out[0].input_tokens, out[0].reason) == (7, "ok")
    assert P.ask(prompts, backend, "s").where(P.is_failure(F.col("fallback"))).count() == 4
    many = spark.createDataFrame([(str(i), "p", 3) for i in range(9)], "run string, prompt string, n_candidates int").coalesce(1)
    with pytest.raises(Exception, match="calls failed in a row"):
        P.ask(many, P.ScriptedBackend([ConnectionError()]), "s").collect()
    assert P.ToolSurface().name == "none" and P.ToolSurface(True, True, True).name == "ecfp+ec+enz"
    assert "closest_chassis" not in P.system_prompt(P.ToolSurface(ec=True))
    with pytest.raises(ValueError):
        P.make_backend("other")


def test_http_backend_retries_without_a_schema(spark):
    import http.server
    import threading

    seen = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(("response_format" in body, body["messages"][1]["content"]))
            code = 400 if "response_format" in body else 500 if "fail" in body["messages"][1]["content"] else 200
            out = json.dumps({"choices": [{"message": {"content": '{"choice": 1}'}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2}}).encode()
            self.send_response(code)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        backend = P.make_backend("http", url=f"http://127.0.0.1:{server.server_port}/v1", model="m")
        prompts = spark.createDataFrame([("a", "one", 2), ("b", "two", 2), ("c", "fail", 2)], "run string, prompt string, n_candidates int").coalesce(1)
        out = P.ask(prompts, backend, "s").orderBy("run").collect()
    finally:
        server.shutdown()
    assert [(r.choice, r.fallback, r.input_tokens) for r in out] == [(1, None, 5), (1, None, 5), (0, "api_error:ConnectionError", 0)]
    assert [s for s, _ in seen] == [True, False, False, False]


def test_sign_test(spark):
    assert one(spark, sign_test(F.lit(0), F.lit(5))) == pytest.approx(0.0625)
    assert one(spark, sign_test(F.lit(30), F.lit(60))) == 1.0
    assert one(spark, sign_test(F.lit(400), F.lit(1000))) == pytest.approx(2.7e-10, rel=0.05)
    assert one(spark, sign_test(F.lit(0), F.lit(0))) != one(spark, sign_test(F.lit(0), F.lit(0)))


def test_one_seed_has_no_spread(spark):
    row = spark.createDataFrame([("p", "t", 0, 7)], "policy string, target string, seed int, solved_at int")
    got = A.solve_rate_curve(row, [5, 10]).orderBy("budget").collect()
    assert [(r.mean, r.sd, r.n_seeds) for r in got] == [(0.0, 0.0, 1), (100.0, 0.0, 1)]


def test_set_relations(spark):
    steps = spark.createDataFrame([("r", i, w) for i, w in enumerate([["a"], ["a", "b"], ["a", "c"], ["q"], []])], "route string, step int, want array<string>")
    got = spark.createDataFrame([(0, 1, ["a", "b"]), (0, 2, ["a"]), (1, 3, ["a", "b", "c"]), (2, 4, ["a"]), (3, 5, ["z"])], "step int, rule_idx int, got array<string>")
    assert [(r.outcome, r.rule_idx) for r in classify_steps(steps, got).orderBy("step").collect()] == [("exact", 2), ("contains", 3), ("partial", 4), ("missing", None), ("degenerate", None)]
    found = spark.createDataFrame([("x", "t", i, m) for i, m in enumerate([["a", "b"], ["a", "b", "c"], ["a"], ["a", "z"], ["z"]])], "run string, target string, route int, mols array<string>")
    ref = spark.createDataFrame([("t", ["a", "b"])], "target string, ref array<string>")
    assert [r["class"] for r in classify_routes(found, ref).orderBy("route").collect()] == ["exact", "covers", "shortcut", "partial", "miss"]


def test_corpus_cuts(spark):
    rows = spark.createDataFrame([(str(i), f"Target molecule: m{i % 12}\nx", i % 7) for i in range(90)], "pair_id string, user string, depth int")
    whole = sorted(itertools.chain.from_iterable([(r.seed_index, r.pair_id) for r in E.part_of(rows, at, 30, 3, "pair_id").collect()] for at in (0, 30, 60)))
    assert [i for i, _ in whole] == list(range(90)) and len({p for _, p in whole}) == 90
    kept = E.keep_deep(rows, 5, 40, 1).collect()
    assert len(kept) == 40 and sum(r.depth >= 5 for r in kept) == rows.where("depth >= 5").count()
    assert E.keep_deep(rows, 0, 10, 1).count() == 90
    split = E.split_groups(E.group_of(rows), "group", 0.25, 1).collect()
    held = {r.group for r in split if r.held}
    assert len(held) == 3 and not held & {r.group for r in split if not r.held}


def test_leak_filters_leave_no_overlap(spark):
    user = "Target molecule: {}\nFrontier candidates:\n[0] {} | depth=1 | EC=1\n[1] {} | depth=2"
    rows = spark.createDataFrame([(str(i), user.format(*t)) for i, t in enumerate([("a", "b", "c"), ("x", "b", "c"), ("a", "x", "c"), ("a", "b", "X")])], "pair_id string, user string")
    banned = E.banned_keys(spark.createDataFrame([("x",), (None,)], "key string"))
    assert {r.pair_id for r in E.drop_targets(rows, banned).collect()} == {"0", "2", "3"}
    assert {r.pair_id for r in E.drop_shown(rows, banned, lambda c: F.lower(c)).collect()} == {"0", "1"}
    bad = spark.createDataFrame([("s", "u", "{}")], "system string, user string, assistant string")
    with pytest.raises(Exception, match="lacks a field"):
        E.restamp(bad, "new").collect()


def test_gates():
    with pytest.raises(ValueError, match="chance"):
        L.gate({"c": 0.6}, 1.0)
    with pytest.raises(ValueError, match="slope"):
        L.gate({"c": 0.5}, -1.0)
    L.gate({"c": 0.53}, 1.0)


def test_model_is_saved_with_its_figures(spark, tmp_path):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i % 40, float(x := rng.random()), rng.random(), int(x + rng.random() * 0.2 > 0.6)) for i in range(800)], "group int, a double, noise double, label int")
    model, _, metrics = L.fit(rows, ["a"], "group", trees=3)
    assert metrics["auc"] > 0.9
    L.save(model, metrics, str(tmp_path / "m"))
    again, figures = L.load(str(tmp_path / "m"))
    assert json.loads(json.dumps(metrics)) == figures
    unknown = spark.createDataFrame([(None,), (0.9,)], "a double")
    got = [r.score for r in L.score(again, unknown).collect()]
    assert got[0] != got[0] and got[1] > 0.5
    edges = spark.createDataFrame([("p", "m1"), ("p", "m1"), ("p", "m2")], "parent string, molecules string")
    features = spark.createDataFrame([("p", "m1", 0.9)], "parent string, molecules string, a double")
    assert sorted(r.score for r in L.score_edges(again, edges, features).collect())[0] == 0.5
