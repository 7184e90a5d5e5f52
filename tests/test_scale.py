"""What a step shuffles or writes grows with its input, not with the pairs it could make."""

import random
import re
from collections import Counter

from routeloom.operators.prefilter import child_counts, children


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_children_add_up_where_a_pair_meets_its_counts(spark):
    draw = random.Random(3)
    fp = [(m, c, draw.randint(1, 3)) for m in range(6) for c in draw.sample(range(12), 5)]
    delta = [(r, c, draw.choice([-2, -1, 1])) for r in range(5) for c in draw.sample(range(-4, 12), 4)] + [(0, 3, -1), (0, 3, 1)]
    pairs = [(m, r) for m in range(7) for r in range(6)]  # one molecule without counts, one rule without a change
    want = {p: Counter() for p in pairs}
    for m, r in pairs:
        for a, c, n in fp:
            want[m, r][c] += n if a == m else 0
        for a, c, n in delta:
            want[m, r][c] += n if a == r else 0
    want = sorted((m, r, c, n) for (m, r), counts in want.items() for c, n in counts.items() if n)
    frames = spark.createDataFrame(fp, "mol long, coord long, n long"), spark.createDataFrame(delta, "rule_idx long, coord long, delta long"), spark.createDataFrame(pairs, "mol long, rule_idx long")
    made = children(*frames)
    assert sorted(map(tuple, made.collect())) == want
    assert not re.search(r"Aggregate \[mol#\w+, rule_idx#\w+, coord#", _plan(made))  # no row per count and pair is gathered
    assert child_counts(*frames).count() == len(pairs)


def test_pairs_that_lack_a_coordinate_fall_before_they_are_moved(spark, monkeypatch):
    from routeloom.operators import prefilter

    made = {}
    cut = prefilter.cut
    monkeypatch.setattr(prefilter, "cut", lambda df, name="step", *more: made.setdefault(name, cut(df, name, *more)))
    draw = random.Random(5)
    fp = [(m, c, draw.randint(1, 3)) for m in range(200) for c in [0, *draw.sample(range(1, 60), 6)]]  # all molecules have coordinate 0
    need = [(r, c, draw.randint(1, 2)) for r in range(300) for c in draw.sample(range(60), 3 if r % 3 else 2)] + [(900, 0, 2), (901, 77, 1), (901, 0, 1), (902, 5, 0)]
    rules = [(r,) for r in [*range(300), 900, 901, 902, 903]]  # two without requirements
    has, asks = {}, {}
    for m, c, n in fp:
        has.setdefault(m, {})[c] = n
    for r, c, n in need:
        asks.setdefault(r, {}).update({c: n} if n else {})
    want = sorted((m, r) for (r,) in rules for m in has if all(has[m].get(c, 0) >= n for c, n in asks.get(r, {}).items()))
    out = prefilter.applicable(
        spark.createDataFrame(fp, "mol long, coord long, n long"), spark.createDataFrame(rules, "rule_idx long"), spark.createDataFrame(need, "rule_idx long, coord long, need long")
    )
    assert sorted(map(tuple, out.collect())) == want
    # what shares the rarest coordinate alone is ten times what is left
    share = sum(len([m for m in has if min(asks[r], key=lambda c: sum(c in h for h in has.values())) in has[m]]) for r in range(300))
    assert made["found"].where("rule_idx < 300").count() * 4 < share


def test_only_the_best_match_of_a_candidate_is_moved(spark):
    from pyspark.sql import functions as F

    from routeloom.operators import completion as C

    draw = random.Random(9)
    part = lambda k: (str(k) if k else None, ["x", "ATP", "y"][k % 3], {"C": k % 3, "O": k % 2} if k != 5 else None)
    sources = [(r, [part(draw.randrange(7)) for _ in range(3)], [part(draw.randrange(7)) for _ in range(2)]) for r in range(12)]
    steps = [(s, str(draw.randrange(1, 7)), str(draw.randrange(1, 7)), draw.choice([{"C": 1}, {"C": 1, "O": -1}, {"O": 0}, {}, None])) for s in range(30)]
    candidates = [(s, r, r // 2) for s in range(30) for r in draw.sample(range(12), 4) if r % 2 or draw.random() < 0.5]
    side, want = dict((r, (a, b)) for r, a, b in sources), {}
    for s, made, used, delta in steps:
        for _, r, place in (c for c in candidates if c[0] == s):
            for agrees, (left, right) in ((True, side[r]), (False, side[r][::-1])):
                for i, c in enumerate(left):
                    for j, d in enumerate(right):
                        if c[0] is None or d[0] is None or "ATP" in (c[1], d[1]):
                            continue
                        change = None if c[2] is None or d[2] is None else {k: d[2][k] - c[2][k] for k in "CO" if d[2][k] != c[2][k]}
                        exact, same = c[0] == used and d[0] == made, change is not None and change == delta
                        if exact or same:
                            key = (-((1000 * exact + 100 * same) * 100 - 5), place, not agrees, i, j, r)
                            want[s] = min(want.get(s, (0,)), (*key, exact))
    want = sorted((s, r, not turned, i, j, exact, -cost) for s, (cost, _, turned, i, j, r, exact) in want.items())
    kind = "array<struct<key: string, name: string, elements: map<string, int>>>"
    sources = spark.createDataFrame(sources, f"rxn long, left {kind}, right {kind}")
    steps = spark.createDataFrame(steps, "step long, made string, used string, delta map<string, int>")
    candidates = spark.createDataFrame(candidates, "step long, rxn long, place int")
    apart = C.pick_reaction(steps, candidates, sources=sources)
    assert sorted(map(tuple, apart.collect())) == want
    assert sorted(map(tuple, C.pick_reaction(steps, candidates.join(sources, "rxn")).collect())) == want
    assert "Generate" not in _plan(apart) and "Window" not in _plan(apart)  # no row for each pair of participants
    best = C.complete_equation(apart, candidates, steps, sources).select("step", F.to_json(F.struct("consumed", "released")))
    whole = C.complete_equation(apart, candidates.join(sources, "rxn"), steps).select("step", F.to_json(F.struct("consumed", "released")))
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, whole.collect()))


def test_a_task_holds_few_similarities(spark):
    import numpy as np

    from routeloom.operators import similarity

    assert 2 * 8 * similarity.SCORES <= 16 << 20  # bytes of the two tables, whatever the sink
    draw = np.random.default_rng(2)
    v = draw.integers(-2, 3, (40, 4)).astype(float)
    v[3] = 0
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "label long, v array<double>")
    out = similarity.nearest(frame.withColumnRenamed("label", "q"), frame, 3)
    dots, squares = v @ v.T, (v * v).sum(1)
    under = squares[:, None] + squares - dots
    sim = np.round(np.where(under == 0, 1, dots / np.where(under == 0, 1, under)), 12)
    want = [(q, int(n), float(sim[q, n]), r + 1) for q in range(40) for r, n in enumerate(np.argsort(-sim[q], kind="stable")[:3])]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_a_pair_with_itself_carries_no_set_and_ranks_lie_by_molecule(spark):
    from pyspark.sql import functions as F

    from routeloom.operators import expand as X
    from routeloom.operators.similarity import set_tanimoto

    draw = random.Random(11)
    sets = {k: set(draw.sample(range(9), draw.randint(1, 5))) for k in range(8)}
    pairs = [(x, y, i) for i, (x, y) in enumerate((x, y) for x in [*range(8), 90] for y in [*range(8), 90])]  # 90 has no members
    want = sorted((x, y, i, len(sets[x] & sets[y]) / len(sets[x] | sets[y]) if x in sets and y in sets else 0.0) for x, y, i in pairs)
    members = spark.createDataFrame([(k, m) for k, v in sets.items() for m in v], "l long, member long")
    frame = spark.createDataFrame(pairs, "l long, r long, rule_idx long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for same in (False, True):
            out = set_tanimoto(frame, members, members.withColumnRenamed("l", "r"), same).select("l", "r", "rule_idx", "sim")
            assert sorted(map(tuple, out.collect())) == want
        ranked = X.rank_rules(out.withColumnRenamed("l", "mol"))
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(l#") <= 2 and "Exchange hashpartitioning(mol#" not in plan  # the pairs and the sets; none for the ranks
        outcomes = spark.createDataFrame([(i, 0, [i % 3, 7]) for _, _, i in pairs], "rule_idx long, pos int, molecules array<long>")
        made = X.expand(ranked, outcomes)
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(mol#") == 1
        assert sorted((r.mol, r.place) for r in made.select("mol", "place").collect()) == [(m, p) for m in sorted({x for x, _, _ in pairs}) for p in (1, 2, 3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_reactions_that_lack_a_child_for_good_are_not_read_in_each_level(spark, monkeypatch):
    from routeloom.operators import graph as G

    made = {}
    cut = G.cut
    monkeypatch.setattr(G, "cut", lambda df, name="step", *more: (made.setdefault(name, []).append(df.count()), cut(df, name, *more))[1])
    # 1 of 2 and 3 of 1 are made; 50 reactions want 99, which nothing makes, 50 more want what those would make
    rows = [("r", 0, 1, 2, 1), ("r", 1, 3, 1, 2)] + [("r", 10 + i, 100 + i, c, 1) for i in range(50) for c in (2, 99)] + [("r", 60 + i, 200 + i, c, 1) for i in range(50) for c in (1, 100 + i)]
    rxns = spark.createDataFrame(rows, "run string, rxn long, parent long, child long, times int")
    mols = spark.createDataFrame([("r", m, m == 2) for m in {r[2] for r in rows} | {2, 99}], "run string, mol long, available boolean")
    assert {r.mol: r.cost for r in G.and_or_depth(mols, rxns)[0].collect()} == {2: 0, 1: 1, 3: 2}
    assert made["lacks"][0] == 2  # 102 before
    assert {r.mol: r.tree_cost for r in G.shortest_cost(mols, rxns).collect()} == {2: 0, 1: 1, 3: 3}
    assert made["sized"] == [2]  # 202 before
    pair = "run string, mol long"
    was = spark.createDataFrame([("r", m) for m in (1, 2, 3)], pair)
    now = spark.createDataFrame([("r", 99)], pair)
    got = G.swap_available(was, rxns, now, now, spark.createDataFrame([("r", 2)], pair)).collect()
    assert [tuple(r) for r in got] == [("r", 99)]
    assert made["leans"] == [2]
    both = G.swap_available(was, rxns, was.where("mol = 2").unionByName(now), now, now.limit(0)).collect()
    assert sorted(r.mol for r in both) == [1, 2, 3, 99, *range(100, 150), *range(200, 250)]


def test_a_later_round_of_a_replay_reads_its_own_trees(spark, sf_dir, monkeypatch):
    from routeloom.operators import replay as R
    from routeloom.plans import search_queries as S

    rounds = []
    timed = R._timed

    def watched(plan, edges):
        rounds.append(tuple({r.run for r in t.select("run").distinct().collect()} for t in (plan, edges)))
        return timed(plan, edges)

    monkeypatch.setattr(R, "_timed", watched)
    S._replay(spark, "/root/testdata/sf0.01", top_k=4)
    assert len(rounds) > 1 and len(rounds[1][0]) < len(rounds[0][0])
    assert all(read <= going for going, read in rounds)


def test_each_row_of_features_is_scored_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from routeloom.operators import learned as L

    rows = spark.createDataFrame([(g, int(g % 4 > 1), float(g % 4), float(g % 3)) for g in range(120)], "group long, label int, a double, b double")
    model = L.train_model(rows, ["a", "b"], "group", trees=2)
    assert model.stages[1].toDebugString.split("\n")[1:] == L.fit(rows, ["a", "b"], "group", trees=2, check=False)[0].stages[1].toDebugString.split("\n")[1:]
    edges = spark.createDataFrame([(i % 40, str(i % 20), i) for i in range(200)], "parent long, molecules string, a long")  # a column of a feature's name
    nan = float("nan")
    features = spark.createDataFrame([(i, str(i % 20), [0.0, 1.0, 3.0, None, nan, -0.0][i % 6], float(i % 2)) for i in range(30)], "parent long, molecules string, a double, b double")
    want = L.score(model, edges.select("parent", "molecules").distinct().join(features, ["parent", "molecules"], "left")).select("parent", "molecules", "score")
    want = edges.join(want, ["parent", "molecules"], "left").withColumn("score", F.coalesce(F.nanvl("score", F.lit(None)), F.lit(0.5)))
    scored = []
    score = L.score
    monkeypatch.setattr(L, "score", lambda m, df, *more: (scored.append(df.count()), score(m, df, *more))[1])
    out = L.score_edges(model, edges, features)
    assert out.columns == want.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert scored[0] <= 12  # 40 before, one for each edge that differs


def _moved(spark):
    """Bytes shuffled and written so far."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() + stages.apply(i).outputBytes() for i in range(stages.size()))


def test_a_report_needs_neither_ranks_nor_sets(spark, monkeypatch):
    from routeloom.operators import prefilter
    from routeloom.plans import search_queries as S

    written = []
    for module in (prefilter, S):
        keep = "cut" if module is prefilter else "settled"
        monkeypatch.setattr(module, keep, lambda df, name="step", *more, f=getattr(module, keep): (written.append(name), f(df, name, *more))[1])
    monkeypatch.setattr(S, "set_tanimoto", None)  # called before
    at = _moved(spark)
    assert len(S.q01_expansion_report(spark, "/root/testdata/sf0.01").collect()) == 1500
    assert written == ["molecules", "found"]  # six tables before
    assert _moved(spark) - at < 6_000_000  # 8.3 MB before, of 60,000 lines


def test_a_report_counts_the_outcomes_of_its_pairs(spark):
    from routeloom.operators import expand as X

    draw = random.Random(4)
    pairs = sorted({(draw.randrange(4), draw.randrange(14)) for _ in range(40)})
    outcomes = [(r, p, draw.choices([1, 2, 3, 8, 9], k=draw.randint(1, 2))) for r in range(12) for p in range(r % 3)]  # 8 and 9 are cofactors; 0, 3, 6, 9, 12, 13 have no outcome
    codes = [(r, ["1.1"] if r % 2 else []) for r in range(10)]
    kept = lambda m: tuple(sorted(x for x in m if x < 8))
    want = []
    for mol in sorted({m for m, _ in pairs}):
        own = [r for m, r in pairs if m == mol]
        made = [(r, kept(m)) for r, _, m in outcomes if r in own]
        some = [k for _, k in made if k]
        want.append((mol, len(own), len({r for r, _ in made}), len([r for r in own if not (r < 10 and r % 2)]), len(made) - len(some), len(some), len(set(some)), len(some) - len(set(some))))
    frames = spark.createDataFrame(outcomes, "rule_idx long, pos int, molecules array<long>"), spark.createDataFrame([(8,), (9,)], "mol long"), spark.createDataFrame(codes, "rule_idx long, ec array<string>")
    pairs = spark.createDataFrame(pairs, "mol long, rule_idx long")
    out = X.report(pairs, frames[0], None, *frames[1:])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(mol#") == 1 and "Expand" not in plan  # each pair three times before
    assert out.columns == ["mol", "n_prefiltered", "n_graph_valid", "n_without_ec", "n_only_cofactors", "n_outcomes", "n_neighbours", "n_duplicates"]
    assert sorted(map(tuple, out.collect())) == want
    made = X.expand(pairs.withColumn("rank", pairs.rule_idx), *frames[:2])
    both = X.report(pairs, frames[0], made, *frames[1:])
    assert sorted(map(tuple, both.select(out.columns).collect())) == want


def test_requirements_meet_counts_where_a_molecule_lies(spark):
    from routeloom.operators import prefilter

    draw = random.Random(8)
    fp = [(m, c, draw.randint(1, 3)) for m in [*range(30), None] for c in draw.sample(range(20), 8)] + [(0, None, 5), (3, None, 1)]
    need = [(r, c, draw.randint(1, 2)) for r in range(200) for c in draw.sample(range(21), draw.randint(1, 3))]
    need += [(300, None, 1), (301, None, 1), (301, fp[0][1], 1), (None, fp[0][1], 1), (None, fp[1][1], 1), (302, 4, 0), (303, fp[0][1], 1), (303, fp[1][1], 0)]
    has, asks = {}, {}
    for m, c, n in fp:
        has.setdefault(m, {})[c] = n
    for r, c, n in need:
        if r is not None and n:
            asks.setdefault(r, []).append((c, n))
    fits = lambda m, r: all(c is not None and has[m].get(c, 0) >= n for c, n in asks.get(r, []))
    key = lambda p: (p[0] is None, p[0] or 0, p[1])
    frames = spark.createDataFrame(fp, "mol int, coord long, n int"), spark.createDataFrame(need, "rule_idx long, coord long, need int")
    rules = [*range(200), 300, 301, 302, 303, 304]
    listed = prefilter.applicable(frames[0], spark.createDataFrame([(r,) for r in rules], "rule_idx long"), frames[1])
    assert sorted(map(tuple, listed.collect()), key=key) == sorted(((m, r) for m in has for r in rules if fits(m, r)), key=key)
    out = prefilter.applicable(frames[0], None, frames[1])
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # more before
    assert sorted(map(tuple, out.collect()), key=key) == sorted(((m, r) for m in has for r in asks if fits(m, r)), key=key)


def test_a_report_follows_its_sql_on_odd_rows(spark, sf_dir, tmp_path):
    import os
    import shutil

    import duckdb

    import __spark_entry__ as entry

    db = duckdb.connect()
    owner = "CASE WHEN o_orderkey % 2 = 0 THEN 7 WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS o_custkey"  # one has half of the orders, some have none
    lost = "CASE WHEN l_orderkey % 23 = 0 THEN l_orderkey + 1000000 ELSE l_orderkey END AS l_orderkey"  # lines without an order
    part = "CASE WHEN l_orderkey % 17 = 0 AND l_linenumber = 1 THEN NULL ELSE l_partkey END AS l_partkey"
    made = "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_suppkey END AS l_suppkey"  # outcomes of no molecules
    for name, columns in (("orders", owner), ("lineitem", f"{lost}, {part}, {made}"), ("supplier", "s_suppkey % 3 - 1.0 AS s_acctbal")):
        db.sql(f"copy (select * replace ({columns}) from '{sf_dir}/{name}.parquet') to '{tmp_path}/{name}.parquet' (format parquet)")
    for name in ("customer", "nation"):
        shutil.copy(f"{sf_dir}/{name}.parquet", tmp_path)
    for name in os.listdir(tmp_path):
        db.sql(f"create view {name.removesuffix('.parquet')} as select * from '{tmp_path}/{name}'")
    for name in ("q02_division", "q05_strip", "q01_expansion_report", "q98_failed_rules"):
        got, want = entry.queries()[name](spark, str(tmp_path)), db.sql(entry.oracle_sql()[name])
        assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, want.fetchall())), name
