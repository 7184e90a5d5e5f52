"""Small graphs with known answers, and random ones against plain loops."""

import itertools
import math
import random

import pytest

from routeloom.operators import graph as G
from routeloom.operators.policy import Environment, breadth_first, depth_first, search, UCT

M, X = "run string, mol long, available boolean", "run string, rxn long, parent long, child long, times int"
SINK = 90


def tables(spark, free, rules):
    """rules: list of (parent, children)."""
    mols = {m for p, cs in rules for m in (p, *cs)} | set(free)
    rows = []
    for i, (p, cs) in enumerate(rules):
        rows += [("r", i, p, c, cs.count(c)) for c in dict.fromkeys(cs)]
    return spark.createDataFrame([("r", m, m in free) for m in mols], M), spark.createDataFrame(rows, X)


CASES = {
    "chain": ([3], [(1, [2]), (2, [3])], {1: 2, 2: 1, 3: 0}, {1: 2, 2: 1}),
    "or choice": ([7, 8, 9], [(1, [7, 8, 9]), (1, [7])], {1: 1, 7: 0, 8: 0, 9: 0}, {1: 1}),
    "and fails": ([7], [(1, [7, 6])], {7: 0}, {}),
    "diamond": ([5], [(1, [2, 3]), (2, [4]), (3, [4]), (4, [5])], {1: 3, 2: 2, 3: 2, 4: 1, 5: 0}, {1: 5, 2: 2, 3: 2, 4: 1}),
    "cycle": ([], [(1, [2]), (2, [1])], {}, {}),
    "cycle with a way out": ([5], [(1, [2]), (2, [1]), (2, [5])], {1: 2, 2: 1, 5: 0}, {1: 2, 2: 1}),
    "child twice": ([5], [(1, [2, 2]), (2, [5])], {1: 2, 2: 1, 5: 0}, {1: 3, 2: 1}),
}


@pytest.mark.parametrize("name", CASES)
def test_known_graphs(spark, name):
    free, rules, depth, cost = CASES[name]
    mols, rxns = tables(spark, free, rules)
    assert {r.mol: r.cost for r in G.and_or_depth(mols, rxns)[0].collect()} == depth
    assert {r.mol: r.tree_cost for r in G.shortest_cost(mols, rxns).collect() if r.rxn is not None} == cost
    assert {r.mol for r in G.solved(mols, rxns)[0].collect()} == set(depth)


def swapped(spark, rules, before, after):
    """The molecules solved after a swap of the available ones, from those solved before, and by the whole fixpoint."""
    mols, rxns = tables(spark, before, rules)
    pairs = lambda ms: spark.createDataFrame([("r", m) for m in ms], "run string, mol long")
    got = G.swap_available(G.solved(mols, rxns)[0], rxns, pairs(after), pairs(after - before), pairs(before - after)).collect()
    assert len({r.mol for r in got}) == len(got)
    whole = set(after)
    while more := {p for p, cs in rules if set(cs) <= whole} - whole:
        whole |= more
    return {r.mol for r in got}, whole


def test_swapped_availability_by_hand(spark):
    # a cycle that leant on 5 alone, an alternative that stands, a molecule that was available and can be made too
    rules = [(1, [2]), (2, [1]), (2, [5]), (3, [5]), (3, [6]), (4, [3, 1]), (7, [6])]
    got, whole = swapped(spark, rules, {5, 6}, {6})
    assert got == whole == {3, 6, 7}
    got, whole = swapped(spark, rules, {5, 6, 7}, {5, 6, 8})
    assert got == whole == {1, 2, 3, 4, 5, 6, 7, 8}
    got, whole = swapped(spark, rules, set(), {5})
    assert got == whole == {1, 2, 3, 4, 5}
    assert swapped(spark, rules, {5, 6}, set())[0] == set()


def test_swapped_availability_of_random_graphs(spark):
    rng = random.Random(11)
    for _ in range(3):
        rules = [(rng.randrange(40), [rng.randrange(60) for _ in range(rng.randint(1, 3))]) for _ in range(90)]
        before, after = ({m for m in range(60) if rng.random() < 0.25} for _ in range(2))
        got, whole = swapped(spark, rules, before, after)
        assert got == whole


def test_distinct_reactions_of_the_diamond(spark):
    free, rules, _, _ = CASES["diamond"]
    mols, rxns = tables(spark, free, rules)
    row = G.route_lengths(mols.where("mol = 1"), G.shortest_cost(mols, rxns), rxns).first()
    assert (row.tree_cost, row.distinct_reactions) == (5, 4)


def test_frontier_holds_what_an_and_needs(spark):
    free, rules, _, _ = CASES["and fails"]
    mols, rxns = tables(spark, free, rules)
    from pyspark.sql import functions as F

    marked = mols.withColumn("expanded", F.col("mol") == 1)
    assert {r.mol for r in G.frontier(marked, G.solved(mols, rxns)[0]).collect()} == {6}


def random_graph(seed, n=24, k=40):
    rng = random.Random(seed)
    return [m for m in range(n) if rng.random() < 0.25], [(rng.randrange(n), [rng.randrange(n) for _ in range(rng.randint(1, 3))]) for _ in range(k)]


def plain_depth(free, rules):
    cost = dict.fromkeys(free, 0)
    for level in itertools.count(1):
        new = {p for p, cs in rules if p not in cost and all(c in cost for c in cs)}
        if not new:
            return cost
        cost |= dict.fromkeys(new, level)


def plain_cost(free, rules):
    cost, changed = dict.fromkeys(free, 0), True
    while changed:
        changed = False
        for p, cs in rules:
            if all(c in cost for c in cs) and 1 + sum(cost[c] for c in cs) < cost.get(p, math.inf):
                cost[p], changed = 1 + sum(cost[c] for c in cs), True
    return cost


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    free, rules = random_graph(seed)
    mols, rxns = tables(spark, free, rules)
    assert {r.mol: r.cost for r in G.and_or_depth(mols, rxns)[0].collect()} == plain_depth(free, rules)
    assert {r.mol: r.tree_cost for r in G.shortest_cost(mols, rxns).collect()} == plain_cost(free, rules)
    shuffled = rules[::-1]
    mols, rxns = tables(spark, free, shuffled)
    assert {r.mol for r in G.solved(mols, rxns)[0].collect()} == set(plain_depth(free, rules))


def test_best_product(spark):
    edges = spark.createDataFrame([("r", 1, 2, 0.5), ("r", 2, 3, 0.5), ("r", 1, 3, 0.2), ("r", 3, 4, float("nan")), ("r", 1, 5, 0.0)], "run string, parent long, child long, score double")
    got = {r.mol: (r.cumulative, r.per_step, r.edges) for r in G.best_product(spark.createDataFrame([("r", 1)], "run string, mol long"), edges).collect()}
    assert got[3] == pytest.approx((0.25, 0.5, 2)) and got[4][0] == pytest.approx(0.125) and got[5][0] == pytest.approx(1e-4)
    assert got[1][1] is None


def test_enumeration_and_its_fallback(spark):
    free, rules = [5, 6], [(1, [2, 3]), (2, [5]), (2, [6]), (3, [5]), (3, [1])]
    mols, rxns = tables(spark, free, rules)
    root = spark.createDataFrame([("r", 1)], "run string, mol long")
    assert [r.reactions for r in G.enumerate_routes(mols, rxns, root).orderBy("route").collect()] == [[0, 1, 3], [0, 2, 3]]
    assert len(G.enumerate_routes(mols, rxns, root, max_routes=1).collect()) == 1


def test_route_trees_are_optimal_and_draws_differ(spark):
    free, rules = [9], [(1, [2]), (1, [3]), (2, [9]), (3, [9])]
    mols, rxns = tables(spark, free, rules)
    cost, chosen = G.and_or_depth(mols, rxns)
    trees = G.route_trees(cost.where("mol = 1").select("run", "mol"), cost, chosen, rxns, mols, draws=8, seed=1).collect()
    sets = {}
    for r in trees:
        sets.setdefault(r.draw, {})[r.mol] = r.cost
    assert sorted(sorted(s) for s in sets.values()) == [[1, 2], [1, 3]]
    assert all(s[1] == 2 for s in sets.values())


def plain_search(free, rules, root, budget, depth_sign):
    ids, depth, opened, known, out = {root: 0}, {root: 0}, set(), [], []
    for step in range(budget):
        solved = plain_depth([m for m in ids if m in free], known)
        if root in solved:
            break
        front = [m for m in ids if m not in solved and m not in opened and m not in free]
        if not front:
            break
        m = min(front, key=lambda x: (depth_sign * depth[x], ids[x]))
        opened.add(m)
        first = {}
        for i, (p, cs) in enumerate(rules):
            if p == m:
                known.append((p, cs))
                for c in cs:
                    first.setdefault(c, (i, c))
        for c in sorted(first, key=first.get):
            if c not in ids:
                ids[c], depth[c] = len(ids), depth[m] + 1
            depth[c] = min(depth[c], depth[m] + 1)
        out.append((step, m, root in plain_depth([x for x in ids if x in free], known)))
    return out


@pytest.mark.parametrize("policy,sign", [(breadth_first, 1), (depth_first, -1)])
def test_batched_search_equals_single_runs(spark, policy, sign):
    free, rules = random_graph(11, 20, 34)
    rules = [(p, list(dict.fromkeys(cs))) for p, cs in rules]
    options = spark.createDataFrame([(p, i, c, c) for i, (p, cs) in enumerate(rules) for c in cs], "parent long, rxn long, child long, place long")
    env = Environment(options, spark.createDataFrame([(m,) for m in free], "mol long"))
    roots = [m for m in range(20) if m not in free][:4]
    log, mols, runs = search(spark.createDataFrame([(str(m), m) for m in roots], "run string, mol long"), env, policy, budget=4)
    got = {}
    for r in log.orderBy("step").collect():
        got.setdefault(int(r.run), []).append((r.step, r.mol, r.solved_after))
    want = {m: plain_search(free, rules, m, 4, sign) for m in roots}
    assert got == {m: w for m, w in want.items() if w}
    for r in runs.collect():
        own = want[int(r.run)]
        assert r.n_expansions == len(own) and r.solved == bool(own and own[-1][2])
        assert r.stopped_because == ("solved" if r.solved else "budget" if len(own) == 4 else "frontier_empty")


def test_a_search_out_of_time(spark):
    options = spark.createDataFrame([(1, 0, 2, 2)], "parent long, rxn long, child long, place long")
    env = Environment(options, spark.createDataFrame([(9,)], "mol long"))
    goals = spark.createDataFrame([("a", 1), ("b", 9)], "run string, mol long")
    _, _, runs = search(goals, env, breadth_first, budget=3, max_seconds=-1.0)
    assert {r.run: r.stopped_because for r in runs.collect()} == {"a": "time", "b": "solved"}
    _, _, runs = search(goals, env, breadth_first, budget=3)
    assert {r.run: (r.stopped_because, r.n_expansions) for r in runs.collect()} == {"a": ("frontier_empty", 2), "b": ("solved", 0)}


def test_costs_too_large_for_a_sum(spark):
    """A small improvement beside costs beyond 2^60 still counts."""
    free, rules = [0], [(100, [0]), (101, [100] * (1 << 30)), (102, [101] * (1 << 30)), (20, [21] * 5), (21, [0]), (20, [22]), (22, [23]), (23, [24]), (24, [0]), (30, [20])]
    mols = {m for p, cs in rules for m in (p, cs[0])}
    rows = [("r", i, p, cs[0], len(cs)) for i, (p, cs) in enumerate(rules)]
    got = G.shortest_cost(spark.createDataFrame([("r", m, m in free) for m in mols], M), spark.createDataFrame(rows, X)).collect()
    cost = {r.mol: r.tree_cost for r in got}
    assert cost[20] == 4 and cost[30] == 5 and cost[102] > 2.0**60


def plain_routes(free, rules, mol, path=()):
    """All routes by recursion, without bounds."""
    if mol in free:
        return [[]]
    out = []
    for i, (p, cs) in enumerate(rules):
        if p == mol and mol not in path:
            parts = [[]]
            for c in sorted(cs):
                parts = [a + b for a in parts for b in plain_routes(free, rules, c, (*path, mol))]
            out += [[i, *x] for x in parts]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_enumeration_of_random_graphs_with_text_ids(spark, seed):
    free, rules = random_graph(seed, 9, 14)
    mols, rxns = tables(spark, free, rules)
    from pyspark.sql import functions as F

    named = lambda c: F.format_string("%03d", c)
    mols = mols.withColumn("mol", named(F.col("mol")))
    rxns = rxns.select("run", named(F.col("rxn")).alias("rxn"), named(F.col("parent")).alias("parent"), named(F.col("child")).alias("child"), "times")
    got = {}
    for r in G.enumerate_routes(mols, rxns, mols.select("run", "mol"), max_routes=10_000).orderBy("root", "route").collect():
        got.setdefault(int(r.root), []).append([int(x) for x in r.reactions])
    want = {m: plain_routes(free, rules, m) for m in {m for p, cs in rules for m in (p, *cs)} | set(free)}
    assert got == {m: w for m, w in want.items() if w}


@pytest.mark.parametrize("seed", range(6, 12))
def test_enumeration_with_many_cycles_and_repeated_children(spark, seed):
    rng = random.Random(seed)
    rules = [(rng.randrange(1, 6), [rng.randrange(0, 7) for _ in range(rng.randint(1, 3))]) for _ in range(9)]
    mols, rxns = tables(spark, [0, 6], rules)
    got = {}
    for r in G.enumerate_routes(mols, rxns, mols.select("run", "mol"), max_routes=7).orderBy("root", "route").collect():
        got.setdefault(r.root, []).append(r.reactions)
    want = {m: plain_routes([0, 6], rules, m)[:7] for m in {m for p, cs in rules for m in (p, *cs)} | {0, 6}}
    assert got == {m: w for m, w in want.items() if w}


def test_enumeration_gives_the_cheapest_where_cycles_have_too_many_ways(spark):
    rules = [(1, [2]), (2, [1]), (1, [0]), (2, [0]), (3, [0]), (3, [0, 0])]
    mols, rxns = tables(spark, [0], rules)
    got = {}
    for r in G.enumerate_routes(mols, rxns, mols.select("run", "mol"), max_contexts=0).collect():
        got.setdefault(r.root, []).append(r.reactions)
    assert got == {0: [[]], 1: [[2]], 2: [[3]], 3: [[4], [5]]}


UCT_RULES = [(1, [2, 3]), (1, [4]), (2, [90]), (3, [90]), (4, [5]), (5, [4])]


def uct_run(spark, rules, near, budget, **more):
    """(log by step, why the run ended) of a search by UCT from m1 with text ids; m90 is available."""
    options = spark.createDataFrame([(f"m{p}", f"x{i}", f"m{c}", j) for i, (p, cs) in enumerate(rules) for j, c in enumerate(cs)], "parent string, rxn string, child string, place int")
    mols = {m for p, cs in rules for m in (p, *cs)}
    scores = spark.createDataFrame([(f"m{m}", near.get(m, 0.1 if m == 1 else 0.5)) for m in mols], "mol string, closeness double")
    env = Environment(options, spark.createDataFrame([("m90",)], "mol string"), scores)
    log, _, runs = search(spark.createDataFrame([("a", "m1")], "run string, mol string"), env, UCT(**more), budget=budget)
    return log.orderBy("step").collect(), runs.first().stopped_because


def test_uct_solves_and_keeps_its_budget(spark):
    out, why = uct_run(spark, UCT_RULES, {90: 1.0}, 10)
    assert out[-1].solved_after and len({r.mol for r in out}) == len(out) <= 10 and why == "solved"
    short, why = uct_run(spark, UCT_RULES, {90: 1.0}, 1)
    assert len(short) == 1 and why == "budget"


def test_uct_by_hand(spark):
    """The order worked by hand.

    Opening m1 (reward 0.9, the better reaction's weakest precursor) shows x0 = {m2 0.9, m3 0.95} and x1 = {m4 0.2}.
    Walk 2: priors 0.9 and 0.2 with equal exploration: x0, and of m2 and m3 the larger prior: m3, whose reaction needs m6 (0.0):
    reward max(0.95, 0.0). Walk 3: x0 has mean 0.95 + sqrt(ln 3 / 2), x1 0.2 + sqrt(ln 3): x0 (1.69 to 1.25); m2 is unvisited:
    0.9 + sqrt(ln 2) beats m3's 0.95 + sqrt(ln 2 / 2).
    """
    near = {2: 0.9, 3: 0.95, 4: 0.2, 6: 0.0, 90: 1.0}
    out, _ = uct_run(spark, [(1, [2, 3]), (1, [4]), (3, [6]), (2, [90])], near, 3)
    assert [r.mol for r in out] == ["m1", "m3", "m2"] and not out[-1].solved_after


def test_uct_dead_end_takes_the_closest(spark):
    """m2 has no reaction: the walk through it ends, and the closest molecule left is opened."""
    out, why = uct_run(spark, [(1, [2]), (1, [3]), (3, [90])], {2: 0.9, 3: 0.1, 90: 1.0}, 5)
    assert [r.mol for r in out] == ["m1", "m2", "m3"] and why == "solved"
