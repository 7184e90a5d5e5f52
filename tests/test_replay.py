"""Replays of trees against a walk step by step."""

import hashlib
import json
import random
import re

import pytest

from routeloom.operators import models as L
from routeloom.operators.policy import Environment
from routeloom.operators.replay import replay


def plain(run, cost, rules, free, max_depth, top_k, seed=0):
    """(pairs, outcome) by opening one molecule after another; rules are (parent, children), numbered in their order."""
    root = min(cost, key=lambda m: (-cost[m], m))
    depth, ids, opened, known, pairs, current = {root: 0}, {root: 0}, [], [], [], root
    while True:
        own = [(i, cs) for i, (p, cs) in enumerate(rules) if p == current]
        if depth[current] >= max_depth:
            return pairs, "depth cap"
        if not own:
            return pairs, "no candidate"
        opened.append(current)
        known += [(current, cs) for _, cs in own]
        first = {}
        for i, cs in own:
            for place, c in enumerate(cs):
                first.setdefault(c, (i, place))
        for c in sorted(first, key=first.get):
            ids.setdefault(c, len(ids))
            depth[c] = min(depth.get(c, 1 << 30), depth[current] + 1)
        if set(cost) <= set(opened):
            return pairs, "complete"
        front = [m for m in ids if m not in opened and m not in free]
        rank = {m: sum(depth[x] == depth[m] and ids[x] < ids[m] for x in front) for m in front}
        view = sorted(front, key=lambda m: (rank[m], depth[m]))[:top_k]
        n = len(view)
        key = lambda m: (hashlib.md5(f"{seed + n}:{run}/{len(opened)}:{ids[m]}".encode()).hexdigest(), ids[m])
        view.sort(key=key)
        seen = [m for m in view if m in cost]
        if not seen:
            return pairs, "truncated away" if any(m in cost for m in front) else "thread lost"
        pick = min(seen, key=lambda m: (-cost[m], m))
        done = {m for m in ids if m in free}
        while more := {p for p, cs in known if p not in done and all(c in done for c in cs)}:
            done |= more
        sizes = (len(ids), len(done), len(known))
        pairs.append((len(opened), sizes, [(m, depth[m]) for m in view], view.index(pick), depth[pick], len(seen), len(view), len(front)))
        current = pick


def read(r):
    sizes = tuple(map(int, re.search(r"Graph: (\d+) molecules \((\d+) of them solved\), (\d+) reactions", r.user).groups()))
    lines = [(int(m), int(d)) for m, d in re.findall(r"(?m)^\[\d+\] (\d+) \| depth=(\d+)", r.user)]
    return (r.step, sizes, lines, json.loads(r.assistant)["choice"], r.depth, r.n_on_route, r.n_shown, r.n_frontier)


def tables(spark, trees, rules, free):
    rows = [(run, m, c) for run, cost in trees.items() for m, c in cost.items()]
    options = spark.createDataFrame([(p, i, c, j) for i, (p, cs) in enumerate(rules) for j, c in enumerate(cs)], "parent long, rxn long, child long, place long")
    return spark.createDataFrame(rows, "run string, mol long, cost int"), Environment(options, spark.createDataFrame([(m,) for m in free], "mol long"))


def solvable(rules, free):
    cost, level = {m: 0 for m in free}, 0
    while True:
        level += 1
        new = {p for p, cs in rules if p not in cost and all(c in cost for c in cs)}
        if not new:
            return cost
        cost |= {p: level for p in new}


def tree_of(root, cost, rules, free, rng):
    out, todo = {}, [root]
    while todo:
        m = todo.pop()
        if m not in free and m not in out:
            out[m] = cost[m]
            todo += rng.choice([cs for p, cs in rules if p == m and all(cost.get(c, 99) < cost[m] for c in cs)])
    return out


@pytest.mark.parametrize(("top_k", "max_depth"), [(20, 7), (3, 7), (2, 3), (1, 7)])
def test_against_a_walk(spark, top_k, max_depth):
    rng = random.Random(7)
    free, rules = set(range(8)), []
    for m in range(8, 60):  # later molecules of earlier ones, and some of anything
        for _ in range(rng.randint(1, 4)):
            rules.append((m, [rng.randrange(max(1, m)) for _ in range(rng.randint(1, 3))]))
        rules.append((m, [rng.randrange(70) for _ in range(2)]))
    cost = solvable(rules, free)
    trees = {f"t{m}": tree_of(m, cost, rules, free, rng) for m in range(20, 60) if cost.get(m, 0) >= 2}
    mols, env = tables(spark, trees, rules, free)
    pairs, outcomes = replay(mols, env, max_depth=max_depth, top_k=top_k)
    got = {run: [] for run in trees}
    for r in pairs.orderBy("run", "step").collect():
        got[r.run].append(read(r))
        assert r.system == L.system_prompt(L.ToolSurface()) and r.user.startswith(f"Target molecule: {r.run[1:]}\n")
    want = {run: plain(run, own, rules, free, max_depth, top_k) for run, own in trees.items()}
    assert {r.run: (r.outcome, r.n_pairs) for r in outcomes.collect()} == {run: (why, len(p)) for run, (p, why) in want.items()}
    assert got == {run: p for run, (p, _) in want.items()}
    assert top_k == 20 or len({why for _, why in want.values()}) > 1
    assert sum(len(t) for t in trees.values()) > 60


def test_the_hard_branch_comes_first(spark):
    rules = [(1, [2, 3]), (2, [9]), (3, [4]), (4, [9]), (1, [5])]
    mols, env = tables(spark, {"a": {1: 3, 2: 1, 3: 2, 4: 1}}, rules, {9})
    pairs, outcomes = replay(mols, env)
    rows = [read(r) for r in pairs.orderBy("step").collect()]
    assert [lines[choice][0] for _, _, lines, choice, *_ in rows] == [3, 2, 4]
    assert tuple(outcomes.first()) == ("a", "complete", 3)


def test_how_a_replay_ends(spark):
    rules = [(1, [2]), (2, [3]), (3, [9]), (5, [6]), (7, [8])]
    trees = {"deep": {1: 3, 2: 2, 3: 1}, "bare": {5: 2, 6: 1}, "lost": {7: 2, 4: 1}, "odd": {40: 1}}
    mols, env = tables(spark, trees, rules, {9})
    outcomes = {r.run: (r.outcome, r.n_pairs) for r in replay(mols, env, max_depth=2)[1].collect()}
    assert outcomes == {"deep": ("depth cap", 2), "bare": ("no candidate", 1), "lost": ("thread lost", 0), "odd": ("no candidate", 0)}
    none = mols.limit(0)
    pairs, outcomes = replay(none, env)
    assert pairs.count() == outcomes.count() == 0
