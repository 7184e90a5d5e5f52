"""Selection policies over the frontiers of many runs at once, and the search that calls them.

A policy is a function from a frontier (run, mol, depth, id, and scores) to one row per run.
It is the only point of extension: rank, cap, filter and view belong to the environment.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import Log, cut, release
from .frontier import select_view

Policy = Callable[[DataFrame], DataFrame]


def _pick(frontier: DataFrame, order) -> DataFrame:
    return frontier.groupBy("run").agg(F.min_by("mol", order).alias("mol"))


def breadth_first(frontier: DataFrame) -> DataFrame:
    return _pick(frontier, F.struct("depth", "id"))


def depth_first(frontier: DataFrame) -> DataFrame:
    return _pick(frontier, F.struct((-F.col("depth")).alias("d"), "id"))


def greedy(penalty: float = 0.0) -> Policy:
    """Least (1 - closeness) + penalty * depth, to nine digits, then the least id; needs ``closeness``."""
    return lambda frontier: _pick(frontier, F.struct(F.round(1 - F.col("closeness") + penalty * F.col("depth"), 9).alias("h"), "id"))


def with_view(policy: Policy, order: str, top_k: int, seed: int = 0) -> Policy:
    """The policy under the truncated view that a model would get."""

    def pick(frontier: DataFrame) -> DataFrame:
        seen = select_view(frontier, order, top_k, seed, shuffle=False).select("run", "id")
        return policy(frontier.join(seen, ["run", "id"]))

    return pick


def observe(picks: DataFrame, view: DataFrame) -> DataFrame:
    """(run, visible): whether each pick was in the view (both run, id)."""
    return picks.join(view.select("run", "id", F.lit(True).alias("seen")), ["run", "id"], "left").select("run", F.coalesce("seen", F.lit(False)).alias("visible"))


@dataclass
class Environment:
    """What every policy meets: ``options`` (parent, rxn, child, place), ``free`` (mol), ``scores`` (mol, …)."""

    options: DataFrame
    free: DataFrame
    scores: DataFrame | None = None


@dataclass
class State:
    """What the searches know so far, as logs: a step appends what it found, and rewrites nothing.

    ``seen`` has a row for each molecule and run when it is found, and another when it is found
    nearer to the root; ``opened`` the decisions, ``edges`` the reactions, ``solved`` what they solve.
    """

    roots: DataFrame
    seen: Log
    opened: Log
    edges: Log
    solved: Log
    scores: tuple[str, ...]
    max_depth: int | None
    step: int = 0

    def molecules(self) -> DataFrame:
        """(run, mol, id, depth, available, scores): each molecule once, at its least depth."""
        fixed = [F.max(c).alias(c) for c in ("available", *self.scores)]
        return self.seen.table().groupBy("run", "mol").agg(F.min("id").alias("id"), F.min("depth").alias("depth"), *fixed)

    def settled(self) -> DataFrame:
        return self.solved.table().select("run", "mol")

    def live(self) -> DataFrame:
        """(run, target) of the runs whose root is not solved."""
        left = self.roots.where("not available").select("run", "mol")
        return left.join(self.settled(), ["run", "mol"], "left_anti").select("run", F.col("mol").alias("target"))

    def frontier(self) -> DataFrame:
        front = self.molecules().where("not available").join(self.live(), "run")
        front = front.join(self.opened.table().select("run", "mol"), ["run", "mol"], "left_anti").join(self.settled(), ["run", "mol"], "left_anti")
        return front if self.max_depth is None else front.where(F.col("depth") < self.max_depth)


def search(
    targets: DataFrame, env: Environment, policy: Policy, budget: int, max_depth: int | None = None, max_seconds: float | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, molecules, runs) of one search per (run, mol) in ``targets``.

    A step expands one molecule in every run that is neither solved nor out of candidates;
    all runs advance in the same jobs.  New molecules get ids in order of reaction and place,
    the root 0.  What a step solves is carried upwards from its new reactions alone.  A policy
    with ``needs_graph`` gets the root and the sizes of each run's graph too, one with ``state``
    is shown the whole state before it picks.  ``runs`` tells why each run ended: solved,
    frontier_empty, budget, or time if ``max_seconds`` were over before a step.
    """
    # read from tables in each step, however they were made
    spark = targets.sparkSession
    known = env.free.select("mol", F.lit(True).alias("available")).distinct()
    if env.scores is not None:
        known = known.join(env.scores, "mol", "full")
    scores = tuple(c for c in known.columns if c not in ("mol", "available"))
    known = cut(known.na.fill(False, ["available"]), "known")

    def facts(df: DataFrame) -> DataFrame:
        return df.join(known, "mol", "left").na.fill(False, ["available"])

    options = facts(env.options.select("parent", "rxn", F.col("child").alias("mol"), "place")).withColumnRenamed("mol", "child")
    options = cut(options, "options")
    roots = cut(facts(targets.select("run", "mol").distinct()), "roots")
    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    run, mol, rxn, own = kind(roots, "run"), kind(roots, "mol"), kind(options, "rxn"), "".join(f", {kind(known, c)}" for c in scores)
    named = lambda name: mol.replace("`mol`", f"`{name}`")
    state = State(
        roots, Log(spark, "seen", f"{run}, {mol}, id long, depth int, available boolean{own}"), Log(spark, "opened", f"{run}, {mol}, id long, depth int, frontier_size long"),
        Log(spark, "edges", f"{run}, {rxn}, {named('parent')}, {named('child')}, {kind(options, 'place')}, depth int, available boolean{own}"),
        Log(spark, "solved", f"{run}, {mol}"), scores, max_depth,
    )
    state.seen.append(roots.select("run", "mol", F.lit(0).cast("long").alias("id"), F.lit(0).alias("depth"), "available", *scores), -1)
    steps, late, began = 0, False, time.monotonic()
    for step in range(budget):
        late = max_seconds is not None and time.monotonic() - began > max_seconds
        if late:
            break
        state.step = step
        front = state.frontier()
        if getattr(policy, "needs_graph", False) or getattr(policy, "state", False):
            if getattr(policy, "needs_graph", False):
                front = _with_sizes(front, state)
            front = cut(front, "frontier")  # such a policy reads it more than once
        if getattr(policy, "state", False):
            policy.look(state)
        sizes = front.groupBy("run").agg(F.count("*").alias("frontier_size"))
        picks = policy(front).select("run", "mol").join(front.select("run", "mol", "id", "depth"), ["run", "mol"]).join(sizes, "run")
        chosen = state.opened.append(picks.select("run", "mol", "id", "depth", "frontier_size"), step)
        release(front)
        if chosen.isEmpty():
            break
        steps += 1
        new = chosen.select("run", F.col("mol").alias("parent"), (F.col("depth") + 1).alias("depth")).join(options, "parent")
        new = state.edges.append(new.select(*state.edges.columns), step)
        found = new.groupBy("run", F.col("child").alias("mol")).agg(
            F.min("depth").alias("d"), F.min(F.struct("rxn", "place")).alias("first"), *(F.max(c).alias(c) for c in ("available", *scores))
        )
        before = state.molecules()
        top = before.groupBy("run").agg(F.max("id").alias("top"))
        old = before.join(found.select("run", "mol"), ["run", "mol"], "left_semi").select("run", "mol", F.col("id").alias("old"), F.col("depth").alias("was"))
        met = found.join(old, ["run", "mol"], "left").where("old is null or d < was").join(top, "run")
        number = F.row_number().over(Window.partitionBy("run").orderBy(F.col("old").isNotNull(), "first", "mol"))
        state.seen.append(met.select("run", "mol", F.coalesce("old", F.col("top") + number).alias("id"), F.col("d").alias("depth"), "available", *scores), step)
        _carry_up(state, new, step)
    return _decisions(state), _molecules(state), _runs(state, budget, steps, late)


def _with_sizes(front: DataFrame, state: State) -> DataFrame:
    """The frontier with the sizes of each run's graph."""
    done = state.settled().withColumn("done", F.lit(True))
    mols = state.molecules().select("run", "mol", "available").join(done, ["run", "mol"], "left")
    sizes = mols.groupBy("run").agg(F.count("*").alias("n_molecules"), F.count_if(F.col("available") | F.coalesce("done", F.lit(False))).alias("n_solved"))
    made = state.edges.table().groupBy("run").agg(F.count_distinct("rxn").alias("n_reactions"))
    return front.join(sizes, "run").join(made, "run", "left").na.fill(0, ["n_reactions"])


def _carry_up(state: State, rows: DataFrame, step: int) -> None:
    """Logs the molecules that new reactions solve, and what these solve in turn, level by level."""
    level = 0
    while True:
        done = state.settled().select("run", F.col("mol").alias("child"), F.lit(True).alias("done"))
        whole = rows.select("run", "rxn", "parent", "child", "available").join(done, ["run", "child"], "left")
        whole = whole.groupBy("run", "rxn", "parent").agg(F.bool_and(F.col("available") | F.coalesce("done", F.lit(False))).alias("whole")).where("whole")
        fired = whole.select("run", F.col("parent").alias("mol")).distinct().join(state.settled(), ["run", "mol"], "left_anti")
        fired = state.solved.append(fired, step, level)
        if fired.isEmpty():
            return
        # only reactions with a child that is new among the solved can follow
        edges = state.edges.table()
        touched = edges.join(fired.select("run", F.col("mol").alias("child")), ["run", "child"], "left_semi").select("run", "rxn").distinct()
        rows, level = edges.join(touched, ["run", "rxn"], "left_semi"), level + 1


def _decisions(state: State) -> DataFrame:
    """A row for each decision, with what it found and whether the root was solved after it."""
    n = state.edges.table().groupBy("run", "step").agg(F.count_distinct("rxn").alias("n_neighbours"))
    won = state.solved.table().groupBy("run", "mol").agg(F.min("step").alias("won")).join(state.roots.select("run", "mol"), ["run", "mol"], "left_semi").select("run", "won")
    rows = state.opened.table().join(n, ["run", "step"], "left").join(won, "run", "left").na.fill(0, ["n_neighbours"])
    after = F.coalesce(F.col("won") <= F.col("step"), F.lit(False)).alias("solved_after")
    return rows.select("run", "step", F.col("id").alias("node_id"), "mol", "depth", "frontier_size", "n_neighbours", after)


def _molecules(state: State) -> DataFrame:
    opened, done = (t.select("run", "mol", F.lit(True).alias(c)) for t, c in ((state.opened.table(), "expanded"), (state.settled(), "solved")))
    rows = state.molecules().join(opened, ["run", "mol"], "left").join(done, ["run", "mol"], "left").na.fill(False, ["expanded", "solved"])
    return rows.select("run", "mol", "available", "id", "depth", "expanded", (F.col("solved") | F.col("available")).alias("solved"))


def _runs(state: State, budget: int, steps: int, late: bool) -> DataFrame:
    taken = state.opened.table().groupBy("run").agg(F.count("*").alias("n_expansions"))
    done = state.settled().withColumn("done", F.lit(True))
    runs = state.roots.join(done, ["run", "mol"], "left").withColumn("solved", F.col("available") | F.coalesce("done", F.lit(False)))
    runs = runs.select("run", "mol", "solved").join(taken, "run", "left").na.fill(0, ["n_expansions"])
    why = F.when(F.col("solved"), "solved").when(F.col("n_expansions") >= budget, "budget").when(F.lit(late) & (F.col("n_expansions") == steps), "time").otherwise("frontier_empty")
    return runs.withColumn("stopped_because", why)


class UCT:
    """Upper confidence bounds over the graphs of all runs, as tables; ``closeness`` scores a molecule that is not settled.

    Visits and rewards are sums over the log of credited paths, by run and molecule or reaction.  A
    step works out, for all runs at once, each opened molecule's reaction of the largest bound, and that
    reaction's open precursors by falling bound; no more rows a run than it has opened.  A run's row of
    these pointers is then followed from its root, past molecules that the walk has met, to a molecule
    of the frontier.  The walk earns what that molecule turns out to be worth once it is opened: the
    better of its own closeness and its reactions' weakest precursors.  A walk that ends elsewhere
    earns nothing, and the closest molecule of the frontier is opened instead, the first of equals.

    The bound is mean reward (an unvisited reaction's weakest precursor, an unvisited molecule's
    closeness) + c * sqrt(ln(1 + visits above) / (1 + visits)), to nine digits; of equal ones the
    smaller id is taken.
    """

    state = True

    def __init__(self, c: float = 1.0, max_walk: int = 64):
        self.c, self.max_walk = c, max_walk
        self.known: State | None = None
        self.credits: Log | None = None
        self.walks: DataFrame | None = None

    def look(self, state: State) -> None:
        if self.known is not state:
            run, mol, rxn = (f"`{c}` {log.schema[c].dataType.simpleString()}" for log, c in ((state.seen, "run"), (state.seen, "mol"), (state.edges, "rxn")))
            self.known, self.walks, self.credits = state, None, Log(state.roots.sparkSession, "credits", f"{run}, {mol}, {rxn}, reward double")

    def _worth(self) -> DataFrame:
        """(run, mol, w, closed, front): what a molecule counts, whether it is settled, whether it may be opened."""
        state = self.known
        opened, done = (t.select("run", "mol", F.lit(True).alias(c)) for t, c in ((state.opened.table(), "opened"), (state.settled(), "done")))
        rows = state.molecules().join(opened, ["run", "mol"], "left").join(done, ["run", "mol"], "left")
        closed = F.col("available") | F.coalesce("done", F.lit(False))
        front = ~closed & F.col("opened").isNull() & (F.lit(True) if state.max_depth is None else F.col("depth") < state.max_depth)
        return rows.select("run", "mol", F.when(closed, 1.0).otherwise(F.coalesce(F.col("closeness").cast("double"), F.lit(0.0))).alias("w"), closed.alias("closed"), front.alias("front"))

    def _credit(self, worth: DataFrame) -> None:
        """Logs what the last step's walks have earned, now that their molecules are opened."""
        new = self.known.edges.part(self.known.step - 1).select("run", "rxn", "parent", F.col("child").alias("mol"))
        weakest = new.join(worth.select("run", "mol", "w"), ["run", "mol"]).groupBy("run", "rxn", "parent").agg(F.min("w").alias("w"))
        below = weakest.groupBy("run", F.col("parent").alias("mol")).agg(F.max("w").alias("below"))
        earned = self.walks.join(worth.select("run", "mol", "w"), ["run", "mol"]).join(below, ["run", "mol"], "left").withColumn("reward", F.greatest("w", F.coalesce("below", F.lit(0.0))))
        kinds = self.credits.schema
        node = lambda mol, rxn, reward: F.struct(mol.cast(kinds["mol"].dataType).alias("mol"), rxn.cast(kinds["rxn"].dataType).alias("rxn"), reward.alias("reward"))
        none, on_path = F.lit(None), F.when(F.col("found"), F.col("reward")).otherwise(0.0)
        instead = F.filter(F.array(node(F.col("mol"), none, F.col("reward"))), lambda _: ~F.col("found"))
        rows = F.concat(F.transform("mols", lambda m: node(m, none, on_path)), F.transform("rxns", lambda x: node(none, x, on_path)), instead)
        self.credits.append(earned.select("run", F.explode(rows).alias("n")).select("run", "n.mol", "n.rxn", "n.reward"), self.known.step - 1)

    def _bound(self, n: Column, total: Column, prior: Column, above: Column) -> Column:
        n = F.coalesce(n, F.lit(0))
        return F.round(F.when(n > 0, total / n).otherwise(prior) + self.c * F.sqrt(F.ln(F.coalesce(above, F.lit(0)) + 1.0) / (1 + n)), 9)

    def _pointers(self, worth: DataFrame, live: DataFrame) -> DataFrame:
        """(run, next): for each opened molecule its best reaction, and that one's open precursors, best first."""
        credits = self.credits.table()
        sums = [F.count("*").alias("n"), F.sum("reward").alias("total")]
        mols = credits.where("mol is not null").groupBy("run", "mol").agg(*sums)
        rxns = credits.where("rxn is not null").groupBy("run", "rxn").agg(*sums)
        edges = self.known.edges.table().select("run", "rxn", "parent", F.col("child").alias("mol")).join(live, "run", "left_semi")
        open_ = F.collect_set(F.when(~F.col("closed"), F.struct("mol", "w", "front")))
        own = edges.join(worth, ["run", "mol"]).groupBy("run", "rxn", "parent").agg(F.min("w").alias("weakest"), open_.alias("open"))
        own = own.join(rxns, ["run", "rxn"], "left").join(mols.select("run", F.col("mol").alias("parent"), F.col("n").alias("above")), ["run", "parent"], "left")
        order = F.struct((-self._bound(F.col("n"), F.col("total"), F.col("weakest"), F.col("above"))).alias("b"), "rxn")
        best = own.groupBy("run", "parent").agg(F.min_by(F.struct("rxn", "open", "n"), order).alias("x"))
        kids = best.select("run", "parent", "x.rxn", F.col("x.n").alias("above"), F.explode_outer("x.open").alias("k")).select("run", "parent", "rxn", "above", "k.*")
        kids = kids.join(mols, ["run", "mol"], "left")
        entry = F.struct((-self._bound(F.col("n"), F.col("total"), F.col("w"), F.col("above"))).alias("b"), "mol", "front")
        lists = kids.groupBy("run", "parent", "rxn").agg(F.sort_array(F.collect_list(F.when(F.col("mol").isNotNull(), entry))).alias("kids"))
        # a row for each molecule that the run has opened
        return lists.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("parent", F.struct("rxn", "kids")))).alias("next"))

    def _follow(self, mol: Column, front: Column, to: Column, kinds: StructType) -> Column:
        """The walk along the pointers: where it ended (``at``), if on the frontier (``found``), and the molecules and reactions on it."""
        none = lambda c: F.array().cast(f"array<{kinds[c].dataType.simpleString()}>")

        def state(at, front, stop, found, mols, rxns):
            return F.struct(at.alias("at"), front.alias("front"), stop.alias("stop"), found.alias("found"), mols.alias("mols"), rxns.alias("rxns"))

        def step(s, _):
            node = F.try_element_at(to, s["at"])
            mols, yes, no = F.array_append(s["mols"], s["at"]), F.lit(True), F.lit(False)
            met = F.get(F.filter(node["kids"], lambda k: ~F.array_contains(mols, k["mol"])), F.lit(0))
            rxns = F.array_append(s["rxns"], node["rxn"])
            return (
                F.when(s["stop"], s).when(s["front"], state(s["at"], s["front"], yes, yes, mols, s["rxns"])).when(node.isNull(), state(s["at"], s["front"], yes, no, mols, s["rxns"]))
                .when(met.isNull(), state(s["at"], s["front"], yes, no, mols, rxns)).otherwise(state(met["mol"], met["front"], no, no, mols, rxns))
            )

        # a walk meets no molecule twice, so it ends after those that are opened
        steps = F.sequence(F.lit(1), F.lit(min(self.max_walk, self.known.step + 2)))
        return F.aggregate(steps, state(mol, front, F.lit(False), F.lit(False), none("mol"), none("rxn")), step)

    def __call__(self, frontier: DataFrame) -> DataFrame:
        worth, state = self._worth(), self.known
        if self.walks is not None:
            self._credit(worth)
        live = frontier.select("run").distinct()
        closest = F.max_by("mol", F.struct(F.coalesce(F.col("closeness").cast("double"), F.lit(0.0)).alias("w"), (-F.col("id")).alias("i")))
        instead = frontier.groupBy("run").agg(closest.alias("instead"))
        starts = state.roots.select("run", "mol").join(instead, "run").join(worth.select("run", "mol", "front"), ["run", "mol"])
        walked = starts.join(self._pointers(worth, live), "run", "left").select("run", "instead", self._follow(F.col("mol"), F.col("front"), F.col("next"), self.credits.schema).alias("w"))
        out = walked.select("run", F.when(F.col("w.found"), F.col("w.at")).otherwise(F.col("instead")).alias("mol"), "w.found", "w.mols", "w.rxns")
        self.walks = cut(out, "walks", self.walks)
        return self.walks.select("run", "mol")
