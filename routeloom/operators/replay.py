"""Replays of route trees: the decisions that a route teaches, all steps of all trees at once.

A tree opens the molecule of the highest remaining cost first, of equal ones the smaller.  As a child
costs less than its parent, that order is the order of cost: known before anything is replayed.  So each
molecule that the replay meets has the steps at which it enters and leaves the frontier, and the frontiers of all
steps are one explosion of these intervals; no loop runs over the steps.

A decision sees only a view of its frontier.  Where the view hides the next molecule of that order,
another one of the tree is taken if it shows one; the order after it is known again, so the replay goes
on from there in another round, for such trees alone.  Where it shows none, the replay ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Log, cut, release
from .frontier import select_view
from .models import ToolSurface, prompts_of, system_prompt
from .policy import Environment

NEVER = 1 << 30


def replay(
    trees: DataFrame, env: Environment, max_depth: int = 7, top_k: int = 20, order: str = "stratified", seed: int = 0, tools: ToolSurface = ToolSurface()
) -> tuple[DataFrame, DataFrame]:
    """(pairs, outcomes) of the trees (run, mol, cost: a route's molecules that are not available, its target the costliest).

    Pairs: run, step, system, user, assistant, depth of the chosen molecule, n_on_route, n_shown, n_frontier;
    none for the target, which every replay opens first.  Outcomes: run, outcome, n_pairs, where an
    outcome is ``complete`` (every molecule of the tree is opened), ``depth cap`` (the next one lies too deep),
    ``no candidate`` (the one opened has no reaction), ``truncated away`` (the view hides all of the tree that the
    frontier has) or ``thread lost`` (the frontier has none of it).
    """
    trees = cut(trees.select("run", "mol", "cost").distinct(), "trees")
    free = env.free.select(F.col("mol").alias("child"), F.lit(True).alias("available")).distinct()
    options = env.options.select("parent", "rxn", "child", "place").join(free, "child", "left").na.fill(False, ["available"])
    edges = cut(trees.select("run", F.col("mol").alias("parent")).join(options, "parent"), "replay-edges")
    plan = trees.withColumn("pos", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("cost"), "mol")) - 1)
    plan = cut(plan.withColumn("checked", F.lit(1)), "plan")  # decisions before it are settled
    kind = trees.schema["run"].dataType.simpleString()
    spark = trees.sparkSession
    pairs = Log(spark, "pairs", f"`run` {kind}, decision int, user string, assistant string, depth int, n_on_route int, n_shown int, n_frontier int")
    ends = Log(spark, "ends", f"`run` {kind}, outcome string")
    turn = 0
    while not plan.isEmpty():
        timed = cut(_timed(plan, edges), "timed")
        decided = cut(_decide(edges, timed, top_k, order, seed, tools), "decided")
        # the last decision of this round: where a tree leaves its order, or ends
        stop = F.when((F.col("opened_depth") >= max_depth) | ~F.col("opens"), F.col("pos"))
        last = timed.groupBy("run").agg(F.min(stop).alias("stops"), F.max("pos").alias("whole"))
        off = decided.where("mol is null or mol <> planned").groupBy("run").agg(F.min("step").alias("off"))
        runs = cut(last.join(off, "run", "left").withColumn("until", F.least("off", "stops", "whole")), "last")
        told = decided.join(runs.select("run", "until"), "run").where("step <= until and mol is not null")
        pairs.append(told.withColumnRenamed("step", "decision"), turn)
        at_end = runs.join(decided.select("run", F.col("step").alias("until"), "mol", "hidden"), ["run", "until"], "left")
        at_stop = timed.select("run", F.col("pos").alias("stops"), (F.col("opened_depth") >= max_depth).alias("deep"))
        at_end = cut(at_end.join(at_stop, ["run", "stops"], "left"), "at-end")
        # a stop counts when its molecule is the one that is opened there
        strays = F.col("off").isNotNull() & (F.col("off") <= F.coalesce("stops", F.lit(NEVER)))
        outcome = F.when(strays, F.when(F.col("hidden"), "truncated away").otherwise("thread lost")).when(F.col("deep"), "depth cap").when(F.col("stops").isNotNull(), "no candidate").otherwise("complete")
        moves = strays & F.col("mol").isNotNull()
        ends.append(at_end.where(~moves).select("run", outcome.alias("outcome")), turn)
        moved = at_end.where(moves).select("run", F.col("off").alias("to"), F.col("mol").alias("taken"))
        own = plan.join(moved, "run")
        came = own.where("mol = taken").select("run", F.col("pos").alias("of"))
        shifted = F.when(F.col("mol") == F.col("taken"), F.col("to")).when(F.col("pos").between(F.col("to"), F.col("of")), F.col("pos") + 1).otherwise(F.col("pos"))
        following = cut(own.join(came, "run").select("run", "mol", "cost", shifted.alias("pos"), (F.col("to") + 1).alias("checked")), "plan")
        if not following.isEmpty():  # the trees that go on are all that the next round reads
            edges = cut(edges.join(moved.select("run"), "run", "left_semi"), "replay-edges", edges)
        for table in (plan, timed, decided, runs, at_end):
            release(table)
        plan, turn = following, turn + 1
    told = pairs.table().withColumn("system", F.lit(system_prompt(tools)))
    counts = told.groupBy("run").agg(F.count("*").alias("n_pairs"))
    outcomes = ends.table().select("run", "outcome").join(counts, "run", "left").na.fill(0, ["n_pairs"])
    return told.select("run", F.col("decision").alias("step"), "system", "user", "assistant", "depth", "n_on_route", "n_shown", "n_frontier"), outcomes


def _timed(plan: DataFrame, edges: DataFrame) -> DataFrame:
    """The plan with each molecule's depth when it is opened, whether it has reactions, and the step from which it counts as solved.

    A route's molecules stand in one row of their run while these are worked out.
    """
    places = plan.select("run", F.col("mol").alias("child"), F.col("pos").alias("at"))
    inside = edges.join(places, ["run", "child"], "left")
    above = inside.where("at is not null").groupBy("run", F.col("child").alias("mol")).agg(F.collect_set("parent").alias("parents"))
    known = F.col("available") | F.col("at").isNotNull()
    rxns = inside.groupBy("run", F.col("parent").alias("mol"), "rxn").agg(F.bool_and(known).alias("whole"), F.collect_set(F.when(~F.col("available"), F.col("at"))).alias("needs"))
    rxns = rxns.groupBy("run", "mol").agg(F.collect_list(F.when(F.col("whole"), F.col("needs"))).alias("ways"), F.count("*").alias("reactions"))
    rows = plan.join(above, ["run", "mol"], "left").join(rxns, ["run", "mol"], "left")
    up = rows.select("run", "mol", "pos", F.explode("parents").alias("parent")).join(plan.select("run", F.col("mol").alias("parent"), F.col("pos").alias("of")), ["run", "parent"])
    up = up.where("of < pos").groupBy("run", "mol").agg(F.collect_set("of").alias("up"))
    rows = rows.drop("parents").join(up, ["run", "mol"], "left")
    none = F.array().cast("array<int>")
    entry = F.struct("pos", F.coalesce("up", none).alias("up"), F.coalesce("ways", F.array().cast("array<array<int>>")).alias("ways"))
    lists = rows.groupBy("run").agg(F.sort_array(F.collect_list(entry)).alias("s"))

    def deeper(depths: Column, s: Column) -> Column:
        over = F.array_min(F.transform(s["up"], lambda j: F.get(depths, j)))
        return F.array_append(depths, F.when(s["pos"] == 0, 0).otherwise(F.coalesce(over + 1, F.lit(NEVER))).cast("int"))

    def settle(times: Column, _: Column) -> Column:
        way = lambda kids: F.coalesce(F.array_max(F.transform(kids, lambda j: F.get(times, j))), F.lit(0))
        once = lambda s: F.greatest(s["pos"] + 1, F.coalesce(F.array_min(F.transform(s["ways"], way)), F.lit(NEVER)))
        return F.transform("s", once)

    depths = F.aggregate("s", none, deeper)
    # a molecule's time rests on a way of at most so many molecules
    times = F.aggregate("s", F.transform("s", lambda s: F.lit(NEVER)), settle)
    timed = lists.select("run", F.posexplode(F.arrays_zip(depths.alias("depth"), times.alias("solved"))).alias("pos", "x"))
    timed = timed.select("run", "pos", F.col("x.depth").alias("opened_depth"), F.col("x.solved").alias("solved_at"))
    return rows.select("run", "mol", "cost", "pos", "checked", F.coalesce("reactions", F.lit(0)).alias("reactions"), F.col("reactions").isNotNull().alias("opens")).join(timed, ["run", "pos"])


def _decide(edges: DataFrame, timed: DataFrame, top_k: int, order: str, seed: int, tools: ToolSurface) -> DataFrame:
    """A row for each unsettled decision: the prompt, what it takes (null if the view shows nothing of the tree) and what was planned."""
    roots = timed.where("pos = 0").select("run", F.col("mol").alias("target"))
    ends = timed.groupBy("run").agg(F.max("pos").alias("whole"), F.max("checked").alias("checked"))
    met = edges.join(timed.select("run", F.col("mol").alias("parent"), (F.col("pos") + 1).alias("from"), (F.col("opened_depth") + 1).alias("depth")), ["run", "parent"])
    found = met.groupBy("run", F.col("child").alias("mol")).agg(
        F.min(F.struct("from", "rxn", "place")).alias("first"), F.max("available").alias("available"), F.collect_set(F.struct("from", "depth")).alias("depths")
    )
    found = found.join(roots, "run").where(F.col("mol") != F.col("target"))
    found = cut(found.withColumn("id", F.row_number().over(Window.partitionBy("run").orderBy("first", "mol")).cast("long")), "found")
    # the sizes of the graph before each decision, as running sums over the steps
    came = found.groupBy("run", F.col("first.from").alias("pos")).agg(F.count("*").alias("mols"), F.count_if("available").alias("ready"))
    won = timed.groupBy("run", F.col("solved_at").alias("pos")).agg(F.count("*").alias("won"))
    steps = timed.select("run", "pos", F.col("mol").alias("planned"), F.lag("reactions", 1, 0).over(Window.partitionBy("run").orderBy("pos")).alias("more"))
    so_far = Window.partitionBy("run").orderBy("pos")
    steps = steps.join(came, ["run", "pos"], "left").join(won, ["run", "pos"], "left").na.fill(0, ["mols", "ready", "won"])
    steps = steps.select(
        "run", F.col("pos").alias("step"), "planned", (1 + F.sum("mols").over(so_far)).alias("n_molecules"), F.sum("more").over(so_far).alias("n_reactions"),
        F.sum(F.col("ready") + F.col("won")).over(so_far).alias("n_solved"),
    )
    own = timed.select("run", "mol", "pos", "cost")
    spans = found.where("not available").join(own, ["run", "mol"], "left").join(ends, "run")
    begin, end = F.greatest("first.from", "checked"), F.least(F.coalesce("pos", F.col("whole")), "whole")
    spans = spans.where(begin <= end).select("run", "mol", "id", "target", "cost", "depths", F.explode(F.sequence(begin, end)).alias("step"))
    depth = F.array_min(F.transform(F.filter("depths", lambda x: x["from"] <= F.col("step")), lambda x: x["depth"]))
    front = spans.withColumn("depth", depth).drop("depths").join(steps, ["run", "step"])
    # each decision is a run of its own to the views
    front = cut(front.withColumnRenamed("run", "tree").withColumn("run", F.concat_ws("/", "tree", "step")), "replay-front")
    view = cut(select_view(front, order, top_k, seed), "replay-view")
    seen = view.join(front.where("cost is not null").select("run", "id", "mol", "cost", "depth"), ["run", "id"])
    first = F.struct((-F.col("cost")).alias("c"), "mol")
    best = seen.groupBy("run").agg(F.min_by(F.struct("place", "mol", "depth"), first).alias("b"), F.count("*").cast("int").alias("n_on_route"))
    state = front.groupBy("run").agg(F.first("tree").alias("tree"), F.first("step").alias("step"), F.first("planned").alias("planned"), F.bool_or(F.col("cost").isNotNull()).alias("hidden"))
    texts = prompts_of(front, view, order, tools)
    shown = steps.join(ends.select("run", "checked"), "run").where("step >= checked").select(F.col("run").alias("tree"), "step", F.col("planned").alias("planned_"))
    out = state.join(texts, "run").join(best, "run", "left").drop("run")
    # a decision without a frontier has lost the thread
    out = shown.join(out, ["tree", "step"], "left")
    return out.select(
        F.col("tree").alias("run"), "step", F.col("planned_").alias("planned"), F.col("b.mol").alias("mol"), F.coalesce("hidden", F.lit(False)).alias("hidden"), F.col("prompt").alias("user"),
        F.format_string('{"choice": %d}', F.col("b.place") - 1).alias("assistant"), F.col("b.depth").cast("int").alias("depth"), "n_on_route",
        F.col("n_candidates").alias("n_shown"), F.col("n_frontier").cast("int").alias("n_frontier"),
    )
