"""AND-OR graphs as tables: solved molecules, depths, costs, routes.

Molecules are rows (run, mol, available); reactions are rows (run, rxn, parent, child, times):
a row for each distinct child.  A reaction needs all its children, a molecule any of its
reactions.  ``run`` may hold many graphs: each loop step advances all of them at once.
Loops end when nothing changes, and cut their lineage at each step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Log, cut, release

KEYS = ["run", "rxn", "parent"]


def reaction_rows(children: DataFrame) -> DataFrame:
    """From one row per place of a child to one per distinct child with its number of places."""
    return children.groupBy(*KEYS, "child").agg(F.count("*").cast("int").alias("times"))


#: Rounds in which reactions fall that lack a child for good; each is two joins, and the loops after it read what is left in every step.
ROUNDS = 3


def makeable(reactions: DataFrame, free: DataFrame) -> DataFrame:
    """Those of the reactions, as a table, that may serve to make something: their parent is not available, and each child is, or is made by one of them.

    What falls can never fire, so solved molecules, depths and costs stay as they are.  It is no fixpoint: after ``ROUNDS``
    rounds some may be left that never fire either.
    """
    made = reactions.join(free.withColumnRenamed("mol", "parent"), ["run", "parent"], "left_anti").select(reactions.columns)
    left = cut(made, "makeable")
    for _ in range(ROUNDS):
        known = free.select("run", "mol").unionByName(left.select("run", F.col("parent").alias("mol"))).distinct()
        dead = left.join(known.withColumnRenamed("mol", "child"), ["run", "child"], "left_anti").select(*KEYS).distinct()
        left = cut(left.join(dead, KEYS, "left_anti").select(reactions.columns), "makeable", left)
    return left


def and_or_depth(molecules: DataFrame, reactions: DataFrame, max_levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(run, mol, cost) of every solvable molecule and (run, rxn, parent) of all reactions that reach it.

    ``cost`` is 0 if available, else 1 + the least over reactions of the largest over children.
    Level by level: a step joins only the molecules that the step before solved, and counts
    down what each open reaction still lacks; a molecule is assigned once.
    """
    cost = cut(molecules.where("available").select("run", "mol", F.lit(0).alias("cost")).distinct(), "cost")
    need = makeable(reactions.select(*KEYS, "child").distinct(), cost.select("run", "mol"))
    lacks = cut(need.groupBy(*KEYS).agg(F.count("*").alias("lacks")), "lacks")
    fresh, costs, chosen, level = cost, [cost], [], 0
    while max_levels is None or level < max_levels:
        level += 1
        met = need.join(fresh.select("run", F.col("mol").alias("child")), ["run", "child"]).groupBy(*KEYS).agg(F.count("*").alias("met"))
        lacks = lacks.join(met, KEYS, "left").withColumn("lacks", F.col("lacks") - F.coalesce("met", F.lit(0))).drop("met")
        lacks = cut(lacks, "lacks")  # the one table that a level writes; later levels read what it fired
        fired = lacks.where("lacks = 0").select(*KEYS)
        if fired.isEmpty():
            break
        fresh = fired.select("run", F.col("parent").alias("mol")).distinct().withColumn("cost", F.lit(level))
        costs.append(fresh)
        chosen.append(fired)
        # reactions of solved molecules are closed: what fires later is no shortest way
        lacks = lacks.where("lacks > 0").join(fresh.select("run", F.col("mol").alias("parent")), ["run", "parent"], "left_anti")
    chosen = chosen or [reactions.select(*KEYS).limit(0)]
    return cut(reduce(DataFrame.unionByName, costs), "cost"), cut(reduce(DataFrame.unionByName, chosen), "chosen")


def solved(molecules: DataFrame, reactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The least fixpoint: (run, mol) of solved molecules, (run, rxn, parent) of solved reactions."""
    cost, _ = and_or_depth(molecules, reactions)
    mols = cost.select("run", "mol")
    need = reactions.select(*KEYS, "child").distinct()
    open_ = need.join(mols.withColumnRenamed("mol", "child"), ["run", "child"], "left_anti").select("run", "rxn").distinct()
    return mols, need.select(*KEYS).distinct().join(open_, ["run", "rxn"], "left_anti")


def swap_available(solved_mols: DataFrame, reactions: DataFrame, available: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(run, mol) solved after some molecules became available and others ceased to be, from those solved before.

    All but ``reactions`` are (run, mol); ``available`` is the new state, in which all of ``added`` and
    none of ``removed`` count.  First whatever the removed ones may have served to solve is put in doubt,
    upwards through the reactions that they completed; then what the rest still solves is derived
    again, along with what the added ones newly solve.  What can be doubted, and what can be derived again, is
    gathered once; a step reads that alone and writes what the last one reached, or what is left to derive.  A cycle that leant on a removed
    molecule alone stays out, as all of it is in doubt.
    """
    pair = ["run", "mol"]
    old, free = cut(solved_mols.select(*pair).distinct(), "solved"), cut(available.select(*pair).distinct(), "free")
    edges = cut(reactions.select(*KEYS, "child").distinct(), "edges")

    # what can be put in doubt: solved molecules that are not available, by those of their reactions that were complete
    known = old.withColumnRenamed("mol", "child")
    kept = edges.join(old.join(free, pair, "left_anti").withColumnRenamed("mol", "parent"), ["run", "parent"], "left_semi")
    broken = kept.join(known, ["run", "child"], "left_anti").select("run", "rxn").distinct()
    leans = cut(kept.join(broken, ["run", "rxn"], "left_anti").select("run", "parent", "child").distinct(), "leans")
    step = cut(removed.select(*pair).distinct().join(old, pair, "left_semi").join(free, pair, "left_anti"), "doubt")
    doubt = step
    while not step.isEmpty():
        led = leans.join(step.withColumnRenamed("mol", "child"), ["run", "child"], "left_semi").select("run", F.col("parent").alias("mol")).distinct()
        step = cut(led.join(doubt, pair, "left_anti"), "doubt")
        doubt = doubt.unionByName(step)
    known = cut(old.join(doubt, pair, "left_anti").unionByName(added.select(*pair).join(free, pair, "left_semi")).distinct(), "known")
    # what stands is closed but for the doubted and the added, so only reactions of molecules that are not known are looked at from here on, and of these what can be made
    rest = makeable(edges, known)
    lacks = rest.join(known.withColumnRenamed("mol", "child"), ["run", "child"], "left_anti")
    lacks = cut(lacks, "lacks")
    ready = rest.select(*KEYS).distinct().join(lacks.select("run", "rxn").distinct(), ["run", "rxn"], "left_anti")
    step = cut(ready.select("run", F.col("parent").alias("mol")).distinct(), "derived")
    out = known
    while not step.isEmpty():
        out = out.unionByName(step)
        # reactions of what is known are closed, the others lack what is left of their children
        open_ = lacks.join(step.withColumnRenamed("mol", "parent"), ["run", "parent"], "left_anti")
        left = cut(open_.join(step.withColumnRenamed("mol", "child"), ["run", "child"], "left_anti").select(*KEYS, "child"), "lacks")
        ready = open_.select(*KEYS).distinct().join(left.select("run", "rxn").distinct(), ["run", "rxn"], "left_anti")
        step = cut(ready.select("run", F.col("parent").alias("mol")).distinct(), "derived")
        release(lacks)
        lacks = left
    return out


def frontier(molecules: DataFrame, solved_mols: DataFrame) -> DataFrame:
    """Molecules that are neither available, expanded nor solved."""
    left = molecules.where("not available and not expanded")
    return left.join(solved_mols.select("run", "mol"), ["run", "mol"], "left_anti")


def shortest_cost(molecules: DataFrame, reactions: DataFrame) -> DataFrame:
    """(run, mol, tree_cost, rxn): 0 if available, else 1 + the summed cost of the children, at its least.

    A shared child counts once for each use and a repeated one by its times, so this is the
    cost of the route as a tree; ``distinct_reactions`` tells how many steps it really has.
    Only reactions with a child whose cost fell are summed again; it ends when nothing changes.
    """
    kind = reactions.schema["rxn"].dataType
    best = cut(molecules.where("available").select("run", "mol", F.lit(0.0).alias("tree_cost"), F.lit(None).cast(kind).alias("rxn")).distinct(), "best")
    left = makeable(reactions.select(*KEYS, "child", "times"), best.select("run", "mol"))
    sized = cut(left.withColumn("n", F.count("*").over(Window.partitionBy("run", "rxn"))), "sized", left)
    fell = best.select("run", "mol")
    while True:
        # the reactions with a child whose cost fell, summed over all their children
        touched = sized.join(fell.withColumnRenamed("mol", "child"), ["run", "child"]).select("run", "rxn").distinct()
        known = sized.join(touched, ["run", "rxn"], "left_semi").join(best.select("run", F.col("mol").alias("child"), "tree_cost"), ["run", "child"])
        total = known.groupBy(*KEYS, "n").agg(F.count("*").alias("k"), (1 + F.sum(F.col("times") * F.col("tree_cost"))).alias("total"))
        offers = total.where("k = n").groupBy("run", F.col("parent").alias("mol")).agg(F.min(F.struct("total", "rxn")).alias("o"))
        old = best.select("run", "mol", F.struct(F.col("tree_cost").alias("total"), "rxn").alias("b"))
        won = offers.join(old, ["run", "mol"], "left").where("b is null or o < b")
        # of equal costs the smaller reaction wins, which changes no other cost
        won = cut(won.select("run", "mol", F.col("o.total").alias("tree_cost"), "o.rxn", F.expr("b is null or o.total < b.total").alias("fell")), "won")
        if won.isEmpty():
            release(sized)
            return best
        best = cut(best.join(won.select("run", "mol"), ["run", "mol"], "left_anti").unionByName(won.drop("fell")), "best", best)
        fell = won.where("fell").select("run", "mol")


def closure(roots: DataFrame, best: DataFrame, reactions: DataFrame) -> DataFrame:
    """(run, root, mol, rxn, level): the molecules of each root's chosen route, by its best reactions.

    ``level`` is the least number of steps from the root.
    """
    best = cut(best.select("run", "mol", "rxn"), "best")
    # only the chosen reactions are walked, and they are read from a table in each step
    used = best.where("rxn is not null").select("run", "rxn")
    reactions = cut(reactions.select("run", "rxn", "child").join(used, ["run", "rxn"], "left_semi"), "walked")
    step = roots.select("run", F.col("mol").alias("root"), "mol").distinct()
    step = cut(step.join(best.where("rxn is not null").select("run", "mol", "rxn"), ["run", "mol"]).withColumn("level", F.lit(0)), "closure")
    seen, level = step, 0
    while not step.isEmpty():
        level += 1
        below = step.join(reactions.select("run", "rxn", "child"), ["run", "rxn"]).select("run", "root", F.col("child").alias("mol")).distinct()
        below = below.join(best.where("rxn is not null").select("run", "mol", "rxn"), ["run", "mol"])
        step = cut(below.join(seen.select("run", "root", "mol"), ["run", "root", "mol"], "left_anti").withColumn("level", F.lit(level)), "closure")
        seen = seen.unionByName(step)
    return cut(seen, "closure")


def route_lengths(roots: DataFrame, best: DataFrame, reactions: DataFrame) -> DataFrame:
    """(run, mol, tree_cost, distinct_reactions) of each solvable root."""
    steps = closure(roots, best, reactions).groupBy("run", F.col("root").alias("mol")).agg(F.count_distinct("rxn").alias("distinct_reactions"))
    out = roots.select("run", "mol").distinct().join(best.select("run", "mol", "tree_cost"), ["run", "mol"])
    return out.join(steps, ["run", "mol"], "left").na.fill(0, ["distinct_reactions"])


def best_product(roots: DataFrame, edges: DataFrame, floor: float = 1e-4, fallback: float = 0.5) -> DataFrame:
    """(run, mol, cumulative, per_step, edges) of the best product of edge scores from a root.

    ``edges`` has run, parent, child, score; a missing score counts ``fallback``, a small one
    ``floor``.  Ties keep fewer edges.  Relaxation with minus logarithms; only molecules whose
    distance fell are joined in the next step.
    """
    score = F.coalesce(F.nanvl("score", F.lit(None)), F.lit(fallback))
    costs = edges.select("run", "parent", "child", (-F.ln(F.greatest(score, F.lit(floor)))).alias("w"))
    costs = cut(costs.groupBy("run", "parent", "child").agg(F.min("w").alias("w")), "edges")
    best = cut(roots.select("run", "mol", F.lit(0.0).alias("dist"), F.lit(0).alias("n")).distinct(), "dist")
    fresh = best
    while not fresh.isEmpty():
        offers = fresh.join(costs, (fresh.run == costs.run) & (fresh.mol == costs.parent))
        offers = offers.select(fresh.run, F.col("child").alias("mol"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("n") + 1).alias("n"))
        offers = offers.groupBy("run", "mol").agg(F.min(F.struct(F.round("dist", 12).alias("dist"), "n")).alias("o"))
        old = best.select("run", "mol", F.struct("dist", "n").alias("b"))
        fresh = offers.join(old, ["run", "mol"], "left").where("b is null or o < b").select("run", "mol", "o.dist", "o.n")
        fresh = cut(fresh, "dist-fresh")
        best = cut(best.join(fresh.select("run", "mol"), ["run", "mol"], "left_anti").unionByName(fresh), "dist", best)
    total = F.exp(-F.col("dist"))
    per_step = F.when(F.col("n") > 0, F.pow(total, 1 / F.nullif("n", F.lit(0))))
    return best.select("run", "mol", total.alias("cumulative"), per_step.alias("per_step"), F.col("n").alias("edges"))


def route_trees(
    targets: DataFrame, cost: DataFrame, chosen: DataFrame, reactions: DataFrame, molecules: DataFrame, draws: int = 1, seed: int = 0
) -> DataFrame:
    """(run, target, draw, mol, cost): the molecules of an optimal route of each target and draw.

    Where reactions tie at the optimum, one is drawn by a hash of seed, draw, target and
    molecule. Equal trees of one target are kept once (the lowest draw).
    """
    from .frontier import seeded

    free = cut(molecules.where("available").select("run", "mol").distinct(), "free")
    reactions = cut(reactions.select("run", "rxn", "child").join(chosen.select("run", "rxn"), ["run", "rxn"], "left_semi"), "walked")
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    step = cut(targets.select("run", F.col("mol").alias("target"), "mol", draw).distinct(), "tree")
    seen = step
    while not step.isEmpty():
        options = step.join(chosen.withColumnRenamed("parent", "mol"), ["run", "mol"])
        key = seeded(seed, "run", "draw", "target", "mol", "rxn")
        pick = options.groupBy("run", "target", "draw", "mol").agg(F.min_by("rxn", F.struct(key.alias("k"), "rxn")).alias("rxn"))
        below = pick.join(reactions.select("run", "rxn", "child"), ["run", "rxn"]).select("run", "target", F.col("child").alias("mol"), "draw").distinct()
        below = below.join(free, ["run", "mol"], "left_anti")
        step = cut(below.join(seen, ["run", "target", "draw", "mol"], "left_anti").select("run", "target", "mol", "draw"), "tree")
        seen = seen.unionByName(step)
    trees = cut(seen, "tree")
    sets = trees.groupBy("run", "target", "draw").agg(F.array_sort(F.collect_list("mol")).alias("set"))
    kept = sets.groupBy("run", "target", "set").agg(F.min("draw").alias("draw")).select("run", "target", "draw")
    return trees.join(kept, ["run", "target", "draw"]).join(cost.select("run", "mol", "cost"), ["run", "mol"], "left").na.fill(-1, ["cost"])


def mine_edges(applied: DataFrame, free: DataFrame) -> DataFrame:
    """(substrate, precursors): the distinct sets that rules make from their own substrates.

    ``applied`` has substrate and molecules; available substrates and self-products go.
    """
    rest = applied.join(free.select(F.col("mol").alias("substrate")), "substrate", "left_anti")
    kept = F.array_sort(F.array_distinct(F.filter("molecules", lambda m: m.isNotNull() & (m != "") & (m != F.col("substrate")))))
    return rest.select("substrate", kept.alias("precursors")).where(F.size("precursors") > 0).distinct()


def enumerate_routes(molecules: DataFrame, reactions: DataFrame, roots: DataFrame, max_routes: int = 256, max_contexts: int = 1000) -> DataFrame:
    """(run, root, route, reactions): solved routes below each root, in order of reaction ids, depth first.

    All roots share one graph.  First the routes of each molecule are counted, level by level up
    from what is available: a sum over its reactions of the products over their children, a repeated
    child for each place, up to ``max_routes``, which bounds the listing by definition.  Then route i of
    a root is read off the counts: its number falls in the range of one reaction, and what is left is
    split into numbers of the children, the first slowest.  A level of all routes of all roots is a join.

    Cycles are cut along the path, so below a molecule that can reach one the routes depend on the
    molecules above.  Such molecules are counted once for each set of cycle members above them; a run
    where one molecule has more than ``max_contexts`` of these lists each such root's cheapest route instead.
    """
    kids = reactions.select(*KEYS, "child", F.col("times").cast("int").alias("times"))
    free = cut(molecules.where("available").select("run", "mol").distinct(), "free")
    roots = cut(roots.select("run", "mol").distinct(), "roots")
    # reactions of available molecules are never taken
    edges = cut(kids.join(free.withColumnRenamed("mol", "parent"), ["run", "parent"], "left_anti"), "edges")
    none = F.array().cast(f"array<{roots.schema['mol'].dataType.simpleString()}>")
    plain = edges.withColumn("pctx", none).withColumn("cctx", none)
    own = edges.select("run", F.col("child").alias("mol")).unionByName(roots).distinct()
    ends = own.join(edges.select("run", F.col("parent").alias("mol")).distinct(), ["run", "mol"], "left_anti").join(free, ["run", "mol"], "left_anti")
    leaves = free.select("run", "mol", none.alias("ctx"), F.lit(1).cast("long").alias("n")).unionByName(ends.select("run", "mol", none.alias("ctx"), F.lit(0).cast("long").alias("n")))
    counts = _count_routes(plain, leaves, max_routes)
    cyclic = cut(edges.select("run", F.col("parent").alias("mol")).distinct().join(counts.table().select("run", "mol"), ["run", "mol"], "left_anti"), "cyclic")
    lost = None
    if not cyclic.isEmpty():
        below, lost = _unroll(edges, cyclic, roots, counts, max_contexts)
        known = plain.join(cyclic.withColumnRenamed("mol", "parent"), ["run", "parent"], "left_anti")
        plain = cut(known.unionByName(below), "edges")
        counts = _count_routes(plain, leaves.unionByName(_dead_ends(plain, leaves)), max_routes)
    out = _unrank(_ranges(plain, counts.table(), max_routes), roots, counts.table())
    if lost is None:
        return out
    # what was given up has its cheapest route
    given = cut(lost.join(roots, ["run", "mol"]), "given-up")
    steps = closure(given, shortest_cost(molecules, reactions), reactions).groupBy("run", "root").agg(F.sort_array(F.collect_list(F.struct("level", "rxn"))).alias("s"))
    cheapest = steps.select("run", "root", F.lit(0).alias("route"), F.col("s.rxn").alias("reactions"))
    return out.join(given.withColumnRenamed("mol", "root"), ["run", "root"], "left_anti").unionByName(cheapest)


NODE = ["run", "mol", "ctx"]


def _count_routes(edges: DataFrame, leaves: DataFrame, most: int) -> Log:
    """(run, mol, ctx, n) of all nodes whose children can be counted, from the leaves up; n is ``most`` at the most.

    ``edges`` has run, rxn, parent, pctx, child, cctx, times.
    """
    kinds = ", ".join(f"`{c}` {leaves.schema[c].dataType.simpleString()}" for c in NODE)
    counts, level = Log(edges.sparkSession, "counts", f"{kinds}, n long"), 0
    counts.append(leaves, 0)
    while True:
        done = counts.table().select(*NODE, "n")
        rest = edges.join(done.select("run", F.col("mol").alias("parent"), F.col("ctx").alias("pctx")), ["run", "parent", "pctx"], "left_anti")
        if level:
            # only nodes with a child that the last level counted can follow
            last = counts.part(level).select("run", F.col("mol").alias("child"), F.col("ctx").alias("cctx"))
            rest = rest.join(rest.join(last, ["run", "child", "cctx"], "left_semi").select("run", "parent", "pctx").distinct(), ["run", "parent", "pctx"], "left_semi")
        known = rest.join(done.select("run", F.col("mol").alias("child"), F.col("ctx").alias("cctx"), "n"), ["run", "child", "cctx"], "left")
        times = F.flatten(F.collect_list(F.array_repeat("n", F.col("times"))))
        each = known.groupBy("run", "parent", "pctx", "rxn").agg(F.count_if(F.col("n").isNull()).alias("lacks"), _product(times, most).alias("n"))
        whole = each.groupBy("run", F.col("parent").alias("mol"), F.col("pctx").alias("ctx")).agg(F.sum("lacks").alias("lacks"), F.least(F.sum("n"), F.lit(most)).alias("n"))
        level += 1
        if counts.append(whole.where("lacks = 0"), level).isEmpty():
            return counts


def _product(numbers: Column, most: int) -> Column:
    """The product of an array's numbers, at most ``most`` if none of them is 0."""
    least = F.aggregate(numbers, F.lit(1).cast("long"), lambda a, n: F.least(a * n, F.lit(most).cast("long")))
    return F.when(F.exists(numbers, lambda n: n == 0), F.lit(0).cast("long")).otherwise(least)


def _dead_ends(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """Nodes that no reaction is left to."""
    nodes = edges.select("run", F.col("child").alias("mol"), F.col("cctx").alias("ctx")).distinct()
    nodes = nodes.join(edges.select("run", F.col("parent").alias("mol"), F.col("pctx").alias("ctx")).distinct(), NODE, "left_anti")
    return nodes.join(leaves.select(*NODE), NODE, "left_anti").withColumn("n", F.lit(0).cast("long"))


def _unroll(edges: DataFrame, cyclic: DataFrame, roots: DataFrame, counts: Log, most: int) -> tuple[DataFrame, DataFrame]:
    """The edges of the molecules that can reach a cycle, once for each set of cycle members above; and those of runs that have too many sets."""
    inner = cut(edges.join(cyclic.withColumnRenamed("mol", "parent"), ["run", "parent"], "left_semi"), "inner")
    core = cyclic  # what no cycle leads to is on none
    links = inner.select("run", "parent", F.col("child").alias("mol")).distinct().join(cyclic, ["run", "mol"], "left_semi")
    while True:
        led = links.join(core.withColumnRenamed("mol", "parent"), ["run", "parent"], "left_semi").select("run", "mol").distinct()
        smaller = cut(core.join(led, ["run", "mol"], "left_semi"), "core")
        if smaller.count() == core.count():
            break
        core = smaller
    # an option with a child that cannot be made is none: a count of 0 already, or not solvable at all
    bad = inner.join(counts.table().where("n = 0").select("run", F.col("mol").alias("child")), ["run", "child"], "left_semi").select("run", "rxn").distinct()
    inner = inner.join(bad, ["run", "rxn"], "left_anti")
    marks = cyclic.select("run", F.col("mol").alias("child"), F.lit(True).alias("again"))
    inner = inner.join(marks, ["run", "child"], "left").join(core.select("run", F.col("mol").alias("parent"), F.lit(True).alias("core")), ["run", "parent"], "left")
    inner = cut(inner.na.fill(False, ["again", "core"]), "inner")
    none = F.array().cast(f"array<{cyclic.schema['mol'].dataType.simpleString()}>")
    kinds = ", ".join(f"`{c}` {cyclic.schema[c].dataType.simpleString()}" for c in ("run", "mol")) + f", ctx array<{cyclic.schema['mol'].dataType.simpleString()}>"
    nodes, level = Log(edges.sparkSession, "contexts", kinds), 0
    step = nodes.append(roots.join(cyclic, ["run", "mol"], "left_semi").withColumn("ctx", none), 0)
    lost = cyclic.limit(0)

    def options(at: DataFrame) -> DataFrame:
        """The edges of nodes: an option that leads back to the path is dropped whole."""
        rows = at.select("run", F.col("mol").alias("parent"), F.col("ctx").alias("pctx")).join(inner, ["run", "parent"])
        back = F.array_contains("pctx", F.col("child")) | (F.col("child") == F.col("parent"))
        cut_off = rows.where(back).select("run", "parent", "pctx", "rxn").distinct()
        above = F.when(F.col("core"), F.array_sort(F.array_union("pctx", F.array("parent")))).otherwise(F.col("pctx"))
        rows = rows.join(cut_off, ["run", "parent", "pctx", "rxn"], "left_anti").withColumn("cctx", F.when(F.col("again"), above).otherwise(none))
        return rows.select(*KEYS, "pctx", "child", "cctx", "times", "again")

    while not step.isEmpty():
        level += 1
        below = options(step).where("again").select("run", F.col("child").alias("mol"), F.col("cctx").alias("ctx")).distinct()
        step = nodes.append(below.join(nodes.table().select(*NODE), NODE, "left_anti"), level)
        full = nodes.table().groupBy("run", "mol").agg(F.count("*").alias("k")).where(F.col("k") > most).select("run").distinct()
        lost = cyclic.join(full, "run", "left_semi")
        step = step.join(full, "run", "left_anti")
    kept = nodes.table().select(*NODE).join(lost.select("run").distinct(), "run", "left_anti")
    return cut(options(kept).drop("again"), "unrolled"), lost


def _ranges(edges: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """(run, mol, ctx, options): each node's reactions with the numbers of routes that they stand for, and their children's shares of these.

    A reaction that begins beyond ``most`` is never asked for, so a node has no more than that.
    """
    known = edges.join(counts.select("run", F.col("mol").alias("child"), F.col("ctx").alias("cctx"), "n"), ["run", "child", "cctx"])
    places = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("child", "cctx", "n", "times"))), lambda k: F.array_repeat(F.struct(k["child"].alias("mol"), k["cctx"].alias("ctx"), k["n"].alias("n")), k["times"])))
    each = known.groupBy("run", "parent", "pctx", "rxn").agg(places.alias("kids"))
    each = each.withColumn("n", _product(F.col("kids.n"), most)).where("n > 0")
    order = Window.partitionBy("run", "parent", "pctx").orderBy("rxn")
    begin = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = each.withColumn("lo", begin).where(F.col("lo") < most)
    # a child's number is what is left over the product of those after it
    share = F.transform("kids", lambda k, i: F.struct(k["mol"].alias("mol"), k["ctx"].alias("ctx"), k["n"].alias("n"), _product(F.slice(F.col("kids.n"), i + 2, F.size("kids")), most).alias("after")))
    option = F.struct("lo", (F.col("lo") + F.col("n")).alias("hi"), "rxn", share.alias("kids"))
    return cut(kept.select("run", F.col("parent").alias("mol"), F.col("pctx").alias("ctx"), option.alias("o")).groupBy(*NODE).agg(F.collect_list("o").alias("options")), "ranges")


def _unrank(ranges: DataFrame, roots: DataFrame, counts: DataFrame) -> DataFrame:
    """(run, root, route, reactions) of all routes of the roots: level by level the reaction of each node's number, and numbers for its children."""
    spark, mol = ranges.sparkSession, ranges.schema["mol"].dataType.simpleString()
    rxn = ranges.schema["options"].dataType.elementType["rxn"].dataType.simpleString()
    first = roots.join(counts.where(F.size("ctx") == 0), ["run", "mol"]).where("n > 0")
    first = first.select("run", F.col("mol").alias("root"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("route"), "mol", "ctx")
    kinds = f"run {ranges.schema['run'].dataType.simpleString()}, root {mol}, route long, place array<int>"
    todo, taken = Log(spark, "numbers", f"{kinds}, mol {mol}, ctx array<{mol}>, i long"), Log(spark, "taken", f"{kinds}, rxn {rxn}, rest array<struct<mol: {mol}, ctx: array<{mol}>, i: long>>")
    start = todo.append(first.withColumn("place", F.array().cast("array<int>")).withColumn("i", F.col("route")), 0)
    step, level = start, 0
    while True:
        met = F.filter("options", lambda o: (o["lo"] <= F.col("i")) & (F.col("i") < o["hi"]))[0]
        chosen = step.join(ranges, NODE).withColumn("o", met).withColumn("r", F.col("i") - F.col("o.lo"))
        rest = F.transform("o.kids", lambda k: F.struct(k["mol"].alias("mol"), k["ctx"].alias("ctx"), (F.floor(F.col("r") / k["after"]).cast("long") % k["n"]).alias("i")))
        chosen = taken.append(chosen.select("run", "root", "route", "place", "o.rxn", rest.alias("rest")), level)
        if chosen.isEmpty():
            break
        level += 1
        below = chosen.select("run", "root", "route", "place", F.posexplode("rest").alias("at", "k"))
        step = below.select("run", "root", "route", F.array_append("place", F.col("at")).alias("place"), "k.*")
    lists = taken.table().groupBy("run", "root", "route").agg(F.sort_array(F.collect_list(F.struct("place", "rxn"))).alias("s"))
    out = start.select("run", "root", "route").join(lists, ["run", "root", "route"], "left")
    return out.select("run", "root", F.col("route").cast("int").alias("route"), F.coalesce(F.col("s.rxn"), F.array().cast(f"array<{rxn}>")).alias("reactions"))


def route_records(steps: DataFrame, reactions: DataFrame, molecules: DataFrame, ec: DataFrame) -> DataFrame:
    """A row per route from (run, route, rxn, parent, depth): steps deepest first, leaves, annotation coverage.

    ``ec`` has rxn and ec; ``molecules`` has run, mol, available and is_cofactor.
    """
    noted = steps.join(ec, "rxn", "left").withColumn("ec", F.coalesce("ec", F.array().cast("array<string>")))
    entry = F.struct((-F.col("depth")).alias("order"), "rxn", "parent", "depth", "ec")
    lists = noted.groupBy("run", "route").agg(
        F.sort_array(F.collect_list(entry)).alias("s"), F.count("*").alias("n_steps"), F.avg((F.size("ec") > 0).cast("double")).alias("ec_coverage")
    )
    own = steps.select("run", "route", "rxn").join(reactions.select("run", "rxn", "child"), ["run", "rxn"])
    leaves = own.join(molecules.where("available").select("run", F.col("mol").alias("child"), "is_cofactor"), ["run", "child"])
    leaves = leaves.groupBy("run", "route").agg(
        F.array_sort(F.collect_set(F.when(~F.col("is_cofactor"), F.col("child")))).alias("leaves"),
        F.array_sort(F.collect_set(F.when(F.col("is_cofactor"), F.col("child")))).alias("cofactor_leaves"),
    )
    steps_ = F.transform("s", lambda x: F.struct(x["rxn"].alias("rxn"), x["parent"].alias("parent"), x["depth"].alias("depth"), x["ec"].alias("ec")))
    out = lists.withColumn("steps", steps_).drop("s").join(leaves, ["run", "route"], "left")
    return out.withColumn("distinct_cofactors", F.coalesce(F.size("cofactor_leaves"), F.lit(0)))


def final_order(routes: DataFrame) -> DataFrame:
    """Adds ``place`` to (run, route, n_steps, n_branching): short routes first, then those that branch less."""
    return routes.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy("n_steps", "n_branching", "route")))
