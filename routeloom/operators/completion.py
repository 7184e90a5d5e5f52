"""Full reactions for the steps of a route: the source reaction that plays the same roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Carriers, which take no role of a route's own molecules.
CARRIERS = (
    "H(+)", "H2O", "O2", "CO2", "NAD(+)", "NADH", "NADP(+)", "NADPH",
    "ATP", "ADP", "AMP", "phosphate", "diphosphate", "CoA", "FAD", "FADH2",
    "NAD(P)+", "NAD(P)H",
    "a reduced flavin", "an oxidized flavin", "FMN", "FMNH2",
    "a reduced ferredoxin [iron-sulfur] cluster",
    "an oxidized ferredoxin [iron-sulfur] cluster",
)

#: Participants that a source leaves unspecified; they name no compound, so nothing can supply them.
GENERIC = (
    "A", "B", "R", "X", "Y", "an alcohol", "an aldehyde", "a ketone",
    "Acceptor", "Donor", "acceptor", "donor", "an electron acceptor", "an electron donor",
    "Oxidized electron acceptor", "Reduced electron acceptor",
)


def pick_reaction(steps: DataFrame, candidates: DataFrame, carriers: tuple[str, ...] = CARRIERS, sources: DataFrame | None = None) -> DataFrame:
    """(step, rxn, agrees, consumed_at, released_at, exact, score) of the best role match of each step.

    ``steps`` has step, made, used (keys) and delta (map of element changes); ``candidates``
    has step, rxn, place, and arrays left and right of (key, name, elements).  These may stand in ``sources``
    instead, by rxn, so that a source is not copied to each step that considers it.  A pair of one
    consumed and one released participant fits if both keys match, or if it changes the same
    elements by the same numbers. Larger scores win, the first of equal ones stays.

    The pairs of a candidate are scored in its row, and only its best one is moved on.
    """
    if sources is None:
        rows = candidates.select("step", "rxn", "place", "left", "right").join(steps, "step")
    else:
        rows = candidates.select("step", "rxn", "place").join(steps, "step").join(sources.select("rxn", "left", "right"), "rxn")
    # maps do not compare: the sorted entries that are not 0 do
    entries = lambda m: F.sort_array(F.map_entries(F.map_filter(m, lambda _, n: F.coalesce(n, F.lit(0)) != 0)))
    without = lambda m: F.map_zip_with(m, F.col("delta"), lambda _, n, d: F.coalesce(n, F.lit(0)) - F.coalesce(d, F.lit(0)))
    usable = lambda p: ~p["name"].isin(*carriers) & p["key"].isNotNull()
    # a change from a to b is the delta if b without the delta is a: one map for each participant, none for each pair
    part = lambda p, i: F.struct(i.alias("i"), p["name"].alias("name"), p["key"].alias("key"), entries(p["elements"]).alias("has"), entries(without(p["elements"])).alias("before"))
    side = lambda c: F.filter(F.transform(c, part), usable)
    rows = rows.select("step", "rxn", "place", "made", "used", (F.size("left") + F.size("right")).alias("size"), F.coalesce(F.forall(F.map_values("delta"), lambda n: F.coalesce(n != 0, F.lit(False))), F.lit(False)).alias("clear"), side("left").alias("l"), side("right").alias("r"))

    def matches(consumed: str, released: str, agrees: bool) -> Column:
        # few pairs fit: only these get a score
        both = lambda c, r: F.coalesce((c["key"] == F.col("used")) & (r["key"] == F.col("made")), F.lit(False))
        equal = lambda c, r: F.coalesce(r["before"] == c["has"], F.lit(False)) & F.col("clear")

        def scored(c: Column, r: Column) -> Column:
            score = (1000 * both(c, r).cast("int") + 100 * equal(c, r).cast("int")) * 100 - F.col("size")
            return F.struct((-score).alias("cost"), "place", F.lit(not agrees).alias("turned"), c["i"].alias("i"), r["i"].alias("j"), "rxn", both(c, r).alias("exact"))

        return F.flatten(F.transform(consumed, lambda c: F.transform(F.filter(released, lambda r: equal(c, r) | both(c, r)), lambda r: scored(c, r))))

    best = F.array_min(F.filter(F.concat(matches("l", "r", True), matches("r", "l", False)), lambda m: m["cost"] < 0))
    # moved before it is grouped, so that the participants are not sorted; a filter ahead of that would work all of it out again
    best = rows.select("step", best.alias("b")).repartition("step").groupBy("step").agg(F.min("b").alias("b")).where("b is not null")
    return best.select("step", "b.rxn", (~F.col("b.turned")).alias("agrees"), F.col("b.i").alias("consumed_at"), F.col("b.j").alias("released_at"), "b.exact", (-F.col("b.cost")).alias("score"))


def side_tally(participants: DataFrame) -> DataFrame:
    """(step, side, element, n, complete): element counts with stoichiometry; incomplete if any part is unread."""
    whole = participants.groupBy("step", "side").agg(F.bool_and(F.col("elements").isNotNull()).alias("complete"))
    parts = participants.select("step", "side", "coefficient", F.explode("elements").alias("element", "k"))
    counts = parts.groupBy("step", "side", "element").agg(F.sum(F.col("coefficient") * F.col("k")).alias("n"))
    return whole.join(counts, ["step", "side"], "left")


def balance(tally: DataFrame, certified: DataFrame, ignored: str = "H") -> DataFrame:
    """(step, balanced): yes, no, or unknown if a side is incomplete or the source is not certified (step, is_balanced)."""
    sides = tally.groupBy("step", "element").agg(
        F.sum(F.when(F.col("side") == "left", F.col("n"))).alias("l"), F.sum(F.when(F.col("side") == "right", F.col("n"))).alias("r"), F.bool_and("complete").alias("complete")
    )
    equal = (F.coalesce("l", F.lit(0.0)) == F.coalesce("r", F.lit(0.0))) | (F.col("element") == ignored) | F.col("element").isNull()
    per_step = sides.groupBy("step").agg(F.bool_and(equal).alias("equal"), F.bool_and("complete").alias("complete"))
    known = F.coalesce(F.col("is_balanced") == "B", F.lit(False)) & F.coalesce("complete", F.lit(False))
    return certified.join(per_step, "step", "left").select("step", F.when(known & F.col("equal"), "yes").when(known, "no").otherwise("unknown").alias("balanced"))


def complete_equation(best: DataFrame, candidates: DataFrame, steps: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(step, rxn, consumed, released, predicted): the keys of the picked reaction in the step's direction.

    The step's own molecules stand in the two roles that they matched, also where the source names
    others there or a generic participant without a key; ``predicted`` tells that it does.  ``sources`` as in ``pick_reaction``.
    """
    sided = best.join(candidates.select("step", "rxn", "left", "right"), ["step", "rxn"]) if sources is None else best.join(sources.select("rxn", "left", "right"), "rxn")
    chosen = sided.join(steps.select("step", "made", "used"), "step")
    side = lambda a, b: F.when(F.col("agrees"), F.col(a)).otherwise(F.col(b))
    put = lambda xs, at, mol: F.transform(xs, lambda x, i: F.when(i == F.col(at), F.col(mol)).otherwise(F.coalesce(x["key"], x["name"])))
    return chosen.select(
        "step", "rxn", put(side("left", "right"), "consumed_at", "used").alias("consumed"), put(side("right", "left"), "released_at", "made").alias("released"), (~F.col("exact")).alias("predicted")
    )


def supplied(needs: DataFrame, sink: DataFrame, made: DataFrame, carriers: tuple[str, ...] = CARRIERS, generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """Adds ``supplied`` to (route, step, key, name): a carrier by name, from the sink, made by key elsewhere in the route, or by name without a key.

    Generic participants are no needs: their rows go.  ``sink`` has key; ``made`` has route, key and name of what any step releases.
    """
    in_sink = sink.select("key", F.lit(True).alias("in_sink")).where("key is not null").distinct()
    by_key = made.where("key is not null").select("route", "key", F.lit(True).alias("by_key")).distinct()
    by_name = made.where("name is not null").select("route", "name", F.lit(True).alias("by_name")).distinct()
    needs = needs.where(~F.coalesce(F.col("name").cast("string").isin(*generic), F.lit(False)))
    out = needs.join(in_sink, "key", "left").join(by_key, ["route", "key"], "left").join(by_name, ["route", "name"], "left")
    carrier = F.coalesce(F.col("name").cast("string").isin(*carriers), F.lit(False))
    has = carrier | F.coalesce("in_sink", F.lit(False)) | F.coalesce("by_key", F.lit(False)) | (F.col("key").isNull() & F.coalesce("by_name", F.lit(False)))
    return out.withColumn("supplied", has).drop("in_sink", "by_key", "by_name")


def completion_totals(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """Counts over completed routes by policy: routes, steps, unresolved, predicted, and routes without unmet needs."""
    per_route = needs.groupBy("route").agg(F.count_if(~F.col("supplied")).alias("unmet"))
    routes = steps.groupBy("policy", "route").agg(F.count("*").alias("steps"), F.count_if(F.col("rxn").isNull()).alias("unresolved"), F.count_if(~F.col("exact")).alias("predicted"))
    routes = routes.join(per_route, "route", "left").na.fill(0, ["unmet"])
    return routes.groupBy("policy").agg(
        F.count("*").alias("routes"), F.sum("steps").alias("steps"), F.sum("unresolved").alias("unresolved"), F.sum("predicted").alias("predicted"),
        F.sum("unmet").alias("unmet"), F.count_if(F.col("unmet") == 0).alias("satisfied"),
    )
