"""Joins with reference data: annotations and full reactions of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ec_list, equation_side, reaction_ids, strip_split
from ..storage import cut


def annotate_rules(rules: DataFrame, reactions: DataFrame) -> DataFrame:
    """(rule_idx, ec, n_reactions, n_unresolved) from rules' ``reaction_id`` and reactions' (id, ec_numbers)."""
    ids = rules.select("rule_idx", F.explode_outer(F.filter(F.split("reaction_id", "[|]"), lambda t: t != "")).alias("token"))
    ids = ids.withColumn("id", strip_split(F.col("token")))
    known = reactions.select("id", ec_list(F.col("ec_numbers")).alias("codes"))
    joined = ids.join(known, "id", "left")
    return joined.groupBy("rule_idx").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("codes")))).alias("ec"),
        F.count("token").cast("int").alias("n_reactions"),
        F.count_if(F.col("token").isNotNull() & F.col("codes").isNull()).cast("int").alias("n_unresolved"),
    )


def parse_equations(equations: DataFrame) -> DataFrame:
    """(id, left, right, classifs, is_balanced) of the equations that have two sides."""
    sides = F.split("equation", "=", 2)
    out = equations.where(F.col("equation").contains("="))
    return out.select("id", equation_side(sides[0]).alias("left"), equation_side(sides[1]).alias("right"), "classifs", "is_balanced")


def complete_reactions(rules: DataFrame, equations: DataFrame, compounds: DataFrame, max_per_rule: int = 1) -> DataFrame:
    """Full reactions of the rules' first source reactions, turned the way the rule uses them.

    A row per rule and source: (rule_idx, place, id, direction, substrates, products, ec, is_balanced);
    participants are (id, coefficient, name, smiles). Rules without a known source have no row.
    """
    first = F.slice(reaction_ids(F.col("reaction_id")), 1, max_per_rule)
    ids = rules.select("rule_idx", F.posexplode(first).alias("place", "x")).select("rule_idx", "place", "x.id", "x.direction")
    found = cut(ids.join(parse_equations(equations), "id"), "sources")  # read for the participants and for the rest
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.col(s).alias("terms")) for s in ("left", "right")))
    flat = found.select("rule_idx", "place", F.explode(sides).alias("s")).select("rule_idx", "place", "s.side", F.posexplode("s.terms").alias("at", "t"))
    flat = flat.select("rule_idx", "place", "side", "at", F.col("t.id").alias("cid"), F.col("t.coefficient").alias("coefficient"))
    named = flat.join(compounds.select(F.col("id").alias("cid"), "name", "smiles"), "cid", "left")
    part = F.struct("at", F.col("cid").alias("id"), "coefficient", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("smiles", F.lit("")).alias("smiles"))
    take = lambda side: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("side") == side, part))), lambda p: F.struct(p["id"].alias("id"), p["coefficient"].alias("coefficient"), p["name"].alias("name"), p["smiles"].alias("smiles"))
    )
    sides = named.groupBy("rule_idx", "place").agg(take("left").alias("l"), take("right").alias("r"))
    out = found.drop("left", "right").join(sides, ["rule_idx", "place"], "left")
    forward = F.col("direction") == "L2R"
    return out.select(
        "rule_idx", "place", "id", "direction", F.when(forward, F.col("l")).otherwise(F.col("r")).alias("substrates"),
        F.when(forward, F.col("r")).otherwise(F.col("l")).alias("products"),
        F.filter(F.split(F.coalesce("classifs", F.lit("")), ";"), lambda e: (e != "") & (e != "NOEC")).alias("ec"), "is_balanced",
    )


def render_reaction(substrates, products):
    """``2 A + B --> C`` with names where known."""
    side = lambda parts: F.array_join(
        F.transform(
            parts,
            lambda p: F.concat(
                F.when(p["coefficient"] == 1, "").otherwise(F.concat(F.regexp_replace(p["coefficient"].cast("string"), "[.]0$", ""), F.lit(" "))),
                F.coalesce(F.nullif(p["name"], F.lit("")), p["id"]),
            ),
        ),
        " + ",
    )
    return F.concat(side(substrates), F.lit(" --> "), side(products))


def label_sink(sink: DataFrame, titles: DataFrame, names: DataFrame, longest: int = 60) -> DataFrame:
    """(mol, label): the first entry of each molecule, labelled by title, else name, else its identifier.

    ``sink`` has mol, id and place; ``titles`` has mol, label and source; ``names`` has id and name.
    """
    first = sink.groupBy("mol").agg(F.min_by(F.struct("id"), F.struct("place", "id")).alias("f")).select("mol", "f.id")
    good = titles.where((F.length("label") <= longest) & (F.col("source") != "unresolved")).select("mol", F.col("label").alias("title"))
    out = first.join(good, "mol", "left").join(names.select("id", "name"), "id", "left")
    return out.select("mol", F.coalesce("title", F.nullif("name", F.lit("")), "id").alias("label"))
