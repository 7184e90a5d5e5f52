"""Scalar functions over annotation codes, identifiers, sets, texts and model answers.

Each takes and returns columns and stays within built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_ANNOTATED = "NOEC"
TARGET_PREFIX = "Target molecule: "
#: What candidate lines and the annotation column look like.
CANDIDATE_LINE = r"(?m)^\s*\[(\d+)\]\s+(\S+)\s+\|"
EC_COLUMN = r" \| EC=[0-9,]+"


# annotation codes

def ec_level(ec: Column, level: int) -> Column:
    """A code cut to a level of 1 to 4; empty if it does not reach that level. Never padded."""
    if not 1 <= level <= 4:
        return F.lit("")
    head = F.slice(F.split(ec, "[.]"), 1, level)
    return F.when((F.size(head) == level) & ~F.array_contains(head, "-"), F.array_join(head, ".")).otherwise("")


def ec_at_level(ecs: Column, level: int) -> Column:
    """The distinct codes of an array at a level, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(ecs, lambda e: ec_level(e, level)), lambda e: e != "")))


def ec_classes(ecs: Column) -> Column:
    """Level-1 heads without ``-``, sorted."""
    heads = F.transform(ecs, lambda e: F.split(e, "[.]")[0])
    return F.array_sort(F.array_distinct(F.filter(heads, lambda h: (h != "") & (h != "-"))))


def ec_list(field: Column) -> Column:
    """A ``;``-joined field as sorted distinct codes; the mark for none and null give an empty array."""
    parts = F.filter(F.transform(F.split(field, ";"), lambda t: F.trim(t)), lambda e: e != "")
    return F.when(field.isNull() | (field == NOT_ANNOTATED), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(parts)))


# identifiers

def strip_split(reaction_id: Column) -> Column:
    return F.regexp_replace(reaction_id, r"__split\d+$", "")


def reaction_ids(field: Column) -> Column:
    """Array of (id, direction) from a ``|``-joined field; left to right if none is given."""
    tokens = F.filter(F.transform(F.split(field, "[|]"), lambda t: F.trim(t)), lambda t: t != "")
    bare = F.transform(tokens, lambda t: strip_split(t))
    direction = lambda t: F.regexp_extract(t, "_(L2R|R2L)$", 1)
    return F.transform(
        bare,
        lambda t: F.struct(
            F.regexp_replace(t, "_(L2R|R2L)$", "").alias("id"), F.when(direction(t) == "", "L2R").otherwise(direction(t)).alias("direction")
        ),
    )


def equation_side(text: Column) -> Column:
    """Array of (id, coefficient) from ``2 A@c + 1 B@c``; what does not read as a term is left out."""
    pattern = r"^\s*([0-9.]+)\s+(\S+?)(?:@\S+)?\s*$"
    terms = F.filter(F.split(text, " [+] "), lambda t: t.rlike(pattern))
    return F.transform(
        terms, lambda t: F.struct(F.regexp_extract(t, pattern, 2).alias("id"), F.regexp_extract(t, pattern, 1).cast("double").alias("coefficient"))
    )


def looks_unnamed(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^MNXM\d+$"), F.lit(False))


def first_block(key: Column) -> Column:
    """The connectivity block of a hashed identifier, null unless it has 14 letters."""
    block = F.split(key, "-")[0]
    return F.when(F.length(block) == 14, block)


# sets and vectors

def jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def binary_tanimoto(a: Column, b: Column) -> Column:
    """0 if either side is missing or both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def tanimoto(uv: Column, uu: Column, vv: Column) -> Column:
    """From the three inner products; 1 if the denominator is 0."""
    return F.when(uu + vv - uv == 0, 1.0).otherwise(uv / F.nullif(uu + vv - uv, F.lit(0.0)))


def counted_tanimoto(a: Column, b: Column) -> Column:
    """Of two dense count vectors."""
    return tanimoto(dot(a, b), dot(a, a), dot(b, b))


def map_tanimoto(a: Column, b: Column) -> Column:
    """Of two sparse count vectors (map of coordinate to count)."""
    square = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    both = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + a[k].cast("double") * F.coalesce(F.try_element_at(b, k), F.lit(0)))
    return tanimoto(both, square(a), square(b))


def element_delta(before: Column, after: Column) -> Column:
    """Non-zero differences of two element counts; null if either is."""
    diff = F.map_zip_with(before, after, lambda _, x, y: F.coalesce(y, F.lit(0)) - F.coalesce(x, F.lit(0)))
    return F.map_filter(diff, lambda _, d: d != 0)


def ratio(n: Column, d: Column) -> Column:
    """NaN on a zero denominator."""
    return F.when(d != 0, n / F.nullif(d.cast("double"), F.lit(0.0))).otherwise(F.lit(float("nan")))


def available(in_sink: Column, is_cofactor: Column) -> Column:
    return F.coalesce(in_sink, F.lit(False)) | F.coalesce(is_cofactor, F.lit(False))


# texts of decisions

def parse_choice(text: Column) -> Column:
    """(choice int, reason) of a model's answer.

    A fenced block is tolerated and the first ``{`` to the last ``}`` is read. A choice
    that is no whole number (a truth value too) or an unreadable answer gives (null, '').
    """
    body = F.trim(text)
    fenced = F.regexp_replace(F.split(body, "```")[1], "^json", "")
    body = F.when(body.startswith("```"), fenced).otherwise(body)
    answer = F.try_parse_json(F.regexp_extract(body, r"(?s)\{.*\}", 0))
    raw = F.try_variant_get(answer, "$.choice", "string")
    kind = F.schema_of_variant(F.try_variant_get(answer, "$.choice", "variant"))
    whole = F.when(~kind.isin("BOOLEAN", "VOID"), raw)
    choice = F.when(whole.rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(whole).try_cast("int")).when(
        ~kind.isin("BOOLEAN", "VOID", "STRING") & whole.rlike(r"^-?\d+[.]\d+$"), whole.try_cast("double").cast("int")
    )
    reason = F.substring(F.coalesce(F.try_variant_get(answer, "$.reason", "string"), F.lit("")), 1, 400)
    return F.struct(choice.alias("choice"), F.when(choice.isNotNull(), reason).otherwise("").alias("reason"))


def shown_candidates(user: Column) -> Column:
    """The molecules of the candidate lines of a prompt."""
    return F.regexp_extract_all(user, F.lit(CANDIDATE_LINE), F.lit(2))


def drop_ec_column(user: Column) -> Column:
    return F.regexp_replace(user, EC_COLUMN, "")


def first_line(text: Column) -> Column:
    return F.split(text, "\n", 2)[0]


def pair_target(user: Column) -> Column:
    """The first line of a prompt without its prefix."""
    head = first_line(user)
    return F.when(head.startswith(TARGET_PREFIX), F.trim(F.substring(head, len(TARGET_PREFIX) + 1, 1 << 30))).otherwise(head)


def render_candidate(
    index: Column, mol: Column, depth: Column, ec: Column | None = None, per_step: Column | None = None, route: Column | None = None,
    edges: Column | None = None, closeness: Column | None = None, nearest: Column | None = None, nearest_mol: Column | None = None,
) -> Column:
    """A candidate's line; columns that are not given or null are left out."""
    parts = [F.format_string("[%d] %s", index.cast("int"), mol), F.format_string("depth=%d", depth.cast("int"))]
    if ec is not None:
        parts.append(F.when(F.size(ec) > 0, F.concat(F.lit("EC="), F.array_join(ec, ","))))
    if per_step is not None:
        shown = F.format_string("enzymatic=%.3f/step (route %.3f over %d)", per_step, route, edges.cast("int"))
        parts.append(F.when(per_step.isNotNull(), shown))
    if closeness is not None:
        near = F.lit("")
        if nearest is not None:
            structure = F.lit("") if nearest_mol is None else F.coalesce(F.concat(F.lit(" ["), F.nullif(nearest_mol, F.lit("")), F.lit("]")), F.lit(""))
            near = F.when(F.coalesce(nearest, F.lit("")) != "", F.concat(F.lit(" to "), nearest, structure)).otherwise("")
        parts.append(F.when(closeness.isNotNull(), F.concat(F.format_string("closest_chassis=%.3f", closeness), near)))
    return F.concat_ws(" | ", *parts)
