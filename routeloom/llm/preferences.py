"""Preference formatting of conversations, in DataFrames alone.

A pair holds a chosen and a rejected conversation.  Their longest common prefix of
turns (equal role and text) is rendered once as the prompt; the rest of each is its
completion, with the character spans of it that are trained on: the texts of assistant
turns and their end marks.  All turns of a pair meet in one shuffle.

Defined results: turns sort by number, role and text, and repeats of a turn are kept;
a null role is ``user``, a null text is empty; markers inside a text are broken up; a
pair without a chosen or a rejected side has no prompt, its one side whole as completion,
and ``paired`` and ``informative`` false; equal conversations give empty completions and
``informative`` false; turns without an id belong to no conversation and give no row; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


def render(turns: str) -> str:
    return f"array_join(transform({turns}, t -> concat('<|', t.role, '|>', chr(10), t.text, '<|end|>', chr(10))), '')"


def spans(turns: str) -> str:
    """Character spans of the trained turns in the rendered text, as ``start-end`` with commas."""
    head, size = "(a.at + length(t.role) + 5)", "length(t.text) + 8"
    state = "named_struct('at', {}, 'out', {})".format
    step = state(f"{head} + {size}", f"if(t.role = '{TRAINED}', array_append(a.out, concat({head}, '-', {head} + {size})), a.out)")
    return f"array_join(aggregate({turns}, {state('0', 'cast(array() as array<string>)')}, (a, t) -> {step}, a -> a.out), ',')"


def format_preferences(turns: DataFrame) -> DataFrame:
    """From (pair_id, chosen boolean, turn, role, text) to a row for each pair."""
    role = F.coalesce("role", F.lit("user"))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    turn = F.struct("turn", role.alias("role"), text.alias("text"))
    both = turns.where("pair_id is not null").groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("chosen"), turn))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("chosen"), turn))).alias("r")
    )
    differs = "array_position(zip_with(c, r, (a, b) -> (a.role <=> b.role) and (a.text <=> b.text)), false)"
    both = both.withColumn("d", F.expr(differs)).withColumn("paired", F.expr("size(c) > 0 and size(r) > 0"))
    both = both.withColumn("common", F.expr("cast(if(d = 0, size(c), d - 1) as int)"))
    rest = {"chosen": "slice(c, common + 1, size(c))", "rejected": "slice(r, common + 1, size(r))"}
    return both.select(
        "pair_id",
        F.col("common").alias("prompt_turns"),
        F.expr(render("slice(c, 1, common)")).alias("prompt"),
        *(F.expr(render(v)).alias(k) for k, v in rest.items()),
        *(F.expr(spans(v)).alias(f"{k}_trained") for k, v in rest.items()),
        ((F.col("d") > 0) & F.col("paired")).alias("informative"),
        "paired",
    )


def answer_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs from a table of single conversations: the rejected side ends in another conversation's answer.

    Conversations 2k and 2k + 1 are partners.  Each one is chosen once, up to its last assistant
    turn; the rejected side is the same with that turn's text replaced by the partner's last
    answer.  Without an assistant turn, or a partner with one, there is no rejected side.
    """
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = F.max(F.when(F.col("role") == TRAINED, F.struct("turn", "text")))
    kept = rows.groupBy("conv_id").agg(last.alias("last"), F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    even = F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id") + 1).otherwise(F.col("conv_id") - 1)
    answers = kept.where("last is not null").select(even.alias("conv_id"), F.col("last.text").alias("other"))
    pairs = kept.join(answers, "conv_id", "left")
    turn = F.explode(F.expr("filter(turns, t -> last is null or t.turn is null or t.turn <= last.turn)")).alias("t")
    sides = pairs.select("conv_id", "last", "other", turn).select("conv_id", "last", "other", "t.*")
    ends = F.col("turn").eqNullSafe(F.col("last.turn")) & (F.col("role") == TRAINED) & (F.col("text") == F.col("last.text"))
    both = F.col("last").isNotNull() & F.col("other").isNotNull()
    side = F.explode(F.when(both, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("chosen")
    return sides.select(
        F.col("conv_id").alias("pair_id"), side, "turn", "role", F.col("text").alias("own"), ends.alias("ends"), "other"
    ).select("pair_id", "chosen", "turn", "role", F.when(~F.col("chosen") & F.col("ends"), F.col("other")).otherwise(F.col("own")).alias("text"))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
o AS (SELECT CASE WHEN conv_id % 2 = 0 THEN conv_id + 1 ELSE conv_id - 1 END AS conv_id, last.text AS other FROM l),
s AS (SELECT t.conv_id AS pair_id, turn, role, text, last IS NOT NULL AND other IS NOT NULL AS paired,
  CASE WHEN turn IS NOT DISTINCT FROM last.turn AND role = 'assistant' AND text = last.text THEN other ELSE text END AS swapped
  FROM t LEFT JOIN l ON l.conv_id = t.conv_id LEFT JOIN o ON o.conv_id = t.conv_id WHERE last IS NULL OR turn IS NULL OR turn <= last.turn),
x AS (SELECT pair_id, role, replace(text, '<|', '< |') AS text, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, replace(text, '<|', '< |')) AS i FROM s),
y AS (SELECT pair_id, role, replace(swapped, '<|', '< |') AS text, row_number() OVER (PARTITION BY pair_id ORDER BY turn, role, replace(swapped, '<|', '< |')) AS i FROM s WHERE paired),
d AS (SELECT pair_id, min(i) FILTER (WHERE x.role <> y.role OR x.text <> y.text) AS d, max(i) AS n FROM x JOIN y USING (pair_id, i) GROUP BY pair_id),
k AS (SELECT p.pair_id, CASE WHEN paired THEN CAST(coalesce(d - 1, n) AS INT) ELSE 0 END AS common, paired AND d IS NOT NULL AS informative, paired
  FROM (SELECT DISTINCT pair_id, paired FROM s) p LEFT JOIN d ON d.pair_id = p.pair_id),
f AS (SELECT pair_id, i, common, side, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM
  (SELECT *, 'c' AS side FROM x UNION ALL SELECT *, 'r' AS side FROM y) JOIN k USING (pair_id)),
a AS (SELECT *, sum(length(shown)) FILTER (WHERE i > common) OVER (PARTITION BY pair_id, side ORDER BY i) AS e FROM f),
b AS (SELECT *, e - length(shown) + length(role) + 5 AS s FROM a)
SELECT pair_id, any_value(common) AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= common), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'c' AND i > common), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE side = 'r' AND i > common), '') AS rejected,
  coalesce(string_agg(CAST(s AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY i) FILTER (WHERE side = 'c' AND i > common AND role = 'assistant'), '') AS chosen_trained,
  coalesce(string_agg(CAST(s AS BIGINT) || '-' || CAST(e AS BIGINT), ',' ORDER BY i) FILTER (WHERE side = 'r' AND i > common AND role = 'assistant'), '') AS rejected_trained,
  any_value(informative) AS informative, any_value(paired) AS paired
FROM b JOIN (SELECT pair_id, informative, paired FROM k) USING (pair_id) GROUP BY pair_id
"""
