"""Mixing sources to target weights by iterative proportional fitting, in DataFrames alone.

Token counts are summed once into cells (source, language, topic).  Raking scales the
cells' weights so that each marginal in turn has its target shares, in ``ROUNDS``
rounds.  The inclusion probability of a cell's documents is its weight over its tokens,
times a factor, at most 1; the factor is solved so that the expected tokens are the
budget (cells that reach 1 are fixed and the rest is scaled again).  A document is kept
if a uniform number made from its id lies below its probability.  Tokens are counted:
words (letters, digits and what is beyond ASCII) and single ASCII signs.

``residuals`` tells how far the raked marginals are from their targets; the sample
carries the largest of them as ``rake_residual``.

Cells are rows: nothing grows on the driver but two numbers a step.  The cells are
broadcast to the documents if they are at most ``BROADCAST_CELLS``; beyond that they are
joined by key, where a hot cell's partitions are split by adaptive execution.

Defined results: null categories are categories of their own; a null text has no tokens
and is kept with its cell's probability, or dropped if the cell has no tokens; rows that
repeat an id are kept or dropped together; a row without an id is drawn by its text; an
empty table gives no rows; columns named probability, sample_weight, rake_residual or
tokens are replaced, and a column topic is taken as it is unless a topic is given.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hash_unit

ROUNDS = 8
SEED = 17
BROADCAST_CELLS = 10_000
MARGINS = ("source", "lang", "topic")
#: Topics by the first pattern that a text has.
TOPICS = {"legal": "License|Licence|Copyright", "contact": "@|[(][0-9]{3}[)]", "table": " [|] ", "signs": "[$%&#*]{3}|!!", "identifiers": "[0-9]{4}"}
#: A word, or a sign; both regular expression dialects read it alike.
TOKEN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]"
#: Target shares in the registered query: observed shares to these powers.
POWERS = {"source": 0.6, "lang": 0.5, "topic": 0.5}
KEEP = 0.5


def matches(text: Column, pattern: str) -> Column:
    """Whether a text has one of a pattern's alternatives; plain ones are searched as strings, which is faster."""
    out = None
    for part in re.split(r"(?<!\[)[|](?!\])", pattern):
        plain = part.replace("[|]", "|")
        own = F.contains(text, F.lit(plain)) if re.fullmatch(r"[\w @!|]+", plain) else text.rlike(part)
        out = own if out is None else out | own
    return out


def topic_of(text: Column, patterns: dict[str, str] | None = None) -> Column:
    out = None
    for name, pattern in (patterns or TOPICS).items():
        out = F.when(matches(text, pattern), name) if out is None else out.when(matches(text, pattern), name)
    return F.when(text.isNull(), None).otherwise(out.otherwise("prose"))


def tokens_of(text: Column) -> Column:
    """Words and signs of a text, counted."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("double")


def rake(cells: DataFrame, targets: dict[str, float | dict], rounds: int = ROUNDS) -> DataFrame:
    """Adds ``weight`` to cells with ``n``: their tokens after raking.

    A target is a power of the observed shares, or a mapping of categories to shares
    (categories that it lacks get none).
    """
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    wanted = []
    for name, target in targets.items():
        own = F.sum("n").over(Window.partitionBy(name))
        if isinstance(target, dict):
            shares = F.create_map(*(F.lit(x) for k, v in target.items() for x in (k, float(v)))) if target else None
            share = F.coalesce(shares[F.col(name)], F.lit(0.0)) if target else F.lit(0.0)
        else:
            share = F.when(own > 0, F.pow(own / total, F.lit(float(target)))).otherwise(0.0)
        cells = cells.withColumn(f"share_{name}", share).withColumn(f"own_{name}", own)
        wanted.append(F.sum(F.when(F.col(f"own_{name}") > 0, F.col(f"share_{name}") * F.col("n") / F.col(f"own_{name}"))).alias(name))
    cells = cut(cells.withColumn("weight", F.col("n")), "cells")
    sums = cells.agg(*wanted).first()
    for name in targets:
        cells = cells.withColumn(f"goal_{name}", F.col(f"share_{name}") * F.lit(total / (sums[name] or 1.0)))
    for step in range(rounds):
        for name in targets:
            have = F.sum("weight").over(Window.partitionBy(name))
            cells = cells.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"goal_{name}") / have).otherwise(0.0))
        if step % 4 == 3 or step == rounds - 1:
            cells = cut(cells, "cells")
    return cells.drop(*(f"{x}_{name}" for name in targets for x in ("share", "own")))


def residuals(cells: DataFrame, names: list[str]) -> DataFrame:
    """(margin, category, goal, weight, residual) of raked cells; the residual is relative to the goal, null without one."""
    out = None
    for name in names:
        own = cells.groupBy(F.col(name).cast("string").alias("category")).agg(F.max(f"goal_{name}").alias("goal"), F.sum("weight").alias("weight"))
        own = own.select(F.lit(name).alias("margin"), "category", "goal", "weight", F.when(F.col("goal") > 0, F.abs(F.col("weight") / F.col("goal") - 1)).alias("residual"))
        out = own if out is None else out.unionByName(own)
    return out


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """Adds ``probability``: weight over tokens times a factor that meets the budget, at most 1."""
    ratio = F.col("weight") / F.col("n")
    capped, factor = 0.0, None
    while True:
        full = F.lit(False) if factor is None else F.lit(factor) * ratio >= 1
        got = cells.where("n > 0").agg(F.sum(F.when(full, F.col("n"))).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("rest")).first()
        now, rest = got["full"] or 0.0, got["rest"] or 0.0
        if factor is not None and now == capped or rest <= 0:
            break
        capped, factor = now, max(factor or 0.0, (budget - now) / rest)
    factor = factor or 0.0
    return cells.withColumn("probability", F.when(F.col("n") > 0, F.least(F.lit(1.0), F.lit(factor) * ratio)).otherwise(0.0))


def mix(
    docs: DataFrame,
    targets: dict[str, float | dict] | None = None,
    keep: float = KEEP,
    topic: Column | None = None,
    rounds: int = ROUNDS,
    seed: int = SEED,
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """The sampled rows of ``docs`` with topic, tokens, probability, sample_weight (its inverse) and rake_residual."""
    targets = dict(POWERS if targets is None else targets)
    docs = docs.drop("probability", "sample_weight", "rake_residual", "tokens", *([] if topic is None and "topic" in docs.columns else ["topic"]))
    if topic is not None or "topic" not in docs.columns:
        docs = docs.withColumn("topic", topic_of(F.col("text")) if topic is None else topic)
    docs = docs.withColumn("tokens", tokens_of(F.col("text")))
    names = list(targets)
    cells = cut(docs.groupBy(*names).agg(F.sum("tokens").alias("n")), "cells")
    total = cells.agg(F.sum("n")).first()[0] or 0.0
    raked = rake(cells, targets, rounds)
    off = residuals(raked, names).agg(F.max("residual")).first()[0]
    cells = cut(calibrate(raked, keep * total).select(*names, "probability"), "cells")
    few = cells.count() <= broadcast_cells
    cells = cells.select(*(F.col(n).alias(f"__mix_{n}") for n in names), "probability")
    same = [docs[n].eqNullSafe(cells[f"__mix_{n}"]) for n in names]
    out = docs.join(F.broadcast(cells) if few else cells, same).drop(*(f"__mix_{n}" for n in names))
    drawn = hash_unit(F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")), seed) < F.col("probability")
    return out.where(drawn).withColumn("sample_weight", 1 / F.col("probability")).withColumn("rake_residual", F.lit(off).cast("double"))


def oracle(table: str = "documents", keep: float = KEEP, rounds: int = ROUNDS, seed: int = SEED, solves: int = 12) -> str:
    """The registered query in DuckDB's SQL, with the rounds written out."""
    topics = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS.items())
    ctes = [
        f"d AS (SELECT *, CASE WHEN text IS NULL THEN NULL ELSE CASE {topics} ELSE 'prose' END END AS topic, "
        f"CAST(coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS DOUBLE) AS tokens FROM {table})",
        "c AS (SELECT source, lang, topic, sum(tokens) AS n FROM d GROUP BY ALL)",
        "t AS (SELECT sum(n) AS total FROM c)",
    ]
    for name, power in POWERS.items():
        ctes.append(
            f"m_{name} AS (SELECT {name}, CASE WHEN sum(n) > 0 THEN pow(sum(n) / (SELECT total FROM t), {power}) ELSE 0 END AS share FROM c GROUP BY {name})"
        )
        ctes.append(f"g_{name} AS (SELECT {name}, share * (SELECT total FROM t) / (SELECT sum(share) FROM m_{name}) AS goal FROM m_{name})")
    last = "w0"
    ctes.append("w0 AS MATERIALIZED (SELECT *, n AS w FROM c)")
    for i in range(rounds * len(MARGINS)):
        name = MARGINS[i % len(MARGINS)]
        ctes.append(
            f"w{i + 1} AS MATERIALIZED (SELECT p.source, p.lang, p.topic, n, CASE WHEN sum(w) OVER (PARTITION BY p.{name}) > 0 "
            f"THEN w * goal / sum(w) OVER (PARTITION BY p.{name}) ELSE 0 END AS w FROM {last} p JOIN g_{name} g ON p.{name} IS NOT DISTINCT FROM g.{name})"
        )
        last = f"w{i + 1}"
    off = " UNION ALL ".join(f"SELECT abs(sum(w) / any_value(goal) - 1) AS r FROM {last} p JOIN g_{n} g ON p.{n} IS NOT DISTINCT FROM g.{n} GROUP BY p.{n} HAVING any_value(goal) > 0" for n in MARGINS)
    ctes.append(f"x AS (SELECT max(r) AS r FROM ({off}))")
    budget = f"{keep} * (SELECT total FROM t)"
    ctes.append(f"f0 AS MATERIALIZED (SELECT {budget} / sum(w) AS f FROM {last} WHERE n > 0)")
    for i in range(solves):
        full = f"w / n * (SELECT f FROM f{i}) >= 1"
        ctes.append(
            f"f{i + 1} AS MATERIALIZED (SELECT CASE WHEN coalesce(sum(w) FILTER (WHERE NOT ({full})), 0) > 0 THEN greatest((SELECT f FROM f{i}), "
            f"({budget} - coalesce(sum(n) FILTER (WHERE {full}), 0)) / sum(w) FILTER (WHERE NOT ({full}))) ELSE (SELECT f FROM f{i}) END AS f FROM {last} WHERE n > 0)"
        )
    ctes.append(f"p AS (SELECT source, lang, topic, CASE WHEN n > 0 THEN least(1.0, w / n * (SELECT f FROM f{solves})) ELSE 0.0 END AS p FROM {last})")
    unit = f"CAST(CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0"
    same = " AND ".join(f"d.{n} IS NOT DISTINCT FROM p.{n}" for n in MARGINS)
    return (
        f"WITH {', '.join(ctes)} SELECT doc_id, d.source, d.lang, d.topic, tokens, round(p, 9) AS probability, round((SELECT r FROM x), 6) AS rake_residual "
        f"FROM d JOIN p ON {same} WHERE {unit} < p"
    )
