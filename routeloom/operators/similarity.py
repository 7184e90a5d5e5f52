"""Similarity joins: binary sets by shared members, dense counts by blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.scalars import dot, tanimoto
from ..session import let_workers_import
from ..storage import cut

BROADCAST_BYTES = 64 << 20
#: Similarities that a task holds at once.
SCORES = 1 << 20


def set_tanimoto(pairs: DataFrame, left: DataFrame, right: DataFrame, same: bool = False) -> DataFrame:
    """Adds ``sim`` to (l, r) pairs, from member tables (l, member) and (r, member).

    Sets travel as arrays: they are the bits of a fingerprint, so their size is bounded, and a
    pair is one row. A side without members gives 0.  The left sets are met last, so the result lies by ``l``,
    and what ranks a left side's pairs moves none of them again.  ``same`` says that both tables hold the sets of the
    same things: a pair of a thing with itself then carries no set.
    """
    own = left.groupBy("l").agg(F.collect_set("member").alias("a"))
    other = right.groupBy("r").agg(F.collect_set("member").alias("b"))
    itself = (F.col("l") == F.col("r")) if same else F.lit(False)
    out = pairs.join(other, "r", "left").withColumn("_self", itself & F.col("b").isNotNull())
    out = out.withColumn("b", F.when(~F.col("_self"), F.col("b"))).join(own, "l", "left")
    both = F.size(F.array_intersect("a", "b"))
    sim = F.when(F.col("_self"), 1.0).when(F.col("a").isNotNull() & F.col("b").isNotNull(), both / (F.size("a") + F.size("b") - both)).otherwise(0.0)
    return out.withColumn("sim", sim).drop("a", "b", "_self")


def nearest(queries: DataFrame, sink: DataFrame, k: int = 1, block_rows: int | None = None) -> DataFrame:
    """(q, label, sim, rank): the k most similar sink rows of each query (q, v) by counted Tanimoto, to twelve digits.

    Ties go to the smaller label; a null vector has no neighbours and is none.  A sink of at most
    ``BROADCAST_BYTES`` (rows times the widest vector) is sent whole, as a matrix that each batch of
    queries is multiplied with; a larger one is dealt in blocks of that size, or of ``block_rows``.  There a
    pair is scored only if the norms allow it a place: of two vectors with norms in proportion r <= 1 the
    similarity is r / (1 - r + r * r) at most, and k members of the first block set what must be reached.
    """
    queries, sink = queries.where("v is not null"), sink.where("v is not null")
    size = sink.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    block_rows = block_rows or max(1, BROADCAST_BYTES // (8 * max(1, size["width"] or 0) + 32))
    blocks = max(1, -(-size["n"] // block_rows))
    if blocks == 1:
        return _against_all(queries, sink, k)
    vv = sink.select("label", F.col("v").alias("w"), dot(F.col("v"), F.col("v")).alias("ww"))
    qq = queries.select("q", "v", dot(F.col("v"), F.col("v")).alias("uu"))
    vv = vv.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks)))
    sim = F.round(tanimoto(dot(F.col("v"), F.col("w")), F.col("uu"), F.col("ww")), 12).alias("sim")
    local = Window.partitionBy("q", "block").orderBy(F.desc("sim"), "label")
    # what the first block gives each query is a bound for the others
    first = qq.withColumn("block", F.lit(0).cast("long")).join(vv, "block").select("q", "label", "block", sim)
    first = cut(first.withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= k).select("q", "label", "sim"), "nearest-first")
    reached = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("sim")).alias("least"))
    copies = qq.join(reached, "q", "left").withColumn("block", F.explode(F.sequence(F.lit(1), F.lit(blocks - 1)).cast("array<long>")))
    r = F.sqrt(F.least("uu", "ww") / F.nullif(F.greatest("uu", "ww"), F.lit(0.0)))
    may = F.col("least").isNull() | (F.coalesce(r / (1 - r + r * r), F.lit(1.0)) >= F.col("least") - 1e-9)
    scored = copies.join(vv, "block").where(may).select("q", "label", "block", sim)
    scored = scored.withColumn("rank", F.row_number().over(local)).where(F.col("rank") <= k).select("q", "label", "sim")
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "label")
    return first.unionByName(scored).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _against_all(queries: DataFrame, sink: DataFrame, k: int) -> DataFrame:
    """``nearest`` for a sink that fits a broadcast."""
    let_workers_import(queries.sparkSession)
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    rows = sorted((r.label, r.v) for r in sink.select("label", "v").collect())  # at most BROADCAST_BYTES
    names_of = pa.array([r[0] for r in rows], to_arrow_type(sink.schema["label"].dataType))
    held = queries.sparkSession.sparkContext.broadcast((names_of, np.array([r[1] for r in rows], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, matrix = held.value
        squares = np.einsum("ij,ij->i", matrix, matrix)  # without a second matrix
        for batch in batches:
            vectors = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1)
            names, found, sims = batch.column(0).to_pylist(), [], []
            step = max(1, SCORES // max(1, len(labels)))
            for at in range(0, len(vectors), step):
                part = vectors[at : at + step]
                dots = part @ matrix.T
                under = (part * part).sum(axis=1)[:, None] + squares - dots
                # in place: a task holds two tables of SCORES numbers, and their order row by row
                np.copyto(dots, 1.0, where=under == 0)
                np.divide(dots, under, out=dots, where=under != 0)
                sim = np.negative(np.round(dots, 12, out=dots), out=under)
                order = np.stack([np.argsort(row, kind="stable")[:k] for row in sim])
                found.append(order)
                sims.append(-np.take_along_axis(sim, order, axis=1))
            order, sim = np.concatenate(found), np.concatenate(sims)
            width = order.shape[1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n in names for _ in range(width)], batch.schema.types[0]), labels.take(pa.array(order.reshape(-1))), pa.array(sim.reshape(-1)), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(names)))],
                ["q", "label", "sim", "rank"],
            )

    schema = f"q {kind(queries, 'q')}, label {kind(sink, 'label')}, sim double, rank int"
    if not rows:
        return queries.sparkSession.createDataFrame([], schema)
    return queries.select("q", "v").mapInArrow(run, schema)


def native_sets(rules: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(rule_idx, native): the representative substrate, or with every source reaction's left side.

    ``rules`` has rule_idx, native and reaction_id; ``sources`` has reaction_id and substrate.
    """
    own = rules.select("rule_idx", "native")
    if sources is not None:
        ids = rules.select("rule_idx", F.explode(F.split("reaction_id", "[|]")).alias("reaction_id"))
        own = own.unionByName(ids.join(sources, "reaction_id").select("rule_idx", F.col("substrate").alias("native")))
    return own.where("native is not null").distinct()
