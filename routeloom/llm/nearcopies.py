"""Near copies by word shingles: BK-trees of SimHash fingerprints in MinHash shards.

Copies with a Jaccard similarity of 0.8 over five-word shingles differ in about ten bits
of a 64-bit SimHash of the distinct shingles (12 if there are only four or five), too
many for a shard key from its own bits; a radius of 32 is six deviations away.  Here the shards come
from MinHash bands: texts that agree in all values of a band meet in one shard, which at
the similarity asked for fails in less than one case in a thousand.  In each shard a
BK-tree with a radius of ``RADIUS`` bits proposes partners, and the sets of all shingle
hashes (their upper 32 bits), which each row of a shard carries, decide.  Up to ``KEPT``
hashes are kept with the fingerprint; larger sets are made again, only for texts that
share a shard.  Groups are the components of these links; the smallest id stays.

Defined results: texts without words are copies of one another; a text with fewer words
than a shingle is one shingle; rows that repeat an id stay or go together; rows
without an id belong to no group and stay; an empty table
gives no rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .simhash import BITS, CHUNK, BKForest, bit_totals, components, majority, shingle_hashes

WORDS = 5
SIMILARITY = 0.8
RADIUS = 32
KEPT = 512
BROADCAST_IDS = 1_000_000
BINS = 64
BANDS, BAND_ROWS = 16, 4
STEP = 0x9E3779B97F4A7C15


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The upper 32 bits of sorted hashes, each once."""
    upper = (hashes >> np.uint64(32)).astype("<u4")
    return upper[np.flatnonzero(np.diff(upper.astype(np.int64), prepend=-1))]


def whole_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """All distinct shingle hashes (their upper 32 bits, sorted)."""
    parts = [h.astype(np.uint64) for h in shingle_hashes(text, words)]
    return distinct(np.unique(np.concatenate(parts))) if parts else np.zeros(0, "<u4")


def sketch(text: str | None, words: int = WORDS) -> tuple[int, np.ndarray, np.ndarray]:
    """Fingerprint of the distinct shingles, their hashes (upper 32 bits, sorted) and band keys."""
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    totals, parts = np.zeros(BITS, np.int64), [np.zeros(0, np.uint64)]
    width = np.uint64(64 - (BINS.bit_length() - 1))
    parts += [h.astype(np.uint64) for h in shingle_hashes(text, words)]
    ordered = np.unique(np.concatenate(parts))
    for at in range(0, len(ordered), CHUNK):
        totals += bit_totals(ordered[at : at + CHUNK].astype(">u8"))
    bins = (ordered >> width).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    least[bins[first]] = ordered[first]
    filled = np.flatnonzero(least != np.iinfo(np.uint64).max)
    if len(filled):
        # an empty bin takes the next filled one's value, told apart by the distance
        source = filled[np.searchsorted(filled, np.arange(BINS)) % len(filled)]
        away = ((source - np.arange(BINS)) % BINS).astype(np.uint64)
        least = least[source] + away * np.uint64(STEP)
    mixed = (least ^ (least >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    rows = mixed[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    keys = np.arange(BANDS, dtype=np.uint64) * np.uint64(STEP)
    for r in range(BAND_ROWS):
        keys = (keys ^ rows[:, r]) * np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(31)
    return majority(totals, len(ordered)), distinct(ordered), keys.astype(np.int64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity; two empty ones do."""
    few, many = sorted((len(a), len(b)))
    if not many or few / many < similarity:
        return not many
    both = np.sort(np.concatenate((a, b)))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) >= similarity


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, digest, n, sketch, bands) of each row: digest and n are of the whole set, sketch has the smallest hashes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                fp, own, bands = sketch(text.as_py(), words)
                rows.append((fp, digest_of(own), len(own), own[:KEPT].tobytes(), bands))
            fps, digests = (pa.array(np.array([r[i] for r in rows], np.uint64).view(np.int64)) for i in (0, 1))
            rest = [pa.array([r[i] for r in rows], k) for i, k in ((2, pa.int32()), (3, pa.binary()), (4, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, digests, *rest], ["doc_id", "fp", "digest", "n", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long, digest long, n int, sketch binary, bands array<long>")


def digest_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def whole_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(rep, digest, whole) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [whole_set(t.as_py(), words) for t in batch.column(1)]
            digests = pa.array(np.array([digest_of(s) for s in sets], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), digests, pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "digest", "whole"])

    # an id that several rows share may give a set more than once
    return docs.mapInArrow(run, "rep long, digest long, whole binary").groupBy("rep", "digest").agg(F.first("whole").alias("whole"))


def shard_links(rows: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Edges (a, b) of a forest within each shard, from (shard, rep, fp, sketch)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, reps, held = None, None, [], []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for name, rep, fp, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != shard:
                    shard, tree, reps, held = name, BKForest(radius), [], []
                own = np.frombuffer(raw, "<u4")
                reps.append(rep)
                held.append(own)
                for other in tree.add(fp & 0xFFFFFFFFFFFFFFFF, lambda i: alike(held[i], own, similarity)):  # noqa: B023
                    found.append((rep, reps[other]))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("shard").sortWithinPartitions("shard", "rep").select("shard", "rep", "fp", "sketch").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """``doc_id`` and ``group_id``, the smallest id of its group of near copies."""
    made = cut(sketches(docs, words), "sketches")
    same = ["fp", "digest"]
    reps = made.groupBy(*same).agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "sketch", "bands")))
    reps = cut(reps.where("rep is not null"), "sketch-reps")
    banded = cut(reps.select("rep", F.explode("bands").alias("shard")), "bands")
    shared = banded.groupBy("shard").count().where("count > 1").select("shard")
    banded = cut(banded.join(shared, "shard", "left_semi"), "bands-shared")
    near = cut(reps.drop("bands").join(banded.select("rep").distinct(), "rep", "left_semi"), "sketch-near")
    long = near.where(F.col("n") > KEPT).select("rep").distinct()
    long = F.broadcast(long) if long.count() <= BROADCAST_IDS else long
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(long, "rep")
    near = near.join(whole_sets(texts, words), ["rep", "digest"], "left")
    rows = banded.join(near.select("rep", "fp", F.coalesce("whole", "sketch").alias("sketch")), "rep")
    found = components(shard_links(rows, similarity, radius))
    classes = reps.join(found, reps.rep == found.node, "left").select(*same, F.coalesce("component", "rep").alias("group_id"))
    return made.select("doc_id", *same).join(classes, same).select("doc_id", "group_id")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that are not near copies of a document with a smaller id."""
    copies = cut(groups(docs, words, similarity, radius).where("doc_id <> group_id").select(F.col("doc_id").alias("__near_copy")).distinct(), "copies")
    return docs.join(copies, docs["doc_id"].cast("long") == copies["__near_copy"], "left_anti")
