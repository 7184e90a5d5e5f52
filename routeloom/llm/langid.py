"""Language identification by the nearest of several centroids per language.

Texts become TF-IDF vectors of hashed letter bigrams and trigrams (lower-cased;
whatever is no letter separates words), normalised to length one.  For each
language a spherical k-means gives several centroids; a text takes the language of
the centroid with the largest cosine.  A text is rejected if its distance to that
centroid is beyond the radius that training texts of its size have.

The fit uses a bounded sample: about ``per_language`` labelled texts of each label,
chosen by a hash of the id; whole texts.  Every label is learned: each in a task of
its own, and only document frequencies (one number a dimension) and a histogram of
cosines reach the driver.  Prediction reads only the text and covers every row; the
centroids are broadcast in blocks of ``block_labels`` labels (32 MB at 256), one
pass over the rows for each block.

Defined results: a null text or one without letters is ``und`` with score 0 and is
rejected; if nothing can be learned every text is; of equal scores the first label
wins; rows without an id never train and are held out; of rows that repeat an id and
a label one trains; repeated rows give repeated results; an empty table gives no
rows; other columns are ignored, but for those that are added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_unit, small_batches

DIMENSIONS = 1 << 13
PER_LANGUAGE = 400
CENTROIDS = 4
ROUNDS = 12
SEED = 11
BATCH = 32
CHUNK = 1 << 16
SIZES = 24
BROADCAST_LABELS = 10_000
BLOCK_LABELS = 256
#: A text may lie this much further from its centroid than the farthest training texts of its size.
SLACK = 0.5
#: The share of training texts beyond the radius before the slack, and how many texts a radius needs.
TAIL, ENOUGH = 0.005, 50
BINS = 1000
UNKNOWN = "und"
NEW = {"lang_pred": "string", "score": "double", "lang_rejected": "boolean", "__lang_size": "int"}

_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    if not _TABLE:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                table[c] = ord(chr(c).lower()[0])
        _TABLE.append(table)
    return _TABLE[0]


def grams(text: str | None) -> np.ndarray | None:
    """Counts of the text's n-grams by hash; None if it has no letters.  Works through the text in chunks."""
    if not text:
        return None
    table, shift = letters(), np.uint32(32 - DIMENSIONS.bit_length() + 1)
    space, tail, out = np.array([32], np.uint32), np.array([32], np.uint32), None
    for at in range(0, len(text), CHUNK):
        codes = table[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), "<u4")]
        codes = np.concatenate((tail, codes, space) if at + CHUNK >= len(text) else (tail, codes))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[keep]
        # the last two begin the next chunk's first n-grams
        tail = codes[-2:]
        if len(codes) < 3:
            continue
        out = np.zeros(DIMENSIONS, np.int64) if out is None else out
        two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]
        three = (two[:-1] * np.uint32(0x85EBCA6B) + codes[2:]) * np.uint32(0xC2B2AE35)
        pair = two[: len(three)] * np.uint32(0x27D4EB2F)
        for h in (three, pair):
            out += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(0x2545F491) >> shift, minlength=DIMENSIONS)
    return out


def size_class(counts: np.ndarray) -> int:
    return min(SIZES - 1, int(counts.sum()).bit_length())


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def vectors_of(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.log1p(counts.astype(np.float32)) * idf)


@dataclass
class Model:
    """``centroids`` has lang, number and centroid (float32 bytes); ``radii`` is the least cosine by size class."""

    idf: np.ndarray
    centroids: DataFrame | None
    labels: int
    block_labels: int = BLOCK_LABELS
    radii: np.ndarray = field(default_factory=lambda: np.zeros(SIZES))

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """The labels and centroids of a block of labels after the other."""
        after = None
        for _ in range(0, self.labels, self.block_labels):
            names = self.centroids.select("lang").distinct()
            names = (names if after is None else names.where(F.col("lang") > after)).orderBy("lang").limit(self.block_labels)
            own = sorted((r for r in self.centroids.join(F.broadcast(names), "lang").collect()), key=lambda r: (r.lang.encode(), r.number))
            after = own[-1].lang
            yield [r.lang for r in own], np.array([np.frombuffer(r.centroid, np.float32) for r in own])


def cluster(vectors: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by spherical k-means; starts from the mean and the texts farthest from those chosen."""
    seeds = [unit(vectors.mean(axis=0))]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(vectors[(vectors @ np.array(seeds).T).max(axis=1).argmin()])
    centroids = np.array(seeds)
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        centroids = np.array([unit(vectors[own == c].mean(axis=0)) if (own == c).any() else centroids[c] for c in range(len(centroids))])
    return centroids


def radii_of(histogram: list[tuple[int, int, int]]) -> np.ndarray:
    """The radius of each size class from (size class, cosine bin, texts): a low quantile, with slack.

    Classes of few texts are pooled with their neighbours, outwards until there are ``ENOUGH`` or
    no more.  Below the least class that has enough by itself (or else the largest of any texts) the
    radius falls by the root of two a class, as the cosine of a piece of text does with its length:
    longer texts would ask too much of a word or two.
    """
    table = np.zeros((SIZES, BINS + 1), np.int64)
    for size, place, n in histogram:
        table[size, place] += n
    out, totals = np.zeros(SIZES), table.sum(axis=1)
    if not totals.any():
        return out
    enough = np.flatnonzero(totals >= ENOUGH)
    least = enough[0] if len(enough) else np.flatnonzero(totals)[-1]
    for s in range(least, SIZES):
        for reach in range(SIZES):
            own = table[max(0, s - reach) : s + reach + 1].sum(axis=0)
            if own.sum() >= ENOUGH:
                break
        out[s] = SLACK * np.searchsorted(np.cumsum(own), max(1, int(own.sum() * TAIL))) / BINS
    out[:least] = out[least] * 2.0 ** ((np.arange(least) - least) / 2)
    return out


def fit(docs: DataFrame, trains: Column | bool = True, per_language: int = PER_LANGUAGE, k: int = CENTROIDS, block_labels: int = BLOCK_LABELS) -> Model:
    """Learn from a sample of the labelled rows where ``trains`` holds."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.lit(trains) if isinstance(trains, bool) else trains).where("lang is not null and doc_id is not null")
    sizes = cut(rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")), "label-sizes")
    labels = sizes.count()
    shares = sizes.select("lang", F.least(F.lit(1.0), per_language / F.col("n")).alias("share"))
    drawn = rows.select(F.col("doc_id").cast("long"), "lang", "text").join(F.broadcast(shares) if labels <= BROADCAST_LABELS else shares, "lang")
    drawn = drawn.where(hash_unit(F.col("doc_id"), SEED) < F.col("share"))
    sample = cut(drawn.groupBy("lang", "doc_id").agg(F.min("text").alias("text")), "language-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(d, n, np.flatnonzero(c).astype(np.int32), c.astype(np.int32)) for n, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (c := grams(t)) is not None]
            lists = [pa.array([r[2] for r in found], pa.list_(pa.int32())), pa.array([r[3][r[2]] for r in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.string()), *lists], ["doc_id", "lang", "at", "n"])

    counted = cut(sample.mapInArrow(run, "doc_id long, lang string, at array<int>, n array<int>"), "gram-counts")
    texts = counted.count()
    seen = np.zeros(DIMENSIONS)
    for r in counted.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row for a dimension at most
        seen[r["at"]] = r["count"]
    idf = np.log((1 + texts) / (1 + seen)).astype(np.float32) + 1

    def clustered(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((len(rows), DIMENSIONS), np.float32)
        for i, r in enumerate(rows.sort_values("doc_id").itertuples()):
            counts[i, r.at] = r.n
        found = cluster(vectors_of(counts, idf), k).astype(np.float32)
        return pd.DataFrame({"lang": key[0], "number": np.arange(len(found)), "centroid": [c.tobytes() for c in found]})

    centroids = cut(counted.groupBy("lang").applyInPandas(clustered, "lang string, number int, centroid binary"), "centroids")
    model = Model(idf, centroids, centroids.select("lang").distinct().count(), block_labels)
    place = F.floor(F.col("score") * BINS).cast("int")
    histogram = predict(sample, model).where(F.col("lang_pred") != UNKNOWN).groupBy("__lang_size", place.alias("place")).count().collect()
    return replace(model, radii=radii_of([tuple(r) for r in histogram]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score (cosine), lang_rejected and __lang_size (class of its size)."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*NEW)
    width, column = len(docs.columns), docs.columns.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{n} {t}" for n, t in NEW.items()])
    idf, radii = model.idf, model.radii

    def scored(held):
        """A pass over the rows for one block; a row of an earlier pass changes its label only for a larger cosine."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, centroids = held.value if held is not None else ([], np.zeros((0, DIMENSIONS), np.float32))
            for batch in batches:
                again = batch.num_columns > width
                labels, scores, rejected, sizes = (batch.column(width + i).to_pylist() if again else [v] * batch.num_rows for i, v in enumerate((UNKNOWN, 0.0, True, 0)))
                rows, counts = [], []

                def settle():
                    cosines = vectors_of(np.array(counts), idf) @ centroids.T
                    best = cosines.argmax(axis=1)
                    for row, b, c in zip(rows, best.tolist(), np.clip(cosines[np.arange(len(best)), best], 0, 1).tolist(), strict=True):
                        if labels[row] == UNKNOWN or c > scores[row]:
                            labels[row], scores[row], rejected[row] = names[b], c, bool(c < radii[sizes[row]])

                for row, text in enumerate(batch.column(column)):
                    if names and (found := grams(text.as_py())) is not None:
                        rows.append(row)
                        counts.append(found)
                        sizes[row] = size_class(found)
                        if len(rows) == BATCH:
                            settle()
                            rows, counts = [], []
                if rows:
                    settle()
                kinds = (pa.string(), pa.float64(), pa.bool_(), pa.int32())
                added = [pa.array(v, t) for v, t in zip((labels, scores, rejected, sizes), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], [*batch.schema.names[:width], *NEW])

        return run

    blocks = 0
    for block in model.blocks():
        # the size of a block is bounded by its labels, centroids and dimensions
        docs = (docs if not blocks else cut(docs, "language-pass")).mapInArrow(scored(docs.sparkSession.sparkContext.broadcast(block)), schema)
        blocks += 1
    return docs if blocks else docs.mapInArrow(scored(None), schema)


def held_out() -> Column:
    """Rows that the fit must not see; an id that is null has the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
