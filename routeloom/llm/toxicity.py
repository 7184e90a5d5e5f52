"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are taken as labelled; all other texts that may train are
unlabelled, whatever else is said of them.  With the class prior p, the risk of a classifier
is p * R+(positive) + max(0, R-(unlabelled) - p * R-(positive)): the unlabelled texts stand for
the clean ones once the share of toxic ones among them is taken off, and where that estimate
turns negative in a batch, the step unlearns it instead.  The loss is the sigmoid loss.

Features are hashed words and the first letters of longer words (lower-cased runs of letters),
as log(1 + 1000 n / (50 + words)).  Those are kept that the positive and the unlabelled texts
have in clearly different shares (a two-sample z beyond ``EVIDENCE``), ``FEATURES`` at most:
weights of rare words would only learn the sample by heart.  ``MEMBERS`` numpy classifiers are
trained, each in a task of its own and without another part of the sample; their mean is the score.

The fit uses a bounded sample, about ``POSITIVES`` and ``UNLABELLED`` whole texts chosen by a
hash of the id; texts with the same least hash of three words are near copies, and one of them
trains.  The prior is the share of toxic rows among the labelled ones that may train, or
``PRIOR`` if these are all toxic.  Prediction reads only the text and covers every row.

Defined results: a null text scores as an empty one; without a toxic text to learn from, or
without a feature that tells, every score is 0; rows without an id never train and are held
out; of rows that repeat an id one trains; a label that is null is none, of labels that
differ toxic wins; an empty table gives no rows; other columns are ignored, but for those
that are added, which are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_unit, release, small_batches

POSITIVES = 4000
UNLABELLED = 16000
PRIOR = 0.1
BUCKETS = 1 << 18
FEATURES = 1024
EVIDENCE = 5.0
LEAST_TEXTS = 5
MEMBERS = 4
SEED = 23
CHUNK = 1 << 20
CACHE = 1 << 18
STARTS = (4, 6)
NEW = {"score": "double", "predicted": "int"}

WORD = re.compile(r"[^\W\d_]+")
LAST_WORD = re.compile(r"[^\W\d_]*\Z")


def words_of(text: str | None) -> Counter:
    """Lower-cased runs of letters; long texts go through in chunks that end between words."""
    out: Counter = Counter()
    tail = ""
    for at in range(0, len(text or ""), CHUNK):
        piece = tail + text[at : at + CHUNK]
        end = len(piece) if at + CHUNK >= len(text) else LAST_WORD.search(piece).start()
        out.update(WORD.findall(piece[:end].lower()))
        tail = piece[end:]
    return out


def buckets_of(word: str) -> list[int]:
    """The word's bucket and those of its first letters."""
    names = [word, *("<" + word[:n] for n in STARTS if len(word) > n)]
    return [crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in names]


def least_shingle(text: str | None) -> int:
    """The least hash of three neighbouring words: near copies mostly share it."""
    words = WORD.findall((text or "").lower())
    return min((crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))), default=0)


def values_of(counts: np.ndarray, words) -> np.ndarray:
    return np.log1p(1000 * counts / (50 + words))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int, epochs: int = 40, rate: float = 0.01, decay: float = 1e-4, batch: int = 512) -> np.ndarray:
    """Weights and, last, the bias of a linear classifier that minimises the non-negative risk by Adam."""
    rng, weights = np.random.default_rng(seed), np.zeros(positive.shape[1] + 1)
    weights[-1], first, second, step = -1.0, np.zeros_like(weights), np.zeros_like(weights), 0
    # small samples get as many steps as it takes to learn anything
    for _ in range(max(epochs, -(-400 * batch // max(1, len(unlabelled))))):
        order = rng.permutation(len(unlabelled))
        for at in range(0, len(order), batch):
            u, p = unlabelled[order[at : at + batch]], positive[rng.choice(len(positive), min(batch, len(positive)), False)]
            su, sp = sigmoid(u @ weights[:-1] + weights[-1]), sigmoid(p @ weights[:-1] + weights[-1])
            gu, gp = su * (1 - su) / len(su), prior * sp * (1 - sp) / len(sp)
            # where the clean texts' part of the risk turns negative, the step goes back on it
            gu, gp = (gu, -2 * gp) if su.mean() >= prior * sp.mean() else (-gu, gp)
            slope = np.append(gu @ u + gp @ p + decay * weights[:-1], gu.sum() + gp.sum())
            step += 1
            first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
            weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


@dataclass
class Model:
    """The kept buckets, and a row of weights and bias for each classifier."""

    buckets: np.ndarray
    weights: np.ndarray
    prior: float

    def columns(self) -> dict[int, int]:
        return {b: i for i, b in enumerate(self.buckets.tolist())}

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(rows))
        return sigmoid(rows @ self.weights[:, :-1].T + self.weights[:, -1]).mean(axis=1)


def fit(docs: DataFrame, labels: DataFrame, trains: Column, positives: int = POSITIVES, unlabelled: int = UNLABELLED, members: int = MEMBERS) -> Model:
    """Learn from a sample of the rows where ``trains`` (a condition on doc_id) holds; ``labels`` has doc_id and toxic."""
    small_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & trains).distinct()
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = cut(ids.join(marks, "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("positive"), F.col("toxic").isNotNull().alias("labelled")), "toxic-ids")
    size = known.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"), F.count_if("labelled").alias("l")).first()
    nothing = Model(np.zeros(0, np.int64), np.zeros((0, 1)), PRIOR)
    if not size.p or not size.u:
        return nothing
    prior = size.p / size.l if size.p < size.l else PRIOR
    share = F.when(F.col("positive"), F.lit(positives / size.p)).otherwise(F.lit(unlabelled / size.u))
    drawn = known.where(hash_unit(F.col("doc_id"), SEED) < share).select("doc_id", "positive")
    # bounded by the two parameters
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, positive, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, found = words_of(text), Counter()
                for word, n in words.items():
                    for b in buckets_of(word):
                        found[b] += n
                rows.append((doc, positive, least_shingle(text), words.total(), list(found), list(found.values())))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "positive", "near", "words", "at", "n"])

    counted = texts.mapInArrow(run, "doc_id long, positive boolean, near long, words long, at array<int>, n array<long>")
    row = F.struct("doc_id", "words", "at", "n")
    sample = cut(counted.groupBy("positive", "near").agg(F.min_by(row, "doc_id").alias("r")).select("positive", "near", "r.*"), "toxic-sample")
    n = sample.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")).first()
    # a text counts once in each bucket
    seen = sample.select("positive", F.explode("at").alias("at")).groupBy("at").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    both = (F.col("p") + F.col("u")) / (n.p + n.u)
    z = F.abs(F.col("p") / n.p - F.col("u") / n.u) / F.sqrt(both * (1 - both) * (1 / n.p + 1 / n.u) + 1e-12)
    kept = seen.where(F.col("p") + F.col("u") >= LEAST_TEXTS).withColumn("z", z).where(F.col("z") > EVIDENCE)
    buckets = np.array(sorted(r["at"] for r in kept.orderBy(F.desc("z"), "at").limit(FEATURES).select("at").collect()), np.int64)
    if not len(buckets):
        return nothing

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_id")
        counts = np.zeros((len(rows), len(buckets)), np.float32)
        for i, (at, n) in enumerate(zip(rows["at"], rows["n"], strict=True)):
            place = np.searchsorted(buckets, at)
            hit = (place < len(buckets)) & (buckets[np.minimum(place, len(buckets) - 1)] == at)
            counts[i, place[hit]] = n[hit]
        values, positive = values_of(counts, rows["words"].to_numpy()[:, None]), rows["positive"].to_numpy(bool)
        if not positive.any() or positive.all():
            return pd.DataFrame({"member": [], "weights": []})
        return pd.DataFrame({"member": [key[0]], "weights": [train(values[positive], values[~positive], prior, SEED + key[0]).astype(np.float64).tobytes()]})

    # a member leaves out the texts of its number; the sample's size bounds the task
    member = F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member")
    shared = sample.select(member, "doc_id", "near", "positive", "words", "at", "n").where((F.pmod("near", F.lit(members)) != F.col("member")) | F.lit(members == 1))
    learnt = shared.groupBy("member").applyInPandas(learn, "member int, weights binary").collect()
    release(sample)
    release(known)
    weights = [np.frombuffer(bytes(r.weights)) for r in sorted(learnt, key=lambda r: r.member)]
    return Model(buckets, np.array(weights), prior) if weights else nothing


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if it is 0.5 or more)."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*NEW)
    width, column = len(docs.columns), docs.columns.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + [f"{n} {t}" for n, t in NEW.items()])
    columns = model.columns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            counts, words = np.zeros((batch.num_rows, len(columns))), np.zeros((batch.num_rows, 1))
            for i, text in enumerate(batch.column(column)):
                found = words_of(text.as_py())
                words[i] = found.total()
                for word, n in found.items():
                    at = kept.get(word)
                    if at is None:
                        if len(kept) >= CACHE:
                            kept.clear()
                        at = kept[word] = tuple(columns[b] for b in buckets_of(word) if b in columns)
                    for c in at:
                        counts[i, c] += n
            scores = model.scores(values_of(counts, words))
            added = [pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], [*batch.schema.names[:width], *NEW])

    return docs.mapInArrow(run, schema)
