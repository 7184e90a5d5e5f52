"""SimHash fingerprints and near-duplicate groups by BK-trees.

Fingerprints: words are runs of bytes other than ASCII white space of the text
with A-Z lower-cased; each shingle of ``words`` words, joined by single spaces, is
hashed with XXH64, and a bit is set if it is set in over half of the hashes.

Links: two fingerprints that differ in at most ``radius`` bits agree in at least
one of ``radius + 1`` blocks of bits.  Each block's value names a shard, and in
each shard a BK-tree (children keyed by their Hamming distance to the parent) is
grown; a search follows only the edges within the radius.  Shards are dealt to
tasks by key, so no tree has to fit more than its own bucket; a bucket over
``split_over`` fingerprints is split by the same argument on its remaining bits.
A search skips a subtree whose members all are in the searcher's component
already, so that dense groups of copies cost about one path each and a shard gives
a spanning forest, never all pairs.  Every component of the threshold graph is
found whole: no bucket or partner is capped.

Components: large-star and small-star contraction over the forest's edges, in
DataFrames that are written between rounds.

Defined results: a null text or one without words has fingerprint zero and is
linked like any other; repeated rows give repeated results; a row without an id links
others too and takes its component's least id, null if no row of it has one; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release, small_batches

SEED = 42
BITS = 64
CHUNK = 1 << 16


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, in chunks of big-endian numbers; none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist()
    for at in range(0, n, CHUNK):
        pieces = map(joined.__getitem__, map(slice, starts[at : at + CHUNK], ends[at : at + CHUNK]))
        yield np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), ">u8", min(CHUNK, n - at))


def bit_totals(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def majority(totals: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(totals * 2 > n).tobytes(), "big")


def simhash(text: str | None, words: int = 3) -> int:
    """The fingerprint as an unsigned number."""
    totals, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, words):
        totals += bit_totals(hashes)
        n += len(hashes)
    return majority(totals, n)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """A BK-tree over one shard that also keeps the components of its members."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []
        self.uniform: list[int] = []  # a member if the whole subtree is in its component, else -1
        self.swept = 64

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def sweep(self) -> None:
        """Renew ``uniform`` bottom-up; children come after their parents."""
        for i in range(len(self.values) - 1, -1, -1):
            own = self.find(i)
            same = all(self.uniform[c] >= 0 and self.find(self.uniform[c]) == own for c in self.children[i].values())
            self.uniform[i] = own if same else -1

    def add(self, value: int, alike: Callable[[int], bool] | None = None) -> list[int]:
        """Insert a value; returns members of other components that it joined.

        ``alike`` may refuse a member within the radius.
        """
        me, links = len(self.values), []
        self.values.append(value)
        self.children.append({})
        self.parent.append(me)
        self.uniform.append(me)
        if not me:
            return links
        stack = [0]
        while stack:
            i = stack.pop()
            if self.uniform[i] >= 0 and self.find(self.uniform[i]) == self.find(me):
                continue
            d = (self.values[i] ^ value).bit_count()
            if d <= self.radius and (a := self.find(i)) != (b := self.find(me)) and (alike is None or alike(i)):
                self.parent[max(a, b)] = min(a, b)
                links.append(i)
            low, high = d - self.radius, d + self.radius
            near = [(abs(k - d), c) for k, c in self.children[i].items() if low <= k <= high]
            stack.extend(c for _, c in sorted(near, reverse=True))
        i, own = 0, self.find(me)
        while True:
            if self.uniform[i] >= 0 and self.find(self.uniform[i]) != own:
                self.uniform[i] = -1
            d = (self.values[i] ^ value).bit_count()
            if d not in self.children[i]:
                self.children[i][d] = me
                break
            i = self.children[i][d]
        if me >= self.swept:
            self.swept *= 2
            self.sweep()
        return links


def blocks(bits: int, parts: int) -> list[tuple[int, int]]:
    """Shift and width of each of ``parts`` blocks of ``bits`` bits."""
    edges = [bits * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _shards(reps: DataFrame, radius: int, split_over: int) -> DataFrame:
    """Rows (shard string, fp, rep), a row for each block of the fingerprint."""

    def part(shift, width):
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))

    cuts = blocks(BITS, radius + 1)
    first = F.array(*(F.struct(F.lit(t).alias("t"), part(s, w).alias("key")) for t, (s, w) in enumerate(cuts)))
    keyed = reps.select("fp", "rep", F.explode(first).alias("x")).select("fp", "rep", "x.t", "x.key")
    hot = cut(keyed.groupBy("t", "key").count().where(F.col("count") > split_over).select("t", "key", F.lit(True).alias("hot")), "shards-hot")
    plain = F.concat_ws(":", "t", "key")
    if hot.isEmpty():
        return keyed.select(plain.alias("shard"), "fp", "rep")
    # within a hot bucket the remaining bits differ in at most ``radius`` places too
    inner = []
    for t, (s, w) in enumerate(cuts):
        rest = [b for b in range(BITS) if not s <= b < s + w]
        names = [
            F.concat_ws(":", F.lit(f"{k}"), *(part(rest[a], 1) if n == 1 else _bits(rest[a : a + n]) for a, n in [span]))
            for k, span in enumerate(blocks(len(rest), radius + 1))
        ]
        inner.append(F.when(F.col("t") == t, F.array(*names)))
    marked = keyed.join(hot, ["t", "key"], "left")
    names = F.when(F.col("hot"), F.transform(F.coalesce(*inner), lambda x: F.concat_ws("/", plain, x))).otherwise(F.array(plain))
    return marked.select(F.explode(names).alias("shard"), "fp", "rep")


def _bits(places: list[int]):
    """The value of chosen bits of ``fp``: runs of neighbouring places are moved together."""
    runs, out, at = [], None, 0
    for p in places:
        if runs and runs[-1][1] == p:
            runs[-1][1] = p + 1
        else:
            runs.append([p, p + 1])
    for a, b in runs:
        value = F.shiftleft(F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)), at)
        out = value if out is None else out.bitwiseOR(value)
        at += b - a
    return out


def links(reps: DataFrame, radius: int = 3, split_over: int = 4096) -> DataFrame:
    """Edges (a, b) of a forest that spans each component within a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, reps_in = None, None, []
        for batch in batches:
            found_a, found_b = [], []
            for name, fp, rep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != shard:
                    shard, tree, reps_in = name, BKForest(radius), []
                reps_in.append(rep)
                for other in tree.add(fp & 0xFFFFFFFFFFFFFFFF):
                    found_a.append(rep)
                    found_b.append(reps_in[other])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    shards = _shards(reps, radius, split_over)
    return shards.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the least node of its component, for every node of an edge.

    Alternates large-star and small-star until nothing changes; a hub's neighbours
    are never gathered, only their minimum is.
    """

    def star(e: DataFrame, both_ways: bool) -> DataFrame:
        """Hang each node's larger neighbours (or its smaller ones and itself) on the least of all."""
        turned = e.select(F.col("b").alias("a"), F.col("a").alias("b"))
        sides = e.union(turned) if both_ways else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        if not both_ways:
            return sides.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))

    def settled(e: DataFrame) -> DataFrame:
        return cut(e.where("a <> b").distinct(), "components")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = settled(edges)
    before, now = None, mark(edges)
    while now != before:
        hung = settled(star(star(edges, True), False))
        release(edges)
        edges, before = hung, now
        now = mark(edges)
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, split_over: int = 4096) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` for every document."""
    fps = cut(fingerprints(docs, words), "fingerprints")
    # fingerprints are the nodes: a row without an id links like any other
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("rep")), radius, split_over))
    known = cut(nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("class")), "fingerprint-classes")
    least = known.groupBy("class").agg(F.min("least").alias("component_id"))
    return fps.join(known.join(least, "class").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
