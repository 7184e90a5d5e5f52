"""Ranked lexical search by best-first branch-and-bound over hierarchical maximum trees.

Terms are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased.
The score of a document is a sum over a query's terms of a weight times an impact, a number
that grows with the term's occurrences and falls with the document's length, all in integers.

Index: each input partition cuts its documents into ranges of at most ``RANGE_DOCS`` documents
and about ``RANGE_POSTINGS`` postings; a range is one row.  When it is searched, each of its
terms gets a tree of maxima: the largest impact in each leaf of ``LEAF`` documents, in each
node of ``FANOUT`` leaves, and in the whole range.  A node's bound for a query is the sum over
the query's terms of weight times maximum, so no document below it scores more.

Search, in three passes over the index, which never leaves its partitions:

1. the bound of every range for every query; each query's range of the largest bound is its seed;
2. the seeds are searched, which gives each query the score that a document must reach;
3. all ranges are searched with it: nodes come off a heap by falling bound, those below the
   score are never opened, those equal to it are (a smaller id may win a tie).

The ten best of each task meet in one window over the queries.  Queries come in blocks of about
``QUERY_TERMS`` terms, as a broadcast; a fixed table of a million bits, made of all query terms,
tells the indexing tasks which terms to keep, and false hits have no weight.

Defined results: a null text has no terms; rows that repeat a document's id are documents of
their own; a null document id ranks after others of its score; rows that share an item's id
are one item with the terms of all; an item without a known term has no rows; other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, release, small_batches

K = 10
RANGE_DOCS = 4096
RANGE_POSTINGS = 1 << 18
LEAF = 256
FANOUT = 4
SLOTS = 1 << 20
QUERY_TERMS = 200_000
CHUNK = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of UTF-8: what is no term becomes a space.
BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(range(256)).lower())

INDEX_SCHEMA = "block long, docs array<long>, lens array<long>, terms array<binary>, starts array<int>, places array<int>, counts array<long>"


def term_counts(data: bytes | None) -> Counter:
    """Occurrences of each term in a text's bytes; long texts go through in chunks that end between terms."""
    out: Counter = Counter()
    if data is None:
        return out
    tail = b""
    for at in range(0, len(data), CHUNK):
        piece = tail + data[at : at + CHUNK].translate(BYTES)
        end = len(piece) if at + CHUNK >= len(data) else piece.rfind(b" ") + 1
        out.update(piece[:end].split())
        tail = piece[end:]
    return out


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of the items' texts."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(words).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def slot_table(terms: DataFrame) -> bytes:
    """A byte for each slot: 1 if a term hashes there.  Its size does not depend on the terms."""
    slot = (F.crc32(F.col("term").cast("binary")) % SLOTS + 1).alias("slot")
    bits = terms.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros(SLOTS, np.uint8)
    for r in bits.collect():  # at most SLOTS / 32768 rows of 4 KB
        part = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[(r.b - 1) * len(part) : r.b * len(part)] = part
    return out.tobytes()


def build_index(docs: DataFrame, terms: DataFrame, range_docs: int = RANGE_DOCS, range_postings: int = RANGE_POSTINGS) -> DataFrame:
    """The written index: every document, with the postings of the terms asked for; a row for each range of documents."""
    small_batches(docs.sparkSession)
    slots = docs.sparkSession.sparkContext.broadcast(slot_table(terms))

    def lists(values: list[np.ndarray], kind) -> pa.Array:
        return pa.array(values, pa.list_(kind))

    def row(block: int, docs: list, lens: list, rows: dict, which: list, places: list, counts: list) -> pa.RecordBatch:
        term, place, count = np.array(which, np.int32), np.array(places, np.int32), np.array(counts, np.int64)
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(rows) + 1)).astype(np.int32)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
        columns = [lists([v], k) for v, k in zip((docs, lens, list(rows), starts, place[order], count[order]), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *columns], [c.split()[0] for c in INDEX_SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, block = slots.value, TaskContext.get().partitionId() << 32
        docs, lens, rows, which, places, counts = [], [], {}, [], [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = term_counts(text.as_py())
                for term, n in found.items():
                    if wanted[crc32(term) % SLOTS]:
                        which.append(rows.setdefault(term, len(rows)))
                        places.append(len(docs))
                        counts.append(n)
                docs.append(doc)
                lens.append(found.total())
                if len(docs) == range_docs or len(which) >= range_postings:
                    yield row(block, docs, lens, rows, which, places, counts)
                    block += 1
                    docs, lens, rows, which, places, counts = [], [], {}, [], [], []
        if docs:
            yield row(block, docs, lens, rows, which, places, counts)

    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX_SCHEMA), "lexical-index")


def corpus_size(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    used = index.select(F.size(F.filter("lens", lambda n: n > 0)).alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, n: a + n).alias("l"))
    r = used.agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return r.n or 0, r.l or 0


def weighted(items: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(item_id, terms, coefs): an item's known terms with times times weight."""
    own = index.select("starts", F.posexplode("terms").alias("at", "term")).select("term", (F.get("starts", F.col("at") + 1) - F.get("starts", F.col("at"))).cast("long").alias("n"))
    seen = own.groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long")
    known = items.withColumn("term", F.col("term").cast("binary")).join(seen, "term").withColumn("coef", F.col("times") * weight).where("coef > 0")
    return known.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.collect_list("coef").alias("coefs"))


class Range:
    """A range of documents under the search: exact impacts, and their maxima level by level."""

    def __init__(self, docs, lens, terms, starts, places, counts, n: int, total: int):
        self.docs, self.rows = docs, {t: i for i, t in enumerate(terms)}
        norms = np.array([25 + 75 * x * n // total for x in lens], np.int64)
        self.places, self.impacts = places, 1_000_000_000 * counts // (1000 * counts + 8 * norms[places])
        leaves = -(-len(docs) // LEAF)
        term = np.repeat(np.arange(len(terms)), np.diff(starts))
        key = term * leaves + places // LEAF
        self.ends = np.searchsorted(key, np.arange(len(terms) * leaves + 1)).reshape(-1)
        self.leaves, maxima = leaves, np.zeros(len(terms) * leaves, np.int64)
        if len(key):
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            maxima[key[first]] = np.maximum.reduceat(self.impacts, first)
        self.levels = [maxima.reshape(len(terms), leaves)]
        while self.levels[-1].shape[1] > 1:
            low = self.levels[-1]
            wide = np.pad(low, ((0, 0), (0, -low.shape[1] % FANOUT)))
            self.levels.append(wide.reshape(len(terms), -1, FANOUT).max(axis=2))

    def known(self, terms, coefs) -> tuple[np.ndarray, np.ndarray]:
        """The rows of a query's terms that stand in this range, and their coefficients."""
        pairs = [(self.rows[t], c) for t, c in zip(terms, coefs, strict=True) if t in self.rows]
        return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)

    def bound(self, rows, coefs) -> int:
        return int(coefs @ self.levels[-1][rows, 0]) if len(rows) else 0

    def scores(self, rows, coefs, leaf: int) -> np.ndarray:
        """The exact scores of a leaf's documents."""
        out = np.zeros(min(LEAF, len(self.docs) - leaf * LEAF), np.int64)
        at = rows * self.leaves + leaf
        for a, b, c in zip(self.ends[at].tolist(), self.ends[at + 1].tolist(), coefs.tolist(), strict=True):
            if a < b:
                out[self.places[a:b] - leaf * LEAF] += c * self.impacts[a:b]  # a document stands once in a term's postings
        return out

    def search(self, rows, coefs, best: Best) -> None:
        """Opens nodes by falling bound while they may still enter ``best``."""
        top = len(self.levels) - 1
        heap = [(-self.bound(rows, coefs), top, 0)]
        while heap and -heap[0][0] >= best.least:
            _, level, node = heapq.heappop(heap)
            if level:
                low = self.levels[level - 1]
                first = node * FANOUT
                for i, b in enumerate((coefs @ low[rows, first : first + FANOUT]).tolist()):
                    if b >= best.least:
                        heapq.heappush(heap, (-b, level - 1, first + i))
            else:
                scores = self.scores(rows, coefs, node)
                near = np.flatnonzero(scores >= best.least)
                if len(near):
                    best.take([(-int(scores[i]), *_order(self.docs[node * LEAF + i])) for i in near])


def _order(doc: int | None) -> tuple[bool, int]:
    return doc is None, doc or 0


class Best:
    """A query's best documents so far, and the score that another one must reach."""

    def __init__(self, k: int, least: int):
        self.k, self.found, self.least = k, [], max(1, least)

    def take(self, more: list[tuple]) -> None:
        self.found = sorted(self.found + more)[: self.k]
        if len(self.found) == self.k:
            self.least = max(self.least, -self.found[-1][0])


def _ranges(batches: Iterator[pa.RecordBatch], n: int, total: int) -> Iterator[tuple[int, Range]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block, docs, lens, terms, starts, places, counts = (c[i] for c in batch.columns)
            numbers = (np.asarray(c.values) for c in (starts, places, counts))
            yield block.as_py(), Range(docs.as_py(), lens.as_py(), terms.as_py(), *numbers, n, total)


def top_documents(index: DataFrame, weights: DataFrame, n: int, total: int, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of weighted items."""
    items = [(r.item_id, list(map(bytes, r.terms)), list(r.coefs)) for r in weights.collect()]  # bounded by QUERY_TERMS
    spark = index.sparkSession
    kind = weights.schema["item_id"].dataType
    held = spark.sparkContext.broadcast([(t, c) for _, t, c in items])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, tuple[int, int]] = {}
        for block, own in _ranges(batches, n, total):
            for q, (terms, coefs) in enumerate(held.value):
                if (b := own.bound(*own.known(terms, coefs))) and (b, block) > most.get(q, (0, 0)):
                    most[q] = (b, block)
        columns = zip(*((q, b, block) for q, (b, block) in most.items()), strict=True) if most else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q", "bound", "block"])

    def searching(floors: list[int], only: dict[int, list[int]] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {}
            for block, own in _ranges(batches, n, total):
                for q in range(len(floors)) if only is None else only.get(block, ()):
                    rows, coefs = own.known(*held.value[q])
                    mine = best.setdefault(q, Best(k, floors[q]))
                    if len(rows) and own.bound(rows, coefs) >= mine.least:
                        own.search(rows, coefs, mine)
            out = [(q, -s, None if missing else doc) for q, b in best.items() for s, missing, doc in b.found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["q", "score", "doc_id"])

        return run

    first = index.mapInArrow(seeds, "q long, bound long, block long").groupBy("q").agg(F.max(F.struct("bound", "block")).alias("m"))
    only: dict[int, list[int]] = {}
    for r in first.select("q", "m.block").collect():  # a row for each item of the block
        only.setdefault(r.block, []).append(r.q)
    floors = [0] * len(items)
    if only:
        blocks = spark.createDataFrame([(b,) for b in only], "block long")
        rows = index.join(F.broadcast(blocks), "block", "left_semi")  # as many as the items at most
        for r in rows.mapInArrow(searching(floors, only), "q long, score long, doc_id long").groupBy("q").agg(F.min("score").alias("s"), F.count("*").alias("n")).collect():
            floors[r.q] = r.s if r.n == k else 0
    found = index.mapInArrow(searching(floors, None), "q long, score long, doc_id long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(q, item) for q, (item, _, _) in enumerate(items)], f"q long, item_id {kind.simpleString()}")
    ranked = found.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, query_block: int = QUERY_TERMS, range_docs: int = RANGE_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, scores above 0, ties by document id."""
    asked = cut(query_terms(items), "lexical-queries")
    index = build_index(docs, asked.select("term"), range_docs)
    n, total = corpus_size(index)
    weights = cut(weighted(asked, index, n), "lexical-weights")
    size = weights.agg(F.sum(F.size("terms")).alias("s")).first().s or 0
    passes, out = max(1, -(-size // query_block)), None
    for p in range(passes):
        own = weights.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p) if passes > 1 else weights
        part = top_documents(index, own, n, total, k)
        out = part if out is None else out.unionByName(part)
    release(asked)
    return out


#: The same in SQL, for whole small tables.
ORACLE = rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
m AS (SELECT doc_id, 25 + (75 * n * nn) // ll AS m FROM n, s),
r AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= {K}"""
