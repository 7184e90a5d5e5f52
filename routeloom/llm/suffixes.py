"""Removal of byte strings that repeat across documents, by blockwise suffix sorting.

A byte goes if a string of ``SPAN`` bytes covers it that also starts in a document
with a smaller id; strings are judged on the input.

1. *Buckets.*  Each string of ``SPAN`` bytes is placed by the least hash among its
   ``GRAM``-byte substrings (its anchor), so equal strings meet in one bucket.
   Neighbouring strings with one anchor form a unit, stored once.
2. *Anchors.*  Only anchors that occur in more than one document matter.  Tasks send
   each anchor once for a block of documents, packed; the buckets answer with the
   anchors that repeat.  An anchor that a third of all documents hold costs one entry
   for each block.
3. *Sorting.*  The units of repeating anchors go to their suffix buckets, equal units
   of a block once.  One bucket at a time is sorted: suffixes by their first 32 bytes,
   and longer ties by a difference cover of period 31: any two positions have an
   offset below 31 that takes both into the cover, so the precomputed ranks of the
   cover's sample decide.  Memory is that of one bucket, whose number follows the input.
4. *Removal.*  Neighbours in the order that share ``SPAN`` bytes (compared as bytes)
   are one string, whose smallest document keeps it.  The others' runs of bytes go
   back to their documents.

Defined results: a null text is empty; texts under ``SPAN`` bytes stay; of equal texts
the smallest id keeps its bytes; rows that repeat an id count as one document, as they
are no smaller than themselves; a null id is the smallest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, small_batches

SPAN = 50
GRAM = 20
WINDOW = SPAN - GRAM + 1
PIECE = 1 << 19
BASE = 0x9E3779B97F4A7C15
ANCHOR_BUCKET_BYTES = 1 << 24
SUFFIX_BUCKET_BYTES = 1 << 22
TEXT_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20
#: A perfect difference set modulo 31.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
PREFIX_WORDS = 4


def _offsets() -> np.ndarray:
    """For each two residues the least offset that takes both into the cover."""
    inside = np.isin(np.arange(2 * PERIOD) % PERIOD, COVER)
    table = np.zeros((PERIOD, PERIOD), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            table[a, b] = next(d for d in range(PERIOD) if inside[a + d] and inside[b + d])
    return table


OFFSETS = _offsets()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each position: a polynomial by doubling, then mixed."""
    power = lambda n: np.uint64(pow(BASE, n, 1 << 64))
    by_length, n = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while n * 2 <= GRAM:
        h = by_length[n]
        by_length[2 * n] = h[:-n] * power(n) + h[n:]
        n *= 2
    out, done = by_length[n], n
    while done < GRAM:
        part = max(k for k in by_length if k <= GRAM - done)
        h = by_length[part]
        size = len(data) - done - part + 1
        out = out[:size] * power(part) + h[done : done + size]
        done += part
    return _mix(out)


def slide_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while n * 2 <= width:
        keys = np.minimum(keys[:-n], keys[n:])
        n *= 2
    return np.minimum(keys[: len(keys) - (width - n)], keys[width - n :]) if n < width else keys


def units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of the pieces [start, end) of a buffer of at most 2^20 bytes.

    Returns the piece, first position, number of strings and anchor (48 bits) of each.
    """
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(data)
    low = np.uint64((1 << 20) - 1)
    least = slide_min((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), WINDOW)
    at = (least & low).astype(np.int64)
    edge = np.zeros(len(at) + 1, np.int32)
    fits = ends - starts >= SPAN
    np.add.at(edge, starts[fits], 1)
    np.add.at(edge, ends[fits] - SPAN + 1, -1)
    valid = np.cumsum(edge[:-1]) > 0
    same = np.zeros(len(at), bool)
    same[1:] = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
    first = np.flatnonzero(valid & ~same)
    follows = np.append(same[1:], False)
    last = np.flatnonzero(valid & ~follows)
    anchor = _mix(hashes[at[first]]) >> np.uint64(16)
    return np.searchsorted(starts, first, "right") - 1, first, last - first + 1, anchor


def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]]:
    """Buffers of whole pieces: bytes, starts, ends, document ids, offsets in the document, and further columns."""
    parts, size, ids, offsets, more = [], 0, [], [], []

    def made():
        lengths = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(parts), np.uint8), ends - lengths, ends, np.array(ids, np.int64), np.array(offsets, np.int64), more

    for batch in batches:
        further = batch.columns[2:]
        for row, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
            data = (text.as_py() or "").encode()
            for at in range(0, len(data) - SPAN + 1, PIECE - SPAN + 1):
                piece = data[at : at + PIECE]
                if size + len(piece) > 2 * PIECE:
                    yield made()
                    parts, size, ids, offsets, more = [], 0, [], [], []
                parts.append(piece)
                size += len(piece)
                ids.append(doc)
                offsets.append(at)
                more.append([c[row] for c in further])
    if parts:
        yield made()


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values, and the end."""
    if not len(sorted_values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]))


def _six(values: np.ndarray) -> bytes:
    return (values & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (values >> np.uint64(32)).astype("<u2").tobytes()


def _unsix(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | np.frombuffer(data, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


ANCHOR_SCHEMA = "bucket long, answered boolean, anchors binary, docs binary"
ANSWER_SCHEMA = "doc_id long, anchor long"


def _send_anchors(n_buckets: int, block_bytes: int):
    """A block's anchors by bucket, each once; those that two of its documents hold are answered at once."""

    def flush(anchors: list, docs: list) -> Iterator[pa.RecordBatch]:
        anchor, doc = np.concatenate(anchors), np.concatenate(docs)
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        anchor, doc = anchor[new], doc[new]
        edges = runs(anchor)
        counts = np.diff(edges)
        many = np.repeat(counts > 1, counts)
        rows = [(int(anchor[0] % np.uint64(n_buckets)), True, _six(anchor[many]), zlib.compress(doc[many].tobytes(), 1))]
        # the highest bit of an entry's document delta tells whether its block has answered
        anchor, doc, told = anchor[edges[:-1]], doc[edges[:-1]], counts > 1
        bucket = (anchor % np.uint64(n_buckets)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        anchor, doc, told, bucket = anchor[order], doc[order], told[order], bucket[order]
        edges = runs(bucket)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                delta = np.diff(doc[a:b], prepend=0)
                rows.append((int(bucket[a]), False, _six(anchor[a:b]), zlib.compress(delta.tobytes() + told[a:b].tobytes(), 1)))
        kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "answered", "anchors", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, docs, size = [], [], 0
        for data, starts, ends, ids, _, _ in buffers(batches):
            piece, _, _, anchor = units(data, starts, ends)
            anchors.append(anchor)
            docs.append(ids[piece])
            size += len(data)
            if size >= block_bytes:
                yield from flush(anchors, docs)
                anchors, docs, size = [], [], 0
        if size:
            yield from flush(anchors, docs)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one bucket after the other; rows come sorted by bucket."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _answer_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each repeating anchor of a document."""

    def answer(doc: np.ndarray, anchor: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(anchor.astype(np.int64))], ["doc_id", "anchor"])

    for rows in _by_bucket(batches):
        anchors, docs, told = [], [], []
        for _, answered, packed, held in rows:
            anchor, raw = _unsix(packed), zlib.decompress(held)
            doc = np.frombuffer(raw, np.int64, len(anchor))
            if answered:
                yield answer(doc, anchor)
            else:
                anchors.append(anchor)
                docs.append(np.cumsum(doc))
                told.append(np.frombuffer(raw, bool, len(anchor), 8 * len(anchor)))
        if anchors:
            anchor, doc, known = np.concatenate(anchors), np.concatenate(docs), np.concatenate(told)
            order = np.argsort(anchor, kind="stable")
            anchor = anchor[order]
            counts = np.diff(runs(anchor))
            want = np.repeat(counts > 1, counts) & ~known[order]
            yield answer(doc[order][want], anchor[want])


UNIT_SCHEMA = "bucket long, texts binary, lengths binary, holders binary, docs binary, at binary"


def _send_units(n_buckets: int, block_bytes: int):
    """The units of repeating anchors by bucket; equal units of a block are sent once, with all their places."""

    def flush(found: dict[int, dict[bytes, list]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for bucket, by_text in found.items():
            places = list(by_text.values())
            rows.append((
                bucket, zlib.compress(b"".join(by_text), 1), np.array([len(t) for t in by_text], "<u4").tobytes(), np.array([len(p) // 2 for p in places], "<u4").tobytes(),
                np.array([d for p in places for d in p[::2]], "<i8").tobytes(), np.array([a for p in places for a in p[1::2]], "<i8").tobytes(),
            ))
        kinds = [pa.int64()] + [pa.binary()] * 5
        names = [x.split()[0] for x in UNIT_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, dict[bytes, list]] = {}
        size = 0
        for data, starts, ends, ids, offsets, more in buffers(batches):
            piece, first, count, anchor = units(data, starts, ends)
            keep = np.zeros(len(piece), bool)
            edges = np.searchsorted(piece, np.arange(len(ids) + 1))
            for k, (repeating,) in enumerate(more):
                a, b = edges[k], edges[k + 1]
                keep[a:b] = np.isin(anchor[a:b], np.asarray(repeating.values).astype(np.uint64))
            piece, first, count, anchor = piece[keep], first[keep], count[keep], anchor[keep]
            raw = data.tobytes()
            bucket = (anchor % np.uint64(n_buckets)).astype(np.int64).tolist()
            doc, at = ids[piece].tolist(), (offsets[piece] + first - starts[piece]).tolist()
            for k, d, p, s, e in zip(bucket, doc, at, first.tolist(), (first + count + SPAN - 1).tolist(), strict=True):
                texts = found.get(k)
                if texts is None:
                    texts = found[k] = {}
                text = raw[s:e]
                places = texts.get(text)
                if places is None:
                    texts[text] = [d, p]
                    size += e - s
                else:
                    places += (d, p)
                size += 16
            if size >= block_bytes:
                yield from flush(found)
                found, size = {}, 0
        if found:
            yield from flush(found)

    return run


class SuffixBucket:
    """The suffixes of one bucket's units, in the order of their first ``SPAN`` bytes."""

    def __init__(self, text: bytes, starts: np.ndarray):
        self.raw = text + b"\0" * (2 * SPAN + PERIOD + 8)
        self.words = np.ndarray(len(self.raw) - 7, ">u8", self.raw, 0, (1,))
        self.text_length = len(text)
        self.starts = starts

    def refine(self, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions ordered by their first ``8 * words`` bytes, and the starts of the runs of ties.

        Word by word; only positions that are still tied are sorted again.
        """
        first = self.words[at].astype(np.uint64)
        order = np.argsort(first, kind="stable")
        at, first = at[order], first[order]
        new = np.ones(len(at), bool)
        new[1:] = first[1:] != first[:-1]
        for w in range(1, words):
            alone = new & np.append(new[1:], True)
            tied = np.flatnonzero(~alone)
            if not len(tied):
                break
            group = np.cumsum(new)[tied]
            key = self.words[at[tied] + 8 * w].astype(np.uint64)
            order = np.lexsort((key, group))
            at[tied] = at[tied][order]
            key = key[order]
            split = np.ones(len(tied), bool)
            split[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
            new[tied] |= split
        return at, new

    def cover_ranks(self) -> np.ndarray:
        """Ranks of the cover's positions by more than ``SPAN`` bytes; equal strings have equal ranks."""
        sample = np.flatnonzero(np.isin(np.arange(self.text_length + PERIOD) % PERIOD, COVER))
        at, new = self.refine(sample, SPAN // 8 + 1)
        ranks = np.full(self.text_length + PERIOD, -1, np.int64)
        ranks[at] = np.cumsum(new)
        return ranks

    def order(self) -> np.ndarray:
        """All suffixes in order: by a prefix, then ties by three-way partition with the cover's ranks."""
        at, new = self.refine(self.starts.copy(), PREFIX_WORDS)
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            return at
        ranks = self.cover_ranks()
        group = np.cumsum(new)[tied]
        while len(tied):
            edges = runs(group)
            sizes = np.diff(edges)
            own, pivot = at[tied], np.repeat(at[tied[edges[:-1]]], sizes)
            offset = OFFSETS[own % PERIOD, pivot % PERIOD]
            side = np.sign(ranks[own + offset] - ranks[pivot + offset])
            order = np.lexsort((side, group))
            at[tied] = own[order]
            part = group * 3 + side[order]
            edges = runs(part)
            sizes = np.diff(edges)
            unsettled = np.repeat(sizes > 1, sizes) & (side[order] != 0)
            tied, part = tied[unsettled], part[unsettled]
            group = np.cumsum(np.concatenate(([1], part[1:] != part[:-1]))) if len(part) else part
        return at

    def equal_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The ordered suffixes and the number of the string of ``SPAN`` bytes that each begins with."""
        at = self.order()
        same = np.ones(max(0, len(at) - 1), bool)
        for w in [*range(0, SPAN - 7, 8), SPAN - 8]:
            same &= self.words[at[1:] + w] == self.words[at[:-1] + w]
        return at, np.concatenate(([0], np.cumsum(~same)))


SPAN_SCHEMA = "doc_id long, span long"
_LONG = 1 << 31


def _pack(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    return at * _LONG + length


def _spans_of_bucket(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Documents and packed byte runs that go, for one suffix bucket."""
    known: dict[bytes, int] = {}
    holder, doc, at = [], [], []
    for _, texts, lengths, holders, docs, places in rows:
        ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
        texts, own, s = zlib.decompress(texts), [], 0
        for e in ends:
            own.append(known.setdefault(texts[s:e], len(known)))
            s = e
        holder.append(np.repeat(np.array(own, np.int64), np.frombuffer(holders, "<u4")))
        doc.append(np.frombuffer(docs, "<i8"))
        at.append(np.frombuffer(places, "<i8"))
    holder, doc, at = np.concatenate(holder), np.concatenate(doc), np.concatenate(at)
    lengths = np.array([len(t) for t in known], np.int64)
    least = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(least, holder, doc)

    # suffixes: every position of a unit where SPAN bytes begin
    counts = lengths - SPAN + 1
    unit = np.repeat(np.arange(len(known)), counts)
    begin = np.cumsum(lengths) - lengths
    within = np.arange(len(unit)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = begin[unit] + within
    bucket = SuffixBucket(b"".join(known), starts)
    ordered, string = bucket.equal_runs()
    unit_at = np.repeat(np.arange(len(known)), lengths)
    smallest = np.full(int(string[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, string, least[unit_at[ordered]])
    goes = np.zeros(len(unit_at), bool)
    goes[ordered] = smallest[string] < least[unit_at[ordered]]
    goes = goes[starts]

    # in a unit's smallest document only the strings of still smaller ones go; elsewhere the whole unit does
    rest = doc > least[holder]
    out_doc, out_span = [doc[rest]], [_pack(at[rest], lengths[holder[rest]])]
    head = goes & ~(np.append(False, goes[:-1]) & (within > 0))
    tail = goes & ~(np.append(goes[1:], False) & np.append(within[1:] > 0, False))
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    if len(first):
        own = unit[first]
        keeps = np.flatnonzero(~rest)
        keeps = keeps[np.argsort(holder[keeps], kind="stable")]
        lo, hi = np.searchsorted(holder[keeps], own), np.searchsorted(holder[keeps], own, "right")
        times = hi - lo
        pick = keeps[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        out_doc.append(doc[pick])
        out_span.append(_pack(at[pick] + np.repeat(within[first], times), np.repeat(last - first + SPAN, times)))
    return np.concatenate(out_doc), np.concatenate(out_span)


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by_bucket(batches):
        doc, span = _spans_of_bucket(rows)
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(span)], ["doc_id", "span"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        sizes, kept, removed = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            data = (text.as_py() or "").encode()
            own: list[dict] = []
            if spans.is_valid and len(packed := np.array(spans.values)):
                edge = np.zeros(len(data) + 1, np.int32)
                np.add.at(edge, packed // _LONG, 1)
                np.add.at(edge, packed // _LONG + packed % _LONG, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                own = [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]
                size, data = len(data), np.frombuffer(data, np.uint8)[~gone].tobytes()
            else:
                size = len(data)
            sizes.append(size)
            kept.append(data)
            removed.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"]
        )


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, suffix_bucket_bytes: int = SUFFIX_BUCKET_BYTES) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (runs of bytes) and ``kept`` (the other bytes) of each row."""
    small_batches(docs.sparkSession)
    # an id that is never null keeps a filter out of the first join, so that both joins share one exchange of the texts
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_anchor, n_suffix = max(least, total // ANCHOR_BUCKET_BYTES), max(least, total // suffix_bucket_bytes)
    sent = docs.mapInArrow(_send_anchors(n_anchor, block_bytes), ANCHOR_SCHEMA)
    answers = sent.repartition(n_anchor, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer_anchors, ANSWER_SCHEMA)
    # partitions of texts follow the bytes, not the session's count
    keyed = docs.repartition(max(least, total // TEXT_BYTES), "doc_id")
    asked = keyed.join(answers.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")), "doc_id")
    found = asked.mapInArrow(_send_units(n_suffix, block_bytes // 4), UNIT_SCHEMA)
    spans = found.repartition(n_suffix, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets, SPAN_SCHEMA)
    gone = spans.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))
    schema = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary"
    out = keyed.join(gone, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_remove, schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
