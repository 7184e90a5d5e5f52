"""Removal of repeated multi-line passages by content-defined chunks of lines.

A text is a sequence of lines.  A window rolls over the hashes of its lines, two at a time;
lines without a letter or a digit take no place in the window, they belong to the passage
that they stand in.  Windows that occur more than once in the table mark passages: a
boundary lies where repeated windows begin or end, which depends on nothing around the
passage, so whatever two texts share in two lines or more is found whole, to its ends, wherever it
stands.  Single lines are not judged.

Of each repeated window the first occurrence (by document id and place) stays whole, line by line:
its lines are removed as part of no other window.  The lines of later occurrences go, after their
bytes have been compared with those of the first, unless they stay as part of some first one.  So every
repeated passage of two lines still stands in the output, and a later occurrence loses at least
one of its lines, but where both are part of first occurrences.

Only hashes of windows are grouped; the bytes of a first occurrence travel to the
documents that would lose a copy and are compared there.

Defined results: a null text stays null; a text without repeats stays as it is, to
the byte; rows that repeat an id, or have none, count as one document; windows whose hashes agree but
not their bytes stay; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, small_batches

LEAST_LINES = 2
#: In UTF-8: ASCII letters and digits, and anything beyond ASCII.
WORDED = re.compile(rb"[0-9A-Za-z\x80-\xff]")


def chunks(text: str) -> list[tuple[int, int, int, bytes]]:
    """Start, end (exclusive) and lines of the window at each line of the text's bytes, with a hash of its lines' hashes."""
    begun, digests, out, at = [], [], [], 0
    for number, line in enumerate(text.encode().split(b"\n")):
        digests.append(xxhash.xxh128_digest(line))
        if WORDED.search(line):
            begun.append((at, number))
            if len(begun) >= LEAST_LINES:
                start, first = begun[-LEAST_LINES]
                out.append((start, at + len(line), number + 1 - first, xxhash.xxh128_digest(b"".join(digests[first:]))))
        at += len(line) + 1
    return out


def without(text: str, later: list[tuple[int, int]], first: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the lines of the ``later`` spans that no ``first`` span has; how many of these spans lost a line, and the lines."""
    lines, at, starts = text.encode().split(b"\n"), 0, []
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    marks = [0] * (len(lines) + 1)  # by line: +1 where a first span begins, -1 after it
    within = lambda span: (bisect_left(starts, span[0]), bisect_left(starts, span[1]))
    for span in first:
        a, b = within(span)
        marks[a] += 1
        marks[b] -= 1
    kept = [n > 0 for n in accumulate(marks[:-1])]
    gone, chunks_gone = set(), 0
    for span in later:
        own = [i for i in range(*within(span)) if not kept[i]]
        chunks_gone += bool(own)
        gone.update(own)
    return b"\n".join(line for i, line in enumerate(lines) if i not in gone).decode(), chunks_gone, len(gone)


CHUNK_SCHEMA = "doc_id long, start int, end int, lines int, hash binary"


def index(docs: DataFrame) -> DataFrame:
    """A row for each multi-line chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            rows = [(d, *c) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if t.is_valid for c in chunks(t.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "start", "end", "lines", "hash"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, CHUNK_SCHEMA)


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of chunks: wanted has doc_id, start, end and hash."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, found = [], []
            for text, parts in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                for p in parts:
                    hashes.append(p["hash"])
                    found.append(data[p["start"] : p["end"]])
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(found, pa.binary())], ["hash", "bytes"])

    own = wanted.groupBy(F.col("doc_id").alias("__line_id")).agg(F.collect_list(F.struct("start", "end", "hash")).alias("__line_parts"))
    # all columns, so that this join and the last one read one exchange of the documents
    rows = docs.join(own.hint("merge"), "__line_id").select(*docs.columns, "__line_parts")
    # an id that several rows share may give the bytes more than once
    return rows.mapInArrow(run, "hash binary, bytes binary").groupBy("hash").agg(F.min("bytes").alias("bytes"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the text without its repeated chunks; adds removed_chunks and removed_lines."""
    small_batches(docs.sparkSession)
    names = ["removed_chunks", "removed_lines"]
    docs = docs.drop(*names)
    columns = docs.columns
    docs = docs.withColumn("__line_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    found = cut(index(docs.select(F.col("__line_id").alias("doc_id"), "text")), "line-chunks")
    place = F.struct("doc_id", "start", "end")
    first = found.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    first = cut(first, "line-chunks-first")
    copies = found.join(first, "hash").where(place != F.col("first"))
    kept = _texts(first.select("first.*", "hash"), docs)
    # a document's later occurrences with the bytes to compare, and its first ones, which stay
    spans = copies.join(kept, "hash").select("doc_id", "start", "end", "bytes").unionByName(first.select("first.doc_id", "first.start", "first.end", F.lit(None).cast("binary").alias("bytes")))
    gone = spans.groupBy(F.col("doc_id").alias("__line_id")).agg(F.collect_list(F.struct("start", "end", "bytes")).alias("__line_gone"))
    at, n = columns.index("text"), len(columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:n]] + [f"{x} int" for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_chunks, n_lines = [], [], []
            for text, parts in zip(batch.column(at), batch.column(n).to_pylist(), strict=True):
                data, removed, lines = text.as_py(), 0, 0
                if parts and data:
                    raw = data.encode()
                    later = [(p["start"], p["end"]) for p in parts if p["bytes"] is not None and raw[p["start"] : p["end"]] == p["bytes"]]
                    if later:
                        data, removed, lines = without(data, later, [(p["start"], p["end"]) for p in parts if p["bytes"] is None])
                texts.append(data)
                n_chunks.append(removed)
                n_lines.append(lines)
            columns = list(batch.columns[:n])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_chunks, pa.int32()), pa.array(n_lines, pa.int32())], [*batch.schema.names[:n], *names])

    return docs.join(gone.hint("merge"), "__line_id", "left").select(*columns, "__line_gone").mapInArrow(run, schema)
