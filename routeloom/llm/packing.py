"""Hierarchical multi-length packing of documents into training sequences.

Every document becomes token ids followed by one end id.  Whole windows of the
longest tier are cut off first; what remains of a document is routed to the
smallest context tier that holds it.  The tiers are packed from the longest to
the shortest: each window is opened by a document of its own tier and its gap is
filled best-fit with whole remainders of shorter tiers, and at last with a cut
piece, so that windows are full.  The sequences of each tier are dealt to step
groups of equal token counts whose attention cost (sum of squared piece lengths)
is levelled.

Work is local to an input partition and goes block by block, so memory is bounded
by the block size (and by one document), nothing is shuffled, and a task that is
run again gives the same rows.

Defined results: a null text is empty (one end id); repeated rows are packed once
each; an empty table gives no rows; other columns are ignored; a null ``doc_id``
is carried through; a tokenizer that prepares texts in another way than by words
encodes them whole.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches

TIERS = (256, 512, 1024, 2048)
END_ID = 1
STEP_TOKENS = 1 << 16
BLOCK_TOKENS = 1 << 20
CACHE_WORDS = 200_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, tier int, step_group long"
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


#: How a tokenizer's file must prepare texts so that their words can be looked up one by one.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(tokenizer) -> bool:
    """Whether a tokenizer lower-cases, drops white space and never merges across it."""
    spec = json.loads(tokenizer.to_str())
    marks = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
    return marks and spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER


def latin_letters(word: str) -> bool:
    """Letters that stay single letters when composed and lower-cased."""
    with suppress(UnicodeEncodeError):
        word.encode("latin-1")
        return word.isalpha()
    return False


class WordIds(dict):
    """Bytes of the ids of a word, by word; holds two generations of bounded size.

    If the tokenizer drops white space and never merges across it, the ids of a text
    are those of its words in turn; the texts of any other tokenizer are encoded whole.
    A word of lower-case Latin letters passes normalisation unchanged and is one piece,
    so the vocabulary's model takes it.
    """

    def __init__(self, tokenizer, limit: int = CACHE_WORDS):
        super().__init__()
        self.tokenizer, self.limit, self.old = tokenizer, limit, {}
        self.letters, self.pieces, self.by_words = byte_letters(), tokenizer.model.tokenize, by_words(tokenizer)

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode_word(self, word: str) -> bytes:
        if word.isalpha() and word.islower() and word.isprintable():
            if not word.isascii():
                try:
                    word.encode("latin-1")
                except UnicodeEncodeError:
                    return self.encode(word)
                word = "".join(map(self.letters.__getitem__, word.encode()))
            return b"".join([t.id.to_bytes(4, "little") for t in self.pieces(word)])
        return self.encode(word)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            # a full stop or comma after such letters is a token of its own; others may end in a mark that takes the sign along
            ids = self[word[:-1]] + self[word[-1]] if word[-1] in ".," and latin_letters(word[:-1]) else self.encode_word(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def text(self, text: str) -> bytes:
        # str.split also splits at these four, which the tokenizer keeps; and its special tokens may hold white space
        if not self.by_words or "<|" in text or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.encode(text)
        with suppress(UnicodeEncodeError):  # elsewhere lower-casing may depend on the place or the Unicode version
            text.encode("latin-1")
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One cache for each Python worker and tokenizer file."""
    if path not in _WORDS:
        from tokenizers import Tokenizer

        _WORDS[path] = WordIds(Tokenizer.from_file(path))
    return _WORDS[path]


class Packer:
    """Packs the documents of one partition; ``rows`` holds the pieces that are final."""

    def __init__(self, tiers: tuple[int, ...], base: int, step_tokens: int):
        self.tiers, self.base, self.step_tokens = tuple(sorted(tiers)), base, step_tokens
        self.longest = self.tiers[-1]
        self.queues: dict[int, list] = {t: [] for t in self.tiers}
        self.sequences: list[tuple[int, list]] = []
        self.tail: list = []
        self.next_sequence = self.next_group = self.serial = self.tokens = 0

    def add(self, doc, ids: bytes) -> None:
        n = len(ids) // 4
        at = 0
        while n - at >= self.longest:
            self.sequences.append((self.longest, [(doc, ids, at, self.longest, n)]))
            at += self.longest
        if at < n:
            self.route((doc, ids, at, n - at, n))
        self.tokens += n

    def route(self, piece) -> None:
        self.serial += 1
        tier = self.tiers[bisect_left(self.tiers, piece[3])]
        insort(self.queues[tier], (piece[3], self.serial, piece))

    def best_fit(self, gap: int):
        """The longest waiting piece of at most ``gap`` ids."""
        for tier in reversed(self.tiers):
            queue = self.queues[tier]
            if queue and queue[0][0] <= gap:
                return queue.pop(bisect_left(queue, (gap + 1,)) - 1)[2]
        return None

    def cut_piece(self, gap: int):
        """``gap`` ids off the shortest waiting piece."""
        for tier in self.tiers:
            if self.queues[tier]:
                doc, ids, at, length, n = self.queues[tier].pop(0)[2]
                self.route((doc, ids, at + gap, length - gap, n))
                return doc, ids, at, gap, n
        return None

    def pack(self) -> None:
        """Pack what waits; only the last window may stay open, as ``tail``."""
        for piece in self.tail:
            self.route(piece)
        self.tail = []
        for tier in reversed(self.tiers):
            queue = self.queues[tier]
            while queue:
                window = [queue.pop()[2]]
                gap = tier - window[0][3]
                while gap:
                    piece = self.best_fit(gap) or self.cut_piece(gap)
                    if piece is None:
                        break
                    window.append(piece)
                    gap -= piece[3]
                if gap:
                    self.tail = window
                else:
                    self.sequences.append((tier, window))
        self.tokens = 0

    def finish(self) -> None:
        """Cut the open window at powers of two, so that nothing is padded."""
        left = sum(p[3] for p in self.tail)
        pieces = self.tail[::-1]
        self.tail = []
        while left:
            size = 1 << (left.bit_length() - 1)
            window, room = [], size
            while room:
                doc, ids, at, length, n = pieces.pop()
                if length > room:
                    pieces.append((doc, ids, at + room, length - room, n))
                    length = room
                window.append((doc, ids, at, length, n))
                room -= length
            self.sequences.append((size, window))
            left -= size

    def groups(self) -> list[int]:
        """A step group for each waiting sequence: equal tokens, level attention cost."""
        by_tier: dict[int, list[int]] = {}
        for k, (tier, _) in enumerate(self.sequences):
            by_tier.setdefault(tier, []).append(k)
        out = [0] * len(self.sequences)
        for tier in sorted(by_tier):
            members = sorted(by_tier[tier], key=lambda k: -sum(p[3] ** 2 for p in self.sequences[k][1]))
            n = -(-len(members) * tier // self.step_tokens)
            for i, k in enumerate(members):
                turn, place = divmod(i, n)
                out[k] = self.next_group + (n - 1 - place if turn % 2 else place)
            self.next_group += n
        return out

    def flush(self) -> pa.RecordBatch | None:
        rows: list[tuple] = []
        for (tier, window), group in zip(self.sequences, self.groups(), strict=True):
            offset = 0
            for doc, ids, at, length, n in window:
                crc = zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)])
                rows.append((doc, at, length, crc, n, self.base + self.next_sequence, offset, tier, self.base + group))
                offset += length
            self.next_sequence += 1
        self.sequences = []
        if not rows:
            return None
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    step_tokens: int = STEP_TOKENS,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """One row for each piece; see the module's text for the method."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        packer = Packer(tiers, TaskContext.get().partitionId() << 32, step_tokens)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc, words.text(text.as_py() or "") + end)
                if packer.tokens >= block_tokens:
                    packer.pack()
                    if (out := packer.flush()) is not None:
                        yield out
        packer.pack()
        packer.finish()
        if (out := packer.flush()) is not None:
            yield out

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
