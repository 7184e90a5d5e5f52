import zlib
from collections import defaultdict

import numpy as np
import pytest

from routeloom.llm.packing import pack_documents
from routeloom.llm.queries import tokenizer_path

from .corpus import frame, rows


def token_ids(text):
    from tokenizers import Tokenizer

    global _T
    try:
        _T
    except NameError:
        _T = Tokenizer.from_file(tokenizer_path())
    return _T.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_every_id_in_exactly_one_piece_and_windows_are_full(spark, block):
    data = [r for r in rows() if r is not None]
    data = list({r[0]: r for r in data}.values())
    out = pack_documents(frame(spark, data), tokenizer_path(), block_tokens=block).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for row in data:
        ids = token_ids(row[1])
        at = 0
        for p in sorted(pieces[row[0]], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0
        assert at == own[0].tier or at < 2048


def test_step_groups_hold_equal_tokens(spark):
    data = [(i, "word " * (50 + 37 * i), None, None, None, None, None) for i in range(120)]
    out = pack_documents(frame(spark, data, 1), tokenizer_path(), step_tokens=4096).collect()
    by_group, tiers = defaultdict(int), {}
    for r in out:
        by_group[r.step_group] += r.length
        tiers[r.step_group] = r.tier
    full = [n for g, n in by_group.items() if tiers[g] == 2048]
    assert max(full) - min(full) <= 2048 and max(full) <= 4096


def test_empty_table_and_repeats(spark):
    assert pack_documents(frame(spark, []), tokenizer_path()).collect() == []
    twice = [(1, "same text", None, None, None, None, None)] * 2
    assert sum(r.length for r in pack_documents(frame(spark, twice), tokenizer_path()).collect()) == 2 * len(token_ids("same text"))


def test_ids_of_every_code_point_before_signs():
    import unicodedata

    from tokenizers import Tokenizer

    from routeloom.llm.packing import word_ids

    token_ids("")
    words = word_ids(tokenizer_path())
    assert words.by_words
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for form in ("{}.", "{},", "a{}. B{}, {}a."):
        texts = [form.replace("{}", c) for c in points]
        for at in range(0, len(texts), 20_000):
            some = texts[at : at + 20_000]
            for text, want in zip(some, _T.encode_batch(some, add_special_tokens=False)):
                assert words.text(text) == np.array(want.ids, "<u4").tobytes(), ascii(text)


def test_another_tokenizer_encodes_whole_texts():
    from routeloom.llm.packing import word_ids

    words = word_ids(tokenizer_path("byte_bpe_50k.json"))
    for text in ("Hello  World. É,\n x", "", "One two  three"):
        assert not words.by_words and words.text(text) == np.array(words.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
