import random

import numpy as np
import pytest

from routeloom.llm.suffixes import COVER, OFFSETS, PERIOD, SPAN, SuffixBucket, remove_repeats

from .corpus import frame, rows


def brute(texts: dict[int, bytes]) -> dict[int, tuple[int, list, bytes]]:
    first: dict[bytes, int] = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - SPAN + 1):
            first.setdefault(texts[d][i : i + SPAN], d)
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - SPAN + 1):
            if first[t[i : i + SPAN]] < d:
                gone[i : i + SPAN] = b"\1" * SPAN
        edges = [i for i in range(len(t) + 1) if (i < len(t) and gone[i]) != (i > 0 and gone[i - 1])]
        out[d] = (len(t), list(zip(edges[::2], edges[1::2])), bytes(c for c, g in zip(t, gone) if not g))
    return out


def check(spark, data, **more):
    got = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.removed], bytes(r.kept)) for r in remove_repeats(frame(spark, data), **more).collect()}
    assert got == brute({r[0]: (r[1] or "").encode() for r in data})


def test_cover():
    for a in range(PERIOD):
        for b in range(PERIOD):
            d = OFFSETS[a, b]
            assert d < PERIOD and (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER


@pytest.mark.parametrize("seed", range(4))
def test_bucket_order(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab") for _ in range(300)) * 4 + b"a" * 200 + bytes(rng.choice(b"xyz") for _ in range(200))
    starts = np.arange(len(text) - SPAN + 1)
    at, string = SuffixBucket(text, starts).equal_runs()
    grams = [text[i : i + SPAN] for i in at]
    assert grams == sorted(grams) and sorted(at.tolist()) == starts.tolist()
    assert [a == b for a, b in zip(grams, grams[1:])] == [a == b for a, b in zip(string, string[1:])]


@pytest.mark.parametrize("block", [1 << 10, 1 << 25])
def test_awkward_documents(spark, block):
    check(spark, list({r[0]: r for r in rows()}.values()), block_bytes=block)


def test_shared_passages_with_edits(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    data = []
    for i in range(40):
        a = rng.randrange(1400)
        b = min(1500, a + rng.randint(30, 700))
        text = "".join(rng.choice("xyzé") for _ in range(rng.randint(0, 90))) + passage[a:b] + "z" * rng.choice([0, 49, 50, 51, 130])
        if rng.random() < 0.5:
            k = rng.randrange(len(text))
            text = text[:k] + "!" + text[k + 1 :]
        data.append((100 - i, text, None, None, None, None, None))
    check(spark, data, suffix_bucket_bytes=2000)


def test_small_alphabet(spark):
    rng = random.Random(6)
    check(spark, [(i, "".join(rng.choice("ab") * rng.randint(1, 60) for _ in range(12)), None, None, None, None, None) for i in range(25)])


def test_empty(spark):
    assert remove_repeats(frame(spark, [])).collect() == []
