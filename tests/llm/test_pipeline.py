import zlib

import numpy as np

import corpus_pipeline
from routeloom.llm import nearcopies
from routeloom.llm.common import cut

from .corpus import frame, rows
from .test_packing import token_ids


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_near_copies_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words, 400)) for _ in range(12)]
    data, copies = [], []
    for i, b in enumerate(base):
        for k in range(5):
            parts = b.split()
            for _ in range(k):
                parts[rng.integers(400)] = "new"
            data.append((100 * k + i, " ".join(parts), "en", "s", 1, "x", 2))
    data += [(900, None, None, None, None, None, None), (901, "", None, None, None, None, None), (902, data[0][1], None, None, None, None, None)]
    got = {r.doc_id: r.group_id for r in nearcopies.groups(frame(spark, data)).collect()}
    sets = {r[0]: shingles(r[1]) for r in data}
    for a in sets:
        for b in sets:
            j = jaccard(sets[a], sets[b])
            if j >= 0.8:
                assert got[a] == got[b], (a, b, j)
            if j < 0.3 and not (a >= 900 and b >= 900):
                assert got[a] != got[b], (a, b, j)
    assert got[901] == 900 and got[902] == 0
    kept = nearcopies.keep_one(frame(spark, data))
    assert kept.columns == frame(spark, data).columns
    assert {r.doc_id for r in kept.collect()} == {d for d, g in got.items() if d == g}


def test_long_copies_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    data, wanted = [], {}
    for i in range(16):
        base = [f"{i}_{k}" for k in range(3004)]
        # of 3000 shingles the last ones are replaced: 3000 - k shared of 3000 + k
        k = int(3000 * 0.195 / 1.805) if i % 2 else int(3000 * 0.21 / 1.79)
        other = base[: 3004 - k] + [f"x{x}" for x in rng.integers(0, 1 << 40, k)]
        data += [(2 * i, " ".join(base), None, None, None, None, None), (2 * i + 1, " ".join(other), None, None, None, None, None)]
        a, b = shingles(data[-2][1]), shingles(data[-1][1])
        assert (jaccard(a, b) >= 0.8) == bool(i % 2) and 0.78 < jaccard(a, b) < 0.82
        wanted |= {2 * i: 2 * i, 2 * i + 1: 2 * i if i % 2 else 2 * i + 1}
    assert {r.doc_id: r.group_id for r in nearcopies.groups(frame(spark, data)).collect()} == wanted


def test_repeated_lines_and_few_shingles(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(3000)]
    data, wanted = [], {}
    for i in range(120):
        if i % 2:
            base = list(rng.choice(words, 9))  # 5 shingles against 4
            other = base[:8]
        else:
            base = list(rng.choice(words, 204))
            other = base + base[-14:] * 20
        data += [(2 * i, " ".join(base), None, None, None, None, None), (2 * i + 1, " ".join(other), None, None, None, None, None)]
        assert jaccard(shingles(data[-2][1]), shingles(data[-1][1])) >= 0.8
        wanted |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    assert {r.doc_id: r.group_id for r in nearcopies.groups(frame(spark, data)).collect()} == wanted


def test_one_common_passage_in_all_documents(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    common = " ".join(rng.choice(words, 60))
    data = [(i, common + " " + " ".join(rng.choice(words, 200)), None, None, None, None, None) for i in range(60)]
    assert all(r.doc_id == r.group_id for r in nearcopies.groups(frame(spark, data)).collect())


def test_stages(spark):
    docs = frame(spark, rows()).select("doc_id", "text", "lang", "source", "n_chars")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, ""), "stage")
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
        assert name == "packing" or docs.count() <= before.count()
    assert {r.lang for r in seen["language_id"].collect()} <= {"en", "fr"}
    assert all(r.text is not None for r in seen["language_id"].collect())
    kept = {r.doc_id: r.text for r in seen["mixing"].collect()}
    pieces = {}
    for r in docs.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(kept)
    for d, text in kept.items():
        ids = token_ids(text)
        for start, length, crc in pieces[d]:
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())


def test_run_and_empty(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    docs = frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.collect() == []
