import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from routeloom.llm.iblt import BREAK, EVERY, LONG, SIGNS, WORDS, as_text, difference, digests, digests_of, fingerprint_edits, likeness_of, with_next

from .corpus import frame, rows


def ordered(data):
    """By id and hash of the text; a null id comes first."""
    return sorted(((r[0], r[1] or "") for r in data), key=lambda x: (x[0] is not None, x[0] or 0, xxhash.xxh64(x[1].encode(), 42).intdigest() ^ 1 << 63))


def test_next_text(spark):
    data = rows() + [(None, t, None, None, None, None, None) for t in ("b", "a", "a", None, "c")]
    want = ordered(data)
    want = sorted((str(d), t, n[: len(t) // 2]) for (d, t), (_, n) in zip(want, want[1:] + want[:1]))
    for part_rows, part_chars in ((500_000, 1 << 24), (7, 1000)):
        got = with_next(frame(spark, data), part_rows, part_chars).collect()
        assert sorted((str(r.doc_id), r.text, r.next_half) for r in got) == want


def test_edits(spark):
    want = ordered(rows())
    following = {}
    for (d, t), (_, n) in zip(want, want[1:] + want[:1]):
        half = len(t) // 2
        following.setdefault(d, []).append((len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    got = fingerprint_edits(frame(spark)).collect()
    assert len(got) == len(want)
    by_text = {}
    texts = dict(want)
    for r in got:
        assert (r.n_chars, r.edited_sha256) in following[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1


def test_recovered_differences(spark):
    rng = random.Random(2)
    data = []
    for n in (0, 1, 3, 8, 20, 60, 150, 400):
        both = [rng.getrandbits(63) for _ in range(10)]
        data.append((both + [rng.getrandbits(63) for _ in range(n)], both + [rng.getrandbits(63) for _ in range(n // 2)]))
    df = spark.createDataFrame(data, "a array<long>, b array<long>").select("a", "b", F.expr(difference("a", "b")).alias("d"))
    for r in df.collect():
        assert sorted(x.k for x in r.d if x.n == 1) == sorted(set(r.a) - set(r.b))
        assert sorted(x.k for x in r.d if x.n == -1) == sorted(set(r.b) - set(r.a))


def test_single_row_and_empty_table(spark):
    one = fingerprint_edits(frame(spark, [(5, "A b. C d.", None, None, None, None, None)])).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fingerprint_edits(frame(spark, [])).collect() == []


def plain_paragraphs(text):
    """The paragraphs of a text and how often each occurs."""
    h = lambda s: xxhash.xxh64(s.encode(), 42).intdigest()
    out = ""
    for clause in re.split(f"(?<=[{SIGNS}])", text):
        java = "[ \\t\\n\\x0b\\f\\r]"
        parts = re.findall(f"[^ \\t\\n\\x0b\\f\\r]{{1,16}}{java}*|{java}+", clause) if len(clause) > LONG else [clause]
        for p in parts:
            out += p + (BREAK if h(p) % (WORDS if len(clause) > LONG else EVERY) == 0 else "")
    return Counter(x for x in out.split(BREAK) if x)


def test_likeness_against_plain_sets(spark):
    rng = random.Random(4)
    unsigned = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(2000))
    data = rows() + [(499, unsigned, None, None, None, None, None), (500, "no signs at all " * 300 + "line. " * 41, None, None, None, None, None), (501, "漢字。仮名、" * 40 + "終", None, None, None, None, None), (502, "x" * 5000, None, None, None, None, None)]
    got = fingerprint_edits(frame(spark, data)).collect()
    texts, sets = ordered(data), {}
    expect = []
    for (d, t), (_, n) in zip(texts, texts[1:] + texts[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = ({(p, m) for p, k in plain_paragraphs(x).items() for m in [*(1 << e for e in range(k.bit_length())), k]} for x in (t, edited, n))
        like = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        expect.append((d, len(t), round(like(a, b), 9), round(like(a, c), 9)))
        sets[d] = a
    assert sorted((r.doc_id, r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(expect)
    assert next(r for r in got if r.doc_id == 499).near_edited > 0.25


def test_repeats_count(spark):
    df = spark.createDataFrame([("a. b. c. ",), ("a. b. b. c. ",), ("a. b. c. ",)], "t string").select(F.expr(digests("t")).alias("k"))
    one, twice, again = [sorted(r.k) for r in df.collect()]
    assert one == again != twice


def plain_digests(fingerprint):
    """The digests of a stored fingerprint, peeled in plain Python from its cells alone."""
    out = set()
    for block in filter(None, fingerprint.split("/")):
        size, *cells = block.split(":")[1].split(" ")
        if size == "0":
            out |= {int(c, 16) for c in cells}
            continue
        cells = {int(c.split(".")[0]): [int(c.split(".")[1]), *(int(x, 16) for x in c.split(".")[2:])] for c in cells}
        third = int(size) // 3

        def h(k, n):
            """The hash of a number and a small one after it."""
            return xxhash.xxh64(n.to_bytes(4, "little"), xxhash.xxh64(k.to_bytes(8, "little"), 42).intdigest()).intdigest()

        while pure := [c[1] for c in cells.values() if c[0] == 1 and c[2] == h(c[1], 3)]:
            k = pure[0]
            out.add(k)
            for t in range(3):
                x = h(k, t)
                c = cells[t * third + ((x - (1 << 64) if x >> 63 else x) % third)]
                c[0], c[1], c[2] = c[0] - 1, c[1] ^ k, c[2] ^ h(k, 3)
        assert all(c == [0, 0, 0] for c in cells.values())
    return out


def test_likeness_from_the_two_strings_alone(spark):
    data = [r for r in rows() if r[0] is not None]
    data = list({r[0]: r for r in data}.values()) + [(900 + i, " ".join(f"w{i % 3}{j}." for j in range(40 * i)), None, None, None, None, None) for i in range(12)]
    got = sorted(fingerprint_edits(frame(spark, data)).collect(), key=lambda r: r.doc_id)
    like = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
    for r, following in zip(got, got[1:] + got[:1]):
        own = plain_digests(r.fingerprint)
        assert abs(r.near_edited - like(own, plain_digests(r.edited_fingerprint))) < 1e-12
        assert abs(r.near_next - like(own, plain_digests(following.fingerprint))) < 1e-12
    stored = spark.createDataFrame([(r.fingerprint, r.edited_fingerprint, r.near_edited) for r in got], "a string, b string, want double")
    assert all(abs(r.likeness - r.want) < 1e-12 for r in likeness_of(stored, "a", "b").collect())


def test_fingerprints_give_their_digests_back(spark):
    rng = random.Random(7)
    sets = [sorted(rng.getrandbits(64) - (1 << 63) for _ in range(n)) for n in (0, 1, 2, 7, 8, 9, 30, 100, 1000, 3000)]
    # one block for all: bits 20 and up are the same, so the larger sketches and at last the plain digests serve
    sets += [sorted((rng.getrandbits(20) for _ in range(n))) for n in (12, 40, 120, 700)]
    sets = [sorted(set(s)) for s in sets]
    df = spark.createDataFrame([(s,) for s in sets], "k array<long>").withColumn("f", F.expr(as_text("k")))
    for r in df.select("k", "f", F.expr(digests_of("f")).alias("d")).collect():
        assert sorted(r.d) == r.k
        assert plain_digests(r.f) == {k % (1 << 64) for k in r.k}
