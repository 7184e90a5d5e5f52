import math
import random
import re
from collections import Counter

import pytest

from routeloom.llm.lexical import CHUNK, search, term_counts

from .corpus import frame, rows

TERM = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """(item, rank, doc, score) by scoring every document for every item; docs are (id, text), items (id, text)."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    used = [c for _, c in counted if c]
    n, total = len(used), sum(c.total() for c in used)
    df = Counter(t for c in used for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, c in counted:
            m = 25 + 75 * c.total() * n // max(1, total)
            score = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, x in q.items() if c[t])
            if score:
                found.append((-score, d is None, d or 0))
        out += [(i, r + 1, None if missing else d, -s) for r, (s, missing, d) in enumerate(sorted(found)[:k])]
    return out


def got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def items_of(spark, data):
    return spark.createDataFrame(data, "item_id long, text string")


def test_terms_of_bytes():
    for r in rows():
        text = r[1]
        assert term_counts(None if text is None else text.encode()) == Counter(t.encode() for t in terms(text))
    long = ("Word " * 20 + "x" * 7 + "É9 ") * (CHUNK // 60)
    assert term_counts(long.encode()) == Counter(t.encode() for t in terms(long))
    assert term_counts(b"A" * (CHUNK * 2 + 5)) == {b"a" * (CHUNK * 2 + 5): 1}


@pytest.mark.parametrize(("range_docs", "query_block"), [(4096, 200_000), (7, 40)])
def test_awkward_documents(spark, range_docs, query_block):
    data = [*rows(), (None, rows()[2][1], None, None, None, None, None), (None, "éa Σας", None, None, None, None, None)]
    asked = [(1, rows()[0][1]), (2, "one ONE two abc"), (2, "Σας"), (3, None), (4, "no-such-term-here"), (5, ""), (6, rows()[3][1]), (7, "\x1cZ é tail 123 日本"), (None, rows()[8][1])]
    want = brute([(r[0], r[1]) for r in data], asked, 10)
    assert got(search(frame(spark, data), items_of(spark, asked), range_docs=range_docs, query_block=query_block)) == sorted(want, key=repr)


def test_ties_go_to_the_smaller_id_across_ranges(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(4)) for _ in range(9)]
    data = [(i, rng.choice(texts), None, None, None, None, None) for i in rng.sample(range(10_000), 900)]
    asked = [(j, t) for j, t in enumerate(texts)]
    out = search(frame(spark, data, 3), items_of(spark, asked), range_docs=130)
    assert got(out) == sorted(brute([(r[0], r[1]) for r in data], asked, 10), key=repr)


def test_empty_tables(spark):
    asked = items_of(spark, [(1, "a b")])
    assert search(frame(spark, []), asked).collect() == []
    assert search(frame(spark), items_of(spark, [])).collect() == []


def test_clashing_columns(spark):
    docs = frame(spark)
    for c in ("block", "term", "score", "rank", "q", "n", "df"):
        docs = docs.withColumn(c, docs["lang"])
    asked = items_of(spark, [(1, rows()[0][1])])
    other = asked.withColumn("term", asked["text"]).withColumn("times", asked["text"])
    assert got(search(docs, other)) == got(search(frame(spark), asked))
