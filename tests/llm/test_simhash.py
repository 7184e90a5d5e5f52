import random

import pytest
import xxhash

from routeloom.llm.simhash import BKForest, components, fingerprints, links, near_duplicates, simhash

from .corpus import frame, rows


def brute(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(values, radius):
    """Least index of each value's component, by comparing all pairs."""
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= radius and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_fingerprints(spark):
    data = rows()
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in fingerprints(frame(spark, data)).collect()}
    assert got == {r[0]: brute(r[1]) for r in data}
    assert simhash(None) == simhash(" \n") == 0


def clustered(n, seed=1):
    rng = random.Random(seed)
    values = [0, rng.getrandbits(64)]
    while len(values) < n:
        base = rng.choice(values) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            base ^= 1 << rng.randrange(64)
        values.append(base)
    return list(dict.fromkeys(values))


def test_forest_finds_the_components():
    values = clustered(700)
    tree, parent = BKForest(3), list(range(len(values)))
    for i, v in enumerate(values):
        for j in tree.add(v):
            a, b = sorted((tree.find(i), tree.find(j)))
            parent[b] = a
    got = [tree.find(i) for i in range(len(values))]
    want = groups(values, 3)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


@pytest.mark.parametrize("split_over", [4096, 8])
def test_links_and_components(spark, split_over):
    values = clustered(400, seed=2)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    reps = spark.createDataFrame([(v, i) for i, v in enumerate(signed)], "fp long, rep long")
    found = {r.node: r.component for r in components(links(reps, 3, split_over)).collect()}
    want = groups(values, 3)
    assert [found.get(i, i) for i in range(len(values))] == want


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in components(edges).collect()} == {0}


def test_documents(spark):
    data = rows()
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, data)).collect()}
    ids = sorted({r[0] for r in data})
    texts = {r[0]: r[1] for r in data}
    want = groups([brute(texts[i]) for i in ids], 3)
    assert got == {i: ids[w] for i, w in zip(ids, want)}
    assert near_duplicates(frame(spark, [])).collect() == []


def near_texts(seed):
    """A text and copies of it that differ in a word each."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = [" ".join(base)]
    while len(texts) < 40:
        words = list(base)
        words[rng.randrange(400)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    return texts


def test_rows_without_ids_link_and_take_the_least_id(spark):
    texts = near_texts(1)
    alone = ["lonely text here", "quite another one, of other words entirely"]
    data = [(None if i % 3 else i, t, None, None, None, None, None) for i, t in enumerate(texts)]
    data += [(None, alone[0], None, None, None, None, None), (7001, alone[1], None, None, None, None, None), (7001, alone[1], None, None, None, None, None), (3, texts[3], None, None, None, None, None)]
    values = [brute(r[1]) for r in data]
    classes = groups(values, 3)
    least = {}
    for r, c in zip(data, classes):
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    want = sorted(((r[0], least[c]) for r, c in zip(data, classes)), key=repr)
    assert len(set(classes)) < len(data) / 2
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(frame(spark, data)).collect()), key=repr)
    assert got == want
