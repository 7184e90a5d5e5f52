import random

from routeloom.llm.linedup import chunks, drop_repeats

from .corpus import frame, rows


def windows(text):
    """(numbers of the first and last line, bytes) of every two neighbouring lines with a letter or digit."""
    lines = text.split("\n")
    worded = [i for i, line in enumerate(lines) if any(c.isascii() and c.isalnum() or not c.isascii() for c in line)]
    return [(a, b, "\n".join(lines[a : b + 1])) for a, b in zip(worded, worded[1:])]


def brute(data):
    """Texts after removal, by walking all windows in order of document and place."""
    texts = {}
    for r in data:
        texts.setdefault(r[0], r[1])
    first, found = {}, {}
    for d in sorted(texts):
        for a, b, w in windows(texts[d] or ""):
            first.setdefault(w, (d, a))
            found[w] = found.get(w, 0) + 1
    out = {}
    for d, text in texts.items():
        own = windows(text or "")
        stay = {i for a, b, w in own if found[w] > 1 and first[w] == (d, a) for i in range(a, b + 1)}
        gone = [{i for i in range(a, b + 1) if i not in stay} for a, b, w in own if first[w] != (d, a)]
        lines = set().union(*gone)
        left = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in lines)
        out[d] = (left, sum(map(bool, gone)), len(lines))
    return out


def test_against_a_walk(spark):
    data = rows()
    got = {r.doc_id: (r.text, r.removed_chunks, r.removed_lines) for r in drop_repeats(frame(spark, data)).collect()}
    assert got == brute(data)
    assert sum(n for _, n, _ in got.values()) > 5


def test_every_repeated_passage_still_stands(spark):
    """Overlapping passages: what is first here and repeated there stays whole."""
    texts = ["a one\nb two\nq", "a one\nb two\nc three", "y one\nb two\nc three\nz"]
    got = [r.text for r in drop_repeats(frame(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got == ["a one\nb two\nq", "b two\nc three", "y one\nz"]
    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in data.select("doc_id", "text").collect()}
    count = {}
    for text in before.values():
        for _, _, w in windows(text or ""):
            count[w] = count.get(w, 0) + 1
    repeated = {w for w, n in count.items() if n > 1}
    after = [r.text for r in drop_repeats(data).select("text").collect()]
    left = {}
    for text in after:
        for _, _, w in windows(text or ""):
            left[w] = left.get(w, 0) + 1
    assert len(repeated) > 500 and all(w in left for w in repeated)
    # later occurrences are gone, but for those whose lines are all part of first ones
    assert sum(n - 1 for w, n in left.items() if w in repeated) <= 0.01 * sum(count[w] - 1 for w in repeated)


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    lines = [str(rng.random()) for _ in range(200)]
    a = {c[3] for c in chunks("\n".join(lines))}
    b = {c[3] for c in chunks("\n".join(["new"] + lines[:100] + ["more"] + lines[100:]))}
    assert len(a & b) > 0.9 * len(a)


def test_repeats_within_a_document_and_other_columns(spark):
    lines = "\n".join(f"line {i}" for i in range(12))
    data = [(1, lines + "\n" + lines, "en", "s", 5, "q", 9), (2, None, None, None, None, None, None)]
    got = {r.doc_id: r for r in drop_repeats(frame(spark, data)).collect()}
    assert got[1].text.startswith(lines) and got[1].removed_chunks > 0 and got[1].tier == "q" and got[1].rep == 9
    assert got[2].text is None and got[2].removed_chunks == 0
    assert drop_repeats(frame(spark, [])).collect() == []


def test_short_passages_in_different_surroundings(spark):
    rng = random.Random(2)
    line = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(12))
    passages = [[line(), *["", "--"][: k % 3], *(line() for _ in range(1 + k % 5))] for k in range(40)]
    data, own = [], {}
    for i in range(120):
        before, after = ([line() for _ in range(rng.randrange(4))] for _ in range(2))
        passage = passages[i % 40]
        data.append((i, "\n".join(before + passage + after), None, None, None, None, None))
        own[i] = (before, passage, after)
    got = {r.doc_id: r for r in drop_repeats(frame(spark, data)).collect()}
    for i, (before, passage, after) in own.items():
        left = got[i].text.split("\n")
        if i < 40:
            assert left == before + passage + after and got[i].removed_lines == 0
        else:
            assert left == before + after or (got[i].text, before + after) == ("", [])
            assert got[i].removed_lines == len(passage)


def test_blank_lines_and_brackets_are_no_passage(spark):
    texts = ["one\n\n\n}\n}\ntwo", "three\n\n\n}\n}\nfour", "x\none\n\n\n}\n}\ntwo\ny"]
    got = {r.doc_id: r.text for r in drop_repeats(frame(spark, [(i, t, None, None, None, None, None) for i, t in enumerate(texts)])).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: "x\ny"}
