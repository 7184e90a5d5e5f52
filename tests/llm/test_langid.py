import random

import numpy as np

from routeloom.llm.langid import CHUNK, fit, grams, held_out, predict, radii_of

from .corpus import frame, rows

LETTERS = {"aa": "abcdefg", "bb": "defghij", "cc": "jklmnop"}


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        words = ["".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(8, 90))]
        out.append((i, " ".join(words), lang, None, None, None, None))
    return out


def test_held_out_accuracy(spark):
    docs = frame(spark, corpus())
    model = fit(docs, ~held_out(), k=3)
    assert sorted(r.lang for r in model.centroids.collect()) == sorted(3 * list(LETTERS)) and model.labels == 3
    out = predict(docs, model).withColumn("held", held_out()).collect()
    held = [r for r in out if r.held]
    assert len(held) > 30 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert np.mean([r.lang_rejected for r in held]) < 0.02
    assert all(0 <= r.score <= 1 for r in out)


def test_labels_of_held_out_rows_are_not_seen(spark):
    data = [(i, t, "zz" if i % 7 == 0 else l, *r) for i, t, l, *r in corpus()]
    model = fit(frame(spark, data), "doc_id % 7 <> 0")
    assert "zz" not in {r.lang for r in model.centroids.collect()}


def test_far_text_is_rejected_and_odd_texts_are_und(spark):
    model = fit(frame(spark, corpus()))
    data = [(1, "ыфва олдж йцук енгш зхъ ячсм итьб" * 5, None, None, None, None, None), (2, None, "aa", None, None, None, None), (3, "12 $$ !", None, None, None, None, None)]
    got = {r.doc_id: r for r in predict(frame(spark, data), model).collect()}
    assert got[1].lang_rejected and got[1].lang_pred in LETTERS
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].lang_rejected for i in (2, 3))


def test_awkward_tables(spark):
    data = rows()
    out = predict(frame(spark, data), fit(frame(spark, data))).collect()
    assert len(out) == len(data)
    none = fit(frame(spark, [(*r[:2], None, *r[3:]) for r in data]))
    assert {r.lang_pred for r in predict(frame(spark, data), none).collect()} == {"und"}
    assert predict(frame(spark, []), fit(frame(spark, []))).collect() == []


def test_case_and_signs_do_not_matter():
    assert (grams("Abc, def") == grams("ABC   $$ DEF!")).all() and grams("1 2") is None


def test_against_a_plain_nearest_centroid(spark):
    """Counts, weights and cosines in dictionaries; one pass or a pass for each label give the same."""
    data = corpus(120) + [(None, "abc abd", "aa", None, None, None, None), (900, None, "aa", None, None, None, None), (901, "x", "bb", None, None, None, None)]
    docs = frame(spark, data)
    model = fit(docs, per_language=20, k=2)
    centroids = [(r.lang, np.frombuffer(r.centroid, np.float32)) for r in model.centroids.orderBy("lang", "number").collect()]
    want = {}
    for doc, text, *_ in data:
        counts = grams(text)
        weights = {} if counts is None else {int(i): float(np.log1p(counts[i]) * model.idf[i]) for i in np.flatnonzero(counts)}
        norm = sum(w * w for w in weights.values()) ** 0.5
        scores = [(sum(w * float(c[i]) for i, w in weights.items()) / norm, -n, lang) for n, (lang, c) in enumerate(centroids)] if weights else [(0.0, 0, "und")]
        want[doc] = max(scores)
    model_by_label = fit(docs, per_language=20, k=2, block_labels=1)
    for m in (model, model_by_label):
        got = predict(docs, m).withColumn("held", held_out()).collect()
        assert len(got) == len(data)
        for r in got:
            assert r.lang_pred == want[r.doc_id][2] and abs(r.score - want[r.doc_id][0]) < 1e-5
            assert r.held is (True if r.doc_id is None else r.held) and r.held is not None


def test_long_texts_count_like_short_ones():
    text = "ab, c  déf " * 20_000
    assert len(text) > 3 * CHUNK
    whole = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    for piece in (whole[:2000], whole[:1999]):
        assert grams(piece).sum() == 2 * (len(" " + " ".join(piece.split()) + " ") - 2)
    assert grams(text).sum() == 2 * (len(whole) - 2)
    assert grams(text + " " * CHUNK).tolist() == grams(text).tolist() and grams(" " * CHUNK + "x").sum() == 2


def test_radii_pool_small_classes():
    out = radii_of([(4, 800, 3), (9, 500, 40), (9, 100, 1), (10, 900, 400)])
    assert abs(out[10] - 0.45) < 1e-9 and abs(out[23] - 0.45) < 1e-9 and abs(out[8] - 0.225) < 1e-9 and 0 < out[4] < 0.06
    few = radii_of([(3, 400, 5), (6, 700, 4)])
    assert abs(few[6] - 0.2) < 1e-9 and abs(few[4] - 0.1) < 1e-9 and few[9] == few[6]
    assert radii_of([]).tolist() == [0.0] * 24


def test_rare_labels_and_repeated_ids_train(spark):
    data = corpus(60) + [(1000, "qqq www zzz", "rare", None, None, None, None)] + [(1001, f"vvv uuu {i}", "copy", None, None, None, None) for i in range(9)]
    model = fit(frame(spark, data), per_language=5)
    assert {"rare", "copy"} <= {r.lang for r in model.centroids.collect()}


def test_a_word_or_two_is_kept(spark):
    """Short texts of a language pass, however long the texts that it was learned from."""
    docs = corpus()
    model = fit(frame(spark, docs))
    short = [(5000 + i, " ".join(t.split()[:1]), l, *r) for i, (_, t, l, *r) in enumerate(docs)]
    assert predict(frame(spark, short), model).where("lang_rejected").count() == 0
