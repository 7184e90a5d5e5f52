import random

import numpy as np
from pyspark.sql import functions as F

from routeloom.llm.langid import held_out
from routeloom.llm.toxicity import CHUNK, WORD, fit, predict, train, words_of

from .corpus import frame, rows

BAD = ["vile", "rotten", "filthy"]


def sample(n=900, seed=4):
    """Rows of frame and labels: a tenth is toxic, half of it confirmed; clean rows are labelled or not."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    data, labels, toxic = [], [], {}
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 300))]
        toxic[i] = rng.random() < 0.1
        if toxic[i]:
            for _ in range(max(2, len(text) // 30)):
                text[rng.randrange(len(text))] = rng.choice(BAD)
        data.append((i, " ".join(text), "en", "a", 1, "x", 7))
        if rng.random() < 0.5:
            labels.append((i, int(toxic[i])))
    return data, labels, toxic


def test_risk_takes_the_toxic_share_off_the_unlabelled():
    rng = np.random.default_rng(0)
    hidden = rng.random(4000) < 0.2
    unlabelled = np.where(hidden[:, None], [2.0, 0.0], [0.0, 1.0]) + rng.normal(0, 0.3, (4000, 2))
    positive = np.array([2.0, 0.0]) + rng.normal(0, 0.3, (300, 2))
    w = train(positive, unlabelled, 0.2, 1)
    said = unlabelled @ w[:-1] + w[-1] > 0
    assert (said == hidden).mean() > 0.99


def test_held_out_texts(spark):
    data, labels, toxic = sample()
    docs = frame(spark, data)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = predict(docs, fit(docs, marks, ~held_out())).select("*", held_out().alias("held")).collect()
    assert len(out) == len(data)
    held = [r for r in out if r.held]
    assert len(held) > 100 and sum(toxic[r.doc_id] for r in held) > 5
    assert sum(bool(r.predicted) == toxic[r.doc_id] for r in held) / len(held) > 0.97
    assert not any(r.predicted for r in held if not toxic[r.doc_id])
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


def test_held_out_labels_are_not_learned(spark):
    data, labels, _ = sample()
    docs = frame(spark, data)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = marks.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (fit(docs, m, ~held_out()) for m in (marks, turned))
    assert np.array_equal(a.buckets, b.buckets) and np.array_equal(a.weights, b.weights)


def test_awkward_rows(spark):
    data, labels, _ = sample(300)
    docs = frame(spark, [*rows(), *data, (None, "vile rotten", None, None, None, None, None)]).withColumn("score", F.lit("old")).withColumn("at", F.lit(1))
    marks = spark.createDataFrame([*labels, (None, 1), (5, None), *labels[:3]], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    out = predict(docs, fit(docs, marks, ~held_out()))
    assert out.columns == [*[c for c in docs.columns if c != "score"], "score", "predicted"]
    same = {}
    for r in out.collect():
        assert same.setdefault(r.text or "", r.score) == r.score
    assert len(same) > 300


def test_nothing_to_learn(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    clean = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    for marks in (none, clean):
        assert {(r.score, r.predicted) for r in predict(docs, fit(docs, marks, ~held_out())).collect()} == {(0.0, 0)}
    empty = frame(spark, [])
    assert predict(empty, fit(empty, none, ~held_out())).collect() == []


def test_words_of_long_texts():
    text = "Straße ΣΑΣ abc1def " * (CHUNK // 10) + "q" * 30
    assert words_of(text).total() == len(WORD.findall(text.lower()))
    assert words_of(text)["straße"] == CHUNK // 10
    assert words_of(None) == words_of("") == {}
