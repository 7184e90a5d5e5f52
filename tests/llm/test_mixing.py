import duckdb
import pytest
from pyspark.sql import functions as F

from routeloom.llm.mixing import calibrate, mix, oracle, rake, residuals, tokens_of

from .corpus import frame, rows


def marginal(cells, names, i):
    out = {}
    for c, w in zip(names, cells):
        out[c[i]] = out.get(c[i], 0) + w
    return out


def test_rake_against_a_plain_loop(spark):
    data = [(s, l, "t", float(3 + 5 * i + 7 * j + i * j)) for i, s in enumerate("abcd") for j, l in enumerate(["x", "y", None])]
    targets = {"source": {"a": 4, "b": 3, "c": 2, "d": 1}, "lang": 0.0}
    df = spark.createDataFrame(data, "source string, lang string, topic string, n double")
    raked = rake(df, targets, 30)
    got = {(r.source, r.lang): r.weight for r in raked.collect()}
    off = residuals(raked, ["source", "lang"]).collect()
    assert len(off) == 7 and max(r.residual for r in off) < 1e-9
    assert max(r.residual for r in residuals(rake(df, targets, 1), ["source", "lang"]).collect()) > 1e-4
    total = sum(r[3] for r in data)
    names = [(r[0], r[1]) for r in data]
    w = [r[3] for r in data]
    goals = [{"a": 0.4 * total, "b": 0.3 * total, "c": 0.2 * total, "d": 0.1 * total}, {k: total / 3 for k in ("x", "y", None)}]
    for _ in range(30):
        for i in (0, 1):
            m = marginal(w, names, i)
            w = [x * goals[i][c[i]] / m[c[i]] for x, c in zip(w, names)]
    assert got == pytest.approx(dict(zip(names, w)), rel=1e-9)


def test_budget_is_met_with_capped_cells(spark):
    df = spark.createDataFrame([(10.0, 60.0), (50.0, 30.0), (40.0, 10.0)], "n double, weight double")
    got = calibrate(df, 50.0).collect()
    assert sum(r.n * r.probability for r in got) == pytest.approx(50.0)
    assert max(r.probability for r in got) == 1.0


@pytest.mark.parametrize("limit", [10_000, 0])
def test_against_sql(spark, sf_dir, limit):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.topic, r.tokens, round(r.probability, 9), round(r.rake_residual, 6)) for r in mix(docs, broadcast_cells=limit).collect()}
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == {r[0]: r[3:] for r in db.sql(oracle()).fetchall()}


def test_awkward_documents(spark):
    data = rows()
    out = mix(frame(spark, data), keep=1.0).collect()
    again = mix(frame(spark, data), keep=1.0).agg(F.count("*")).first()[0]
    assert 0 < len(out) == again <= len(data) and all(0 < r.probability <= 1 for r in out)
    assert mix(frame(spark, [])).collect() == []
    nothing = [(1, None, None, None, None, None, None)]
    assert mix(frame(spark, nothing)).collect() == []


def test_counted_tokens(spark):
    texts = ["", None, "One two, three.", "naïve 日本 語!", "a_b 3.14\n\t  x", "\x00\x7f"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(tokens_of(F.col("t"))).collect()]
    assert got == [0, 0, 5, 4, 7, 0]


def test_rows_without_an_id_are_drawn_by_their_text(spark, tmp_path):
    data = [(None, f"text number {i}", "en", "a", None, None, None) for i in range(200)] + [(1, "one", "en", "a", None, None, None)]
    assert len(mix(frame(spark, data), keep=1.0).collect()) == 201
    half = mix(frame(spark, data), keep=0.5).collect()
    assert 60 < len(half) < 140
    frame(spark, data).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(r.text for r in half) == sorted(r[0] for r in db.sql(oracle().replace("SELECT doc_id, d.source", "SELECT text, d.source")).fetchall())
