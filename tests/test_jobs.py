"""The jobs: hand-worked rows, reruns, growing input, broken batches."""

import glob
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import policy_corpus, run_ledger
from jobs.common import load
from routeloom.plans import bindings as B
from routeloom.plans.tables import solve_rate_curve

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def files(folder):
    return sorted(p for p in glob.glob(f"{folder}/**/*.*", recursive=True) if not p.endswith(".crc"))


# the corpus


TURNS = [
    (1, 0, "user", "alpha beta gamma, to the delta"),
    (1, 1, "assistant", "Surely GAMMA or beta"),
    (1, 2, "user", "alpha beta gamma, to the delta"),
    (1, 3, "assistant", "beta it is"),
    (2, 0, "user", "secretword here now"),
    (2, 1, "assistant", "here"),
    (3, 0, "user", "nothing said"),
    (3, 1, "assistant", "no"),
    (4, 0, "user", "is it ok"),
    (4, 1, "assistant", "is it ok"),
    (5, 0, "user", "open end"),
    (5, 2, "assistant", "open after a gap"),
    (6, 8, "user", "deep one"),
    (6, 9, "assistant", "one"),
    (7, 8, "user", "deep one"),
    (7, 9, "assistant", "deep"),
    (None, 0, "user", "alpha"),
    (8, 0, None, "alpha"),
    (8, 0, "user", None),
    (8, None, "user", "alpha"),
    (9, 0, "user", "twin here"),
    (9, 0, "user", "twin again"),
    (9, 1, "assistant", "twin"),
    (9, 1, "assistant", "twin"),
]


@pytest.fixture()
def tables(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("x"))
    turns.repartition(3).write.parquet(f"file://{tmp_path}/conversations")
    spark.createDataFrame([(1, "a Secretword of it"), (2, None)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark")
    return f"file://{tmp_path}"


def corpus(spark, base, out="out", **settings):
    left = policy_corpus.run(spark, f"{base}/conversations", f"{base}/benchmark", f"{base}/{out}", policy_corpus.Settings(**{"keep_share": 1.0, "held_share": 0.4} | settings))
    return left, policy_corpus.read(spark, f"{base}/{out}")


def test_corpus_rows(spark, tables):
    left, out = corpus(spark, tables)
    assert list(left.items()) == [("decisions", 7), ("answered", 6), ("unleaked", 5), ("distinct", 4), ("kept", 4)]
    got = {r.pair_id: r for r in out.collect()}
    assert set(got) == {"1-0", "1-2", "6-8", "9-0"}  # equal prompts of 6-8 and 7-8: the first stays; the depth tells 1-0 from 1-2
    assert got["1-0"].prompt[1].content == "Target molecule: alpha\nFrontier candidates:\n[0] alpha | depth=0\n[1] beta | depth=0\n[2] gamma | depth=0\n[3] the | depth=0\n[4] delta | depth=0"
    assert [m.role for m in got["1-0"].prompt] == ["system", "user"] and got["1-0"].completion[0].role == "assistant"
    assert {k: json.loads(r.completion[0].content)["choice"] for k, r in got.items()} == {"1-0": 1, "1-2": 1, "6-8": 1, "9-0": 0}
    assert got["9-0"].prompt[1].content.startswith("Target molecule: twin\nFrontier candidates:\n[0] twin | depth=0\n[1] again")
    assert got["1-0"].split == got["1-2"].split and sum(r.split == "validation" for r in got.values()) in (1, 2)


def test_corpus_again(spark, tables):
    first = rows(corpus(spark, tables)[1])
    assert rows(corpus(spark, tables)[1]) == first
    # what an earlier run wrote is replaced whole, partitions that are empty now too
    spark.createDataFrame(TURNS[:2], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tables}/conversations")
    assert [r.pair_id for r in corpus(spark, tables)[1].collect()] == ["1-0"]


def test_corpus_keeps_the_deep(spark, tables):
    left, out = corpus(spark, tables, keep_share=0.5)
    kept = {r.pair_id for r in out.collect()}
    assert left["kept"] == len(kept) == 2 and "6-8" in kept


def test_corpus_of_nothing(spark, tables):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{tables}/conversations")
    left, out = corpus(spark, tables)
    assert set(left.values()) == {0} and out.count() == 0


# the ledger


@pytest.fixture()
def arriving(spark, sf_dir, tmp_path):
    """A folder to fill, and the events in three shares: days before the 20th, the rest, and some of both again with others that are late."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 <> 0 or ts < timestamp'2024-01-21'")
    late = events.where("event_id % 50 = 7")
    base = f"file://{tmp_path}"
    old, new = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"), F.col("event_id") % 50 != 7
    shares = [events.where(old & new), events.where(~old & new), late.unionByName(events.where("event_id % 40 = 3"))]

    def arrive(i):
        shares[i].repartition(2).write.mode("append").parquet(f"{base}/events")

    return events, base, arrive


def ledger(spark, base, name="out", budgets=(1, 10, 100), per_batch=64):
    return run_ledger.run(spark, f"{base}/events", f"{base}/{name}", f"{base}/{name}-checkpoint", run_ledger.Settings(budgets, per_batch))


def whole(events):
    return run_ledger.daily(run_ledger.entries(events).withColumn("batch", F.lit(0).cast("long")), (1, 10, 100)).select("policy", "seed", "budget", "runs", "solved", "expansions", "seconds", "day")


@pytest.mark.parametrize("per_batch", [64, 1])
def test_ledger_takes_only_what_is_new(spark, arriving, per_batch):
    events, base, arrive = arriving
    arrive(0)
    first = ledger(spark, base, per_batch=per_batch)
    before = {p: os.path.getmtime(p) for p in files(f"{base[7:]}/out/daily")}
    assert first["events"] == spark.read.parquet(f"{base}/events").count() and rows(run_ledger.read(spark, f"{base}/out")) == rows(whole(spark.read.parquet(f"{base}/events")))
    arrive(1)
    second = ledger(spark, base, per_batch=per_batch)
    both = spark.read.parquet(f"{base}/events")
    assert second["events"] == both.count() - first["events"] > 0
    assert rows(run_ledger.read(spark, f"{base}/out")) == rows(whole(both))
    # days that got nothing are not written again
    assert all(os.path.getmtime(p) == t for p, t in before.items() if "day=" in p)
    assert ledger(spark, base) == {"events": 0, "batches": 0, "days": 0}
    arrive(2)
    third = ledger(spark, base, per_batch=per_batch)
    assert 0 < third["events"] < first["events"]
    out = run_ledger.read(spark, f"{base}/out")
    assert rows(out) == rows(whole(events))
    # the sums of all days give the curve that the table of all runs gives
    plain = lambda df: sorted((r.policy, r.budget, round(r["mean"], 9), round(r.sd, 9), r.n_seeds) for r in df.collect())
    assert plain(run_ledger.curve(out)) == plain(solve_rate_curve(B.runs_of(events), [1, 10, 100]))


def test_ledger_after_a_broken_batch(spark, arriving, monkeypatch):
    events, base, arrive = arriving
    arrive(0)
    ledger(spark, base)
    arrive(1)

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(run_ledger, "daily", broken)  # after the batch has reached the ledger
        with pytest.raises(Exception, match="lost"):
            ledger(spark, base)
    arrive(2)
    ledger(spark, base)
    assert rows(run_ledger.read(spark, f"{base}/out")) == rows(whole(events))


def test_ledger_without_its_checkpoint(spark, arriving):
    events, base, arrive = arriving
    for i in range(3):
        arrive(i)
    for name in ("first", "second"):
        run_ledger.run(spark, f"{base}/events", f"{base}/out", f"{base}/{name}", run_ledger.Settings((1, 10, 100), 2))
    assert rows(run_ledger.read(spark, f"{base}/out")) == rows(whole(events))


def test_ledger_of_awkward_events(spark, tmp_path):
    base = f"file://{tmp_path}"
    data = [(1, None, 5, "view", 3.5, '{"k": 4}'), (None, None, 5, "view", 3.5, '{"k": 4}'), (None, None, 5, "view", 3.5, '{"k": 4}'), (2, None, None, None, None, None), (1, None, 5, "view", 3.5, '{"k": 4}')]
    spark.createDataFrame(data, run_ledger.EVENTS).withColumn("day", F.lit("x")).write.parquet(f"{base}/events")
    ledger(spark, base)
    got = {(r.policy, r.seed, r.budget): (r.day, r.runs, r.solved, r.expansions, r.seconds) for r in run_ledger.read(spark, f"{base}/out").collect()}
    assert got[("view", 1, 1)] == ("unknown", 2, 0, 2, 0.875) and got[("view", 1, 10)] == ("unknown", 2, 2, 8, 0.875)
    assert got[(None, None, 1)][:3] == ("unknown", 1, 0)


def test_ledger_before_anything_arrives(spark, tmp_path):
    os.makedirs(f"{tmp_path}/events")
    base = f"file://{tmp_path}"
    assert ledger(spark, base)["events"] == 0 and run_ledger.read(spark, f"{base}/out").count() == 0


# the command line


def test_settings(tmp_path):
    assert load(policy_corpus.Settings) == policy_corpus.Settings()
    assert tuple(load(run_ledger.Settings).budgets) == run_ledger.Settings().budgets
    (tmp_path / "x.toml").write_text("budget = [1]\n")
    with pytest.raises(ValueError, match="budget"):
        load(run_ledger.Settings, str(tmp_path / "x.toml"))


def test_command_line(sf_dir, tmp_path):
    args = ["--conversations", f"{sf_dir}/conversations.parquet", "--benchmark", f"{sf_dir}/benchmark.parquet", "--out", f"file://{tmp_path}/out", "--master", "local[2]"]
    done = subprocess.run([sys.executable, "-m", "jobs.policy_corpus", *args], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "pairs/split=train" in done.stderr and glob.glob(f"{tmp_path}/out/pairs/split=train/depth=*/*.json")


def test_jobs_do_not_need_the_corpus_operators():
    for p in glob.glob(f"{ROOT}/jobs/*.py"):
        text = open(p).read()
        assert "llm" not in text and "corpus_pipeline" not in text
