import duckdb
from routeloom.llm.preferences import ORACLE, answer_pairs, format_preferences


def turns(spark, data):
    return spark.createDataFrame(data, "pair_id long, chosen boolean, turn long, role string, text string")


def test_prefix_is_rendered_once(spark):
    shared = [(0, "system", "Be kind."), (1, "user", "Hi é?")]
    data = [(1, c, *t) for c in (True, False) for t in shared]
    data += [(1, True, 2, "assistant", "Good"), (1, True, 3, "user", "And?"), (1, True, 4, "assistant", "more <|end|>"), (1, False, 2, "assistant", "Bad")]
    data += [(2, True, 0, "user", "same"), (2, False, 0, "user", "same"), (3, True, 0, None, None), (4, False, 0, "user", "x"), (4, True, 0, "user", "x"), (4, True, 0, "user", "x")]
    got = {r.pair_id: r for r in format_preferences(turns(spark, data)).collect()}
    assert set(got) == {1, 2, 3, 4} and [got[i].paired for i in (1, 2, 3, 4)] == [True, True, False, True]
    assert (got[3].prompt, got[3].chosen, got[3].rejected, got[3].informative) == ("", "<|user|>\n<|end|>\n", "", False)
    one = got[1]
    assert one.prompt == "<|system|>\nBe kind.<|end|>\n<|user|>\nHi é?<|end|>\n" and one.prompt_turns == 2
    assert one.rejected == "<|assistant|>\nBad<|end|>\n"
    spans = [tuple(map(int, s.split("-"))) for s in one.chosen_trained.split(",")]
    assert [one.chosen[a:b] for a, b in spans] == ["Good<|end|>\n", "more < |end|><|end|>\n"]
    assert not got[2].informative and got[2].chosen == got[2].rejected == got[2].chosen_trained == ""
    assert got[4].prompt_turns == 1 and got[4].informative


def test_against_sql(spark, sf_dir):
    got = sorted(map(tuple, format_preferences(answer_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).collect()))
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{sf_dir}/conversations.parquet'")
    want = sorted(db.sql(ORACLE).fetchall())
    assert got == want and len(got) > 10 and max(r[1] for r in got) > 0


def test_awkward_turns(spark):
    data = [(None, 0, "user", "x"), (0, 0, None, None), (0, 1, "assistant", ""), (1, 0, "assistant", "z" * 5000), (1, 0, "assistant", "z" * 5000), (2, None, "assistant", "a"), (3, 1, "user", "q")]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in format_preferences(answer_pairs(rows)).collect()}
    assert set(got) == {0, 1, 2, 3} and got[0].prompt_turns == 1 and [got[i].paired for i in range(4)] == [True, True, False, False]
    assert got[3].chosen == "<|user|>\nq<|end|>\n" and got[2].chosen_trained != ""
    assert format_preferences(answer_pairs(rows.limit(0))).collect() == []
