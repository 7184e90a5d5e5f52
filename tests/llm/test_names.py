"""Extra columns whose names clash with results or inner columns pass through or are replaced, as stated."""

import pytest

from routeloom.llm import iblt, langid, linedup, media, mixing, nearcopies, packing, pii, simhash, suffixes
from routeloom.llm.queries import tokenizer_path

from .corpus import rows

CLASHES = [
    "fp", "rep", "shard", "_id", "_gone", "_row", "_found", "hash", "start", "end", "spans", "kept", "bucket", "k", "part", "close", "next_text", "score", "lang_pred", "n", "weight",
    "probability", "topic", "tokens", "tier", "offset", "digest", "length", "component_id", "n_entities", "kind", "canon", "value", "removed_chunks", "n_chars2", "bands", "sketch", "group_id",
]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(r[0], r[1], r[2], r[3], r[4], *([f"v{r[0]}"] * len(CLASHES))) for r in rows()[:20]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(data, schema)


def test_operators_that_give_their_own_columns(docs, tmp_path):
    for out in (
        packing.pack_documents(docs, tokenizer_path()), media.store_media(docs, f"file://{tmp_path}/m"), simhash.near_duplicates(docs), suffixes.remove_repeats(docs),
        iblt.fingerprint_edits(docs), nearcopies.groups(docs),
    ):
        assert out.count() >= 20


@pytest.mark.parametrize("name", ["langid", "linedup", "pii", "mixing", "nearcopies"])
def test_operators_that_keep_the_columns(docs, name):
    model = langid.fit(docs) if name == "langid" else None
    run = {
        "langid": lambda: langid.predict(docs, model), "linedup": lambda: linedup.drop_repeats(docs), "pii": lambda: pii.replace_entities(docs, "k"), "mixing": lambda: mixing.mix(docs, keep=1.0),
        "nearcopies": lambda: nearcopies.keep_one(docs),
    }[name]
    replaced = {"langid": {"lang_pred", "score"}, "linedup": {"removed_chunks"}, "pii": {"n_entities"}, "mixing": {"probability", "tokens"}, "nearcopies": set()}[name]
    out = run()
    got = out.collect()
    assert got and len(set(out.columns)) == len(out.columns)
    for r in got:
        for c in set(CLASHES) - replaced:
            assert r[c] == f"v{r.doc_id}", c
