"""The registered queries of the corpus operators, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, lexical, toxicity
from .common import documents, shared_dir
from .iblt import fingerprint_edits
from .linedup import drop_repeats
from .media import store_media
from .mixing import mix
from .mixing import oracle as mixing_oracle
from .packing import pack_documents
from .pii import replace_entities
from .preferences import ORACLE as PREFERENCES_ORACLE
from .preferences import answer_pairs, format_preferences
from .simhash import near_duplicates
from .suffixes import remove_repeats


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file; ``ROUTELOOM_TOKENIZER`` names another."""
    if path := os.environ.get("ROUTELOOM_TOKENIZER"):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


#: The key of the surrogates in the registered query; a corpus of one's own takes a secret one.
PII_KEY = os.environ.get("ROUTELOOM_PII_KEY", "example-key")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mix(documents(spark, sf_dir))
    return kept.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 9).alias("probability"), F.round("rake_residual", 6).alias("rake_residual"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_path())


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(documents(spark, sf_dir)).select("doc_id", "text", "removed_chunks", "removed_lines")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, ~langid.held_out())
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(documents(spark, sf_dir), PII_KEY).select("doc_id", "text", "n_entities")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(answer_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op7_suffix_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", length.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_iblt_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return fingerprint_edits(documents(spark, sf_dir)).select(*columns)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_media(documents(spark, sf_dir), f"{shared_dir(spark)}/media")
    return stored.withColumn("media_bytes", F.col("length"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~langid.held_out())
    return toxicity.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_packing": op2_packing,
    "op3_line_chunks": op3_line_chunks,
    "op4_language_id": op4_language_id,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_preferences": op6_preferences,
    "op7_suffix_blocks": op7_suffix_blocks,
    "op8_simhash_bktree": op8_simhash_bktree,
    "op9_iblt_sketch": op9_iblt_sketch,
    "op10_media_columns": op10_media_columns,
    "op11_lexical_search": op11_lexical_search,
    "op12_toxicity_pu": op12_toxicity_pu,
}

ORACLES: dict[str, str] = {"op1_mixing": mixing_oracle(), "op6_preferences": PREFERENCES_ORACLE, "op11_lexical_search": lexical.ORACLE}
