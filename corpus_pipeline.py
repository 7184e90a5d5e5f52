"""A training-corpus pipeline over ``documents``, stage by stage.

Language identification (rejected documents go), removal of repeated line chunks,
near-copy removal (one of each group stays), mixing to target weights, and packing.
Each stage's rows are written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm import langid
from routeloom.llm.common import cut, documents
from routeloom.llm.linedup import drop_repeats
from routeloom.llm.mixing import mix
from routeloom.llm.nearcopies import keep_one
from routeloom.llm.packing import pack_documents
from routeloom.llm.queries import tokenizer_path

#: The share of the tokens that mixing keeps.
KEEP = 0.8


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, with that language."""
    columns = docs.columns
    found = langid.predict(docs, langid.fit(docs)).where(~F.col("lang_rejected"))
    return found.withColumn("lang", F.col("lang_pred")).select(*columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; those that were nothing else go."""
    out = drop_repeats(docs).where((F.col("removed_chunks") == 0) | (F.col("text") != ""))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with raked shares of sources, languages and topics."""
    return mix(docs, keep=KEEP).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL expresses neither the language model nor the trees; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
