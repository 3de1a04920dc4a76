"""The corpus pipeline: language, near-duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs.

Null ids, texts, languages and sources, empty and very long texts, repeated
rows, empty tables and extra columns pass through as the operators define:
documents without a letter go in the first stage, null texts with them; equal
rows are one near-duplicate class, of which one stays; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import decontamination, language_id, mixing, near_dup, pii
from vicinal.llm.common import crc_mod, discard, materialize, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text has no letter or is hardly more like a learned language than random vectors are."""
    protos = language_id.learn_prototypes(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    scored = language_id.identify(docs, protos)
    kept = scored.where((F.col("lang_pred") != "und") & (F.col("score") >= language_id.resembles())).select(*docs.columns)
    return materialize(kept, "language")  # written here, where whole texts go to Python in small batches


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return near_dup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives every detected entity a surrogate; n_chars follows the new text."""
    out = pii.pseudonymize(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))
    return materialize(out, "personal_data")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of their sources, in a global random order."""
    return mixing.poisson_mix(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
]

#: Hyperdimensional scores and consistent samples have no SQL form; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
