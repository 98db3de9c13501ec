"""The corpus pipeline: language ID, quality classifier, SimHash near-dedup, mixing of sources, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as Parquet to the shared folder and reads it
back for the next one; then it deletes what the stage left there and the table that it read. All stages but the last return the columns of
``documents``, further ones included.

An empty table passes through all stages. Null ids, sources and languages are values like others; the text decides alone in the first
two stages. Repeated rows are repeated in what a stage keeps, but for near_dedup, which keeps one of them. This module needs tidemark.llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, language, mixing, rules, simhash
from tidemark.llm.common import crc32_of_id, discard, materialize, read, temporaries


#: Entries of the encoder's caches: fewer than by default, since workers that have run the other stages hold their models too.
CACHE_ENTRIES = 150_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects: null and empty texts, texts without a letter, and those too far from every centroid. Without any
    labelled language all are rejected."""
    found = language.predict(docs, language.train(language.for_training(docs)))
    return found.where(~F.col("lang_rejected")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose score is below ``rules.ACCEPT_AT``; null and empty texts are scored by the same rules. Without labels all score one half
    and stay."""
    model = rules.train(docs, read(spark, sf_dir, "labels").where(crc32_of_id() % 5 != 0))
    return rules.score(docs, model).where(F.col("quality_score") >= rules.ACCEPT_AT).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links connect: that of the smallest id (nulls last), of these that of the smallest hash of its text. Null, empty
    and blank texts are one group."""
    return simhash.deduplicate(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats every document by its Poisson count for equal shares of all sources (null is one), and shuffles. Sources without any text get no copy."""
    return mixing.mix(docs).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and ids_sha256 of every row; null and empty texts have no ids."""
    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), cache_entries=CACHE_ENTRIES)
    return done.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("language_id", language_id), ("quality_classifier", quality), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("bpe_encode", encode)]

#: SQL cannot express the classifiers, links and merges; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporaries():
            kept = materialize(stage(spark, docs, sf_dir), name, keep=True)
        discard(docs)  # deletes a table of a stage only
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
