"""The corpus pipeline: quality rules, near-duplicates, secrets, the mix and token ids, one after the other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyworks.llm import jaccard_dedup, prefix_bpe, quality_rules, secret_scan, source_mix
from plyworks.llm.common import materialize, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, at a similarity of 0.8 or more of their runs of five words, the document of the least id stays."""
    return jaccard_dedup.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are replaced in the texts, and n_chars follows."""
    clean = secret_scan.redact(docs, F.concat_ws("/", "source", "lang"), F.col("source"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources reach their target weights: documents go, or come again as often as the mix repeats them."""
    return source_mix.mixed(docs, F.array("source"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, n_tokens, ids_sha256, decoded_sha256, ids) of each document of the mix."""
    return prefix_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source", "lang"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("secret scans", secrets),
    ("source mix", mix),
    ("byte-level BPE", token_ids),
]

#: SQL has no form for the seeded mix or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
