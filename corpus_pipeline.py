"""A training corpus in five stages, each by one of the operators in ``mnemora.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and reread as the next stage's docs; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.llm import bpe, minhash, mixing, quality, suffix
from mnemora.llm.common import Scratch, table


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each row, and their number."""
    ids = bpe.encode_documents(docs.select("doc_id", "text", "lang", "source"), keep=["lang", "source"])
    return ids.select("doc_id", "kept.lang", "kept.source", F.col("ids").alias("token_ids"), F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("quality", quality.quality_stage),
    ("near_dedup", minhash.near_dedup_stage),
    ("repeats", suffix.repeats_stage),
    ("mixing", mixing.mixing_stage),
    ("encode", encode),
]

#: Learned trees and sketches have no SQL form; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
