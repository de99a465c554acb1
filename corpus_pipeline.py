"""The training-data pipeline: each stage reads what its predecessor wrote.

quality: documents that the classifier rejects go. near_copies: of each group of near-duplicates, the smallest doc_id
stays. benchmark: documents that share a window with a benchmark item go. tokens: the rest is encoded and decoded.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from spectrafleet.llm import bpe, decontaminate, quality, simhash
from spectrafleet.llm._shared import delete, new_path, own_tables
from spectrafleet.llm.queries import quality_model, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality_model(spark, docs, sf_dir))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def no_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded_and_decoded(encoder, documents: list[bytes]) -> list[tuple]:
    wide = [w for (w,) in bpe.ids_of(encoder, documents)]
    texts = encoder.decode_many(documents)
    return [(len(w) // 4, w, hashlib.sha256(w).hexdigest(), hashlib.sha256(t).hexdigest()) for w, t in zip(wide, texts, strict=True)]


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    schema = "n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
    return bpe.encode_documents(docs.select("doc_id", "text"), str(tokenizer_path("word_bpe_49k.json")), encoded_and_decoded, schema)


STAGES = [("quality", good_quality), ("near_copies", one_of_each_group), ("benchmark", no_benchmark_passages), ("tokens", tokens)]

#: SQL can express neither the classifier nor the fingerprints; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again.

    What a stage wrote besides goes once its result is written, and a result once the next one is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with own_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
