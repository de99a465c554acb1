"""The queries of this subpackage: one opN_<name> each over its whole table."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, divergence, minhash, ngram_lm, quality, reshard, simhash, token_files, url_rules, whitening, wrappers
from ._shared import new_path


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs.select("doc_id", "text"), items).drop("spans")


def op8_simhash_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op9_one_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op10_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents lie in shards by source, which are uneven; they go to 16 shards of near equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(16))
    written, _ = reshard.reshard(docs, old, 16, new_path(spark, "shards"))
    slots = reshard.with_slots(written.select("doc_id", "size", "text_crc32", "shard", "file"))
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Learned from the labelled documents outside fold 2 of 4."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_fold(4) != 2)
    return quality.fit(docs.select("doc_id", "text"), labels.select("doc_id", F.col("quality").alias("label")))


def op2_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = quality.add_scores(docs, quality_model(spark, docs, sf_dir))
    return scored.select("doc_id", (_fold(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"), "n_passages")


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = ngram_lm.score_documents(docs, _fold(7) != 2)
    return scored.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_redirect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_rules.judge_urls(pages, url_rules.default_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


#: Conversation -7: texts that look like the template's own markers.
_PROBE = "\\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PROBE).alias("text"))
    return chat.conversation_digests(chat.parse_formatted(chat.format_conversations(turns.unionByName(probe))))


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: in TOKENIZER_DIR if that is set, else where the public_tokenizers package has it."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = new_path(spark, "token-files")
    manifest = token_files.write_token_files(docs, str(tokenizer_path("byte_bpe_50k.json")), out, end_id=2)
    return token_files.read_token_files(manifest, out)


def bpe_digests(encoder, documents: list[bytes]) -> list[tuple]:
    texts = encoder.decode_many(documents)
    return [(len(wide) // 4, hashlib.sha256(wide).hexdigest(), hashlib.sha256(text).hexdigest()) for (wide,), text in zip(bpe.ids_of(encoder, documents), texts, strict=True)]


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe.encode_documents(docs, str(tokenizer_path("word_bpe_49k.json")), bpe_digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_page_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.add_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op12_range_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_joint_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_winnowing": op1_winnowing,
    "op2_attention_mil": op2_attention_mil,
    "op3_deleted_interpolation": op3_deleted_interpolation,
    "op4_redirect_rules": op4_redirect_rules,
    "op5_token_files": op5_token_files,
    "op6_chat_format": op6_chat_format,
    "op7_bpe_chunks": op7_bpe_chunks,
    "op8_simhash_popcount": op8_simhash_popcount,
    "op9_one_permutation": op9_one_permutation,
    "op10_flow_reshard": op10_flow_reshard,
    "op11_page_wrappers": op11_page_wrappers,
    "op12_range_finder": op12_range_finder,
    "op13_joint_histograms": op13_joint_histograms,
}
