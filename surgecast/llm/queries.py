"""The registered queries of the training-data operators (see ``__spark_entry__``).

Each query applies its operator to its whole table and derives the digest columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import conversations, decontam, lattice, linededup, merkle, minhash, ordermin, quality, ring, tokenfile, tokens, toxic
from .common import documents, prepare
from .oracles import merkle_sql, repair_sql


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = tokens.encode(documents(spark, sf_dir), ranks)
    return tokens.decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return linededup.dedup(docs).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "removed_words")


def op3_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(documents(spark, sf_dir), shards=8)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.fingerprints(documents(spark, sf_dir))


def op5_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontam.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dirty = F.size("leaks") > 0
    return found.select("doc_id", dirty.alias("contaminated"), (~dirty).alias("kept"), F.col("leaks.item").alias("item_ids"),
                        F.col("leaks.score").alias("scores"), F.col("leaks.at").alias("first_words"))


def op6_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxic.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept", "set_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    rows = tokenfile.encoded(documents(spark, sf_dir), spec, end_id=1)
    path = tokenfile.write(rows, scratch_path(spark, "token-files"), vocabulary=49_408)
    return tokenfile.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, weight = lattice.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.score_documents(documents(spark, sf_dir), pieces, weight)


def op11_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conversations.damage(prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.repair(rows, here=F.col("here"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = merkle.manifest(documents(spark, sf_dir))
    return merkle.proofs(tree).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_ring_sharding": op3_ring_sharding,
    "op4_order_minhash": op4_order_minhash,
    "op5_spaced_seed_decontamination": op5_spaced_seed_decontamination,
    "op6_toxicity_trees": op6_toxicity_trees,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_token_files": op8_token_files,
    "op9_token_counts": op9_token_counts,
    "op10_subword_lattice": op10_subword_lattice,
    "op11_quality_discriminant": op11_quality_discriminant,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op12_conversation_repair": repair_sql(), "op13_merkle_manifest": merkle_sql()}
