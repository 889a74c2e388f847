"""A training-data pipeline over ``documents``: every stage is one operator of
``surgecast.llm``, written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from surgecast.llm import decontam, linededup, minhash, tokens, toxic
from surgecast.llm.common import documents, prepare
from surgecast.session import scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxic.score(docs, labels, carry=True).where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated stretches.  A document of which nothing is left stands
    whole in earlier ones and goes; a text that was empty before stays."""
    prepare(spark)
    cut = linededup.dedup(docs)
    left = cut.where((F.col("removed_words") == 0) | (F.length("text") > 0))
    return left.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8): the
    one of the smallest id.  Rows without words all stay."""
    prepare(spark)
    groups = minhash.near_duplicates(docs, width=5, percent=80)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    first = (groups.where("group is not null").groupBy("group").agg(F.min(order).alias("f"))
             .select(F.col("f.doc_id").alias("_id"), F.col("f.key").alias("_first")))
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    some = (keyed.where(~blank).join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_first")), "left_semi")
            .dropDuplicates(["doc_id", "_key"]))
    return some.select(*docs.columns).unionByName(docs.where(blank))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    found = decontam.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with checksums of the ids and of the decoded bytes."""
    prepare(spark)
    ranks = tokens.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    decoded = tokens.decode(tokens.encode(docs, ranks), ranks)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: No SQL expresses trees or merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
