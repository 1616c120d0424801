"""The registered queries of this package: one for each operator."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm import (
    chat,
    decontaminate,
    hash_index,
    link_rank,
    near_copies,
    packing,
    prefix_trie,
    quality,
    ranked_search,
    set_join,
    shards,
    suffix_dedup,
    token_files,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op7_chat_windows": chat.ORACLE,
    "op11_ranked_search": ranked_search.ORACLE,
    "op12_set_join": set_join.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rated_model(spark: SparkSession, sf_dir: str) -> quality.Ordinal:
    """The quality model of a data folder, fitted on its labels."""
    labels = _table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", quality.grade_of(labels["quality"], labels["toxic"]).alias("grade"))
    return quality.train(_table(spark, sf_dir, "documents"), ratings)


@query
def op1_length_buckets(spark, sf_dir):
    return packing.length_buckets(_table(spark, sf_dir, "documents"))


@query
def op2_token_files(spark, sf_dir):
    return token_files.encode_and_read_back(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeated_bytes(_table(spark, sf_dir, "documents"))


@query
def op4_hash_index(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return hash_index.nearest(vectors, vectors.where("vec_id % 100 = 0"))


@query
def op5_kd_shards(spark, sf_dir):
    return shards.kd_shards(_table(spark, sf_dir, "documents"))


@query
def op6_quality_grades(spark, sf_dir):
    return quality.graded(_table(spark, sf_dir, "documents"), rated_model(spark, sf_dir))


@query
def op7_chat_windows(spark, sf_dir):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.chat_windows(rows.unionByName(own)))


@query
def op8_benchmark_matches(spark, sf_dir):
    return decontaminate.benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op9_url_verdicts(spark, sf_dir):
    return link_rank.url_verdicts(_table(spark, sf_dir, "pages"))


@query
def op10_simhash_components(spark, sf_dir):
    return near_copies.simhash_components(_table(spark, sf_dir, "documents"))


@query
def op11_ranked_search(spark, sf_dir):
    index = ranked_search.build_index(_table(spark, sf_dir, "documents"))
    return ranked_search.search(index, _table(spark, sf_dir, "benchmark"))


@query
def op12_set_join(spark, sf_dir):
    return set_join.jaccard_components(_table(spark, sf_dir, "documents"))


@query
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))
