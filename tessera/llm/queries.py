"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, fmindex, hilbert, lines, minmax, ngram_join, phrases, quality, rans, sharding, substring, trie_lm, yinyang
from .common import read
from .oracle import ORACLE  # noqa: F401  registered beside QUERIES

QUALITY_THRESHOLD = 0.3


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(common.crc_mod5(F.col("doc_id")) != 0))
    scored = quality.score(docs, weights)
    held_out = F.coalesce(common.crc_mod5(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedupe_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = common.Workspace(spark, "token-files")
    rans.write_token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), work.path)
    back = rans.read_token_files(spark, work.path)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trie_lm.score_texts(read(spark, sf_dir, "documents"), lambda doc_id: common.crc_mod5(doc_id) != 1)
    return out.withColumn("held_out", ~F.col("training")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 fixes exactly, for SQL to check."""
    return op6_lm_scoring(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 5))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.bpe_encode(read(spark, sf_dir, "documents"), ranks, pattern, decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), 40)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(read(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minmax.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.compress(read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_line_dedup, op3_token_files, op4_ngram_jaccard_join, op5_nearest_neighbours, op6_lm_scoring, op7_substring_dedup, op8_byte_bpe, op9_benchmark_decontamination, op10_sharding, op11_phrase_collocations, op12_minhash_dedup, op13_vector_codes, lm_base_scores)}
