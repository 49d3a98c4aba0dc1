"""A training-corpus pipeline of five stages over ``documents``.

quality -> line dedup -> near duplicates -> decontamination -> tokens. Each stage
takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of
documents, with ``n_chars`` of the text as it now is.

A stage expects that its input has been written, as ``run`` and any caller of STAGES does; it
then deletes the work folders that the stage before it left, and no others, so lazy results
of other operators and of other runs stay readable.

Every stage: null and empty texts, null and repeated ids and repeated rows pass or go as said
below, an empty table gives no rows, and further columns stay, whatever their names.

* quality: documents that score under 0.3 go; the model learns from labelled rows outside the held-out fifth
* line dedup: lines with an earlier line of a word-set Jaccard of 0.8 or more go; a document stays even if empty
* near duplicates: of each group linked by a Jaccard of 0.8 on five-word shingles one row stays, that of
  the smallest id, where no id comes first; rows are told apart by id and text; rows without words all stay,
  but for exact repeats of a row
* decontamination: documents go of whose words a twentieth or more lie in test passages
* tokens: byte-level BPE ids of each document, decoded again as a check
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, fmindex, lines, ngram_join, quality

QUALITY_THRESHOLD = 0.3
SHINGLE_WORDS, PERCENT = 5, 80
#: Lists of rows to drop are broadcast up to so many; longer ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No stage's result but the last is SQL's to check: the first one's scores are learned.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Work folders that the latest call of each stage left, by the stage's name.
_left: dict[str, list[common.Workspace]] = {}


def _after(before: str | None) -> Callable[[Stage], Stage]:
    """Marks a stage: what stage ``before`` left is deleted first, what this one opens is kept for the next."""

    def mark(stage: Stage) -> Stage:
        @wraps(stage)
        def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for work in _left.pop(before, []):
                work.release()
            with common.recorded() as made:
                out = stage(spark, docs, sf_dir)
            _left.setdefault(stage.__name__, []).extend(made)
            return out

        return call

    return mark


def _columns(docs: DataFrame) -> DataFrame:
    own = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return own.select(*[c for c in docs.columns])


def _anti(docs: DataFrame, gone: DataFrame, on: str | list[str]) -> DataFrame:
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, on, "left_anti")


@_after(None)
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score under ``QUALITY_THRESHOLD`` go; null and empty texts have the score of no features, and
    without labelled rows all documents have one score."""
    labels = common.read(spark, sf_dir, "labels")
    weights = quality.fit(docs, labels.where(common.crc_mod5(F.col("doc_id")) != 0))
    scored = quality.with_score(docs, weights)
    name = scored.columns[-1]
    return _columns(scored.where(F.col(name) >= QUALITY_THRESHOLD).select(*docs.columns))


@_after("quality_stage")
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; every document stays, and a null text becomes empty."""
    return _columns(lines.dedupe_lines(docs).select(*docs.columns))


@_after("line_stage")
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays; rows without words are in no group, and of equal rows of one id one stays."""
    work = common.Workspace(spark, "groups")
    key = [common.free_name(docs.columns, "id"), common.free_name([*docs.columns, "id"], "hash")]
    keyed = docs.withColumns(dict(zip(key, common.row_key(F.col("doc_id"), F.col("text")))))
    found = ngram_join.similarity_components(docs, SHINGLE_WORDS, PERCENT)
    found = work.save(found.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias(key[0]), F.col("row_hash").alias(key[1]), "is_first"), "found")
    gone = work.save(found.where(~F.col("is_first")).select(*key).distinct(), "gone")
    kept = _anti(keyed, gone, key)
    if not found.groupBy(*key).count().where("count > 1").isEmpty():  # repeated rows: one of equal rows stays
        kept = kept.dropDuplicates(key)
    return _columns(kept.select(*docs.columns))


@_after("near_duplicate_stage")
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, each judged by its own text; documents without words stay."""
    key = common.free_name(docs.columns, "key")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), "text"))
    found = fmindex.find_contamination(keyed, common.read(spark, sf_dir, "benchmark"), id_col=key)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["stop"] - s["start"])
    gone = found.where((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).select(F.col("doc_id").alias(key)).distinct()
    gone = common.Workspace(spark, "contaminated").save(gone, "gone")
    return _columns(_anti(keyed, gone, key).select(*docs.columns))


@_after("decontamination_stage")
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, n_bytes, text_sha256`` of every row; null and empty texts have no tokens."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.bpe_encode(docs, ranks, pattern, decode=True)
    return coded.select("doc_id", "n_tokens", "ids", F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder, until the session ends."""
    docs = common.read(spark, sf_dir, "documents")
    work = common.Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
