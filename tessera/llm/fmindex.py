"""Benchmark decontamination with an FM-index for each shard of the corpus.

A shard is a group of documents. Its words become numbers: words of the test set
keep their number, all others are one breaker that no phrase contains. Stretches of
test words too short to hold the shortest phrase are left out; no occurrence can
lie in them. The rest is indexed: suffix array, Burrows-Wheeler transform, ranks
from a wavelet matrix, and sampled suffix positions. All phrases are searched
backwards at once; the occurrences are located and merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW_WORDS = 13
#: Bytes of text in a shard.
SHARD_BYTES = 6 << 20
#: Every so-manyth text position has its place in the suffix array kept.
SAMPLE = 8
#: Words of test items that are searched for in one pass over the corpus.
BLOCK_WORDS = 400_000


# ------------------------------------------------------------------ index
def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.concatenate(([True], text[order][1:] != text[order][:-1]))
    heads = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = heads
    width = 1
    while True:
        tied = np.flatnonzero(~(first & np.append(first[1:], True)))  # places in groups of two or more
        if not len(tied):
            return order
        suffix = order[tied]
        after = np.where(suffix + width < n, rank[np.minimum(suffix + width, n - 1)] + 1, 0)
        head = rank[suffix]
        by = np.lexsort((after, head))
        order[tied] = suffix[by]
        new_first = np.concatenate(([True], (head[by][1:] != head[by][:-1]) | (after[by][1:] != after[by][:-1])))
        first[tied] = new_first
        rank[order[tied]] = np.maximum.accumulate(np.where(new_first, tied, 0))
        width *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit plane a level, with counts before each position."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        cur = seq
        for level in range(self.levels - 1, -1, -1):
            bit = (cur >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        lo, hi = np.zeros_like(at), at.copy()
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            l1, h1 = self.ones[i][lo], self.ones[i][hi]
            lo = np.where(one, self.zeros[i] + l1, lo - l1)
            hi = np.where(one, self.zeros[i] + h1, hi - h1)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out, at = np.zeros(len(at), np.int64), at.copy()
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            before = self.ones[i][at]
            one = self.ones[i][at + 1] > before
            out |= one.astype(np.int64) << level
            at = np.where(one, self.zeros[i] + before, at - before)
        return out


class FMIndex:
    """Backward search and location over a sequence of symbols 1..sigma-1; 0 ends the text."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        text = np.append(symbols.astype(np.int64), 0)
        sa = suffix_array(text)
        self.n = len(text)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:sigma]
        self.bwt = WaveletMatrix(text[sa - 1], sigma)
        kept = sa % SAMPLE == 0
        self.kept_rank = np.concatenate(([0], np.cumsum(kept, dtype=np.int32))).astype(np.int32)
        self.kept_sa = sa[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffix array for each phrase; phrases are padded on the left."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((lengths > step) & (hi > lo))
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - step]
            lo[live] = self.before[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.before[c] + self.bwt.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by steps back to a sampled one."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            r = at[open_]
            hit = self.kept_rank[r + 1] > self.kept_rank[r]
            done = open_[hit]
            out[done] = self.kept_sa[self.kept_rank[at[done]]] + steps[done]
            open_ = open_[~hit]
            c = self.bwt.access(at[open_])
            at[open_] = self.before[c] + self.bwt.rank(c, at[open_])
            steps[open_] += 1
        return out


# ------------------------------------------------------------------ test set
class TestSet:
    """Distinct phrases of some items: their words' numbers, padded on the left, and their items."""

    def __init__(self, item_ids: list[int], texts: list[str], window: int):
        buf, starts, _ = common.text_bytes(pa.array(texts, pa.string()))
        words = common.Words(common.lower_ascii(buf), starts, common.ALNUM_WORDS)
        self.vocabulary, number = np.unique(words.hashes(), return_inverse=True)
        number = number + 1
        found: dict[bytes, tuple[np.ndarray, set[int]]] = {}
        for item, first, count in zip(item_ids, words.first.tolist(), words.count.tolist()):
            size = min(window, count)
            for at in range(first, first + count - size + 1) if count else ():
                phrase = number[at : at + size]
                found.setdefault(phrase.tobytes(), (phrase, set()))[1].add(item)
        self.lengths = np.array([len(p) for p, _ in found.values()], np.int64)
        self.phrases = np.zeros((len(found), window), np.int64)
        for i, (p, _) in enumerate(found.values()):
            self.phrases[i, window - len(p) :] = p
        items = [sorted(s) for _, s in found.values()]
        self.item_at = np.concatenate(([0], np.cumsum([len(s) for s in items]))).astype(np.int64)
        self.items = np.array([i for s in items for i in s], np.int64)
        self.shortest = int(self.lengths.min()) if len(found) else 0


def _search_shard(tests: TestSet, batch: pa.Table) -> pa.RecordBatch:
    buf, starts, _ = common.text_bytes(batch.column("text"))
    words = common.Words(common.lower_ascii(buf), starts, common.ALNUM_WORDS)
    n = len(words.start)
    n_docs = len(starts)
    symbol = np.zeros(n, np.int64)
    if n and len(tests.vocabulary):
        h = words.hashes()
        at = np.minimum(np.searchsorted(tests.vocabulary, h), len(tests.vocabulary) - 1)
        symbol = np.where(tests.vocabulary[at] == h, at + 1, 0)
    # stretches of test words within one document
    doc = words.doc
    known = symbol > 0
    new = known & np.concatenate(([True], ~known[:-1] | (doc[1:] != doc[:-1]))) if n else known
    last = known & np.concatenate((~known[1:] | (doc[1:] != doc[:-1]), [True])) if n else known
    begin, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    fits = end - begin >= max(1, tests.shortest)
    begin, end = begin[fits], end[fits]
    hit_doc = np.zeros(0, np.int64)
    if len(begin):
        size = end - begin
        sigma = len(tests.vocabulary) + 2
        total = int(size.sum()) + len(size)
        place = np.cumsum(size + 1) - (size + 1)
        text = np.full(total, sigma - 1, np.int64)  # a breaker after each stretch
        word_of = np.full(total, -1, np.int64)
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(place, size) + inside] = symbol[np.repeat(begin, size) + inside]
        word_of[np.repeat(place, size) + inside] = np.repeat(begin, size) + inside
        index = FMIndex(text, sigma)
        lo, hi = index.search(tests.phrases, tests.lengths)
        count = np.maximum(hi - lo, 0)
        phrase = np.repeat(np.arange(len(lo)), count)
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        where = word_of[index.locate(rows)]
        length = tests.lengths[phrase]
        hit_doc = doc[where]
    docs_hit = np.unique(hit_doc)
    out = {"doc_id": batch.column("doc_id").combine_chunks(), "n_words": words.count}
    spans, items = [None] * n_docs, [None] * n_docs
    if len(docs_hit):
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, where, 1)
        np.add.at(covered, where + length, -1)
        covered = np.cumsum(covered)[:-1] > 0
        n_items = tests.item_at[phrase + 1] - tests.item_at[phrase]
        pair_doc = np.repeat(hit_doc, n_items)
        inner = np.arange(int(n_items.sum())) - np.repeat(np.cumsum(n_items) - n_items, n_items)
        pair_item = tests.items[np.repeat(tests.item_at[phrase], n_items) + inner]
        pairs = np.unique(np.stack((pair_doc, pair_item)), axis=1)
        bounds = np.searchsorted(pairs[0], [docs_hit, docs_hit + 1])
        for d, a, b in zip(docs_hit.tolist(), bounds[0].tolist(), bounds[1].tolist()):
            items[d] = pairs[1][a:b].tolist()
            mark = covered[words.first[d] : words.first[d] + words.count[d]]
            edge = np.diff(mark.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
            spans[d] = [{"start": s, "stop": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
    out["spans"] = pa.array([s or [] for s in spans], _HITS.field("spans").type)
    out["items"] = pa.array([i or [] for i in items], _HITS.field("items").type)
    return common.table(out, _HITS)


_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.int64()))])
_HITS_SQL = "doc_id long, n_words long, spans array<struct<start: long, stop: long>>, items array<long>"


def find_contamination(docs: DataFrame, tests: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, n_words, spans, items`` of every document: covered word ranges [start, stop), merged, and the items found.

    * null and empty texts have no words, spans or items; such test items are never found
    * items without an id are not searched for; items with the same id count once
    * ids of documents, null or repeated, pass through; other columns are not read
    * an empty test set finds nothing; an empty corpus gives no rows

    The test set is read in blocks of ``BLOCK_WORDS`` words, so what is broadcast has a fixed size;
    each block is one pass over the corpus, and the passes' spans and items are united.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    passes = []
    for ids, texts in _blocks(tests.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))):
        shared = spark.sparkContext.broadcast((ids, texts, window))
        passes.append(rows.mapInArrow(_searcher(shared), _HITS_SQL))
    if len(passes) == 1:
        return passes[0]
    raise_rows = rows.withColumn("row", F.monotonically_increasing_id())
    work = common.Workspace(spark, "contamination")
    fixed = work.save(raise_rows, "rows")
    merged = None
    for ids, texts in _blocks(tests.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text"))):
        shared = spark.sparkContext.broadcast((ids, texts, window))
        part = fixed.select(F.col("row").alias("doc_id"), "text").mapInArrow(_searcher(shared), _HITS_SQL)
        merged = part if merged is None else merged.unionByName(part)
    united = merged.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    united = united.withColumn("spans", _merge_spans(F.col("spans")))
    return fixed.select("row", F.col("doc_id").alias("own_id")).join(united.withColumnRenamed("doc_id", "row"), "row").select(F.col("own_id").alias("doc_id"), "n_words", "spans", "items")


def _merge_spans(spans):
    def add(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] <= last["stop"], joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(spans, F.slice(spans, 1, 0), add)


def _searcher(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, window = shared.value
        tests = TestSet(ids, texts, window)
        for b in common.text_batches(batches, "text", SHARD_BYTES):
            yield _search_shard(tests, b)

    return run


def _blocks(tests: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """Test items with words, in blocks; one empty block if there is none."""
    ids: list[int] = []
    texts: list[str] = []
    size, any_ = 0, False
    for r in tests.where("item_id is not null and text is not null").toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"]) // 2 + 1
        if size >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, size, any_ = [], [], 0, True
    if ids or not any_:
        yield ids, texts
