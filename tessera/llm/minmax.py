"""Near-duplicate removal by min-max hashing.

A set's signature keeps, for each of PERMUTATIONS orders of tokens, both the first and the
last token: two values for one evaluation of the hash, each equal between two sets with a
probability of their Jaccard similarity. The values of the same order bend away from each
other, which lowers the variance of estimates, so first and last ones form bands of their
own: four first values of four orders, and the four last ones. Sets that share a band are
candidates; what links is decided on the whole sets (``meeting``).

With 16 + 16 bands of four, a pair at exactly 0.8 shares none with a probability of about
5 in 10^8, less above it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .meeting import similar_components
from .shingles import Sets, pieces

U64 = np.uint64
SHINGLE_WORDS, PERCENT = 4, 80
#: Orders of tokens, and how many of them form a band.
PERMUTATIONS, BAND = 64, 4


def min_max(sets: Sets, permutations: int = PERMUTATIONS) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each non-empty set under each order: two arrays of (sets, permutations)."""
    first = sets.first[sets.n > 0]
    low, high = (np.empty((permutations, len(first)), U64) for _ in range(2))
    base = common.mix(sets.token + U64(0x3C6EF372))
    factors = common.mix(np.arange(1, permutations + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    if len(first):
        for i, f in enumerate(factors):
            value = base * f  # an odd factor permutes the 64-bit numbers
            np.minimum.reduceat(value, first, out=low[i])
            np.maximum.reduceat(value, first, out=high[i])
    return low.T, high.T


def bands(values: np.ndarray, seed: int, size: int = BAND) -> np.ndarray:
    """A hash of each band of ``size`` values: (sets, bands)."""
    parts = np.ascontiguousarray(values).reshape(len(values), values.shape[1] // size, size)
    out = np.arange(parts.shape[1], dtype=U64) + U64(seed)
    out = np.broadcast_to(common.mix(out), parts.shape[:2])
    for j in range(size):
        out = common.mix(out + parts[:, :, j])
    return out


_INDEXED = "id long, h long, n long, node long, sigs array<long>, sketch binary"


def _index(k: int, percent: int, permutations: int, band: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = Sets(b.column("text"), k, None)
            low, high = min_max(s, permutations)
            sigs = np.concatenate((bands(low, 1_000, band), bands(high, 2_000, band)), axis=1)
            offsets = np.concatenate(([0], np.cumsum((s.n > 0) * sigs.shape[1]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").combine_chunks(),
                    b.column("h").combine_chunks(),
                    pa.array(s.n, pa.int64()),
                    pa.array(s.digests().view(np.int64), mask=s.n == 0),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(sigs).reshape(-1).view(np.int64))),
                    pa.array(s.sketches(percent), pa.binary()),
                ],
                names=["id", "h", "n", "node", "sigs", "sketch"],
            )

    return run


def near_duplicates(
    docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, permutations: int = PERMUTATIONS, band: int = BAND, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, row_hash, is_first`` of every row; ``100 * |x & y| >= percent * |x | y|`` links two texts.

    Columns and cases are those of ``ngram_join.similarity_components``; links are confirmed on whole sets (of shingles'
    51-bit hashes), and found with the probability of sharing a band of ``band`` values, 1 - 5e-8 at 0.8 with the
    parameters given. Lower thresholds need more orders or narrower bands.

    * null and empty texts, and those without words, have an empty set and link with nothing
    * texts with fewer than ``shingle_words`` words have one shingle, the whole sequence
    * equal sets link, repeated rows among them; rows with a null id come before all ids and share components as any others
    * an empty table gives no rows; other columns are not read
    """
    if permutations % band:
        raise ValueError("bands must divide the orders")
    spark = docs.sparkSession
    common.small_batches(spark)
    work = common.Workspace(spark, "minmax")
    text = F.col(text_col).cast("string")
    key_id, key_h = common.row_key(F.col(id_col), text)
    rows = docs.select(key_id.alias("id"), key_h.alias("h"), text.alias("text"))
    indexed = work.save(rows.mapInArrow(_index(shingle_words, percent, permutations, band), _INDEXED), "indexed")
    return similar_components(rows, indexed, shingle_words, percent, work)
