"""N-gram Jaccard join: exact set similarity with token-combination prefixes.

A text's set holds its distinct word shingles, as 51-bit hashes. All sets follow one
order of tokens: rare ones first, then frequent ones, by hash within. With overlap
bound ``need = ceil(t * n)`` a set of n tokens loses at most ``n - need`` of them to a
partner, so a prefix that no such loss can empty must meet its partner's prefix:

* small sets are indexed by single tokens: the first ``n - need + 1``;
* larger ones by single rare tokens and, for frequent tokens, by pairs. Frequent
  tokens are dealt into classes; a class with c tokens in the prefix counts c - 1,
  for so many losses leave it a whole pair. The prefix is extended until the counts
  reach ``n - need + 1``. Only tokens of a class combine, so pairs stay few.

Sets around the border between the two schemes are indexed by both.

How sets that share a signature are compared and linked: ``meeting``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .meeting import similar_components
from .shingles import HASH_BITS, Sets, pieces

U64 = np.uint64
SHINGLE_WORDS, PERCENT = 3, 90
#: Sets with fewer tokens use single tokens throughout.
PAIRS_FROM = 64
#: Classes of frequent tokens.
CLASSES = 16
#: A token is frequent if its slot of the corpus counts has so many occurrences and so many times the mean.
FREQUENT, FREQUENT_TIMES = 256, 4
SLOTS, SLICES = 1 << 20, 64


def prefix_signatures(sets: Sets, percent: int) -> list[np.ndarray]:
    """Each set's single tokens and pairs of its extended prefix."""
    loss = sets.n - (percent * sets.n + 99) // 100
    rank = np.arange(len(sets.key)) - sets.first[sets.doc]
    rare = (sets.key >> U64(51)) & U64(1) == 0
    border = -(-PAIRS_FROM * 100 // percent)
    single = common.mix(sets.token + U64(0x51ED270B))  # scheme for small sets
    own = common.mix(sets.token + U64(0xA24BAED4))
    in_prefix = rank <= loss[sets.doc]
    small = in_prefix & (sets.n[sets.doc] <= border)
    large = in_prefix & rare & (sets.n[sets.doc] >= PAIRS_FROM)
    n_rare = np.bincount(sets.doc[rare], minlength=len(sets.n))
    sig = np.concatenate((single[small], own[large]))
    owner = np.concatenate((sets.doc[small], sets.doc[large]))
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(sets.n) + 1))
    sig = sig[order]
    out = [sig[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    for d in np.flatnonzero((sets.n >= PAIRS_FROM) & (n_rare <= loss)).tolist():
        a = int(sets.first[d])
        tokens = sets.token[a + int(n_rare[d]) : a + int(sets.n[d])]
        out[d] = np.concatenate((out[d], _pair_signatures(tokens, int(loss[d]) + 1 - int(n_rare[d]))))
    return out


def _pair_signatures(tokens: np.ndarray, need: int) -> np.ndarray:
    """Pairs within classes of the shortest prefix whose classes count ``need`` together."""
    kind = (common.mix(tokens ^ U64(0x2545F491)) % U64(CLASSES)).astype(np.int64)
    seen = np.zeros(CLASSES, bool)
    count, stop = 0, len(tokens)
    for i, c in enumerate(kind.tolist()):
        count += seen[c]
        seen[c] = True
        if count >= need:
            stop = i + 1
            break
    tokens, kind = tokens[:stop], kind[:stop]
    found = []
    for c in np.flatnonzero(np.bincount(kind, minlength=CLASSES) > 1).tolist():
        t = tokens[kind == c]
        i, j = np.triu_indices(len(t), 1)
        found.append(common.mix(common.mix(t[i] + U64(0x9FB21C65)) + t[j]))
    return np.concatenate(found) if found else np.zeros(0, U64)


def _count_slots(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(SLOTS, np.int64)
        for b in pieces(batches):
            s = Sets(b.column("text"), k, None)
            counts += np.bincount((s.all >> U64(HASH_BITS - 20)).astype(np.int64), minlength=SLOTS)
        part = TaskContext.get().partitionId() % 64
        slices = counts.astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8").reshape(SLICES, -1)
        rows = [s.astype("<i8").tobytes() for s in slices]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES)), pa.array([part] * SLICES), pa.array(rows, pa.binary())], names=["slice", "part", "counts"])

    return run


def _add(key: tuple, t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(r, "<i8") for r in t.column("counts").to_pylist()], axis=0)
    return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int64()), "part": pa.array([0], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def frequent_slots(texts: DataFrame, k: int) -> np.ndarray:
    """One bit for each slot of token hashes: whether its tokens are frequent in the whole corpus."""
    schema = "slice long, part long, counts binary"
    some = texts.mapInArrow(_count_slots(k), schema).groupBy("slice", "part").applyInArrow(_add, schema)
    counts = np.zeros((SLICES, SLOTS // SLICES), np.int64)
    for r in some.groupBy("slice").applyInArrow(_add, schema).collect():  # SLICES rows
        counts[r["slice"]] = np.frombuffer(r["counts"], "<i8")
    return (counts.reshape(-1) >= max(FREQUENT, FREQUENT_TIMES * counts.mean()))


_INDEXED = "id long, h long, n long, node long, sigs array<long>, sketch binary"


def _index(k: int, percent: int, frequent):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(frequent.value, np.uint8)).astype(bool)
        for b in pieces(batches):
            s = Sets(b.column("text"), k, table)
            sigs = prefix_signatures(s, percent)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sigs]))).astype(np.int32)
            flat = np.concatenate(sigs).astype(U64).view(np.int64) if sigs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").combine_chunks(),
                    b.column("h").combine_chunks(),
                    pa.array(s.n, pa.int64()),
                    pa.array(s.digests().view(np.int64), mask=s.n == 0),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(s.sketches(percent), pa.binary()),
                ],
                names=["id", "h", "n", "node", "sigs", "sketch"],
            )

    return run


def similarity_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, row_hash, is_first`` of every row; ``100 * |x & y| >= percent * |x | y|`` links two texts.

    component_id is the smallest id that links reach, itself included. ``row_hash`` tells rows of one id
    apart by their texts (``common.row_key``); ``is_first`` marks one row of each component, of the smallest
    id, where no id comes first, and the smallest hash among those.

    * null and empty texts, and those without words, have an empty set and link with nothing
    * texts with fewer than ``shingle_words`` words have one shingle, the whole sequence
    * equal sets link, repeated rows among them; rows with a null id come before all ids and share components as any others
    * an empty table gives no rows; other columns are not read
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    work = common.Workspace(spark, "jaccard")
    text = F.col(text_col).cast("string")
    key_id, key_h = common.row_key(F.col(id_col), text)
    rows = docs.select(key_id.alias("id"), key_h.alias("h"), text.alias("text"))
    bits = np.packbits(frequent_slots(rows.select("text"), shingle_words)).tobytes()  # SLOTS bits
    frequent = spark.sparkContext.broadcast(bits)
    indexed = work.save(rows.mapInArrow(_index(shingle_words, percent, frequent), _INDEXED), "indexed")
    return similar_components(rows, indexed, shingle_words, percent, work)
