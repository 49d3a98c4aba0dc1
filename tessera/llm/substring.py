"""Substring dedup: repeated runs of words, found in prefix-partitioned groups of windows.

Every run of ``window`` words is the beginning of a suffix. Suffixes are split into
groups by a prefix of variable length: the first two words, four where too many
suffixes share those, and the whole run where even that is too many, by counts over
the whole corpus. A group fits in memory. No suffix tree is built: the window is
fixed, so what would be the leaves under an inner node at its depth are the suffixes
whose first ``window`` words are equal, and these are grouped by hash; words beyond
the window aren't compared. The first of equal runs, in the order of documents and
positions, stays; the others are marked, and marked runs that overlap merge into
maximal spans.

Suffixes that can't repeat are left out first. A run has a landmark, the smallest
hash among its six-word pieces; equal runs have equal landmarks. Landmarks (an
eighth of all positions) are counted over the corpus, and only runs whose landmark
occurs twice or more are grouped. Runs are told apart by 96 bits of hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW_WORDS = 20
LANDMARK_WORDS = 6
#: Suffixes in a group.
GROUP_SUFFIXES = 4_000_000
#: Slots of two-word prefixes that are counted, and the slices in which their counts travel.
PREFIX_SLOTS, SLICES = 1 << 16, 256
#: Landmarks that one task compares.
BUCKET_LANDMARKS = 1_000_000
BATCH_BYTES = 6 << 20


class Batch:
    """Words of a batch with all hashes that the passes need; repeated rows (same id and text) count once."""

    def __init__(self, b: pa.Table, window: int):
        self.id = np.asarray(b.column("id"), dtype=np.int64)
        self.hash = np.asarray(b.column("row_hash"), dtype=np.int64)
        buf, starts, _ = common.text_bytes(b.column("text"))
        self.words = common.Words(buf, starts, common.BLANK_SEPARATED)
        once = np.zeros(len(starts), bool)
        once[np.unique(np.stack((self.id, self.hash)), axis=1, return_index=True)[1]] = True
        count = np.where(once, self.words.count, 0)
        self.h = self.words.hashes()
        self.at = common.window_starts(count, self.words.first, window)
        self.doc = self.words.doc[self.at]
        pieces = common.rolling(self.h, LANDMARK_WORDS, seed=1)
        self.mark = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        if len(self.at):
            self.mark, self.place = pieces[self.at].copy(), self.at.copy()
            for j in range(1, window - LANDMARK_WORDS + 1):
                other = pieces[self.at + j]
                less = other < self.mark
                self.mark[less] = other[less]
                self.place[less] = self.at[less] + j


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def pack(doc_id: np.ndarray, row_hash: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of entries, sorted by document; a document's id and hash are stored once."""
    first = _runs(doc_id, row_hash)
    sizes = np.diff(np.append(first, len(doc_id)))
    head = struct.pack("<II", len(first), len(doc_id))
    return b"".join([head, doc_id[first].astype("<i8").tobytes(), row_hash[first].astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), *[c.tobytes() for c in columns]])


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    n_docs, n = struct.unpack_from("<II", raw)
    at = 8
    out = []
    for kind in ("<i8", "<i8", "<u4"):
        out.append(np.frombuffer(raw, kind, n_docs, at))
        at += n_docs * np.dtype(kind).itemsize
    cols = [np.repeat(out[0], out[2]), np.repeat(out[1], out[2])]
    for kind in kinds:
        cols.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return cols


def _join(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts)]


def _by_group(group: np.ndarray, doc_id: np.ndarray, row_hash: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    order = np.lexsort((row_hash, doc_id, group))
    group, doc_id, row_hash = group[order], doc_id[order], row_hash[order]
    columns = [c[order] for c in columns]
    first = _runs(group)
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(group)]):
        yield int(group[a]), pack(doc_id[a:z], row_hash[a:z], *[c[a:z] for c in columns])


# ------------------------------------------------------------------ pass 1: landmarks
def _landmarks(window: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PREFIX_SLOTS, np.int64)
        for b in common.text_batches(batches, "text", BATCH_BYTES):
            x = Batch(b, window)
            if not len(x.at):
                continue
            counts += np.bincount((common.rolling(x.h, 2)[x.at] >> np.uint64(48)).astype(np.int64), minlength=PREFIX_SLOTS)
            new = np.concatenate(([True], (x.place[1:] != x.place[:-1])))  # windows come in order, so equal places are neighbours
            order = np.argsort(x.place[new], kind="stable")
            place, mark, doc = x.place[new][order], x.mark[new][order], x.doc[new][order]
            keep = np.concatenate(([True], place[1:] != place[:-1]))
            mark, doc = mark[keep], doc[keep]
            rows = list(_by_group((mark % np.uint64(buckets)).astype(np.int64), x.id[doc], x.hash[doc], [mark]))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows]), pa.array([r for _, r in rows], pa.binary())], names=["bucket", "entries"])
        parts = counts.reshape(SLICES, -1)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(-1 - some), pa.array([parts[i].astype("<i8").tobytes() for i in some], pa.binary())], names=["bucket", "entries"])

    return run


def _repeated_landmarks(key: tuple, t: pa.Table) -> pa.Table:
    bucket = t.column("bucket")[0].as_py()
    raws = t.column("entries").to_pylist()
    if bucket < 0:  # a slice of the prefix counts
        total = np.sum([np.frombuffer(r, "<i8") for r in raws], axis=0)
        return pa.table({"id": pa.array([bucket], pa.int64()), "row_hash": pa.array([None], pa.int64()), "marks": pa.array([total.astype("<i8").tobytes()], pa.binary())})
    doc_id, row_hash, mark = _join([unpack(r, "<u8") for r in raws])
    order = np.argsort(mark)
    mark, doc_id, row_hash = mark[order], doc_id[order], row_hash[order]
    first = _runs(mark)
    size = np.diff(np.append(first, len(mark)))
    common.trim()
    many = np.repeat(size > 1, size)
    mark, doc_id, row_hash = mark[many], doc_id[many], row_hash[many]
    order = np.lexsort((mark, row_hash, doc_id))
    mark, doc_id, row_hash = mark[order], doc_id[order], row_hash[order]
    first = _runs(doc_id, row_hash)
    ends = [*first[1:].tolist(), len(mark)]
    marks = [np.unique(mark[a:z]).astype("<u8").tobytes() for a, z in zip(first.tolist(), ends if len(first) else [])]
    return pa.table({"id": pa.array(doc_id[first], pa.int64()), "row_hash": pa.array(row_hash[first].astype(np.int64), pa.int64()), "marks": pa.array(marks, pa.binary())})


def prefix_groups(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first group, number of groups, prefix words) of each two-word prefix slot.

    Slots share a group while they fit; a slot that is too large by itself gets several groups, dealt
    by four words, or by the whole run if it is many times too large.
    """
    budget = max(1, min(GROUP_SUFFIXES, int(counts.sum()) // least))
    spread = np.maximum(1, -(-2 * counts // budget))
    spread[counts <= budget] = 1
    words = np.where(counts > 8 * budget, 0, 4)
    words[spread == 1] = 2
    first = np.zeros(len(counts), np.int64)
    group, filled = 0, 0
    for slot in np.flatnonzero(counts).tolist():
        n = int(counts[slot])
        if spread[slot] > 1 or filled + n > budget:
            group, filled = group + (filled > 0), 0
        first[slot] = group
        if spread[slot] > 1:
            group += int(spread[slot])
        else:
            filled += n
    return first, spread, words


# ------------------------------------------------------------------ pass 2: suffixes
def _suffixes(window: int, groups):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, spread, words = groups.value
        for b in common.text_batches(batches, "text", BATCH_BYTES):
            x = Batch(b, window)
            known = np.unique(np.concatenate([np.frombuffer(m, "<u8") for ms in b.column("marks").to_pylist() for m in ms or []] or [np.zeros(0, np.uint64)]))
            if not len(x.at) or not len(known):
                continue
            near = np.minimum(np.searchsorted(known, x.mark), len(known) - 1)
            may = known[near] == x.mark
            at, doc = x.at[may], x.doc[may]
            if not len(at):
                continue
            run20 = common.rolling(x.h, window, seed=2)[at]
            other = common.rolling(x.words.hashes(seed=1), window, seed=3)[at].astype(np.uint32)
            pos = (at - x.words.first[doc]).astype(np.uint32)
            doc_id, row_hash = x.id[doc], x.hash[doc]
            # what repeats within the batch is settled here; only the first of equal runs travels
            order = np.lexsort((pos, row_hash, doc_id, other, run20))
            firsts = _runs(run20[order], other[order])
            lead = np.zeros(len(order), bool)
            lead[firsts] = True
            go, stay = order[lead], order[~lead]
            slot = (common.rolling(x.h, 2)[at[go]] >> np.uint64(48)).astype(np.int64)
            four = common.rolling(x.h, 4)[at[go]]
            deal = np.where(words[slot] == 4, four, run20[go]) % spread[slot].astype(np.uint64)
            group = first[slot] + deal.astype(np.int64)
            rows = [(g, True, r) for g, r in _by_group(group, doc_id[go], row_hash[go], [pos[go], run20[go], other[go]])]
            if len(stay):
                rows += [(g, False, r) for g, r in _by_group(np.full(len(stay), int(group[0])), doc_id[stay], row_hash[stay], [pos[stay]])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary())], names=["grp", "leaf", "entries"])

    return run


def _subtree(key: tuple, t: pa.Table) -> pa.Table:
    """Marks of a group: of each deep node all leaves but the first, and what batches settled themselves."""
    leaf = t.column("leaf").to_pylist()
    raws = t.column("entries").to_pylist()
    leaves = [unpack(r, "<u4", "<u8", "<u4") for r, yes in zip(raws, leaf) if yes]
    settled = [unpack(r, "<u4") for r, yes in zip(raws, leaf) if not yes]
    if leaves:
        doc_id, row_hash, pos, run, other = _join(leaves)
        order = np.lexsort((pos, row_hash, doc_id, other, run))
        doc_id, row_hash, pos, run, other = (c[order] for c in (doc_id, row_hash, pos, run, other))
        again = np.ones(len(run), bool)
        node = _runs(run, other)
        again[node] = False
        # the same place may arrive twice (a repeated row in another batch): it doesn't repeat itself
        head = np.repeat(node, np.diff(np.append(node, len(run))))
        again &= (doc_id != doc_id[head]) | (row_hash != row_hash[head]) | (pos != pos[head])
        settled.append([doc_id[again], row_hash[again], pos[again]])
    doc_id, row_hash, pos = _join(settled)
    order = np.lexsort((pos, row_hash, doc_id))
    doc_id, row_hash, pos = doc_id[order], row_hash[order], pos[order]
    first = _runs(doc_id, row_hash)
    ends = [*first[1:].tolist(), len(pos)]
    out = [pos[a:z].astype("<u4").tobytes() for a, z in zip(first.tolist(), ends if len(first) else [])]
    return pa.table({"id": pa.array(doc_id[first], pa.int64()), "row_hash": pa.array(row_hash[first].astype(np.int64), pa.int64()), "starts": pa.array(out, pa.binary())})


# ------------------------------------------------------------------ pass 3: removal
def join_words(words: common.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    doc = words.doc[keep]
    start, size = words.start[keep], (words.end - words.start)[keep]
    with_space = size + 1
    ends = np.cumsum(with_space)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(ends - with_space, size) + inside] = words.buf[np.repeat(start, size) + inside]
    per_doc = np.bincount(doc, weights=with_space, minlength=len(words.count)).astype(np.int64)
    drop = ends[np.cumsum(np.bincount(doc, minlength=len(words.count)))[per_doc > 0] - 1] - 1  # the space after a text's last word
    lengths = per_doc - (per_doc > 0)
    solid = np.delete(out, drop)
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(solid.tobytes()))


def _remove(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.text_batches(batches, "text"):
            buf, starts, _ = common.text_bytes(b.column("text"))
            words = common.Words(buf, starts, common.BLANK_SEPARATED)
            marked = [np.frombuffer(s, "<u4") for ss in b.column("starts").to_pylist() for s in ss or []]
            owner = [d for d, ss in enumerate(b.column("starts").to_pylist()) for _ in ss or []]
            edge = np.zeros(len(words.start) + 1, np.int64)
            if marked:
                at = np.concatenate(marked).astype(np.int64) + np.repeat(words.first[owner], [len(m) for m in marked])
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            removed = np.bincount(words.doc[gone], minlength=len(words.count))
            doc_of = words.doc
            edge_of_doc = np.concatenate(([True], doc_of[1:] != doc_of[:-1])) if len(gone) else gone
            begin = np.flatnonzero(gone & (edge_of_doc | np.concatenate(([True], ~gone))[: len(gone)]))
            end = np.flatnonzero(gone & np.concatenate((edge_of_doc[1:] | ~gone[1:], [True]))[: len(gone)]) + 1
            doc = doc_of[begin]
            spans: list[list[dict]] = [[] for _ in range(len(words.count))]
            for d, s, e in zip(doc.tolist(), begin.tolist(), end.tolist()):
                f = int(words.first[d])
                spans[d].append({"start": s - f, "stop": e - f})
            yield common.table(
                {"doc_id": b.column("doc_id").combine_chunks(), "n_words": words.count, "n_removed": removed, "kept": join_words(words, ~gone).cast(pa.string()), "spans": pa.array(spans, _OUT.field("spans").type)}, _OUT
            )

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept, spans`` of every row: removed word ranges [start, stop), and the other words joined by one space.

    * null and empty texts have no words
    * rows with a null id come before all others; rows that share an id come in the order of their texts' hashes
    * rows with the same id and the same text count as one document and get the same result
    * an empty table gives no rows; other columns are not read
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    work = common.Workspace(spark, "repeats")
    text = F.col(text_col).cast("string")
    key_id, key_hash = common.row_key(F.col(id_col), text)
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), key_id.alias("id"), key_hash.alias("row_hash"), text.alias("text")
    )
    landmarks = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 50
    least = max(64, common.shuffle_parts(spark))
    buckets = max(48, landmarks // BUCKET_LANDMARKS)
    found = rows.select("id", "row_hash", "text").mapInArrow(_landmarks(window, buckets), "bucket long, entries binary").groupBy("bucket").applyInArrow(_repeated_landmarks, "id long, row_hash long, marks binary")
    found = work.save(found, "landmarks")
    common.release_shuffles(spark)
    counts = np.zeros((SLICES, PREFIX_SLOTS // SLICES), np.int64)
    for r in found.where("row_hash is null").select("id", "marks").collect():  # SLICES rows at most
        counts[-1 - r["id"]] = np.frombuffer(r["marks"], "<i8")
    groups = spark.sparkContext.broadcast(prefix_groups(counts.reshape(-1), least))  # a fixed number of slots
    marks = found.where("row_hash is not null").groupBy("id", "row_hash").agg(F.collect_list("marks").alias("marks"))
    near = rows.select("id", "row_hash", "text").join(marks, ["id", "row_hash"])
    leaves = near.mapInArrow(_suffixes(window, groups), "grp long, leaf boolean, entries binary")
    repeated = work.save(leaves.groupBy("grp").applyInArrow(_subtree, "id long, row_hash long, starts binary"), "starts")
    work.drop("landmarks")
    del found, marks, near, leaves
    common.release_shuffles(spark)
    starts = repeated.groupBy("id", "row_hash").agg(F.collect_list("starts").alias("starts"))
    return rows.join(starts, ["id", "row_hash"], "left").select("doc_id", "text", "starts").mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start: long, stop: long>>")
