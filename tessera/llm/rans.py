"""Token ids in a binary format: static range asymmetric numeral systems.

One frequency table, counted over all ids, codes independent blocks. In a block,
``LANES`` coder states take turns on the ids and share one stream of 32-bit words;
NumPy moves all lanes at once. A block carries its own document ids, lengths and
global start, checkpoints (lane states and stream position every
``CHECKPOINT_STEPS`` steps, so that its parts decode separately) and checksums of
the words and of the ids.

A block is one self-contained byte string, beginning with ``MAGIC``; the files of a
dataset hold one block a row, in order of ``block``, beside a file with the table.
"""

from __future__ import annotations

import gc
import itertools
import json
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"TRANS1\x00\x00"
SCALE_BITS = 20
LANES = 2048
CHECKPOINT_STEPS = 64
#: Ids in a block, but for the last ids of a document that is longer.
BLOCK_TOKENS = 1 << 18
LOW = np.uint64(1 << 31)


# ------------------------------------------------------------------ coder
class Table:
    """Frequencies scaled to 2**SCALE_BITS; every counted id keeps one slot at least."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.float64)
        total, size = counts.sum(), 1 << SCALE_BITS
        seen = counts > 0
        if seen.sum() > size:
            raise ValueError(f"more than {size} different ids")
        freq = np.zeros(len(counts), dtype=np.int64)
        if total:
            freq[seen] = np.maximum(1, np.floor(counts[seen] / total * size)).astype(np.int64)
            order = np.argsort(-freq, kind="stable")
            over = int(freq.sum()) - size
            if over < 0:
                freq[order[0]] -= over
            at = 0
            while over > 0:  # ids raised to one slot are paid for by the most frequent ones
                take = min(over, int(freq[order[at]]) // 2)
                freq[order[at]] -= take
                over -= take
                at = (at + 1) % max(1, int(seen.sum()))
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode_ids(ids: np.ndarray, t: Table) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(words, checkpoints): a checkpoint is the stream position and the lane states before a step."""
    n = len(ids)
    steps = -(-n // LANES)
    state = np.full(LANES, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    written = 0
    shift, bits, low32 = np.uint64(32), np.uint64(SCALE_BITS), np.uint64(0xFFFFFFFF)
    for step in range(steps - 1, -1, -1):
        part = ids[step * LANES : (step + 1) * LANES]
        k = len(part)
        x, f, c = state[:k], t.freq[part], t.start[part]
        full = x >= (f << np.uint64(63 - SCALE_BITS))
        if full.any():
            out = (x[full] & low32).astype("<u4")
            words.append(out)
            written += len(out)
            x = np.where(full, x >> shift, x)
        q = x // f
        state[:k] = (q << bits) + (x - q * f) + c
        if step % CHECKPOINT_STEPS == 0:
            marks.append((step, written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    return stream, [(written - w, s) for _, w, s in reversed(marks)]


def decode_ids(words: np.ndarray, marks: list[tuple[int, np.ndarray]], n: int, t: Table) -> np.ndarray:
    """The ids; each checkpoint's part is decoded by itself."""
    out = np.empty(n, dtype=np.uint32)
    for i, (at, states) in enumerate(marks):
        begin = i * CHECKPOINT_STEPS * LANES
        out[begin : min(n, begin + CHECKPOINT_STEPS * LANES)] = decode_part(words, at, states, min(n - begin, CHECKPOINT_STEPS * LANES), t)
    return out


def decode_part(words: np.ndarray, at: int, states: np.ndarray, n: int, t: Table) -> np.ndarray:
    out = np.empty(n, dtype=np.uint32)
    state = states.astype(np.uint64)
    mask, bits, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(32)
    for begin in range(0, n, LANES):
        k = min(LANES, n - begin)
        x = state[:k]
        slot = x & mask
        s = t.slot[slot]
        out[begin : begin + k] = s
        x = t.freq[s] * (x >> bits) + slot - t.start[s]
        need = np.flatnonzero(x < LOW)
        if len(need):
            x[need] = (x[need] << shift) | words[at : at + len(need)].astype(np.uint64)
            at += len(need)
        state[:k] = x
    return out


# ------------------------------------------------------------------ blocks
def pack_block(start: int, doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray, t: Table) -> bytes:
    words, marks = encode_ids(ids, t)
    body = [np.asarray(doc_ids, "<i8").tobytes(), np.asarray(valid, "u1").tobytes(), np.asarray(lengths, "<u8").tobytes()]
    for at, states in marks:
        body += [struct.pack("<Q", at), states.astype("<u8").tobytes()]
    body.append(words.tobytes())
    head = struct.pack("<QQQQQII", start, len(doc_ids), len(ids), len(marks), len(words), zlib.crc32(words.tobytes()), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
    return MAGIC + head + b"".join(body)


def unpack_block(raw: bytes, t: Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, doc ids, their validity, lengths, ids); raises where a checksum differs."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a block")
    at = len(MAGIC)
    start, n_docs, n, n_marks, n_words, words_crc, ids_crc = struct.unpack_from("<QQQQQII", raw, at)
    at += struct.calcsize("<QQQQQII")
    doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
    valid = np.frombuffer(raw, "u1", n_docs, at + 8 * n_docs).astype(bool)
    lengths = np.frombuffer(raw, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 17 * n_docs
    marks = []
    for _ in range(n_marks):
        marks.append((struct.unpack_from("<Q", raw, at)[0], np.frombuffer(raw, "<u8", LANES, at + 8)))
        at += 8 + 8 * LANES
    words = np.frombuffer(raw, "<u4", n_words, at)
    if zlib.crc32(words.tobytes()) != words_crc:
        raise ValueError("the words of a block are damaged")
    ids = decode_ids(words, marks, n, t)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the ids of a block are damaged")
    return start, doc_ids, valid, lengths, ids


# ------------------------------------------------------------------ tokenizer
#: Pieces that a worker remembers; 24 bytes each and what their ids take.
MEMO_PIECES = 1_500_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_NO_QUOTE = _PUNCT.copy()
_NO_QUOTE[39] = False


def _white(buf: np.ndarray) -> np.ndarray:
    """Which bytes belong to Unicode white space."""
    white = _SPACE[buf]
    if (buf >= 0xC2).any():
        b0, b1, b2 = buf, np.append(buf[1:], 0), np.append(buf[2:], [0, 0])[: len(buf)]
        two = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))
        end = ((b2 >= 0x80) & (b2 <= 0x8A)) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)
        three = ((b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)) | ((b0 == 0xE2) & (b1 == 0x80) & end) | ((b0 == 0xE2) & (b1 == 0x81) & (b2 == 0x9F)) | ((b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80))
        for n, head in ((2, two), (3, three)):
            at = np.flatnonzero(head)
            for j in range(n):
                white[at + j] = True
    return white


def piece_starts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where every byte-level splitting ends a match, so that pieces encode independently.

    Before white space after anything else; between an ASCII letter or digit and ASCII punctuation,
    but not after an apostrophe, which may begin a contraction.
    """
    white = _white(buf)
    cut = np.zeros(len(buf), bool)
    before = buf[:-1]
    cut[1:] = (white[1:] & ~white[:-1]) | (_PUNCT[buf[1:]] & _ALNUM[before]) | (_ALNUM[buf[1:]] & _NO_QUOTE[before])
    cut[starts] = True
    return np.flatnonzero(cut)


class UnitEncoder:
    """Encodes texts by a file of the tokenizers library, remembering pieces already seen by their hash."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self.vocab = self._tokenizer.get_vocab_size()
        self.dtype = "<u2" if self.vocab <= 1 << 16 else "<u4"
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self._known, self._from, self._size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._pool, self._used = np.zeros(1 << 16, np.uint16 if self.dtype == "<u2" else np.uint32), 0

    def encode(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, ids per text)."""
        texts = pa.compute.fill_null(texts, "")
        # a text with the string of an added token is encoded whole: the library looks for those first
        whole = np.zeros(len(texts), bool)
        for token in self._added:
            whole |= np.asarray(pa.compute.match_substring(texts, token))
        if whole.any():
            return self._mixed(texts, whole)
        return self._pieces(texts)

    def _mixed(self, texts, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        ids, sizes = self._pieces(texts.filter(pa.array(~whole)))
        ends = np.cumsum(sizes)
        plain = iter(np.split(ids, ends[:-1]) if len(sizes) else [])
        for t, w in zip(texts.to_pylist(), whole.tolist()):
            parts.append(np.array(self._tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if w else next(plain))
        return np.concatenate(parts).astype(np.uint32), np.array([len(p) for p in parts])

    def _pieces(self, texts) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        buf, starts, lengths = common.text_bytes(texts)
        at = piece_starts(buf, starts)
        end = np.append(at[1:], len(buf))
        doc = np.searchsorted(starts, at, "right") - 1
        end = np.minimum(end, (starts + lengths)[doc])  # without the newline that text_bytes adds
        real = end > at
        at, end, doc = at[real], end[real], doc[real]
        pieces = object.__new__(common.Words)
        pieces.buf, pieces.start, pieces.end = buf, at, end
        h, lead, code = np.unique(pieces.hashes(), return_index=True, return_inverse=True)
        place = np.searchsorted(self._known, h)
        new = np.ones(len(h), bool)
        inside = place < len(self._known)
        new[inside] = self._known[place[inside]] != h[inside]
        if new.any():
            if len(self._known) > MEMO_PIECES:
                self._clear()
                new[:] = True
            self._learn(h[new], [buf[a:z].tobytes().decode() for a, z in zip(at[lead[new]].tolist(), end[lead[new]].tolist())])
            place = np.searchsorted(self._known, h)
        size, begin = self._size[place][code], self._from[place][code]
        ends = np.cumsum(size)
        ids = self._pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)].astype(np.uint32)
        return ids, np.bincount(doc, weights=size, minlength=len(starts)).astype(np.int64)

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        # few at a time: the library's results are many times larger than their ids
        found = [e.ids for at in range(0, len(pieces), 2048) for e in self._tokenizer.encode_batch_fast(pieces[at : at + 2048], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), self._pool.dtype, int(size.sum()))
        while self._used + len(flat) > len(self._pool):
            self._pool = np.concatenate((self._pool, np.zeros_like(self._pool)))
        self._pool[self._used : self._used + len(flat)] = flat
        begin = self._used + np.cumsum(size) - size
        self._used += len(flat)
        at = np.searchsorted(self._known, h)
        if len(h) > 10_000:
            common.trim()
        self._known, self._from, self._size = np.insert(self._known, at, h), np.insert(self._from, at, begin), np.insert(self._size, at, size)


_ENCODERS: dict[str, UnitEncoder] = {}


def unit_encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


# ------------------------------------------------------------------ Spark
_RAW = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("docs", pa.binary()), ("ids", pa.binary()), ("counts", pa.binary())])


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts in ascending id order (null ids first, equal ids by text) and write files to ``path``.

    ``end_id`` follows each document. Null texts count as empty. ``path`` gets ``blocks`` (rows
    ``part, seq, start, n_tokens, payload``) and ``table`` (id counts as JSON text).
    Texts are range-partitioned once; ids wait in the shared folder while their counts are summed.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    work = common.Workspace(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = common.shuffle_parts(spark)
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt = dealt.withColumn("part", F.spark_partition_id().cast("long"))

    def tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = unit_encoder(tokenizer_path)
        counts = np.zeros(max(enc.vocab, end_id + 1), np.int64)
        part, seq = 0, 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size, held
            ids = np.concatenate([h[2] for h in held])
            meta = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[3] for h in held])
            packed = meta[0].astype("<i8").tobytes() + meta[1].astype("u1").tobytes() + meta[2].astype("<u8").tobytes()
            out = table_row(part, seq, len(ids), packed, ids.astype(enc.dtype).tobytes(), None)
            seq, size, held = seq + 1, 0, []
            return out

        for b in common.text_batches(batches, "text"):
            part = b.column("part")[0].as_py()
            ids, lengths = enc.encode(b.column("text"))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id).astype(np.uint32)
            lengths = lengths + 1
            counts += np.bincount(ids, minlength=len(counts))
            ends = np.cumsum(lengths)
            doc = b.column("doc_id").combine_chunks()
            valid = np.asarray(doc.is_valid())
            doc_ids = np.asarray(doc.fill_null(0), dtype=np.int64)
            at = 0
            while at < len(lengths):
                done = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_TOKENS - size, "right")))
                held.append((doc_ids[at:to], valid[at:to], ids[done : int(ends[to - 1])], lengths[at:to]))
                size += int(ends[to - 1]) - done
                at = to
                if size >= BLOCK_TOKENS or at < len(lengths):
                    yield flush()
        if held:
            yield flush()
        if seq:
            yield table_row(part, -1, 0, None, None, counts.astype("<i8").tobytes())

    raw = work.save(dealt.mapInArrow(tokenise, "part long, seq long, n_tokens long, docs binary, ids binary, counts binary"), "raw")
    del dealt
    gc.collect()
    spark._jvm.System.gc()  # lets Spark drop the shuffled texts, which nothing needs any more

    counts = _sum_counts(raw)
    t = spark.sparkContext.broadcast(counts)
    blocks = raw.where("seq >= 0")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "seq", "n_tokens")
    parts = {r["part"]: r["n"] for r in sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each partition
    run, offsets = 0, []
    for p in sorted(parts):
        offsets.append((p, run))
        run += parts[p]
    per_part = spark.createDataFrame(offsets, "part long, base long")
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(per_part, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("start"))
    wide = "<u2" if len(counts) <= 1 << 16 else "<u4"

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = _table(t.value)
        for b in batches:
            for r in b.to_pylist():
                n_docs = len(r["docs"]) // 17
                ids = np.frombuffer(r["ids"], wide).astype(np.uint32)
                payload = pack_block(r["start"], np.frombuffer(r["docs"], "<i8", n_docs), np.frombuffer(r["docs"], "u1", n_docs, 8 * n_docs), np.frombuffer(r["docs"], "<u8", n_docs, 9 * n_docs), ids, freq)
                yield pa.RecordBatch.from_pylist([{"part": r["part"], "seq": r["seq"], "start": r["start"], "n_tokens": r["n_tokens"], "payload": payload}], schema=_BLOCK)

    # each task reads its blocks where they lie; only their starts are joined, a few bytes a block
    joined = blocks.drop("counts").join(F.broadcast(starts), ["part", "seq"]) if sizes.count() <= BROADCAST_BLOCKS else blocks.drop("counts").join(starts, ["part", "seq"])
    joined.mapInArrow(pack, "part long, seq long, start long, n_tokens long, payload binary").write.mode("overwrite").option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(json.dumps(counts.tolist()),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/table")
    work.release()


#: Block starts (24 bytes each) are broadcast up to so many blocks; beyond, they are joined by shuffle.
BROADCAST_BLOCKS = 100_000
_BLOCK = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])


def table_row(part, seq, n, docs, ids, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "n_tokens": n, "docs": docs, "ids": ids, "counts": counts}], schema=_RAW)


def _sum_counts(raw: DataFrame) -> np.ndarray:
    """Counts of all ids, as many numbers as the vocabulary has ids; summed on executors by slices."""

    def slices(batches):
        total = None
        for b in batches:
            for c in b.column(0).to_pylist():
                x = np.frombuffer(c, "<i8")
                total = x.copy() if total is None else total + x
        if total is not None:
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, len(total))), pa.array(np.append(total[seen], 0))], names=["id", "n"])

    rows = raw.where("seq < 0").select("counts").mapInArrow(slices, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = np.asarray(rows["id"]), np.asarray(rows["n"])
    out = np.zeros(int(ids.max()) if len(ids) else 0, np.int64)
    real = ids < len(out)
    out[ids[real]] = n[real]
    return out


_TABLES: dict[bytes, Table] = {}


def _table(counts: np.ndarray) -> Table:
    key = counts.tobytes()
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Table(counts)
    return _TABLES[key]


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of each document, decoded block by block; ids as unsigned 32-bit little-endian."""
    counts = np.array(json.loads("".join(r["value"] for r in spark.read.text(f"{path}/table").collect()) or "[]"), dtype=np.int64)  # one number for each id of the vocabulary
    t = spark.sparkContext.broadcast(counts)

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = _table(t.value)
        for b in batches:
            for raw in b.column(0).to_pylist():
                start, doc_ids, valid, lengths, ids = unpack_block(raw, freq)
                ends = np.cumsum(lengths)
                flat = ids.astype("<u4").tobytes()
                rows = [flat[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=~valid), pa.array(start + ends - lengths), pa.array(lengths), pa.array(rows, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    common.small_batches(spark, 16)
    blocks = spark.read.schema("payload binary").parquet(f"{path}/blocks")
    return blocks.mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids binary")
