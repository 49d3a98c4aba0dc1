"""Language-model scores from an Elias-Fano n-gram trie.

The model is a bigram model with back-off. Its lower order is the add-a-half
distribution over single tokens; a pair that was seen has its relative frequency,
less an absolute discount, and the mass that discounts leave goes to the other tokens
in proportion to the lower order, renormalised for each context.

The trie has two levels. The first holds the contexts (all training words) as a
monotone sequence, with counts, quantised back-off weights and pointers to the
second, which holds the successors of each context, made monotone by adding the
context's place times the number of words; both sequences and the pointers are
Elias-Fano coded. Words are 64-bit hashes, also wherever they are counted; within a
trie the successors are ranks in its own list of them. A lookup finds a context,
then searches its successors for the word. Log ratios of pair and lower-order
probability are quantised to 256 values.

A corpus needs many tries: contexts are dealt to shards by hash. All that a token
adds to a text's score depends on its context's shard alone,

    log p(text) = sum log p1(w) + sum over known pairs of log(p(w|v) / p1(w))
                                + sum over other pairs of log backoff(v),

and since each word is the context of what follows it, the first sum gathers there
too.

Counting takes two passes. The first counts single words and lists the few that are
so frequent that they need care. The second counts pairs where their second word is
counted, so that each pair meets its word's count without a join; pairs with a
frequent second word are dealt by both words and take its count from the list. They
then move, each once, to their context's shard. All pairs are kept.

For scoring, tokens travel to their shards in packed blocks, under the number of the
batch of texts they come from; each shard answers with sums for the texts of a batch,
and these meet the batch's ids again. A shard that gets too many tokens is read by
several tasks, each with its own copy of the (compact) trie.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

U64 = np.uint64
ID_BITS = 64
#: Ids of the begin and the end of a text; words have hashes.
BEGIN, END = 0, 1
#: What a pair's count is lowered by.
DISCOUNT = 0.75
BATCH_BYTES = 8 << 20
#: Bytes of text for each shard, and tokens that one task scores.
SHARD_BYTES, SHARD_TOKENS = 12_000_000, 2_000_000
LEAST_SHARDS = 64
#: A word is frequent if it occurs so often for each byte of all texts. As a token and its separator
#: have two bytes or more, no corpus has more than half as many frequent words as this.
FREQUENT_SHARE = 1 << 15
FREQUENT_LEAST = 64


# ------------------------------------------------------------------ Elias-Fano
class EliasFano:
    """A monotone sequence of integers: low bits packed, high bits in unary.

    Both stay mapped; in memory there are the places of the unary code's zeros, four bytes for each
    bucket of high bits, and of its ones where values are read by place.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self._zeros = _places(np.unpackbits(high, bitorder="little") == 0)

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[int, np.ndarray, np.ndarray]:
        """(low bits, packed low parts, unary high parts)."""
        n = len(values)
        low_bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low_bits = min(low_bits, 56)
        values = values.astype(U64)
        low = values & U64((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits, dtype=U64)) & U64(1)).astype(np.uint8)
        packed = np.append(np.packbits(bits.reshape(-1), bitorder="little"), np.zeros(8, np.uint8))
        high = (values >> U64(low_bits)).astype(np.int64)
        top = (universe >> low_bits) + 1
        unary = np.zeros(n + top + 1, np.uint8)
        unary[high + np.arange(n)] = 1
        return low_bits, packed, np.packbits(unary, bitorder="little")

    def lows(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), U64)
        bit = at.astype(np.int64) * self.low_bits
        byte = bit >> 3
        word = np.zeros(len(at), U64)
        for k in range(8):
            word |= self.low[byte + k].astype(U64) << U64(8 * k)
        return (word >> (bit & 7).astype(U64)) & U64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at places."""
        ones = self._ones()
        return ((ones[at].astype(np.int64) - at).astype(U64) << U64(self.low_bits)) | self.lows(at)

    def _ones(self) -> np.ndarray:
        if not hasattr(self, "_one"):
            self._one = _places(np.unpackbits(self.high, bitorder="little"))
        return self._one

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where the sequence doesn't have it: successor search within its bucket of high bits."""
        high = (keys >> U64(self.low_bits)).astype(np.int64)
        want = keys & U64((1 << self.low_bits) - 1)
        inside = high < len(self._zeros)
        high = np.where(inside, high, 0)
        lo = np.where(high > 0, self._zeros[np.maximum(high - 1, 0)].astype(np.int64) - (high - 1), 0)
        end = self._zeros[high].astype(np.int64) - high
        hi = end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self.lows(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        found = inside & (lo < end)
        at = np.flatnonzero(found)
        found[at] = self.lows(lo[at]) == want[at]
        return np.where(found, lo, -1)


def _places(bits: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(bits)
    return at.astype(np.uint32) if len(bits) < 1 << 32 else at


def quantise(values: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(codes, centres): the values themselves if they are few, else equally filled bins, each with its mean."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.float32)
    if len(values) <= levels:
        some, code = np.unique(values, return_inverse=True)
        return code.astype(np.uint8), some.astype(np.float32)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, levels + 1)[1:-1]))
    code = np.searchsorted(edges, values, "right")
    n = np.bincount(code, minlength=len(edges) + 1)
    centres = np.bincount(code, weights=values, minlength=len(edges) + 1) / np.maximum(n, 1)
    return code.astype(np.uint8), centres.astype(np.float32)


class Trie:
    """One shard: contexts, their successors and quantised values, in one block of bytes."""

    @staticmethod
    def build(context: np.ndarray, count: np.ndarray, backoff: np.ndarray, first: np.ndarray, successor: np.ndarray, gain: np.ndarray) -> bytes:
        """Contexts ascending; ``first`` has where each one's successors (ascending within it) begin, and the end."""
        owner = np.repeat(np.arange(len(context)), np.diff(first))
        words, rank = np.unique(successor, return_inverse=True)
        levels = [
            EliasFano.encode(context, 1 << ID_BITS),
            EliasFano.encode(first, int(first[-1]) + 1),
            EliasFano.encode(words, 1 << ID_BITS),
            EliasFano.encode(owner * len(words) + rank, max(1, len(context) * len(words))),
        ]
        codes = [quantise(np.log10(backoff)), quantise(gain)]
        parts: list[np.ndarray] = []
        head = [len(context), len(words), len(successor)]
        for low_bits, low, high in levels:
            head += [low_bits, len(low), len(high)]
            parts += [low, high]
        for code, centres in codes:
            head += [len(code), len(centres)]
            parts += [code, centres.view(np.uint8)]
        parts.append(count.astype("<u8").view(np.uint8))
        return np.array(head, "<i8").tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    def __init__(self, raw: bytes):
        with tempfile.TemporaryFile() as f:  # the mapping outlives the file's name and the worker's copy of the bytes
            f.write(raw)
            f.flush()
            data = np.memmap(f, np.uint8, "r")
        head = np.frombuffer(data[: 8 * 19].tobytes(), "<i8").tolist()
        at = 8 * 19

        def take(n: int) -> np.ndarray:
            nonlocal at
            at += n
            return data[at - n : at]

        n_context, n_words, n_successor = head[:3]
        sequences = []
        for i, n in enumerate((n_context, n_context + 1, n_words, n_successor)):
            low_bits, n_low, n_high = head[3 + 3 * i : 6 + 3 * i]
            sequences.append(EliasFano(n, low_bits, take(n_low), take(n_high)))
        self.contexts, self.pointers, self.words, self.successors = sequences
        tables = []
        for i in range(2):
            n_code, n_centre = head[15 + 2 * i : 17 + 2 * i]
            tables.append((take(n_code), np.frombuffer(take(4 * n_centre).tobytes(), "<f4").astype(np.float64)))
        (self.backoff_code, self.backoffs), (self.gain_code, self.gains) = tables
        self.count = np.frombuffer(take(8 * n_context).tobytes(), "<u8")

    def lookup(self, v: np.ndarray, size: np.ndarray, words: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count of each context, log10 p(w|v) - log10 p1(w)) of tokens in runs: ``size`` of them follow each v, each w a place in words."""
        node = self.contexts.find(v)
        known = np.flatnonzero(node >= 0)
        at = node[known]
        count, value = np.zeros(len(v)), np.zeros(len(v))
        count[known] = self.count[at]
        value[known] = self.backoffs[self.backoff_code[at]]
        count, value = np.repeat(count, size), np.repeat(value, size)
        if self.successors.n:
            has = np.zeros(len(v), bool)
            has[known] = self.pointers.get(at) < self.pointers.get(at + 1)
            rank = self.words.find(words)[w]
            some = np.flatnonzero(np.repeat(has, size) & (rank >= 0))
            pair = self.successors.find((np.repeat(node, size)[some] * self.words.n + rank[some]).astype(U64))
            hit = pair >= 0
            value[some[hit]] = self.gains[self.gain_code[pair[hit]]]
        return count, value


# ------------------------------------------------------------------ tokens
def _tokens(batch: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, text) of every token: a text's words and its end."""
    buf, starts, _ = common.text_bytes(batch.column("text"))
    words = common.Words(common.lower_ascii(buf), starts, common.BLANK_SEPARATED)
    h = words.hashes()
    h = np.where(h <= END, h + U64(2), h)
    n = words.count + 1
    ends = np.cumsum(n)
    w = np.full(int(ends[-1]), END, U64)
    inside = np.arange(len(h)) + np.repeat(np.arange(len(starts)), words.count)
    w[inside] = h
    v = np.concatenate((np.array([BEGIN], U64), w[:-1]))
    v[ends[:-1]] = BEGIN
    return v, w, np.repeat(np.arange(len(starts)), n)


_ZSTD = pa.Codec("zstd", 1)


def _pack_small(x: np.ndarray) -> bytes:
    """Counts or places in as few bytes as the largest needs, compressed byte by byte: the upper ones differ little."""
    kind = _place_type(int(x.max(initial=0)) + 1) if x.max(initial=0) < 1 << 32 else "<u8"
    planes = x.astype(kind).view(np.uint8).reshape(len(x), -1).T
    packed = [_ZSTD.compress(np.ascontiguousarray(p), asbytes=True) if len(x) > 64 else p.tobytes() for p in planes]
    return np.array([len(packed), *map(len, packed)], "<u4").tobytes() + b"".join(packed)


def _unpack_small(raw: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    width = int(np.frombuffer(raw, "<u4", 1, at)[0])
    sizes = np.frombuffer(raw, "<u4", width, at + 4).tolist()
    at += 4 + 4 * width
    planes = np.empty((n, width), np.uint8)
    for i, size in enumerate(sizes):
        part = raw[at : at + size]
        planes[:, i] = np.frombuffer(_ZSTD.decompress(part, n) if n > 64 else part, np.uint8)
        at += size
    return planes.view(f"<u{width}").reshape(n).astype(np.int64), at


def _place_type(n: int) -> str:
    return "<u1" if n <= 1 << 8 else "<u2" if n <= 1 << 16 else "<u4"


def _pack(x: np.ndarray) -> bytes:
    """Numbers as places in a list of the different ones."""
    used, local = np.unique(x, return_inverse=True)
    return np.array([len(used)], "<i8").tobytes() + used.astype("<u8").tobytes() + _pack_small(local)


def _unpack(raw: bytes, at: int, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The different numbers, n places in them, and where they end."""
    n_used = int(np.frombuffer(raw, "<i8", 1, at)[0])
    used = np.frombuffer(raw, "<u8", n_used, at + 8)
    local, at = _unpack_small(raw, at + 8 + 8 * n_used, n)
    return used, local, at


def shard_of(v: np.ndarray, shards: int) -> np.ndarray:
    return (common.mix(v + U64(0x632BE59B)) % U64(shards)).astype(np.int64)


def _parts(group: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each group that occurs, and the places of its members."""
    order = np.argsort(group, kind="stable")
    bounds = np.searchsorted(group[order], np.arange(groups + 1))
    for g in np.flatnonzero(np.diff(bounds)).tolist():
        yield g, order[bounds[g] : bounds[g + 1]]


def _rows(names: list[str], rows: list[tuple], binary: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if n == binary else pa.int64()) for i, n in enumerate(names)], names=names)


# ------------------------------------------------------------------ pass 1: single words
def _count_words(groups: int):
    """How often each word occurs in a batch, and in its training texts; by the word's shard."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.text_batches(batches, "text", BATCH_BYTES):
            _, w, doc = _tokens(b)
            learn = np.asarray(b.column("training"))[doc]
            word, at, n = np.unique(w, return_inverse=True, return_counts=True)
            seen = np.bincount(at, weights=learn, minlength=len(word)).astype(np.int64)
            some = word != END  # as many as texts
            word, n, seen = word[some], n[some], seen[some]
            rows = [(g, np.array([len(p)], "<i8").tobytes() + word[p].astype("<u8").tobytes() + _pack_small(n[p]) + _pack_small(seen[p])) for g, p in _parts(shard_of(word, groups), groups)]
            yield _rows(["grp", "entries"], rows, "entries")

    return run


def _sum_words(frequent_from: int):
    """A group's load (all tokens), its training tokens and types, and its frequent words with their training counts."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ws, ns, seens = [], [], []
        for raw in t.column("entries").to_pylist():
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            ws.append(np.frombuffer(raw, "<u8", n, 8))
            count, at = _unpack_small(raw, 8 + 8 * n, n)
            ns.append(count)
            seens.append(_unpack_small(raw, at, n)[0])
        word, at = np.unique(np.concatenate(ws), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(ns)).astype(np.int64)
        seen = np.bincount(at, weights=np.concatenate(seens)).astype(np.int64)
        often = n >= frequent_from
        common.trim()
        cols = [[t.column("grp")[0].as_py()], [int(n.sum())], [int(seen.sum())], [int((seen > 0).sum())], [word[often].view(np.int64).tolist()], [seen[often].tolist()]]
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, _SUMS)], schema=_SUMS)

    return run


_SUMS = pa.schema([("shard", pa.int64()), ("load", pa.int64()), ("tokens", pa.int64()), ("types", pa.int64()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


# ------------------------------------------------------------------ pass 2: pairs
def _count_pairs(groups: int, frequent):
    """Counts of a batch's pairs, by the shard of the second word, or of the pair where that word is frequent."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value[0]
        for b in common.text_batches(batches, "text", BATCH_BYTES):
            v, w, n = _merged(*_tokens(b)[:2])
            rows = [(g, _pack_pairs(v[p], w[p], n[p])) for g, p in _parts(np.where(_among(w, often) >= 0, shard_of(_pair(v, w), groups), shard_of(w, groups)), groups)]
            yield _rows(["grp", "entries"], rows, "entries")

    return run


def _pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return common.mix(common.mix(v + U64(7)) + w)


def _merged(v: np.ndarray, w: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs with their summed counts. In case of equal hashes a pair may stay in two parts; ``_build`` adds these up."""
    order = np.argsort(_pair(v, w))
    v, w = v[order], w[order]
    first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])))) if len(v) else np.zeros(0, np.int64)
    total = np.diff(np.append(first, len(v))) if n is None else np.add.reduceat(n[order], first) if len(v) else n
    return v[first], w[first], total


def _among(x: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Place of each x in an ascending list, or -1."""
    if not len(listed):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(listed, x), len(listed) - 1)
    return np.where(listed[at] == x, at, -1)


def _pack_pairs(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    return np.array([len(v)], "<i8").tobytes() + _pack(v) + _pack(w) + _pack_small(n)


def _unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    v, v_at, at = _unpack(raw, 8, n)
    w, w_at, at = _unpack(raw, at, n)
    count, at = _unpack_small(raw, at, n)
    return v[v_at], w[w_at], count, at


def _total_pairs(shards: int, frequent):
    """A group's pairs with their counts and those of their second words, packed by the shard of the first."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        listed, counts = frequent.value
        v, w, n = _merged(*[np.concatenate(c) for c in zip(*[_unpack_pairs(raw)[:3] for raw in t.column("entries").to_pylist()])])
        words, at = np.unique(w, return_inverse=True)
        of_word = np.bincount(at, weights=n).astype(np.int64)
        place = _among(words, listed)
        of_word = np.where(place >= 0, counts[np.maximum(place, 0)], of_word) if len(listed) else of_word
        rows = []
        for g, p in _parts(shard_of(v, shards), shards):
            used, local = np.unique(at[p], return_inverse=True)
            rows.append((g, np.array([len(p)], "<i8").tobytes() + _pack(v[p]) + _pack(w[p]) + _pack_small(n[p]) + _pack_small(of_word[used])))
        common.trim()
        return pa.Table.from_batches([_rows(["shard", "entries"], rows, "entries")])

    return run


def _build(n_tokens: int, n_types: int):
    """One shard's trie from its pairs with the counts of their second words."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        vs, ws, ns, wns = [], [], [], []
        for raw in t.column("entries").to_pylist():
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            v, v_at, at = _unpack(raw, 8, n)
            w, w_at, at = _unpack(raw, at, n)
            count, at = _unpack_small(raw, at, n)
            of_word, _ = _unpack_small(raw, at, len(w))
            for into, x in ((vs, v[v_at]), (ws, w[w_at]), (ns, count), (wns, of_word[w_at])):
                into.append(x)
        v, w, n, wn = (np.concatenate(c) for c in (vs, ws, ns, wns))
        order = np.lexsort((w, v))
        v, w, n, wn = v[order], w[order], n[order], wn[order]
        first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]))))
        n = np.add.reduceat(n, first)
        v, w, wn = v[first], w[first], wn[first]
        lead = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        count = np.add.reduceat(n, lead)
        size = np.diff(np.append(lead, len(v)))
        lower = (wn + 0.5) / (n_tokens + 0.5 * (n_types + 1))
        higher = (n - DISCOUNT) / np.repeat(count, size)
        backoff = np.maximum(1e-9, (DISCOUNT * size / count) / np.maximum(1e-9, 1 - np.add.reduceat(lower, lead)))
        raw = Trie.build(v[lead], count, backoff, np.append(lead, len(v)), w, np.log10(higher) - np.log10(lower))
        common.trim()
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "trie": pa.array([raw], pa.binary())})

    return run


# ------------------------------------------------------------------ scoring
_ASKED = "shard long, copy long, batch long, seal long, asked binary, docs binary, trie binary"
_ANSWERED = "batch long, seal long, sums binary, docs binary"


def _ask(shards: int, spread):
    """Every token, packed by the shard of its context; ``spread`` tasks share a shard.

    A batch is known by its number and by a hash of its rows: should a lost task's input come in another
    order when it runs again, the batches don't mix.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        copies = spread.value
        part = TaskContext.get().partitionId()
        for turn, b in enumerate(common.text_batches(batches, "text", BATCH_BYTES)):
            v, w, doc = _tokens(b)
            batch = (part << 32) | turn
            h = np.asarray(b.column("h"), np.int64).view(U64)
            seal = int(common.mix(common.mix(h + np.arange(len(h), dtype=U64)).sum(dtype=U64, keepdims=True)).view(np.int64)[0])
            n_tokens = np.bincount(doc, minlength=b.num_rows)
            order = np.argsort(v, kind="stable")
            v, w, doc = v[order], w[order], doc[order]
            lead = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
            runs = np.diff(np.append(lead, len(v)))
            rows = []
            for s, p in _parts(shard_of(v[lead], shards), shards):
                size = runs[p]
                take = np.arange(int(size.sum())) + np.repeat(lead[p] - (np.cumsum(size) - size), size)
                raw = b"".join([np.array([len(p), len(take)], "<i8").tobytes(), v[lead[p]].astype("<u8").tobytes(), _pack_small(size), _pack(w[take]), _pack_small(doc[take])])
                rows.append((s, int((part + turn + s) % copies[s]), batch, seal, raw, None))
            sealed = pa.RecordBatch.from_arrays([b.column("doc_id").combine_chunks(), b.column("training").combine_chunks(), pa.array(n_tokens)], names=["doc_id", "training", "n_tokens"])
            s = batch % shards
            rows.append((s, int((part + turn) % copies[s]), batch, seal, None, np.array([len(rows)], "<i8").tobytes() + sealed.serialize().to_pybytes()))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)] + [pa.array([r[i] for r in rows], pa.binary()) for i in (4, 5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.binary())], names=["shard", "copy", "batch", "seal", "asked", "docs", "trie"])

    return run


def _answer(key: tuple, t: pa.Table) -> pa.Table:
    """For each batch, sums for its texts over the tokens whose contexts lie in this shard; lists of ids pass through."""
    tries = t.column("trie").drop_null().to_pylist()
    trie = Trie(tries[0]) if tries else None
    out: list[tuple] = []
    for batch, seal, raw, docs in zip(*[t.column(c).to_pylist() for c in ("batch", "seal", "asked", "docs")]):
        if raw is None:
            if docs is not None:
                out.append((batch, seal, None, docs))
            continue
        n_v, n = np.frombuffer(raw, "<i8", 2).tolist()
        v = np.frombuffer(raw, "<u8", n_v, 16)
        size, at = _unpack_small(raw, 16 + 8 * n_v, n_v)
        words, w, at = _unpack(raw, at, n)
        doc, _ = _unpack_small(raw, at, n)
        count, value = trie.lookup(v, size, words, w) if trie else (np.zeros(n), np.zeros(n))
        word = np.repeat(v, size) != BEGIN  # each word once, as the context of what follows; ends are added for each text
        used, doc = np.unique(doc, return_inverse=True)
        sums = [np.bincount(doc, weights=x, minlength=len(used)) for x in (word & (count > 0), np.where(word, np.log10(count + 0.5), 0), value)]
        packed = b"".join([np.array([len(used)], "<i8").tobytes(), _pack_small(used), _pack_small(sums[0].astype(np.int64)), sums[1].astype("<f8").tobytes(), sums[2].astype("<f4").tobytes()])
        out.append((batch, seal, packed, None))
    common.trim()
    columns = [pa.array([r[i] for r in out], pa.int64()) for i in (0, 1)] + [pa.array([r[i] for r in out], pa.binary()) for i in (2, 3)]
    return pa.Table.from_arrays(columns, names=["batch", "seal", "sums", "docs"])


def _gather(key: tuple, t: pa.Table) -> pa.Table:
    """The texts of one batch with their sums."""
    lists = t.column("docs").drop_null().to_pylist()
    answers = t.column("sums").drop_null().to_pylist()
    if len(lists) != 1 or int(np.frombuffer(lists[0], "<i8", 1)[0]) != len(answers):
        raise RuntimeError("answers don't fit their batch: the order of the input changed while tasks ran again")
    docs = pa.ipc.read_record_batch(pa.py_buffer(lists[0][8:]), _DOCS)
    known, logs, gain = (np.zeros(docs.num_rows) for _ in range(3))
    for raw in answers:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        doc, at = _unpack_small(raw, 8, n)
        more, at = _unpack_small(raw, at, n)
        known[doc] += more
        logs[doc] += np.frombuffer(raw, "<f8", n, at)
        gain[doc] += np.frombuffer(raw, "<f4", n, at + 8 * n)
    return pa.Table.from_arrays([*docs.columns, pa.array(known.astype(np.int64)), pa.array(logs), pa.array(gain)], names=[*_DOCS.names, "known", "logs", "gain"])


_DOCS = pa.schema([("doc_id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64())])


def score_texts(docs: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, training, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``training`` (a function of the id column) says which rows the model learns from; a null counts as
    no. base_score is the lower order's log10 probability of the text, score the model's.

    * null and empty texts have one token, the end; without training rows all tokens are unknown
    * ids, null or repeated, pass through: each row is scored by itself, and each training row counts
    * an empty table gives no rows; other columns are not read
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    work = common.Workspace(spark, "trie-lm")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(training(F.col(id_col)), F.lit(False)).alias("training"), text.alias("text"))
    facts = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.count_if("training").alias("n"), F.count(F.lit(1)).alias("rows")).first()
    parts = common.shuffle_parts(spark)
    shards = max(LEAST_SHARDS, parts, facts["bytes"] // SHARD_BYTES)

    words = rows.select("training", "text").mapInArrow(_count_words(shards), "grp long, entries binary").groupBy("grp")
    sums = words.applyInArrow(_sum_words(max(FREQUENT_LEAST, facts["bytes"] // FREQUENT_SHARE)), "shard long, load long, tokens long, types long, words array<long>, counts array<long>").collect()  # a row for each shard, half of FREQUENT_SHARE words
    n_ends = facts["n"]
    n_tokens, n_types = sum(r["tokens"] for r in sums) + n_ends, sum(r["types"] for r in sums) + (n_ends > 0)
    often = {END: n_ends} | {int(np.int64(w).view(U64)): n for r in sums for w, n in zip(r["words"], r["counts"])}
    frequent = spark.sparkContext.broadcast((np.array(sorted(often), U64), np.array([often[w] for w in sorted(often)], np.int64)))
    copies = np.ones(shards, np.int64)
    for r in sums:
        copies[r["shard"]] = max(1, -(-r["load"] // SHARD_TOKENS))
    begin = int(shard_of(np.array([BEGIN], U64), shards)[0])
    copies[begin] = max(copies[begin], -(-facts["rows"] // SHARD_TOKENS))
    common.release_shuffles(spark)

    counted = rows.where("training").select("text").mapInArrow(_count_pairs(shards, frequent), "grp long, entries binary")
    moved = counted.groupBy("grp").applyInArrow(_total_pairs(shards, frequent), "shard long, entries binary")
    tries = work.save(moved.groupBy("shard").applyInArrow(_build(n_tokens, n_types), "shard long, trie binary"), "tries")
    del counted, moved, words
    common.release_shuffles(spark)

    spread = spark.sparkContext.broadcast(copies)
    own = rows.select("doc_id", "training", "text", F.xxhash64("doc_id", "training", "text").alias("h"))
    asked = own.mapInArrow(_ask(shards, spread), _ASKED)
    extra = spark.createDataFrame([(s, int(c)) for s, c in enumerate(copies) if c > 1], "shard long, copies long")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    models = tries.join(F.broadcast(extra), "shard", "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)).alias("copy"), none("batch", "long"), none("seal", "long"), none("asked", "binary"), none("docs", "binary"), "trie")
    answers = asked.unionByName(models).groupBy("shard", "copy").applyInArrow(_answer, _ANSWERED)
    texts = answers.groupBy("batch", "seal").applyInArrow(_gather, "doc_id long, training boolean, n_tokens long, known long, logs double, gain double")
    base = F.col("logs") + log10(n_ends + 0.5) - F.col("n_tokens") * log10(n_tokens + 0.5 * (n_types + 1))
    return texts.select("doc_id", "training", "n_tokens", (F.col("known") + (1 if n_ends else 0)).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
