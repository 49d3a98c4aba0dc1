"""Sets of word shingles, as 51-bit hashes, with digests and parity sketches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from . import common

U64 = np.uint64
#: Bits of the smallest sketch; see ``sketch_class``.
SKETCH_BITS = 512
HASH_BITS = 51
_HASH = U64((1 << HASH_BITS) - 1)
_DOCS_A_BATCH = 2048


class Sets:
    """Distinct shingles of some texts: ``key`` = text (12 bits), frequent or not (1 bit), hash (51 bits), ascending."""

    def __init__(self, texts, k: int, frequent: np.ndarray | None):
        buf, starts, _ = common.text_bytes(texts)
        words = common.Words(common.lower_ascii(buf), starts, common.BLANK_SEPARATED)
        h = words.hashes()
        at = common.window_starts(words.count, words.first, k)
        tokens, doc = common.rolling(h, k)[at], words.doc[at]
        for n in range(1, k):  # fewer words: the whole sequence
            few = np.flatnonzero(words.count == n)
            if len(few):
                tokens = np.concatenate((tokens, common.rolling(h, n, seed=50 + n)[words.first[few]]))
                doc = np.concatenate((doc, few))
        tokens = tokens >> U64(64 - HASH_BITS)
        self.all = tokens
        key = (doc.astype(U64) << U64(52)) | tokens
        if frequent is not None:
            key |= frequent[(tokens >> U64(HASH_BITS - 20)).astype(np.int64)].astype(U64) << U64(51)
        key = np.sort(key)
        self.key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
        self.doc = (self.key >> U64(52)).astype(np.int64)
        self.n = np.bincount(self.doc, minlength=len(starts))
        self.first = np.cumsum(self.n) - self.n
        self.token = self.key & _HASH

    def digests(self) -> np.ndarray:
        out = np.zeros(len(self.n), U64)
        some = self.n > 0
        if some.any():
            out[some] = np.add.reduceat(common.mix(self.token + U64(1)), self.first[some])
        return common.mix(out + self.n.astype(U64))

    def sketches(self, percent: int) -> list[bytes]:
        """Parity sketches: a token flips one bit, chosen by the low bits of a hash, so halves fold together."""
        h = common.mix(self.token ^ U64(0x5BD1E995))
        kind = sketch_class(self.n, percent)
        out: list[bytes] = [b""] * len(self.n)
        for k in np.unique(kind).tolist():
            docs = np.flatnonzero(kind == k)
            bits = SKETCH_BITS << k
            local = np.full(len(self.n), -1)
            local[docs] = np.arange(len(docs))
            mine = local[self.doc] >= 0
            at = local[self.doc[mine]] * bits + (h[mine] & U64(bits - 1)).astype(np.int64)
            parity = (np.bincount(at, minlength=len(docs) * bits) & 1).astype(np.uint8).reshape(len(docs), bits)
            for d, raw in zip(docs.tolist(), np.packbits(parity, axis=1)):
                out[d] = raw.tobytes()
        return out


def sketch_class(n: np.ndarray, percent: int) -> np.ndarray:
    """How often the smallest sketch doubles for sets of n tokens.

    Sketches of unrelated sets differ in half of their bits; that half must exceed by a fifth or
    more what sets that link may differ in, 2n(100 - percent) / (100 + percent).
    """
    most = n * (2.0 * (100 - percent) / (100 + percent))
    return np.ceil(np.log2(np.maximum(1.0, 2.6 * most / SKETCH_BITS))).astype(np.int64)


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    for b in common.text_batches(batches, "text"):
        for at in range(0, b.num_rows, _DOCS_A_BATCH):
            yield b.slice(at, _DOCS_A_BATCH)
