"""Byte-level BPE encoding and decoding as a monoid tree reduction.

An element is a stretch of text with its token ids. Encoding halves a text until a
stretch is short, encodes the stretches by themselves, and joins neighbours on the
way up. A join re-encodes a window around the seam and keeps everything outside.

The window grows until both of its ends are *certain* seams: places before a white
space that follows something other than white space. No alternative of the
splitting pattern continues from a non-space into white space, and none looks
behind, so such a place ends a match in every context, and what follows depends
only on what follows. Tokens outside the window are therefore final. Where no such
place exists the window grows to the element's own end.

Decoding concatenates the bytes of halves up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Characters that are encoded without halving.
LEAF_CHARS = 128
#: Texts are worked on in groups of about so many bytes.
BATCH_BYTES = 1 << 20
#: First width of a window on either side of a seam; doubled until both ends are certain.
WINDOW_CHARS = 32


class TreeCodec:
    """Encoder and decoder over a rank file; ``pattern`` splits text before the merges."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self._enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf, self.window = leaf, window
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    # -- encoding
    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._stretch(text, lo, hi)
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    def _stretch(self, text: str, lo: int, hi: int) -> np.ndarray:
        return np.array(self._enc.encode_ordinary(text[lo:hi]), dtype=np.uint32)

    @staticmethod
    def _certain(text: str, at: int) -> bool:
        return text[at] in " \n\t\r" and not text[at - 1].isspace()

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        p, width = mid, self.window
        while p > lo and not (p < mid and self._certain(text, p)):  # leftwards, in growing windows
            p = next((i for i in range(min(p, mid) - 1, max(mid - width, lo), -1) if self._certain(text, i)), max(mid - width, lo))
            width *= 2
        q, width = mid, self.window
        while q < hi and not self._certain(text, q):
            q = next((i for i in range(q, min(mid + width, hi)) if self._certain(text, i)), min(mid + width, hi))
            width *= 2
        keep = len(left) - self._tokens(left[::-1], len(text[p:mid].encode()))
        skip = self._tokens(right, len(text[mid:q].encode()))
        return np.concatenate((left[:keep], self._stretch(text, p, q), right[skip:]))

    def _tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many tokens from the front have n_bytes bytes; n_bytes ends at a token's end."""
        if not n_bytes:
            return 0
        return int(np.searchsorted(np.cumsum(self.length[ids[: n_bytes]]), n_bytes)) + 1

    # -- decoding
    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            table = self.bytes_of
            return b"".join([table[i] for i in ids.tolist()])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_CODECS: dict[tuple[str, str], TreeCodec] = {}


def codec(ranks_path: str, pattern: str) -> TreeCodec:
    """One codec per worker process and rank file."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = TreeCodec(ranks_path, pattern)
    return _CODECS[ranks_path, pattern]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids`` per row; ids are little-endian unsigned 32-bit integers.

    ``decode`` adds ``decoded``, the bytes that the ids stand for, in the same pass: one Python worker a
    task instead of two. Null and empty texts give no ids. Ids, null or repeated, pass through, one row
    for each input row; other columns are not read.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(ranks_path, pattern)
        for b in common.text_batches(batches, "text", BATCH_BYTES):
            found = [enc.encode(t or "") for t in b.column("text").to_pylist()]
            columns = [b.column("doc_id").combine_chunks(), pa.array([len(x) for x in found], pa.int64()), common.binary_rows(found, "<u4")]
            if decode:
                columns.append(pa.array([enc.decode(x) for x in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decode)


def bpe_decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``encoded`` with the column ``decoded`` (binary). Null ids decode to no bytes."""
    common.small_batches(encoded.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = codec(ranks_path, pattern)
        for b in batches:
            ids = b.column(b.schema.get_field_index("ids")).to_pylist()
            out = pa.array([enc.decode(np.frombuffer(x or b"", dtype="<u4")) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "decoded"])

    from pyspark.sql import types as T

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
