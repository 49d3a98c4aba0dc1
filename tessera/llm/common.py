"""Shared pieces of the text operators: work folders, byte-level word splitting and hashing.

Word splitting works on UTF-8 bytes with NumPy: every separator of the supported
word classes is a single ASCII byte, so a byte mask finds the same words as the
regular expressions of the contracts, whatever the script of the text.
"""

from __future__ import annotations

import gc
import re
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  binds pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Texts are worked on in groups of about so many bytes.
CHUNK_BYTES = 4 << 20

# The finaliser constants of the public SplitMix64 generator.
_MIX_STEP, _MIX_A, _MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


# ------------------------------------------------------------------ work folders
def work_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is set and all runs in one process (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Tables written to the shared folder, to cut lineage and to reuse results.

    A folder lives as long as the session's JVM unless its owner calls ``release``;
    results that an operator returns may still read from it.
    """

    _open: list["Workspace"] = []
    _recorders: list[list["Workspace"]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        Workspace._open.append(self)
        for made in Workspace._recorders:
            made.append(self)

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")

    def release(self) -> None:
        self._delete(self.path)
        if self in Workspace._open:
            Workspace._open.remove(self)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def recorded() -> Iterator[list[Workspace]]:
    """A list of the work folders that are opened meanwhile, for a caller who knows when their results are written."""
    made: list[Workspace] = []
    Workspace._recorders.append(made)
    try:
        yield made
    finally:
        Workspace._recorders.remove(made)


def release_shuffles(spark) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    What one collection frees may hold the last reference to more, hence several, with a moment for the
    cleaner's messages to the executors.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that long texts can't fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


# ------------------------------------------------------------------ batches
def text_batches(
    batches: Iterable[pa.RecordBatch], column: str, target: int = CHUNK_BYTES
) -> Iterator[pa.Table]:
    """Regroup Arrow batches so that each has about ``target`` bytes of text (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column))
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        start, run = 0, 0
        for cut in _cuts(lengths, target, size):
            held.append(b.slice(start, cut - start))
            yield pa.Table.from_batches(held)
            held, size, start = [], 0, cut
        if start < b.num_rows:
            run = int(lengths[start:].sum())
            held.append(b.slice(start))
            size += run
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    trim()


def _cuts(lengths: np.ndarray, target: int, held: int) -> list[int]:
    out, run = [], held
    for i, n in enumerate(lengths):
        run += int(n)
        if run >= target:
            out.append(i + 1)
            run = 0
    return out


def text_bytes(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array with a newline after each; starts and byte lengths per text.

    Null texts count as empty.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
    raw = col.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if len(raw) and data is not None else np.zeros(0, np.uint8)
    starts = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths + 1, out=starts[1:])
    out = np.full(int(starts[-1]), 10, dtype=np.uint8)
    at = offsets - offsets[0]
    for to, a, z in zip(starts[:-1].tolist(), at[:-1].tolist(), at[1:].tolist()):
        out[to : to + z - a] = flat[a:z]
    return out, starts[:-1], lengths


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and nothing else."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    return out


def _class_table(separators: Iterable[int]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[list(separators)] = False
    return t


#: ``[^\x20\x09-\x0D]+``
BLANK_SEPARATED = _class_table([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (of lower-cased text)
ALNUM_WORDS = _class_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


class Words:
    """The words of several texts: byte starts and ends, and the number of words per text."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, table: np.ndarray):
        self.buf = buf
        is_word = table[buf]
        edge = np.diff(is_word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, starts)  # first word of each text
        self.count = np.diff(np.append(self.first, len(self.start)))

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: a multilinear sum with pseudo-random factors, then mixed."""
        n = len(self.start)
        if not n:
            return np.zeros(0, U64)
        lengths = self.end - self.start
        if int(lengths.max()) > _LONG_WORD:
            return self._hashes_long(seed)
        factors = _factors(seed)
        sums = np.empty(n, U64)
        for a in range(0, n, _SLICE_WORDS):  # a slice at a time: the temporary arrays have eight bytes for each byte of text
            part = lengths[a : a + _SLICE_WORDS]
            begin = np.cumsum(part) - part
            off = np.arange(int(part.sum())) - np.repeat(begin, part)
            byte = self.buf[off + np.repeat(self.start[a : a + _SLICE_WORDS], part)]
            sums[a : a + _SLICE_WORDS] = np.add.reduceat(factors[off] * (byte.astype(U64) + U64(1)), begin)
        return mix(sums + lengths.astype(U64) * _MIX_STEP)

    def _hashes_long(self, seed: int) -> np.ndarray:
        lengths = self.end - self.start
        out = np.zeros(len(lengths), U64)
        short = lengths <= _LONG_WORD
        part = object.__new__(Words)
        part.buf, part.start, part.end = self.buf, self.start[short], self.end[short]
        out[short] = part.hashes(seed)
        for i in np.flatnonzero(~short):  # words of over 4,096 bytes: block by block, chained
            h = U64(lengths[i])
            factors = _factors(seed)
            for at in range(int(self.start[i]), int(self.end[i]), _LONG_WORD):
                piece = self.buf[at : min(at + _LONG_WORD, int(self.end[i]))].astype(U64) + U64(1)
                h = mix(np.array([h * _MIX_STEP + (piece * factors[: len(piece)]).sum(dtype=U64)], U64))[0]
            out[i] = h
        return out


_LONG_WORD = 4096
_SLICE_WORDS = 1 << 15
_FACTORS: dict[int, np.ndarray] = {}


def _factors(seed: int) -> np.ndarray:
    if seed not in _FACTORS:
        _FACTORS[seed] = mix(np.arange(1, _LONG_WORD + 1, dtype=U64) * _MIX_STEP + U64(seed * 7919 + 1)) | U64(1)
    return _FACTORS[seed]


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, element by element, wrapping."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * _MIX_A
        x = (x ^ (x >> U64(27))) * _MIX_B
        return x ^ (x >> U64(31))


def rolling(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive words (len - k + 1 of them), whatever text they belong to."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        acc = np.full(n, U64(seed + 1) * _MIX_STEP, U64)
        for j in range(k):
            acc = acc + hashes[j : j + n] * (_factors(seed + 101)[j])
    return mix(acc)


def window_starts(count: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Word indexes at which a window of k words of one text starts."""
    n = np.maximum(count - k + 1, 0)
    total = int(n.sum())
    base = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return np.arange(total) + base


def trim() -> None:
    """Gives freed memory back to the system: a worker lives for many tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def binary_rows(arrays: list[np.ndarray], dtype) -> pa.Array:
    return pa.array([np.ascontiguousarray(a, dtype=dtype).tobytes() for a in arrays], pa.binary())


def table(batch: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch[f.name] if isinstance(batch[f.name], pa.Array) else pa.array(batch[f.name], f.type) for f in schema], schema=schema)


# ------------------------------------------------------------------ small relational helpers
def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(id_col, text) -> tuple["F.Column", "F.Column"]:
    """(id, h) that tell rows apart by id and text, both never null, ordered as ids are, null ids first.

    A null id has the smallest long and a negative h, any other a non-negative one; texts of one id
    are told apart by 63 bits, and a null text counts as empty.
    """
    h = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 1)
    given = id_col.cast("bigint")
    return F.coalesce(given, F.lit(-(1 << 63))), F.when(given.isNull(), -1 - h).otherwise(h)


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores before it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_mod5(column) -> "F.Column":
    """Remainder by 5 of the CRC-32 of an id as text; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % 5
