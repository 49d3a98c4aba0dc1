"""Vector code compression: product codes whose codebooks are learned by Yinyang Lloyd rounds.

Vectors become integers and are cut into equal parts; each part position has a codebook.
A round assigns every part to the nearest entry and replaces entries by their parts'
floored means. The entries of a codebook are clustered into groups. For each part of a
vector an upper bound on the distance to its own entry and, for each group, a lower bound
on the distance to the group's other entries travel with the vector from round to round:
when entries move, bounds give way by how far they moved, and only groups whose lower
bound doesn't exceed the upper one are scanned. Bounds are rounded outwards, so a group
that is passed over has no entry as near; what is scanned is compared in integers, ties to
the lower index.

Each round is one pass over the table: a task writes its vectors with their new bounds
and, as further rows, its parts' sums for each entry, which Spark adds up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a group, about.
GROUP_ENTRIES = 16
#: Labels whose sums are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 100_000
#: Vectors that are worked on together.
_ROWS = 4096
#: Distances up to here are exact in doubles, so products may go to BLAS.
_EXACT = 1 << 52


class Codebook:
    """A part position's entries, their groups and how far each entry moved since the round before."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, moved: np.ndarray):
        self.entries, self.group, self.moved = entries, group, moved
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max(initial=-1)) + 1)]


def grouped(entries: np.ndarray) -> np.ndarray:
    """Entries clustered by a few plain rounds around evenly spaced ones; groups only save work, so any will do."""
    k = max(1, -(-len(entries) // GROUP_ENTRIES))
    x = entries.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    own = np.zeros(len(x), np.int64)
    for _ in range(5):
        own = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(k):
            if (own == g).any():
                centres[g] = x[own == g].mean(axis=0)
    return np.unique(own, return_inverse=True)[1]


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, as exact integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < _EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, e in enumerate(entries):
        d = x - e
        out[:, j] = (d * d).sum(axis=1)
    return out


def own_squares(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    d = x - entries[code]
    return (d * d).sum(axis=1)


def _down(x: np.ndarray) -> np.ndarray:
    """Lower bounds, rounded down."""
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(-np.inf))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def _lower(d2: np.ndarray, members: list[np.ndarray], code: np.ndarray) -> np.ndarray:
    """For each group the least distance to an entry of it other than the row's own."""
    d = np.sqrt(d2.astype(np.float64))
    d[np.arange(len(d)), code] = np.inf
    return np.stack([d[:, m].min(axis=1) for m in members], axis=1)


def assign_all(x: np.ndarray, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper and lower bounds by comparing with every entry."""
    d2 = squares(x, book.entries)
    code = d2.argmin(axis=1)  # the first of equals
    own = np.sqrt(d2[np.arange(len(x)), code].astype(np.float64))
    return code, _up(own), _down(_lower(d2, book.members, code))


def assign_again(x: np.ndarray, book: Codebook, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after entries have moved, by bounds; also how many distances were computed."""
    drift = np.array([book.moved[m].max(initial=0) for m in book.members])
    upper = _up(upper.astype(np.float64) + book.moved[code])
    lower = _down(lower.astype(np.float64) - drift)
    code = code.copy()
    open_ = np.flatnonzero(lower.min(axis=1) <= upper)
    looked = len(open_)
    upper[open_] = _up(np.sqrt(own_squares(x[open_], book.entries, code[open_]).astype(np.float64)))
    open_ = open_[lower[open_].min(axis=1) <= upper[open_]]
    if not len(open_):
        return code, upper, lower, looked
    px, old = x[open_], code[open_]
    best = own_squares(px, book.entries, old)
    old_best, new = best.copy(), old.copy()
    scanned = lower[open_] <= upper[open_][:, None]
    least = lower[open_].astype(np.float64)
    second: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for g, m in enumerate(book.members):
        rows = np.flatnonzero(scanned[:, g])
        if not len(rows):
            continue
        d2 = squares(px[rows], book.entries[m])
        looked += d2.size
        second[g] = rows, d2
        j = d2.argmin(axis=1)
        d, c = d2[np.arange(len(rows)), j], m[j]
        better = (d < best[rows]) | ((d == best[rows]) & (c < new[rows]))
        best[rows[better]], new[rows[better]] = d[better], c[better]
    for g, (rows, d2) in second.items():  # without the entry that is now the row's own
        d = np.sqrt(d2.astype(np.float64))
        d[book.members[g][None, :] == new[rows][:, None]] = np.inf
        least[rows, g] = d.min(axis=1)
    left = np.flatnonzero(new != old)  # the entry left behind counts again in its group
    g = book.group[old[left]]
    least[left, g] = np.minimum(least[left, g], np.sqrt(old_best[left].astype(np.float64)))
    code[open_], upper[open_] = new, _up(np.sqrt(best.astype(np.float64)))
    lower[open_] = _down(least)
    return code, upper, lower, looked


# ------------------------------------------------------------------ one round over the table
_ROUND = "vec_id long, label string, x binary, code binary, upper binary, lower binary, error long, part int, entry int, count long, sums array<long>"


def _round(books, ks: int, dims: int):
    """Assigns all parts; x holds the integers, code two bytes for each part. The last rows of a task are its sums."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: list[Codebook] = books.value
        sums = np.zeros((len(every), ks, dims), np.int64)
        counts = np.zeros((len(every), ks), np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                n = b.num_rows
                x = np.frombuffer(b"".join(b.column("x").to_pylist()), "<i4").reshape(n, len(every), dims).astype(np.int64)
                held = b.column("code").null_count == 0 and n > 0
                codes = np.empty((n, len(every)), "<u2")
                upper = np.empty((n, len(every)), "<f4")
                if held:
                    old = np.frombuffer(b"".join(b.column("code").to_pylist()), "<u2").reshape(n, len(every)).astype(np.int64)
                    was_upper = np.frombuffer(b"".join(b.column("upper").to_pylist()), "<f4").reshape(n, len(every))
                    was_lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), "<f4").reshape(n, -1)
                error = np.zeros(n, np.int64)
                lowers, seen = [], 0
                for p, book in enumerate(every):
                    k = len(book.members)
                    if held:
                        c, u, low, _ = assign_again(x[:, p], book, old[:, p], was_upper[:, p], was_lower[:, seen : seen + k])
                    else:
                        c, u, low = assign_all(x[:, p], book)
                    seen += k
                    codes[:, p], upper[:, p] = c, u
                    lowers.append(low)
                    error += own_squares(x[:, p], book.entries, c)
                    counts[p] += np.bincount(c, minlength=ks)
                    np.add.at(sums[p], c, x[:, p])
                low = np.ascontiguousarray(np.concatenate(lowers, axis=1), dtype="<f4")
                yield _rows(n, vec_id=b.column("vec_id"), label=b.column("label"), x=b.column("x"), code=common.binary_rows(list(codes), "<u2"), upper=common.binary_rows(list(upper), "<f4"), lower=common.binary_rows(list(low), "<f4"), error=pa.array(error))
        part, entry = np.nonzero(counts)
        if len(part):
            flat = sums[part, entry]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dims, pa.int32()), pa.array(flat.reshape(-1)))
            yield _rows(len(part), part=pa.array(part, pa.int32()), entry=pa.array(entry, pa.int32()), count=pa.array(counts[part, entry]), sums=lists)

    return run


_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("x", pa.binary()), ("code", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("error", pa.int64()), ("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def integers(vector: str, scale: int = SCALE):
    """The vector as integers floor(scale * x), or null where it is null or has a null or non-finite component."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(~bad, F.transform(x, lambda v: F.floor(v * float(scale)).cast("bigint")))


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column("v")
        size = int(pa.compute.list_value_length(v)[0].as_py()) if b.num_rows else 0
        x = np.asarray(v.flatten()).reshape(b.num_rows, size).astype("<i4") if b.num_rows else np.zeros((0, 0), "<i4")
        yield _rows(b.num_rows, vec_id=b.column("vec_id"), label=b.column("label"), x=common.binary_rows(list(x), "<i4"))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every vector that takes part.

    Components become ``floor(1024 * x)``; each of ``parts`` consecutive parts has a codebook of ``entries`` entries that
    starts as that part of the rows of smallest ids (equal ids: smallest components first). After ``rounds`` rounds parts
    are assigned once more: code has two hex digits for each, error is the sum of the squared distances, label_error its
    sum over equal labels (nulls are one label), codebooks_sha256 the digest of the final entries in decimal.

    * vectors that are null or empty, or hold null or non-finite components, take no part
    * with fewer vectors than ``entries`` there are so many entries; repeated rows are coded each, null ids come before all others
    * an entry that no part is nearest to stays as it is; equal entries: the lower index
    * vectors of different lengths, a length that ``parts`` doesn't divide, and components so large that errors pass 64
      bits are refused with an error
    * an empty table gives no rows; other columns are not read
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook 1 to 256 entries")
    spark = vectors.sparkSession
    common.small_batches(spark, 10_000)
    work = common.Workspace(spark, "codes")
    kept = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), integers(vector_col).alias("v")).where(F.size("v") > 0)
    kept = work.save(kept, "integers")
    span = kept.agg(F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    result = "vec_id long, label string, code string, error long, label_error long, codebooks_sha256 string"
    if span["least"] is None:
        return spark.createDataFrame([], result)
    size = span["most"]
    if span["least"] != size or size % parts:
        raise ValueError(f"vectors have {span['least']} to {size} components; all must have as many, in {parts} equal parts")
    if 4 * size * span["top"] * span["top"] >= 1 << 63 or span["top"] >= 1 << 31:
        raise ValueError(f"components up to {span['top']} make errors of over 64 bits")
    dims = size // parts

    first = kept.orderBy(F.col("vec_id").asc_nulls_first(), "v").limit(entries).collect()  # ``entries`` rows
    start = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dims)
    books = [Codebook(e, grouped(e), np.zeros(len(e))) for e in (start[:, p] for p in range(parts))]
    table = work.save(kept.mapInArrow(_pack, _ROUND), "round-0")
    work.drop("integers")
    for step in range(1, rounds + 2):
        sent = spark.sparkContext.broadcast(books)  # parts * entries entries
        vectors_now = table.where("x is not null").select("vec_id", "label", "x", "code", "upper", "lower")
        table = work.save(vectors_now.mapInArrow(_round(sent, len(first), dims), _ROUND), f"round-{step}")
        work.drop(f"round-{step - 1}")
        if step <= rounds:
            books = _moved(books, table, dims)

    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.entries.reshape(-1).tolist()).encode()).hexdigest()
    hexed = F.concat(*[F.lower(F.hex(F.substring("code", 2 * p + 1, 1))) for p in range(parts)])
    coded = table.where("x is not null").select("vec_id", "label", hexed.alias("code"), "error")
    by_label = work.save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "__label")
    by_label = F.broadcast(by_label) if by_label.count() <= BROADCAST_LABELS else by_label
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _moved(books: list[Codebook], table: DataFrame, dims: int) -> list[Codebook]:
    """Entries replaced by their parts' floored means, with how far they moved, rounded up."""
    sums = table.where("part is not null").groupBy("part", "entry").agg(F.sum("count").alias("count"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    new = [b.entries.copy() for b in books]
    for r in sums.collect():  # an entry a row
        new[r["part"]][r["entry"]] = [r[f"s{i}"] // r["count"] for i in range(dims)]
    out = []
    for b, e in zip(books, new):
        d = (e - b.entries).astype(np.float64)
        out.append(Codebook(e, b.group, np.sqrt((d * d).sum(axis=1)) * (1 + 1e-12)))
    return out
