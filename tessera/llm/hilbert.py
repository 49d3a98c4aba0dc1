"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are dealt into bands of like norms, for within a band the largest inner
product is nearly the smallest angle. The directions of each band are rotated at
random and put in order along a Hilbert curve through their leading coordinates,
several times with different rotations and shifts. All orders form one sequence of
keys, range-partitioned by Spark and cut into blocks of ``window`` vectors. A query
is placed in each order of each band by its own direction; the vectors of its block
and of the blocks before and after it are its candidates. The best few of each block
merge and are ranked by the true inner product.

Bands follow the norms' quantiles, so a few long vectors don't change how the others
are ordered. Vectors of one norm are one band.

Equal vectors are one point with its smallest ids, so copies can't crowd a window.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

NEIGHBOURS = 20
CURVES = 32
#: Vectors in a block: a hundredth of their band, and so many at least. A query sees three blocks in each order.
WINDOW, SHARE = 256, 100
#: Coordinates of a curve and bits of each.
AXES, BITS = 12, 5
SEED = 20240229
#: Bands of norms are so many at most, but for that of the longest hundredth, and their norms differ by such a factor at least.
BANDS, BAND_RATIO = 16, 1.15


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of integer points, by bit operations on all points at once."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = np.uint64(q - 1)
        for i in range(n):
            set_ = (x[i] & np.uint64(q)) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    q = top
    while q > 1:
        turn ^= np.where((x[n - 1] & np.uint64(q)) != 0, np.uint64(q - 1), np.uint64(0))
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)  # 60 bits


class Curves:
    """Keys of directions on all curves."""

    def __init__(self, dim: int, curves: int = CURVES, axes: int = AXES, bits: int = BITS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bits = bits
        self.turns, self.shifts = [], []
        for _ in range(curves):
            self.turns.append(np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0][:, : min(axes, dim + 1)])
            self.shifts.append(rng.uniform(-0.5, 0.5, self.turns[-1].shape[1]))
        self.scale = 2.0 / np.sqrt(dim + 1)  # a coordinate's spread, twice

    def keys(self, v: np.ndarray) -> list[np.ndarray]:
        v = v / np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        v = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        out = []
        for turn, shift in zip(self.turns, self.shifts):
            p = v @ turn[:-1] / self.scale
            cells = np.floor((p + shift * 0.5 + 1.25) / 2.5 * (1 << self.bits))
            out.append(hilbert_keys(np.clip(cells, 0, (1 << self.bits) - 1), self.bits))
        return out


# ------------------------------------------------------------------ Spark
def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: no null or non-finite component, not all zero, the commonest length."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & good)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def band_cuts(top: float, low: float) -> list[float]:
    """Descending norms between bands, from those that a hundredth (top) and nine tenths (low) of all vectors exceed."""
    ratio = max(BAND_RATIO, (top / low) ** (1 / (BANDS - 1)))
    cuts = [1.01 * top]
    while cuts[-1] / ratio > low and len(cuts) < BANDS:
        cuts.append(cuts[-1] / ratio)
    return cuts


def _keyed(bands: list[int], dim: int, curves: int):
    """A row for each point and curve, and one more in each band for each query point: its key in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Curves(dim, curves)
        for b in batches:
            v = _matrix(b.column(1))
            point, own = np.asarray(b.column(0)), np.asarray(b.column(3), np.int32)
            asks = np.flatnonzero(np.asarray(b.column(2)))
            for curve, key in enumerate(c.keys(v) if len(v) else ()):
                for query, rows, band in ((False, np.arange(len(v)), own), *((True, asks, np.full(len(asks), x, np.int32)) for x in bands)):
                    yield pa.RecordBatch.from_arrays([pa.array(band), pa.array(np.full(len(rows), curve, np.int32)), pa.array(key[rows]), pa.array(point[rows]), pa.array(np.full(len(rows), query))], names=["band", "curve", "key", "point", "query"])

    return run


def _numbered(windows: dict[int, int]):
    """Adds the partition and a number of the block within it; rows come in order. A block has one band and curve, so no point twice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, seen, base, top = TaskContext.get().partitionId(), None, 0, 0, -1
        for b in batches:
            if not b.num_rows:
                continue
            data = ~np.asarray(b.column(b.schema.get_field_index("query")))
            band, curve = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("band", "curve"))
            local = np.zeros(b.num_rows, np.int64)
            starts = np.flatnonzero(np.concatenate(([True], (band[1:] != band[:-1]) | (curve[1:] != curve[:-1])))).tolist()
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                if (band[a], curve[a]) != held:
                    held, seen, base = (int(band[a]), int(curve[a])), 0, top + 1
                mine = data[a:z]
                local[a:z] = base + (seen + np.cumsum(mine) - mine) // windows[held[0]]
                seen += int(mine.sum())
                top = max(top, int(local[z - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int64)), pa.array(local), *[b.column(b.schema.get_field_index(c)) for c in ("point", "query")]], names=["part", "local", "point", "query"])

    return run


def _nearest_in_blocks(keep: int):
    """Rows sorted by block: the vectors of a block and the queries placed in it or beside it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            block = np.asarray(held.column("block"))
            if block[0] == block[-1]:
                continue
            whole = int(np.flatnonzero(block != block[-1])[-1]) + 1
            yield from _best(held.slice(0, whole), keep)
            held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from _best(held, keep)

    return run


def _best(t: pa.Table, keep: int) -> Iterator[pa.RecordBatch]:
    block, point, query = (np.asarray(t.column(c)) for c in ("block", "point", "query"))
    raw = _matrix(t.column("v"))
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(block)]):
        q, d = np.flatnonzero(query[a:z]) + a, np.flatnonzero(~query[a:z]) + a
        if not len(q) or not len(d):
            continue
        for at in range(0, len(q), 512):
            some = q[at : at + 512]
            score = raw[some] @ raw[d].T  # in double precision, as the final score
            n = min(keep, len(d))
            top = np.argpartition(-score, n - 1, axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(point[some], n)), pa.array(point[d][top].ravel()), pa.array(np.take_along_axis(score, top, 1).ravel().astype(np.float64))], names=["query", "point", "score_in_block"])


def nearest(vectors: DataFrame, asks, k: int = NEIGHBOURS, curves: int = CURVES, window: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for each row whose id fulfils ``asks`` (a function of a column).

    * nearness is the inner product in double precision; ties go to the smaller id; a query isn't its own neighbour
    * vectors that are null, all zero, or hold null or non-finite components, rows without an id, and
      vectors of another length than the commonest take no part, as queries or as candidates
    * of rows that share id and vector one is kept; other columns are not read
    * with k candidates or fewer all are returned; an empty table gives no rows
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    work = common.Workspace(spark, "curves")
    rows = usable(vectors, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    rows = rows.where(F.size("v") == dim).dropDuplicates(["vec_id", "v"])
    # equal vectors are one point; of its ids the k + 1 smallest can be asked for
    rows = work.save(rows.withColumn("same", F.xxhash64("v")), "rows")
    points = rows.groupBy("same").agg(F.min("vec_id").alias("point"), F.first("v").alias("v"), F.max(asks(F.col("vec_id"))).alias("asked"))
    longest = F.array_max(F.transform("v", F.abs))  # squares neither overflow nor vanish
    points = points.withColumn("norm", longest * F.sqrt(F.aggregate(F.transform("v", lambda x: x / longest), F.lit(0.0), lambda s, x: s + x * x)))
    points = work.save(points.select("point", "v", "asked", "same", "norm"), "points")
    top, low = points.agg(F.percentile_approx("norm", [0.99, 0.1]).alias("norms")).first()["norms"]
    band = F.lit(0)
    for cut in band_cuts(top, low):
        band = band + (F.col("norm") <= cut).cast("int")
    banded = points.withColumn("band", band)
    windows = {r["band"]: window or max(WINDOW, -(-r["n"] // SHARE)) for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each band
    parts = common.shuffle_parts(spark)
    keyed = banded.select("point", "v", "asked", "band").mapInArrow(_keyed(sorted(windows), dim, curves), "band int, curve int, key long, point long, query boolean")
    keyed = work.save(keyed, "keyed")
    ordered = keyed.repartitionByRange(parts, "band", "curve", "key", "point").sortWithinPartitions("band", "curve", "key", "point", "query")
    placed = work.save(ordered.mapInArrow(_numbered(windows), "part long, local long, point long, query boolean"), "placed")
    last = placed.groupBy("part").agg((F.max("local") + 1).alias("n")).orderBy("part").collect()  # a row for each partition
    base, offsets = 0, []
    for r in last:
        offsets.append((r["part"], base))
        base += r["n"]
    offset = F.broadcast(spark.createDataFrame(offsets, "part long, base long"))
    blocks = placed.join(offset, "part").withColumn("block", F.col("base") + F.col("local"))
    spread = F.when(F.col("query"), F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))
    dealt = blocks.withColumn("block", F.explode(spread)).select("block", "point", "query")
    dealt = dealt.join(points.select("point", F.col("v").cast(vectors.schema[vector_col].dataType).alias("v")), "point").select("block", "point", "query", "v")
    found = dealt.repartition(parts, "block").sortWithinPartitions("block", "query").mapInArrow(_nearest_in_blocks(k + 1), "query long, point long, score_in_block double")
    found = found.where("query <> point").groupBy("query", "point").agg(F.max("score_in_block").alias("score_in_block"))
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score_in_block"), "point"))).where(F.col("at") <= k).select("query", "point")
    asked = points.where("asked").select(F.col("point").alias("query"), F.col("v").alias("q"), F.col("same").alias("query_same"))
    own = asked.select("query", F.col("query").alias("point"))
    pairs = best.unionByName(own).join(asked, "query").join(points.select("point", "v", "same"), "point")
    dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.select("query_same", "same", dot.alias("score"))
    salted = rows.select("same", "vec_id").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.withColumn("at", F.row_number().over(Window.partitionBy("same", "salt").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    few = few.withColumn("at", F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))).where(F.col("at") <= k + 1).select("same", "vec_id")
    # neighbours of a point, copies spread out, k + 1 of them for each point asked for
    near = scored.join(few, "same").withColumn("at", F.row_number().over(Window.partitionBy("query_same").orderBy(F.desc("score"), "vec_id"))).where(F.col("at") <= k + 1)
    queries = rows.where(asks(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("same").alias("query_same"))
    each = queries.join(near.select("query_same", "vec_id", "score"), "query_same").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
