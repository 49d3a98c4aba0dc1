"""Vectors of texts from term weights, where no embedding model is at hand.

A sparse random projection: each term adds its weight, with a sign, to one place in each of eight blocks of the vector.
Places and signs follow from the term's MD5, so no matrix is drawn, kept or broadcast, and vectors of two runs can be
compared. The cosine of two vectors differs from that of the term weights by ``sqrt((1 + c * c) / dims)`` or so (a
standard error: 0.06 to 0.09 with 256 places). Weights are rounded to units of 2^-20 and added as integers, so that
results don't depend on the order of rows.

A model's own vectors come as a table (S15), or from ``pyspark.ml.functions.predict_batch_udf``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Places that a term adds to: an MD5 has eight groups of four digits.
BLOCKS = 8
UNIT = 1 << 20
#: Places of some rows' keys that are added up in one array; more are sorted.
MOST_PLACES = 1 << 20


def project(weights: DataFrame, key: str, dims: int = 256) -> DataFrame:
    """``key, pos, total`` of ``key, term, weight``: sums in units of 2^-20, those that aren't zero.

    ``dims`` is a multiple of eight, 2^18 at most. Null terms and weights add nothing. Rows in order of
    key, as term weights are, are added up before they are shuffled.
    """
    if dims % BLOCKS or not BLOCKS <= dims <= BLOCKS << 15:
        raise ValueError(f"{dims} places")
    rows = weights.where("term is not null and weight is not null")
    rows = rows.select(F.col(key).alias("key"), F.md5(F.col("term").cast("binary")).alias("digest"), F.round(F.col("weight") * UNIT).cast("bigint").alias("amount"))
    kind = weights.schema[key].dataType.simpleString()
    return rows.mapInArrow(_adder(key, dims), f"`{key}` {kind}, pos int, total bigint").groupBy(key, "pos").agg(F.sum("total").alias("total")).where("total <> 0")


def _adder(key: str, dims: int):
    """Sums of some rows: eight for a term are added where they are, so that Spark gets a row for each key and place at most."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, digit = dims // BLOCKS, np.zeros(256, np.int64)
        digit[np.frombuffer(b"0123456789abcdef", np.uint8)] = np.arange(16)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            keys = b.column("key").dictionary_encode(null_encoding="encode")
            code, amount = np.asarray(keys.indices).astype(np.int64), np.asarray(b.column("amount")).astype(np.int64)
            text = pa.concat_arrays([b.column("digest")])  # without an offset
            hexa = digit[np.frombuffer(text.buffers()[2], np.uint8)[: 32 * n].reshape(n, BLOCKS, 4)]
            group = hexa @ np.array([4096, 256, 16, 1])
            at = code[:, None] * dims + np.arange(BLOCKS) * width + (group >> 1) % width
            places, which = np.unique(at, return_inverse=True) if len(keys.dictionary) * dims > MOST_PLACES else (np.arange(len(keys.dictionary) * dims), at)
            total = np.zeros(len(places), np.int64)
            np.add.at(total, which.reshape(-1), np.where(group % 2 == 0, amount[:, None], -amount[:, None]).reshape(-1))
            some = np.flatnonzero(total)
            of, pos = np.divmod(places[some], dims)
            yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(of)), pa.array(pos, pa.int32()), pa.array(total[some])], names=[key, "pos", "total"])

    return add


def unit_vectors(projected: DataFrame, key: str, dims: int = 256, name: str = "embedding") -> DataFrame:
    """``key, embedding`` (doubles, of unit length) of ``project``'s rows, in the form that S15, M04 and vector search take.

    Keys without terms, or whose terms cancel out, have no row.
    """
    rows = projected.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pos", "total"))).alias("__m"))
    squares = F.aggregate(F.map_values("__m"), F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    places = F.sequence(F.lit(0), F.lit(dims - 1))
    return rows.withColumn("__n", F.sqrt(squares)).select(key, F.transform(places, lambda i: F.coalesce(F.try_element_at("__m", i).cast("double"), F.lit(0.0)) / F.col("__n")).alias(name))
