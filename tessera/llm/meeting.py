"""Sets that share a signature meet, and those that are similar are linked, without pairing a group off.

Equal sets are one node. First each node meets the hubs of a few of its signatures, the two that most
sets share and the two that fewest do: the hub is the node whose signatures are shared most, which of
a group of near copies is the text that they were made from. So a group of m near copies makes some m
pairs, and what is linked to a hub has the hub's label. The same again, with other hubs within classes
of like sizes, while a signature of many sets with different labels is left. Then all sets that share a
signature and have different labels are compared in blocks by sketches, so that no link is lost.

A pair is first judged by lengths and parity sketches, whose difference never exceeds the sets' own;
what passes is verified on the whole sets, read again from the texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import connected_components
from .shingles import Sets, pieces, sketch_class, SKETCH_BITS

U64 = np.uint64
#: Turns with hubs before what is left is compared in blocks; after the first only while a signature has so many sets.
TURNS, MANY_SETS = 2, 1024
#: Signatures of a node that name a hub: so many of the most and of the least shared ones.
NAMING = 2
#: Sets of one signature that are compared in one block.
BLOCK_SETS = 512
#: Lists of ids that are broadcast have at most so many rows of three numbers; longer ones are joined by shuffle.
BROADCAST_IDS = 200_000


class _Sketches:
    """Sketches of rows at a common width: those of the next class are folded to it."""

    def __init__(self, raw: list[bytes], n: np.ndarray, percent: int):
        self.kind = sketch_class(n, percent)
        self._raw = raw
        self._at: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _width(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._at:
            rows = np.flatnonzero((self.kind == k) | (self.kind == k + 1))
            words = (SKETCH_BITS << k) // 64
            out = np.empty((len(rows), words), U64)
            for i, r in enumerate(rows.tolist()):
                x = np.frombuffer(self._raw[r], U64)
                out[i] = x if len(x) == words else x[:words] ^ x[words:]
            place = np.full(len(self.kind), -1)
            place[rows] = np.arange(len(rows))
            self._at[k] = place, out
        return self._at[k]

    def gap(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Differing bits; never more than the sets differ in tokens."""
        out = np.zeros(len(x), np.int64)
        narrow = np.minimum(self.kind[x], self.kind[y])
        for k in np.unique(narrow).tolist():
            some = np.flatnonzero(narrow == k)
            place, table = self._width(k)
            out[some] = np.bitwise_count(table[place[x[some]]] ^ table[place[y[some]]]).sum(axis=1, dtype=np.int64)
        return out


def _may_link(n: np.ndarray, sketch: _Sketches, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows lengths and sketches don't rule out."""
    low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    near = 100 * low >= percent * high
    some = np.flatnonzero(near)
    near[some] = sketch.gap(x[some], y[some]) * (100 + percent) <= (n[x[some]] + n[y[some]]) * (100 - percent)
    return near


def _close(percent: int):
    """Of pairs with both sides' sizes and sketches those that may link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            m = t.num_rows
            n = np.concatenate([np.asarray(t.column("na")), np.asarray(t.column("nb"))])
            sketch = _Sketches(t.column("sa").to_pylist() + t.column("sb").to_pylist(), n, percent)
            near = _may_link(n, sketch, np.arange(m), np.arange(m, 2 * m), percent)
            yield t.select(["a", "b"]).filter(pa.array(near))

    return run


def _compare(percent: int):
    """Rows sorted by (sig, i, j): the sets of block i, and of block j if another. Emits pairs that may link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 20_000:
                continue
            g = np.stack([np.asarray(held.column(c)) for c in ("sig", "i", "j")])
            whole = int(np.flatnonzero((g != g[:, -1:]).any(axis=0))[-1]) + 1 if (g != g[:, -1:]).any() else 0
            if whole:
                yield from _pairs(held.slice(0, whole), percent)
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from _pairs(held, percent)

    return run


def _pairs(t: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    sig, i, j, node, n, block, comp = (np.asarray(t.column(c)) for c in ("sig", "i", "j", "node", "n", "block", "comp"))
    sketch = _Sketches(t.column("sketch").to_pylist(), n, percent)
    start = np.flatnonzero(np.concatenate(([True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
    size = np.diff(np.append(start, len(sig)))
    end = np.repeat(start + size, size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.arange(len(sig))
    for d in range(1, int(size.max())):
        rows = rows[rows + d < end[rows]]
        x, y = rows, rows + d
        ok = (comp[x] != comp[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
        x, y = x[ok], y[ok]
        if len(x):
            near = _may_link(n, sketch, x, y, percent)
            if near.any():
                found.append((x[near], y[near]))
    if not found:
        return
    x, y = (np.concatenate(c) for c in zip(*found))
    a, b = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
    once = np.unique(np.stack((a, b)), axis=1, return_index=True)[1]
    yield pa.RecordBatch.from_arrays([pa.array(c[once]) for c in (a, b)], names=["a", "b"])


def _token_sets(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            s = Sets(b.column("text"), k, None)
            sets = [s.token[f : f + n].astype("<u8").tobytes() for f, n in zip(s.first.tolist(), s.n.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("node").combine_chunks(), pa.array(sets, pa.binary())], names=["node", "tokens"])

    return run


def _verify(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for p, q in zip(t.column(t.schema.get_field_index("left")), t.column(t.schema.get_field_index("right"))):
                x, y = np.frombuffer(p.as_buffer(), "<u8"), np.frombuffer(q.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int, work: common.Workspace, name: str) -> DataFrame | None:
    """The pairs that do link, by their whole sets; none: None."""
    pairs = work.save(pairs.select("a", "b").distinct(), f"{name}-pairs")
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if (n := ids.count()) == 0:
        work.drop(f"{name}-pairs")
        return None
    chosen = reps.select("node", "id", "h").join(ids, "node", "left_semi")
    chosen = F.broadcast(chosen) if n <= BROADCAST_IDS else chosen
    sets = work.save(texts.join(chosen, ["id", "h"]).select("node", "text").mapInArrow(_token_sets(k), "node long, tokens binary").dropDuplicates(["node"]), f"{name}-sets")
    left = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("left")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("right")), "b").select("a", "b", "left", "right")
    out = work.save(both.mapInArrow(_verify(percent), "a long, b long"), f"{name}-links")
    work.drop(f"{name}-pairs")
    work.drop(f"{name}-sets")
    return None if out.isEmpty() else out


def _with_component(met: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return met.withColumn("comp", F.col("node"))
    return met.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")


def _hub_pairs(known: DataFrame, reps: DataFrame, percent: int, turn: int) -> DataFrame:
    """Each node with the hub of a few of its signatures, where that has another label and may link.

    From the second turn on a signature has a hub for each class of sizes; sets of one class differ by a factor of
    100 / percent at most, and hubs come by an order of labels, so that large groups aren't preferred.
    """
    own = Window.partitionBy("node")
    shared = known.withColumn("weight", F.sum("size").over(own) if turn == 0 else F.xxhash64("comp", F.lit(turn)))
    shared = shared.withColumn("most", F.row_number().over(own.orderBy(F.desc("size"), "sig"))).withColumn("least", F.row_number().over(own.orderBy("size", "sig")))
    kind = F.floor(F.log(F.col("n").cast("double")) / log(100 / percent)) if turn else F.lit(0)
    few = shared.where((F.col("most") <= NAMING) | (F.col("least") <= NAMING)).select("sig", kind.alias("kind"), "node", "n", "comp", "weight")
    hubs = few.groupBy("sig", "kind").agg(F.max(F.struct("weight", "node", "comp", "n")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    apart = few.join(hubs.drop("lo", "hi"), ["sig", "kind"]).where((F.col("comp") != F.col("hub.comp")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")))
    pairs = apart.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    side = lambda c: reps.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_close(percent), "a long, b long")


def _nearby(links: DataFrame) -> DataFrame:
    """``node, label``: of a node and those it is linked to the one with the most links; equal labels are one component."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    degree = both.groupBy(F.col("a").alias("b")).agg(F.count(F.lit(1)).alias("degree"))
    seen = both.join(degree, "b").select(F.col("a").alias("node"), F.struct("degree", "b").alias("best"))
    own = degree.select(F.col("b").alias("node"), F.struct("degree", "b").alias("best"))
    return seen.unionByName(own).groupBy("node").agg(F.max("best").alias("best")).select("node", F.col("best.b").alias("label"))


def _mixed(known: DataFrame, work: common.Workspace, name: str) -> DataFrame:
    """Rows of signatures whose sets are in several components still."""
    open_ = known.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    return work.save(known.join(open_.select("sig", "size"), "sig").select("node", "n", "sig", "comp", "size"), name)


def _block_pairs(met: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """All pairs of one signature and different components that may link; a signature's sets are dealt into blocks."""
    same = met.groupBy("sig").agg(F.bit_xor(F.xxhash64("node")).alias("who"), F.min("size").alias("size"))
    once = same.groupBy("size", "who").agg(F.min("sig").alias("sig"))  # signatures of the same sets
    blocks = F.ceil(F.col("size") / BLOCK_SETS).cast("int")
    own = F.pmod(F.xxhash64("node", "sig"), blocks.cast("bigint")).cast("int")
    dealt = met.join(once.select("sig"), "sig").join(reps.select("node", "sketch"), "node").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "n", "block", "comp", "sketch")
    parts = common.shuffle_parts(met.sparkSession)
    return dealt.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(_compare(percent), "a long, b long")


def similar_components(rows: DataFrame, indexed: DataFrame, k: int, percent: int, work: common.Workspace) -> DataFrame:
    """``doc_id, n_shingles, component_id, row_hash, is_first`` of every row.

    ``rows`` has id, h and text; ``indexed`` id, h, n (size of the set), node (hash of the set, null if empty), sigs
    (signatures, of which similar sets share one) and sketch.
    """
    spark = rows.sparkSession
    first = indexed.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "h")).alias("rep"))
    # one row for each node: repeated rows would cancel in the XOR below
    reps = indexed.where("node is not null").dropDuplicates(["node", "id", "h"]).join(first.select("node", "rep.id", "rep.h"), ["node", "id", "h"])
    reps = work.save(reps.select("node", "id", "h", "n", "sigs", "sketch"), "reps")

    # sets by signature; a signature of one set is dropped, and sets that meet in many signatures alike meet once
    sigs = reps.select("node", "n", F.explode("sigs").alias("sig"))
    shared = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("who")).where("size > 1")
    groups = work.save(shared.groupBy("size", "who").agg(F.min("sig").alias("sig")).select("sig"), "groups")
    met = work.save(sigs.join(F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups, "sig").select("node", "n", "sig"), "met-0")
    common.release_shuffles(spark)

    links, labels, whole, turn, in_blocks = None, None, False, 0, False
    while not in_blocks:
        known = _mixed(_with_component(met, labels), work, f"met-{turn + 1}")
        work.drop(f"met-{turn}")
        met = known.drop("comp", "size")
        largest = known.agg(F.max("size")).first()[0]
        if largest is None:
            break
        in_blocks = turn >= TURNS or turn > 0 and largest <= MANY_SETS
        pairs = _block_pairs(known, reps, percent) if in_blocks else _hub_pairs(known, reps, percent, turn)
        new = _links(pairs, reps, rows, k, percent, work, f"turn-{turn}")
        if new is not None:
            links = new if links is None else links.union(new)
            if turn + 1 >= TURNS:  # what is compared in blocks next needs whole components
                labels, whole = connected_components(links, work, f"components-{turn}"), True
                links = labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))  # a star says the same
            elif not in_blocks:
                labels = work.save(_nearby(links), f"labels-{turn}")
        turn += 1
    if links is not None and not whole:
        labels = connected_components(links, work)

    if labels is None:
        labels = spark.createDataFrame([], "node long, label long")
    per_node = first.select("node", F.col("rep").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    per_label = per_node.groupBy("label").agg(F.min("least").alias("least"))
    of_node = per_node.select("node", "label").join(per_label, "label").select("node", "least")
    out = indexed.select("id", "h", "n", "node").join(of_node, "node", "left")
    component = F.coalesce("least", F.struct("id", "h"))
    given = lambda row: F.when(row["h"] >= 0, row["id"])
    return out.select(
        given(F.struct("id", "h")).alias("doc_id"), F.col("n").alias("n_shingles"), given(component).alias("component_id"), F.col("h").alias("row_hash"), (component == F.struct("id", "h")).alias("is_first")
    )
