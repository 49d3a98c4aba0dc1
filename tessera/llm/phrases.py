"""Phrase collocation mining: hierarchical pair naming.

Texts are read once, in batches of some megabytes of one language. A batch becomes a
sequence of local codes, with breaks between pieces, and the list of its distinct words.
Each level then does the same:

* the batches' distinct items are counted together, and those with enough occurrences
  get a global id (the only shuffle that grows with the corpus; an item comes once for
  each batch);
* the ids are joined back to the batches, which replace each two adjacent named items
  by the code of their pair; whatever holds a rarer item is a break from then on.

A pair of words is a two-word phrase, a pair of overlapping two-word phrases one of
three words, and so on. The two ids of a phrase are its parents: the phrase without its
last and without its first word. Following them gives the counts of all first and last
parts for the cuts, and tells which phrases lie inside a longer one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAX_WORDS, LEAST, TOP, COVERED_PERCENT = 3, 10, 2000, 50
#: Text of one batch; a longer text is a batch of its own.
BATCH_BYTES = 16 << 20
#: Parts of a language that are ranked on their own before their first ones are ranked together.
PARTS = 64

_BREAKS = [*b".,;:!?", *range(0x0A, 0x0E)]
_WORD = common._class_table([0x20, 0x09, *_BREAKS])
_BREAK = ~common._class_table(_BREAKS)

_BATCH = "lang string, n long, codes binary, items array<struct<word: string, c: long>>"
_PAIRS = "batch long, codes binary, items array<struct<left: long, right: long, c: long>>"


def _one_row(columns: dict, items: dict) -> pa.Table:
    """A row with an array of structs."""
    structs = pa.StructArray.from_arrays(list(items.values()), names=list(items))
    lists = pa.ListArray.from_arrays(pa.array([0, len(structs)], pa.int32()), structs)
    return pa.table({**{k: pa.array([v]) if not isinstance(v, bytes) else pa.array([v], pa.binary()) for k, v in columns.items()}, "items": lists})


def _sequence(texts: pa.Array, lang: str) -> pa.Table:
    buf, starts, _ = common.text_bytes(texts)
    buf = common.lower_ascii(buf)
    words = common.Words(buf, starts, _WORD)
    n = len(words.start)
    piece = np.searchsorted(np.flatnonzero(_BREAK[buf]), words.start)  # every text ends in a break
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(words.end - words.start, out=offsets[1:])
    data = buf[_WORD[buf]]
    coded = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    local = np.asarray(coded.indices, dtype=np.int32)
    at = np.arange(n)
    at[1:] += np.cumsum(piece[1:] != piece[:-1])
    codes = np.full(int(at[-1]) + 1 if n else 0, -1, np.int32)
    codes[at] = local
    counts = np.bincount(local, minlength=len(coded.dictionary))
    return _one_row({"lang": lang, "n": n, "codes": codes.tobytes()}, {"word": coded.dictionary, "c": pa.array(counts, pa.int64())})


def _batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in common.text_batches(batches, "text", BATCH_BYTES):
        langs = t.column("lang").combine_chunks()
        for lang in pa.compute.unique(langs).to_pylist():
            mine = t.column("text").filter(pa.compute.equal(langs, lang))
            yield from _sequence(mine, lang).to_batches()


def _pair(_key: tuple, seq: pa.Table, names: pa.Table) -> pa.Table:
    """A batch's next sequence: codes of adjacent named items' pairs, each pair's parents and count."""
    codes = np.frombuffer(seq.column("codes")[0].as_py(), "<i4")  # every batch with names has its row
    n = int(codes.max(initial=-1)) + 1
    ids = np.full(n + 1, -1, np.int64)  # the last one is a break's
    ids[np.asarray(names.column("code"), dtype=np.int64)] = np.asarray(names.column("id"))
    named = ids[codes]
    at = np.flatnonzero((named[:-1] >= 0) & (named[1:] >= 0))
    both, pair, count = np.unique(codes[at].astype(np.int64) * (n + 1) + codes[at + 1], return_inverse=True, return_counts=True)
    new = np.full(max(len(codes) - 1, 0), -1, np.int32)
    new[at] = pair
    keep = new >= 0
    keep[1:] |= new[:-1] >= 0  # one break of several
    return _one_row({"batch": seq.column("batch")[0].as_py(), "codes": new[keep].tobytes()}, {"left": pa.array(ids[both // (n + 1)]), "right": pa.array(ids[both % (n + 1)]), "c": pa.array(count, pa.int64())})


def _used(seq: DataFrame, *carried: str) -> DataFrame:
    return seq.select("batch", *carried, F.posexplode("items").alias("code", "item")).select("batch", "code", *carried, "item.*")


def _named(used: DataFrame, keys: list[str], least: int, work: common.Workspace, name: str) -> DataFrame:
    """``keys, a, id`` of items with so many occurrences; ids are those of the rows as they were written."""
    counted = used.groupBy(*keys).agg(F.sum("c").alias("a")).where(F.col("a") >= least)
    return work.save(counted.withColumn("id", F.monotonically_increasing_id()), name)


def _score(a: str, left: Column, right: Column) -> Column:
    exact = lambda c: c.cast("decimal(15,0)")  # noqa: E731  products have 36 digits at most
    whole = exact(F.col(a)) * exact(F.col(a)) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", whole, exact(left) * exact(right)).cast("bigint")


def _ranked(df: DataFrame, part: list[str], top: int) -> DataFrame:
    order = Window.partitionBy("lang", *part).orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return df.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)


def mine_phrases(docs: DataFrame, max_words: int = MAX_WORDS, least: int = LEAST, top: int = TOP, covered_percent: int = COVERED_PERCENT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of 2 to ``max_words`` words.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line ends and these into words at blanks
    and tabs; a phrase lies within a piece. ``a`` is how often it occurs, ``least`` times or more. Cut after its first
    k words it has the parts' counts ``l`` and ``r`` and the score ``a * a * 1000000 // (l * r)``; the cut of the lowest
    score counts, the first among equals. A phrase inside a longer one (of ``least`` occurrences) with
    ``covered_percent`` of its count or more is left out. ``n`` counts all words of the language. Order: score and count
    descending, then the phrase's bytes.

    * null and empty texts have no words; a null language is ``und``, the empty one its own
    * repeated rows count each time; ids and other columns are not read
    * an empty table, or one without frequent phrases, gives no rows
    * counts are exact; above 10^15 the arithmetic raises an error
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    work = common.Workspace(spark, "phrases")
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    seq = work.save(rows.mapInArrow(_batches, _BATCH).withColumn("batch", F.monotonically_increasing_id()), "level-1")
    totals = work.save(seq.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    used, keys = _used(seq, "lang"), ["lang", "word"]
    levels = [_named(used, keys, least, work, "items-1")]
    for k in range(2, max_words + 1):
        names = used.join(levels[-1].select(*keys, "id"), keys).select(F.col("batch").alias("of"), "code", "id")
        dealt = seq.select("batch", "codes").groupBy("batch").cogroup(names.groupBy("of"))
        seq = work.save(dealt.applyInArrow(_pair, _PAIRS), f"level-{k}")
        work.drop(f"level-{k - 1}")
        common.release_shuffles(spark)
        used, keys = _used(seq), ["left", "right"]
        levels.append(_named(used, keys, least, work, f"items-{k}"))
    work.drop(f"level-{max_words}")
    common.release_shuffles(spark)

    # heads and tails: counts of the first and last 1, 2, ... words
    none = F.array().cast("array<bigint>")
    phrases = levels[0].select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a", none.alias("heads"), none.alias("tails"))
    found = None
    for k in range(2, max_words + 1):
        head = phrases.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), F.concat("heads", F.array("a")).alias("heads"))
        tail = phrases.select(F.col("id").alias("right"), "last", F.concat("tails", F.array("a")).alias("tails"))
        joined = levels[k - 1].join(head, "left").join(tail, "right")
        phrases = work.save(joined.select("id", "lang", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "a", "heads", "tails"), f"phrases-{k}")
        cuts = [(F.col("heads")[j - 1], F.col("tails")[k - j - 1], j) for j in range(1, k)]
        best = F.array_min(F.array(*[F.struct(_score("a", x, y).alias("score"), F.lit(j).alias("cut"), x.alias("l"), y.alias("r")) for x, y, j in cuts]))
        own = phrases.withColumn("best", best).select("id", "lang", "phrase", "a", "best.l", "best.r", "best.score")
        if k < max_words:  # any longer phrase around it holds one with a word more, as frequent at least
            longer = levels[k].select(F.explode(F.array("left", "right")).alias("id"), F.col("a").alias("over")).groupBy("id").agg(F.max("over").alias("over"))
            own = own.join(longer, "id", "left").where(F.col("over").isNull() | (100 * F.col("over") < covered_percent * F.col("a"))).drop("over")
        found = own if found is None else found.unionByName(own)

    parted = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = _ranked(_ranked(parted, ["part"], top).drop("rank"), [], top)
    return first.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
