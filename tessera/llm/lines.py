"""Line dedup: an exact set-similarity join of lines, in DataFrame functions only.

A line is the set of its words. Words are ordered by rarity: by the size class of
their slot in corpus-wide counts, then by hash. Of two lines with a Jaccard similarity
of t or more, n words the shorter and m the longer, the shorter has a word among its
first ``n - ceil(2t / (1 + t) * n) + 1`` that is among the first ``m - ceil(t * m) + 1``
of the longer. Shorter sides meet longer ones in the buckets of those words. Lengths,
the places of the first shared word and parity sketches rule out nearly all others;
those that remain are verified on the whole sets.

A sketch never differs in more bits than the sets do in words. Its width follows the
line's length, so joins run class by class: a class holds the pairs whose longer side
has a length in its range, and only long lines carry wide sketches.

Only whether an *earlier* line is similar matters. Equal sets are one line with its
first place. In the buckets of a few of those words lines first meet the few
earliest lines of like length alone; those that are found similar to one are settled,
and pairs whose later line is settled need not meet again. So a group of near copies
costs a few pairs for each member, not one for each two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

PERCENT = 80
#: Slots in which words are counted.
SLOTS = 1 << 16
#: Lengths of the longer side up to which pairs belong to a class, and 64-bit lanes of its sketches.
CLASSES = ((96, 1), (400, 4), (1600, 16), (1 << 31, 64))
#: Words of a prefix, those of smallest hash, in whose buckets lines of like length meet the earliest ones; buckets of frequent words are split into parts of about so many lines.
STAR_WORDS, STAR_BUCKET_LOG2 = 6, 12
#: Earliest lines of a bucket that the others meet first.
STAR_HUBS = 4
#: Lists of documents that are broadcast have at most so many rows; longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: A set with more than one in so many of all lines is joined by broadcast.
OFTEN_SHARE = 1000
_HASH = (1 << 56) - 1


def _slot(h: Column) -> Column:
    return h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def rarity_classes(texts: DataFrame) -> Column:
    """An array literal: for each slot the number of binary digits of its words' count in all texts, in the uppermost byte."""
    words = texts.select(F.explode(F.split(_spaced("text"), "[ \n]")).alias("word")).where("word <> ''")
    counts = words.groupBy(_slot(F.xxhash64("word")).alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()  # SLOTS rows at most
    classes = [0] * SLOTS
    for r in counts:
        classes[r["slot"]] = r["n"].bit_length() << 56
    return F.split(F.lit(",".join(map(str, classes))), ",").cast("array<bigint>")  # folded to a constant by the optimizer


def _spaced(text) -> Column:
    """The text with a space for each white space within a line."""
    text = F.col(text) if isinstance(text, str) else text
    rare = reduce(lambda a, b: a | b, [text.contains(c) for c in "\t\x0b\x0c\r"])
    return F.when(rare, F.translate(text, "\t\x0b\x0c\r", "    ")).otherwise(text)


def _token(h: Column, classes: Column) -> Column:
    return F.get(classes, _slot(h)).bitwiseOR(h.bitwiseAND(F.lit(_HASH)))


def line_tokens(line: Column, classes: Column) -> Column:
    """The distinct words of a spaced line as ordered 64-bit numbers, rarest first."""
    hashes = F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(hashes, lambda h: _token(h, classes)))


# ------------------------------------------------------------------ sketches
def _parity(tokens: Column) -> Column:
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), t.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("bigint"), lambda acc, t: acc.bitwiseXOR(bit(t)))


def sketches(tokens: Column, n: Column, percent: int) -> Column:
    """Lanes of parity bits, as many as the widest class needs in which a line of n words can be the shorter side."""

    def wide(some: Column, lanes: int) -> Column:  # in fours, upper bits of the lane's number first
        if lanes == 1:
            return F.array(_parity(some))
        low = lanes // 4 << 6  # the lower of the two bits
        own = lambda g: F.filter(some, lambda t: t.bitwiseAND(F.lit(3 * low).cast("bigint")) == g)
        return F.flatten(F.transform(F.array(*[F.lit(g * low).cast("bigint") for g in range(4)]), lambda g: wide(own(g), lanes // 4)))

    out = F.array(_parity(tokens))
    for (top, _), (_, lanes) in zip(CLASSES, CLASSES[1:]):
        out = F.when(n * 100 < percent * (top + 1), out).otherwise(wide(tokens, lanes))
    return out


def _lane(sketch: Column, i: int, lanes: int) -> Column:
    """One lane of a sketch of ``lanes`` lanes or, folded, of one of four times as many."""
    at = lambda k: F.get(sketch, F.lit(k))
    return F.when(F.size(sketch) == lanes, at(i)).otherwise(reduce(lambda a, b: a.bitwiseXOR(b), [at(i + k * lanes) for k in range(4)]))


def _may_link(nx: Column, ny: Column, gap: Column, percent: int) -> Column:
    both = nx + ny
    # different sets differ in one word at least, those of one size in two
    some = (100 - percent) * both >= (100 + percent) * F.when(both % 2 == 0, 2).otherwise(1)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & some & ((100 + percent) * gap <= (100 - percent) * both)


def dedupe_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_lines, n_removed`` of every row, with its other columns: the text keeps the lines that stay.

    A line goes if an earlier one (smaller id, or same document and earlier line) has a Jaccard similarity
    of ``percent`` or more; all lines are judged on the input, whether or not the earlier one goes too.

    * lines without words stay; a null text stays null, with no lines
    * rows with a null id come before all others; those of rows that share an id are in the order of their lines' numbers, then of hashes of their texts
    * rows with the same id and the same text count as one document and get the same result
    * an empty table gives no rows; other columns pass through, but for one named ``n_lines`` or ``n_removed``, whose place the result takes
    """
    spark = docs.sparkSession
    work = common.Workspace(spark, "lines")
    text = F.col(text_col).cast("string")
    key_id, key_h = common.row_key(F.col(id_col), text)
    keys = docs.select(key_id.alias("id"), key_h.alias("h"), text.alias("text"))
    classes = rarity_classes(keys.select("text"))
    c = F.col

    cut = keys.select("id", "h", F.posexplode(F.split(_spaced("text"), "\n")).alias("pos", "line")).where(F.trim("line") != "")
    lines = cut.select("id", "h", "pos", line_tokens(c("line"), classes).alias("tokens")).withColumn("n", F.size("tokens"))
    need = F.ceil(c("n") * percent / 100).cast("int")
    lines = lines.select("id", "h", "pos", "n", F.xxhash64("tokens", "n").alias("key"), F.slice("tokens", 1, c("n") - need + 1).alias("prefix"), sketches(c("tokens"), c("n"), percent).alias("sketch"))
    lines = work.save(lines, "lines")
    sets = work.save(lines.groupBy("key").agg(F.min(F.struct("id", "pos", "h")).alias("first"), F.count(F.lit(1)).alias("copies"), *[F.first(x).alias(x) for x in ("n", "prefix", "sketch")]), "sets")
    places = work.save(lines.select("id", "h", "pos", "key"), "places")
    work.drop("lines")
    del lines
    common.release_shuffles(spark)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        return work.save(_similar(pairs, sets, keys, lambda line: line_tokens(line, classes), percent, work, name), name)

    alone = (c("n") * 100 < percent * (c("n") + 1)) & ((c("n") - 1) * 100 < percent * c("n"))  # too short for another set to be near
    able = sets.where(~alone)
    settled = verified(_stars(able, percent), "settled").select(c("x").alias("key"))
    done = F.broadcast(settled) if settled.count() <= BROADCAST_ROWS else settled
    open_ = able.join(done.withColumn("settled", F.lit(True)), "key", "left")
    longest = able.agg(F.max("n")).first()[0] or 0
    met = []
    for (low, _), (top, lanes) in zip(((0, 0), *CLASSES), CLASSES):
        if longest > low:
            met.append(work.save(_class_pairs(open_, low, top, lanes, percent).distinct(), f"met-{lanes}"))
            common.release_shuffles(spark)
    late = settled
    if met:
        pairs = reduce(DataFrame.unionByName, met)
        order = lambda k: sets.select(c("key").alias(k), c("first").alias(f"{k}_first"))
        ordered = pairs.join(order("a"), "a").join(order("b"), "b")
        later = c("a_first") > c("b_first")
        ordered = ordered.select(F.when(later, c("a")).otherwise(c("b")).alias("x"), F.when(later, c("b")).otherwise(c("a")).alias("y"))
        late = late.unionByName(verified(ordered.join(done.withColumnRenamed("key", "x"), "x", "left_anti"), "rest").select(c("x").alias("key")))
    late = late.distinct().withColumn("late", F.lit(True))

    first = sets.select("key", "first", "copies").join(late, "key", "left")
    often = places.count() // OFTEN_SHARE  # more copies than this have OFTEN_SHARE sets at most
    usual, common_ones = first.where(c("copies") <= often), first.where(c("copies") > often)
    found = places.join(F.broadcast(common_ones), "key").unionByName(places.join(F.broadcast(common_ones.select("key")), "key", "left_anti").join(usual, "key"))
    gone = found.where(c("late") | (F.struct("id", "pos", "h") != c("first")))
    gone = work.save(gone.groupBy("id", "h").agg(F.collect_set("pos").alias("gone")), "gone")
    for part in ("places", "sets", "settled", "rest", *[f"met-{lanes}" for _, lanes in CLASSES]):
        work.drop(part)
    common.release_shuffles(spark)
    return _without(docs, gone, id_col, text_col)


def _stars(sets: DataFrame, percent: int) -> DataFrame:
    """``x, y``: lines and the earliest lines in the bucket of one of their words, where they may be similar."""
    c = F.col
    # one lane is as good as four for short lines, the others being 0; wider sketches are folded to four lanes
    lane = lambda k: F.coalesce(F.get("sketch", F.lit(k)), F.lit(0).cast("bigint"))
    folded = lambda i: F.when(F.size("sketch") <= 4, lane(i)).otherwise(reduce(lambda a, b: a.bitwiseXOR(b), [lane(k) for k in range(i, CLASSES[-1][1], 4)]))
    lanes = [f"s{i}" for i in range(4)]
    flat = sets.select("key", "first", "n", "prefix", (F.size("sketch") > 1).alias("wide"), *[folded(i).alias(s) for i, s in enumerate(lanes)])
    flat = flat.withColumn("s", reduce(lambda a, b: a.bitwiseXOR(b), [c(s) for s in lanes]))
    sketch = ["wide", "s", *lanes]
    # by hash, the class in the last byte: the rarest words of near copies are those in which they differ
    by_hash = F.sort_array(F.transform("prefix", lambda t: F.shiftleft(t, 8).bitwiseOR(F.shiftrightunsigned(t, 56))))
    posted = flat.select("key", "first", "n", *sketch, F.slice(by_hash, 1, STAR_WORDS).alias("some")).select("key", "first", "n", *sketch, F.explode("some").alias("token"))
    frequent = F.greatest(c("token").bitwiseAND(F.lit(255)).cast("int") - STAR_BUCKET_LOG2, F.lit(0))
    part = F.pmod(c("key"), F.call_function("shiftleft", F.lit(1).cast("bigint"), frequent))
    like = F.floor(4 * F.log("n")).cast("int")  # lengths that differ by a quarter or less
    in_order = Window.partitionBy("token", like, part).orderBy("first", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    star = posted.select("key", "n", *sketch, *[F.nth_value(F.struct("key", "n", *sketch), i + 1).over(in_order).alias(f"hub{i}") for i in range(STAR_HUBS)])

    def near(hub: str) -> Column:  # of 64 bits or, where both have them, of 256
        differ = lambda s: F.bit_count(c(s).bitwiseXOR(c(f"{hub}.{s}")))
        gap = F.when(c("wide") & c(f"{hub}.wide"), reduce(lambda a, b: a + b, map(differ, lanes))).otherwise(differ("s"))
        return (c("key") != c(f"{hub}.key")) & _may_link(c("n"), c(f"{hub}.n"), gap, percent)

    # few lines have one, so most go before an array is made; no lambda, which Spark would interpret with all that is in it
    hubs = [f"hub{i}" for i in range(STAR_HUBS)]
    some = star.where(reduce(lambda a, b: a | b, map(near, hubs)))
    return some.select(c("key").alias("x"), F.explode(F.array(*[F.when(near(hub), c(f"{hub}.key")) for hub in hubs])).alias("y")).where("y is not null").distinct()


def _class_pairs(sets: DataFrame, low: int, top: int, lanes: int, percent: int) -> DataFrame:
    """``a, b``: pairs that may be similar, of which the longer one has more than ``low`` words and no more than ``top``, and the later one isn't settled."""
    c = F.col
    names = ["key", "n", "settled", "id", *[f"s{i}" for i in range(lanes)]]
    lean = sets.select("key", "n", "settled", c("first.id").alias("id"), "prefix", *[_lane(c("sketch"), i, lanes).alias(f"s{i}") for i in range(lanes)])
    # ceil(2t / (1 + t) * n) words of the shorter side are shared at least
    shared = F.ceil(2 * percent * c("n") / (100 + percent)).cast("int")
    shorter = lean.where((c("n") * 100 >= percent * (low + 1)) & (c("n") <= top)).select(*names, F.posexplode(F.slice("prefix", 1, c("n") - shared + 1)).alias("p", "token"))
    longer = lean.where((c("n") > low) & (c("n") <= top)).select(*names, F.posexplode("prefix").alias("p", "token"))
    a, b = shorter.alias("a"), longer.alias("b")
    gap = reduce(lambda x, y: x + y, [F.bit_count(c(f"a.s{i}").bitwiseXOR(c(f"b.s{i}"))) for i in range(lanes)])
    order = (c("a.n") < c("b.n")) | ((c("a.n") == c("b.n")) & (c("a.key") < c("b.key")))
    place = (100 + percent) * F.least(c("a.n") - c("a.p"), c("b.n") - c("b.p")) >= percent * (c("a.n") + c("b.n"))
    # the later one isn't settled; ids tell which that may be
    open_ = (c("a.settled").isNull() & (c("a.id") >= c("b.id"))) | (c("b.settled").isNull() & (c("b.id") >= c("a.id")))
    meets = (c("a.token") == c("b.token")) & order & place & _may_link(c("a.n"), c("b.n"), gap, percent) & open_
    return a.join(b, meets).select(c("a.key").alias("a"), c("b.key").alias("b"))


def _similar(pairs: DataFrame, sets: DataFrame, keys: DataFrame, tokens_of, percent: int, work: common.Workspace, name: str) -> DataFrame:
    """The ``x`` of pairs that reach the threshold on whole sets; words are read again from the documents that hold them."""
    pairs = work.save(pairs.select("x", "y").distinct(), f"{name}-pairs")
    wanted = pairs.select(F.col("x").alias("key")).union(pairs.select("y")).distinct()
    places = work.save(sets.join(wanted, "key", "left_semi").select("key", "first.id", "first.h", "first.pos"), f"{name}-places")
    holders = places.groupBy("id", "h").agg(F.collect_list(F.struct("pos", "key")).alias("asked"))
    holders = work.save(holders, f"{name}-holders")
    near = F.broadcast(holders) if holders.count() <= BROADCAST_ROWS else holders
    # the text is split once, as a lambda's variable, and not for each line that is asked for
    asked = F.transform(F.array(F.split(_spaced("text"), "\n")), lambda lines: F.transform("asked", lambda a: F.struct(a["key"].alias("key"), F.get(lines, a["pos"]).alias("line"))))
    found = keys.join(near, ["id", "h"]).select(F.explode(F.get(asked, 0)).alias("w")).select("w.key", tokens_of(F.col("w.line")).alias("tokens"))
    whole = work.save(found.dropDuplicates(["key"]), f"{name}-tokens")
    both = pairs.join(whole.select(F.col("key").alias("x"), F.col("tokens").alias("left")), "x").join(whole.select(F.col("key").alias("y"), F.col("tokens").alias("right")), "y")
    shared = F.size(F.array_intersect("left", "right"))
    return both.where((100 + percent) * shared >= percent * (F.size("left") + F.size("right"))).select("x").distinct()


def _without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents without the lines whose numbers are listed."""
    text = F.col(text_col).cast("string")
    key_id, key_h, listed = (common.free_name(docs.columns, f"__{c}") for c in ("id", "h", "gone"))
    own_id, own_h = common.row_key(F.col(id_col), text)
    out = docs.withColumns({key_id: own_id, key_h: own_h}).join(gone.select(F.col("id").alias(key_id), F.col("h").alias(key_h), F.col("gone").alias(listed)), [key_id, key_h], "left")
    split = F.split(text, "\n")
    kept = F.filter(split, lambda line, i: ~F.array_contains(listed, i))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col, "n_lines", "n_removed")]
    return out.select(
        F.col(id_col),
        F.when(F.col(listed).isNull(), text).otherwise(F.array_join(kept, "\n")).alias(text_col),
        F.when(text.isNull(), 0).otherwise(F.size(split)).cast("bigint").alias("n_lines"),
        F.when(F.col(listed).isNull(), 0).otherwise(F.size(listed)).cast("bigint").alias("n_removed"),
        *others,
    )
