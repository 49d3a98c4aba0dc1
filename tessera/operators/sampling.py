"""Deterministic samples and folds: rows are ordered by a hash of their key with a seed, not drawn from a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lot(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """W11"""
    return df.orderBy(lot(key, seed), key).limit(n)


def allocation(sizes: dict, n: int) -> dict:
    """Proportional shares rounded down, one at least, the remainder to the largest; never over the stratum or n."""
    total = sum(sizes.values())
    n = min(n, total)
    out = {s: min(size, max(1, n * size // total)) for s, size in sizes.items()} if total else {}
    order = sorted(sizes, key=lambda s: (-sizes[s], str(s)))
    at = 0
    while out and sum(out.values()) != n and at < 10 * len(order) + n:
        s = order[at % len(order)]
        if sum(out.values()) < n and out[s] < sizes[s]:
            out[s] += 1
        elif sum(out.values()) > n and out[s] > 1:
            out[s] -= 1
        at += 1
    return out


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, order: Column | None = None, seed: int = 42) -> DataFrame:
    """So many rows of each stratum as ``allocation`` says; a count for each stratum is collected."""
    sizes = {r[stratum]: r["count"] for r in df.groupBy(stratum).count().collect()}
    return matched_sample(df, key, stratum, allocation(sizes, n), order, seed)


def matched_sample(df: DataFrame, key: str, stratum: str, wanted: dict, order: Column | None = None, seed: int = 42) -> DataFrame:
    """Given numbers of rows of each class, without replacement.

    Rows are ranked within parts of a stratum first, and only each part's first ones together, so a large stratum
    takes no single task.
    """
    by = order if order is not None else lot(key, seed)
    table = df.sparkSession.createDataFrame([(s, int(k)) for s, k in wanted.items()], f"{stratum} {df.schema[stratum].dataType.simpleString()}, __k int")
    rows = df.join(F.broadcast(table), stratum).withColumn("__part", F.pmod(F.xxhash64(key), F.lit(64)))
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy(stratum, "__part").orderBy(by, key))).where("__r <= __k")
    return first.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(by, key))).where("__r <= __k").drop("__k", "__part", "__r")


def positions(df: DataFrame, key: str, label: str, repeats: int, seed: int) -> DataFrame:
    """``key, label, repeat, position, n_class``: each row's place from 0 in its class in hash order, for each repeat.

    Numbered within parts of the order, with the parts before as offset: a large class takes no single task.
    """
    each = df.select(key, label, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    each = each.withColumn("__h", F.xxhash64(F.col(key), F.col("repeat") + F.lit(seed))).withColumn("__part", F.shiftright("__h", 58))
    by = [label, "repeat", "__part"]
    sizes = each.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(label, "repeat")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.struct(*by).alias("__by"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("n_class"))
    at = F.row_number().over(Window.partitionBy(*by).orderBy("__h", key)) - 1
    numbered = each.withColumn("__at", at).join(offsets, F.struct(*by).eqNullSafe(F.col("__by")))
    return numbered.select(key, label, "repeat", (F.col("__before") + F.col("__at")).alias("position"), "n_class")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, repeats: int = 5, seed: int = 20260803) -> DataFrame:
    """``key, repeat, fold``: rows of each class dealt in turn in hash order, for each repeat."""
    return positions(df, key, label, repeats, seed).select(key, "repeat", (F.col("position") % folds).cast("int").alias("fold"))


def rare_classes_out(df: DataFrame, label: str, least: int = 5) -> DataFrame:
    """rows of classes with so many rows at least."""
    return df.join(df.groupBy(label).count().where(F.col("count") >= least).select(label), label, "left_semi")


# ------------------------------------------------------------------ S26: samples that add up over runs
def bottom_k(df: DataFrame, group: str, key: str, k: int, order: Column | None = None, seed: int = 42) -> DataFrame:
    """Of each group the ``k`` different keys that come first in ``order`` (a hash of the key), one row for each.

    Samples of parts add up: the first keys of all rows are the first among the parts' first, so ``bottom_k`` of a union
    of samples is that of all rows. ``order`` must follow from the key alone. Each task lets only its first ``k`` keys of
    a group through, so a group with most of the rows is no more to one task than any other. Of a repeated key's rows the
    smallest stays, by the other columns in their order. Rows with a null key are left out; null is a group.
    """
    first = Window.partitionBy(group).orderBy(lot(key, seed) if order is None else order, key)
    taken = df.where(F.col(key).isNotNull()).withColumn("__nth", F.dense_rank().over(first)).where(F.col("__nth") <= k).drop("__nth")
    others = [c for c in df.columns if c not in (group, key)]
    if not others:
        return taken.distinct()
    return taken.groupBy(group, key).agg(F.min(F.struct(*others)).alias("__row")).select(*[c if c in (group, key) else F.col("__row")[c].alias(c) for c in df.columns])


def sample_run(df: DataFrame, group: str, key: str, k: int, path: str, run: int, order: Column | None = None, seed: int = 42) -> None:
    """Leave a run's sample in ``path``; a run that is made again replaces its own."""
    bottom_k(df, group, key, k, order, seed).write.mode("overwrite").parquet(f"{path.rstrip('/')}/run={run}")


def sampled(spark: SparkSession, path: str, group: str, key: str, k: int, order: Column | None = None, seed: int = 42) -> DataFrame:
    """The sample over all runs left in ``path``, made with the same ``k`` or a larger one, the same order and seed."""
    return bottom_k(spark.read.parquet(path).drop("run"), group, key, k, order, seed)


def coverage(sample: DataFrame, group: str, has: Column) -> DataFrame:
    """``group, n, n_has, share``: how many of a sample's rows have what is asked for; unknown counts as no."""
    found = F.count_if(F.coalesce(has, F.lit(False)))
    return sample.groupBy(group).agg(F.count(F.lit(1)).alias("n"), found.alias("n_has"), (found / F.count(F.lit(1))).alias("share"))
