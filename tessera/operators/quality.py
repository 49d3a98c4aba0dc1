"""Data-quality checks. Each returns a small report or raises; none collects rows without a bound."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    pass


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Q01: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    if some := repeated_keys(df, *keys).limit(5).collect():
        raise CheckFailed(f"{keys} repeat: {[tuple(r)[:-1] for r in some]}")
    return df


def assert_columns(df: DataFrame, *names: str) -> DataFrame:
    """Q02"""
    if missing := sorted(set(names) - set(df.columns)):
        raise CheckFailed(f"missing columns: {missing}")
    return df


def assert_same_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """Q03"""
    if (a := before.count()) != (b := after.count()):
        raise CheckFailed(f"{a} rows before, {b} after")
    return after


def figure_drift(figures: dict, committed: dict) -> list[tuple]:
    """Q04: (name, committed, now) of figures that differ."""
    return [(k, v, figures.get(k)) for k, v in committed.items() if figures.get(k) != v]


def assert_count_between(df: DataFrame, low: int, high: int) -> DataFrame:
    """Q05"""
    if not low <= (n := df.count()) <= high:
        raise CheckFailed(f"{n} rows; {low} to {high} expected")
    return df


def probability_mass(df: DataFrame, key: str, p: str) -> DataFrame:
    """Q06: one row ``n_keys, mass``: they are equal where every distribution adds up to one."""
    return df.agg(F.count_distinct(key).alias("n_keys"), F.sum(p).alias("mass"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """One row ``n_rows, n_keys`` of child rows without a parent."""
    return child.join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))


def coverage(df: DataFrame, *columns: str) -> DataFrame:
    """``column, n_present, n_blank`` in one pass."""
    one = df.agg(*[F.count(c).alias(f"p_{c}") for c in columns], *[F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"b_{c}") for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"p_{c}").alias("n_present"), F.col(f"b_{c}").alias("n_blank")) for c in columns])).alias("x")).select("x.*")


def group_coverage(df: DataFrame, by: str, *columns: str) -> DataFrame:
    """Rows for each group and how many have a value that isn't blank."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.trim(F.col(c).cast("string")) != "").alias(f"n_{c}") for c in columns])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without columns that are null or blank in every row; one pass decides."""
    if not df.columns:
        return df
    seen = df.agg(*[F.max(F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", 1)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if seen[i]])


def compare_collections(old: DataFrame, new: DataFrame, keys: list[str], tolerance: float = 0.01) -> dict:
    """Row counts, whether they are within the tolerance, and keys lost and gained."""
    a, b = old.count(), new.count()
    o, n = old.select(*keys).distinct(), new.select(*keys).distinct()
    return {"old": a, "new": b, "within": abs(b - a) <= tolerance * max(a, 1), "lost": o.join(n, keys, "left_anti").count(), "gained": n.join(o, keys, "left_anti").count()}


class GateFailed(CheckFailed):
    """A gate of ``write_checked`` that the rows didn't pass; what was measured is in ``measured``."""

    def __init__(self, failed: list[str], measured: dict):
        super().__init__(f"{', '.join(failed)}: {measured}")
        self.failed, self.measured = failed, measured


def write_checked(df: DataFrame, path: str, gates: dict[str, tuple[Column, Callable[[object], bool]]]) -> dict:
    """Q02 Q03 Q05 in the pass that writes: each gate is an aggregate of the rows and what it must satisfy.

    The rows are written beside ``path`` and measured on the way, with no scan of their own; they move to ``path`` only if
    all gates pass, else they are deleted and ``GateFailed`` says which failed. ``path`` must not exist yet.
    """
    from pyspark.sql import Observation

    spark = df.sparkSession
    jvm, staged = spark._jvm, f"{path.rstrip('/')}__staged"
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    system = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(at(path)):
        raise FileExistsError(path)
    seen = Observation("gates")
    try:
        df.observe(seen, *[what.alias(name) for name, (what, _) in gates.items()]).write.mode("overwrite").parquet(staged)
        measured = seen.get
        failed = [name for name, (_, passes) in gates.items() if not passes(measured.get(name))]
        if failed:
            raise GateFailed(failed, measured)
        if not system.rename(at(staged), at(path)):
            raise OSError(f"could not move {staged} to {path}")
    finally:
        system.delete(at(staged), True)
    return measured
