"""Small table operators: unions, sets, ordered reports, dimension lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import nested
from tessera.operators.match import many_to_one


def union_all(*parts: DataFrame) -> DataFrame:
    """Rows of all, by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def common_keys(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """U05"""
    return a.select(*keys).intersect(b.select(*keys))


def ordered(df: DataFrame, *columns: str) -> DataFrame:
    """``-name`` for descending order, nulls last."""
    return df.orderBy(*[F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in columns])


def top(df: DataFrame, n: int, *columns: str) -> DataFrame:
    """The first rows of a report."""
    return ordered(df, *columns).limit(n)


def long_enough(df: DataFrame, *columns: str, more_than: int = 40) -> DataFrame:
    """rows whose texts together have more characters."""
    return df.where(F.length(F.trim(F.concat_ws(" ", *columns))) > more_than)


def distinct_per_group(df: DataFrame, by: str, counted: str, name: str = "n") -> DataFrame:
    """A04"""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count_distinct(counted).alias(name))


def lookup(df: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns of a dimension whose key is there and unique; rows without a match get nulls."""
    side = dimension.where(F.col(key).isNotNull()).select(key, *columns)
    return many_to_one(df, side, key).drop("matched")


def first_of_same_name(df: DataFrame, names: list[str], to: str) -> DataFrame:
    """Columns that a reader numbered because their names were the same, merged to the first that isn't null."""
    return df.withColumn(to, F.coalesce(*[F.col(f"`{n}`") for n in names if n in df.columns])).drop(*[n for n in names if n != to])


def align(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Two tables that must hold the same keys, joined by them instead of by position; raises where they don't."""
    a, b = left.select(*keys), right.select(*keys)
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError(f"the tables differ in {keys}")
    return left.join(right, list(keys))


def apply_crosswalk(df: DataFrame, key: str, tags: str, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with ``field`` by their main mapped tag, subjects that the mapping doesn't know)."""
    parsed = df.withColumn("__tags", nested.weighted_tags(F.col(tags)))
    fields = nested.primary_mapped_tag(parsed, key, "__tags", mapping)
    known = mapping.select("subject").distinct()
    unknown = parsed.select(F.explode("__tags").alias("t")).select(F.col("t.subject").alias("subject")).distinct().join(known, "subject", "left_anti")
    return df.join(fields, key, "left"), unknown


def merged_after(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Labels merged after prediction; the other arm of the comparison merges before training, by the same table."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(table, F.col(column)), F.col(column)))
