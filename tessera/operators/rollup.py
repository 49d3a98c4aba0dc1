"""Roll-ups to the grain of a spine: counts, pivots with fixed values, flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_non_null(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """For each key the first value of every column that isn't null."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def distinct_with_null(c: str) -> Column:
    """Distinct values, a null counting as one."""
    return F.count_distinct(c) + F.max(F.when(F.col(c).isNull(), 1).otherwise(0))


def count_pivot(df: DataFrame, key: str, category: str, values, prefix: str = "n_") -> DataFrame:
    """Rows for each key and value, values fixed beforehand so that the schema is, absent ones 0.

    One aggregation with a condition for each value, instead of a pivot's two.
    """
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.count_if(F.col(category) == v).alias(f"{prefix}{v}") for v in values])


def distinct_pivot(df: DataFrame, key: str, category: str, values, counted: str, prefix: str = "n_") -> DataFrame:
    """Distinct values of ``counted`` for each key and value, and over all (``<prefix>all``)."""
    # distinct once per (key, category, counted); then plain sums: no expansion of rows by the number of values
    once = df.where(F.col(key).isNotNull() & F.col(counted).isNotNull()).groupBy(key, counted).agg(*[F.max(F.when(F.col(category) == v, 1).otherwise(0)).alias(f"__{i}") for i, v in enumerate(values)])
    return once.groupBy(key).agg(*[F.sum(f"__{i}").alias(f"{prefix}{v}") for i, v in enumerate(values)], F.count(F.lit(1)).alias(f"{prefix}all"))


def to_spine(spine: DataFrame, key: str, *rollups: DataFrame) -> DataFrame:
    """Roll-ups left-joined to the spine; numbers that are missing become 0."""
    out = spine
    for r in rollups:
        out = out.join(r, key, "left")
        out = out.fillna(0, [c for c, t in r.dtypes if c != key and t in ("bigint", "int", "double")])
    return out


def totals_and_flags(df: DataFrame, columns: list[str], total: str, flag: str) -> DataFrame:
    """A10"""
    return df.withColumn(total, reduce(lambda a, b: a + b, [F.col(c) for c in columns])).withColumn(flag, F.col(total) > 0)


def institution_summary(links: DataFrame, key: str, institution: str, role: str, kind: str, kinds) -> DataFrame:
    """The lead's institution and type, distinct partners, and partners by type; missing counts are 0."""
    lead = links.where(F.col(role) == "lead").groupBy(key).agg(F.min(F.struct(institution, kind)).alias("l")).select(key, F.col(f"l.{institution}").alias("lead_institution"), F.col(f"l.{kind}").alias("lead_type"))
    partners = distinct_pivot(links.where(F.col(role) != "lead"), key, kind, kinds, institution, "n_partners_")
    return links.select(key).distinct().join(lead, key, "left").join(partners, key, "left").fillna(0, [c for c in partners.columns if c != key])


def semi(df: DataFrame, spine: DataFrame, key: str) -> DataFrame:
    """F03"""
    return df.join(spine.select(key).distinct(), key, "left_semi")


def best_citations(merged: str, other: str) -> tuple[Column, Column]:
    """(count, where it is from)."""
    return F.coalesce(merged, other), F.when(F.col(merged).isNotNull(), "merged").when(F.col(other).isNotNull(), "alternative")
