"""Audits of names, identifiers, searches and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text


def name_fragmentation(df: DataFrame, name: str, source: str, keys: dict[str, Column]) -> DataFrame:
    """For each way of normalising: distinct names, distinct keys, share collapsed, keys in several sources."""
    out = None
    for label, key in keys.items():
        per = df.where(F.col(name).isNotNull()).select(key.alias("k"), F.col(name).alias("n"), F.col(source).alias("s")).groupBy("k").agg(F.count_distinct("n").alias("n"), F.count_distinct("s").alias("s"))
        one = per.agg(F.lit(label).alias("normaliser"), F.sum("n").alias("n_names"), F.count(F.lit(1)).alias("n_keys"), (1 - F.count(F.lit(1)) / F.sum("n")).alias("collapsed"), F.count_if(F.col("s") > 1).alias("n_cross_source"))
        out = one if out is None else out.unionByName(one)
    return out


def shapes(df: DataFrame, name: str) -> DataFrame:
    """How names are written, counted."""
    return df.groupBy(text.name_shape(F.col(name)).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def merge_review(df: DataFrame, key: str, raw: str, given: str) -> DataFrame:
    """For each key its variants, given names and a flag: several given names, or initials beside one."""
    words = F.filter(F.split(F.lower(F.col(given)), r"[\s.]+"), lambda w: w != "")
    rows = df.select(key, raw, F.get(words, 0).alias("__g"))
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_set(raw)).alias("variants"), F.array_sort(F.collect_set(F.when(F.length("__g") > 1, F.col("__g")))).alias("given_names"), F.max((F.length("__g") == 1).cast("int")).alias("__i"))
    reason = F.when(F.size("given_names") > 1, "several given names").when((F.size("given_names") == 1) & (F.col("__i") == 1), "initials beside a given name").when((F.size("given_names") == 0) & (F.size("variants") > 1), "initials only")
    return grouped.withColumn("reason", reason).drop("__i")


def term_yield(df: DataFrame, term: str, item: str, passed: str, known: DataFrame) -> DataFrame:
    """For each term its hits, those that passed, those not known before, and precision."""
    rows = df.join(known.select(item).distinct().withColumn("__k", F.lit(True)), item, "left")
    return rows.groupBy(term).agg(
        F.count_distinct(item).alias("hits"),
        F.count_distinct(F.when(F.col(passed), F.col(item))).alias("passed"),
        F.count_distinct(F.when(F.col(passed) & F.col("__k").isNull(), F.col(item))).alias("net_new"),
    ).withColumn("precision", F.try_divide(F.col("passed"), F.col("hits")))


def search_claims(df: DataFrame, terms, main: list[str], other: list[str]) -> DataFrame:
    """Rows, those with no term in the main texts, and where the terms of these are found instead."""
    has = lambda c: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t.lower())) for t in terms])
    missing = ~reduce(lambda a, b: a | b, [has(c) for c in main])
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(missing).alias("n_without"), *[F.count_if(missing & has(c)).alias(f"n_in_{c}") for c in other])


def identifier_coverage(df: DataFrame, source: str, authors: str, identifier: str, given: str, bands: tuple[float, float] = (0.40, 0.15)) -> DataFrame:
    """Author slots of each source and the shares with an identifier and a given name, with a verdict by bands."""
    slots = df.select(source, F.explode(authors).alias("a"))
    there = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    out = slots.groupBy(source).agg(F.count(F.lit(1)).alias("n_slots"), F.count_if(there(F.col(f"a.{identifier}"))).alias("n_ids"), F.count_if(there(F.col(f"a.{given}"))).alias("n_given"))
    share = F.col("n_ids") / F.col("n_slots")
    return out.withColumns({"share": share, "verdict": F.when(share >= bands[0], "good").when(share >= bands[1], "partial").otherwise("poor")})


def misaligned(df: DataFrame, *lists: str) -> DataFrame:
    """Rows whose lists differ in length."""
    first = F.size(F.split(F.coalesce(F.col(lists[0]), F.lit("")), ";"))
    return df.where(reduce(lambda a, b: a | b, [F.size(F.split(F.coalesce(F.col(c), F.lit("")), ";")) != first for c in lists[1:]]))


def contributor_ids(authors: DataFrame, contributors: DataFrame, record: str) -> DataFrame:
    """Authors (record, surname, given) with the identifier of the contributor of the same record and letters-only
    surname and given name, else surname and initial where that is one contributor's alone."""
    letters = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]", "")
    keyed = lambda df: df.withColumns({"__s": letters(F.col("surname")), "__g": letters(F.col("given"))}).withColumn("__i", F.substring("__g", 1, 1))
    people = keyed(contributors)
    full = people.groupBy(record, "__s", "__g").agg(F.min("identifier").alias("__full"))
    short = people.groupBy(record, "__s", "__i").agg(F.count_distinct("identifier").alias("__n"), F.min("identifier").alias("__short")).where("__n = 1").drop("__n")
    out = keyed(authors).join(full, [record, "__s", "__g"], "left").join(short, [record, "__s", "__i"], "left")
    return out.withColumn("identifier", F.coalesce("__full", "__short")).drop("__s", "__g", "__i", "__full", "__short")


def overlap_pairs(labelled: DataFrame, known: DataFrame, key: str, labels: str, field: str) -> DataFrame:
    """``label, field`` pairs of records on both sides, lists of labels split."""
    each = labelled.where(F.col(key).isNotNull()).select(key, F.explode(F.filter(F.transform(F.split(labels, ";"), lambda x: F.trim(x)), lambda x: x != "")).alias("label"))
    return each.join(known.where(F.col(key).isNotNull()).select(key, field), key).select("label", field)


def coders(first: DataFrame, *others: DataFrame, key: str, code: str) -> DataFrame:
    """One row for each item of the first coder, with ``code_1``, ``code_2``, ... of all."""
    out = first.select(key, F.col(code).alias("code_1"))
    for i, df in enumerate(others, 2):
        out = out.join(df.select(key, F.col(code).alias(f"code_{i}")), key, "left")
    return out


def refresh_sample(pool: DataFrame, previous: DataFrame, key: str, answers: list[str]) -> DataFrame:
    """The previous sample's items with the pool's present answers."""
    return previous.select(key).join(pool.select(key, *answers), key, "left").where(F.col(answers[0]).isNotNull())


def corrected_shares(shares: dict[str, float], confusion: dict[str, dict[str, float]]) -> dict[str, float]:
    """A42, diagnostic only: shares that a classifier with this confusion (true -> predicted) would have to come from.

    A small least-squares problem over the classes; the result is clipped to zero and scaled to one.
    """
    import numpy as np

    names = sorted(shares)
    m = np.array([[confusion.get(t, {}).get(p, 0.0) for t in names] for p in names])
    x = np.clip(np.linalg.lstsq(m, np.array([shares[p] for p in names]), rcond=None)[0], 0, None)
    return dict(zip(names, (x / x.sum() if x.sum() else x).tolist()))
