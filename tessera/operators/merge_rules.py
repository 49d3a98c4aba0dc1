"""Rules that merge one attribute from several sources into one value, all in row expressions.

Source columns are named ``<source>_<column>``. Nothing here shuffles: each rule is
a projection, and reports are single aggregates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids, text

#: Fixed value: sources in order of trust.
SOURCE_PRIORITY = ("gtr", "scopus", "wos", "openalex")


def source_columns(df: DataFrame, sources, column: str) -> list[str]:
    return [f"{s}_{column}" for s in sources if f"{s}_{column}" in df.columns]


def first_populated(*columns: Column, blank_is_missing: bool = False) -> Column:
    """The first value in order; only nulls count as missing unless told otherwise."""
    return F.coalesce(*[ids.blank_to_null(c) if blank_is_missing else c for c in columns])


def longest(*columns: Column) -> Column:
    """The longest text, ties to the first listed; null where none has a character."""
    options = F.array(*[F.struct(F.coalesce(F.length(c), F.lit(0)).alias("n"), F.lit(-i).alias("i"), c.alias("v")) for i, c in enumerate(columns)])
    best = F.array_max(options)
    return F.when(best["n"] > 0, best["v"])


def majority_or_priority(*columns: Column) -> Column:
    """struct(value, place): a value that more than half of those present share, else the first present.

    place is the 1-based place of the first column that has the value; null where none is present.
    """
    kept = F.filter(F.array(*[F.struct(F.lit(i + 1).alias("place"), c.alias("value")) for i, c in enumerate(columns)]), lambda x: x["value"].isNotNull())
    shared = F.filter(kept, lambda x: F.size(F.filter(kept, lambda y: y["value"] == x["value"])) * 2 > F.size(kept))
    return F.coalesce(F.get(shared, 0), F.get(kept, 0))


def disagrees(*columns: Column) -> Column:
    """Two or more are present and not all are equal."""
    present = F.array_compact(F.array(*columns))
    return (F.size(present) >= 2) & (F.size(F.array_distinct(present)) > 1)


def agreement(df: DataFrame, column: str, sources, kind: str | None = None, fallback: tuple[str, ...] = (), compatibility: bool = True) -> DataFrame:
    """One row: records with the column, with it or a fallback, and with disagreement, on comparison keys."""
    keys = [text.comparison_key(F.col(c), kind or column, compatibility) for c in source_columns(df, sources, column)]
    there = reduce(lambda a, b: a | b, [k.isNotNull() for k in keys])
    more = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in fallback if c in df.columns], there)
    return df.agg(F.count_if(there).alias("n_present"), F.count_if(more).alias("n_with_fallback"), F.count_if(disagrees(*keys)).alias("n_disagree"))


def outlier_counts(df: DataFrame, column: str, sources) -> DataFrame:
    """``source, n_outlier``: rows where three or more are present and this one alone differs from the others."""
    names = source_columns(df, sources, column)
    kept = F.filter(F.array(*[F.struct(F.lit(c.removesuffix(f"_{column}")).alias("source"), F.col(c).alias("value")) for c in names]), lambda x: x["value"].isNotNull())
    values = F.transform(kept, lambda x: x["value"])
    single = F.filter(kept, lambda x: F.size(F.filter(values, lambda v: v == x["value"])) == 1)
    odd = F.when((F.size(kept) >= 3) & (F.size(F.array_distinct(values)) == 2) & (F.size(single) == 1), F.get(single, 0)["source"])
    seen = df.select(odd.alias("source")).where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    names_df = df.sparkSession.createDataFrame([(s, i) for i, s in enumerate(sources)], "source string, place int")
    return names_df.join(seen, "source", "left").select("source", "place", F.coalesce("n", F.lit(0)).alias("n_outlier"))


def source_priority(df: DataFrame, column: str, sources) -> list[str]:
    """Sources from fewest outliers to most, equal ones in the order given; a row for each source is collected."""
    return [r["source"] for r in outlier_counts(df, column, sources).orderBy("n_outlier", "place").collect()]


def merge_majority(df: DataFrame, column: str, sources) -> DataFrame:
    """A28 on ``<source>_<column>``: adds the column and ``<column>_source``."""
    names = source_columns(df, sources, column)
    if not names:
        return df
    best = majority_or_priority(*[F.col(c) for c in names])
    label = F.element_at(F.array(*[F.lit(c.removesuffix(f"_{column}")) for c in names]), best["place"])
    return df.withColumns({column: best["value"], f"{column}_source": F.when(best.isNotNull(), label)})


def compare_numbers(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row comparing two numbers where both are present."""
    a, b = F.col(left), F.col(right)
    both = a.isNotNull() & b.isNotNull()
    gap = F.abs(a - b)
    return df.agg(
        F.count_if(both).alias("n_both"),
        F.count_if(both & (a > b)).alias("n_left_higher"),
        F.count_if(both & (b > a)).alias("n_right_higher"),
        F.count_if(both & (a == b)).alias("n_equal"),
        F.count_if(both & gap.between(1, 2)).alias("n_gap_1_2"),
        F.count_if(both & (gap >= 3)).alias("n_gap_3"),
        F.median(F.when(both, a - b)).alias("median_gap"),
        F.median(F.when(both, gap)).alias("median_abs_gap"),
    )


def map_types(df: DataFrame, raw: str, source: Column, type_map: DataFrame) -> DataFrame:
    """Adds type and subtype from a table ``source, raw, type, subtype``; blank gives null, unknown other/other."""
    keyed = df.withColumns({"__source": source, "__raw": F.lower(F.trim(F.col(raw)))})
    known = type_map.select(F.col("source").alias("__source"), F.col("raw").alias("__raw"), F.col("type").alias("__t"), F.col("subtype").alias("__s"))
    out = keyed.join(known, ["__source", "__raw"], "left")
    there = F.coalesce(F.col("__raw"), F.lit("")) != ""
    return out.withColumns({"type": F.when(there, F.coalesce("__t", F.lit("other"))), "subtype": F.when(there, F.coalesce("__s", F.lit("other")))}).drop("__source", "__raw", "__t", "__s")


def vote_types(types: list[Column], subtypes: list[Column], fallback: tuple[Column, Column]) -> Column:
    """struct(type, subtype): the pair of most sources, else of the first, other/other aside; else the fallback."""
    pairs = [F.when(t.isNotNull() & s.isNotNull() & ~((t == "other") & (s == "other")), F.struct(t.alias("type"), s.alias("subtype"))) for t, s in zip(types, subtypes)]
    best = majority_or_priority(*pairs)["value"]
    return F.struct(F.coalesce(best["type"], fallback[0]).alias("type"), F.coalesce(best["subtype"], fallback[1]).alias("subtype"))


def title_and_abstract(titles: list[Column], abstracts: list[Column], description: Column) -> Column:
    """struct(title, abstract): the longest abstract, else the description; a missing title is the description
    unless that is the abstract already."""
    abstract = F.coalesce(longest(*abstracts), ids.blank_to_null(description))
    title = longest(*titles)
    other = ids.blank_to_null(description)
    fill = F.when(text.match_text(other) != text.match_text(abstract), other)
    return F.struct(F.coalesce(title, fill).alias("title"), abstract.alias("abstract"))


def organisations(*columns: Column, compatibility: bool = True) -> Column:
    """struct(value, disagree): the first that isn't blank; disagreement by sets of names."""
    sets = [F.when(ids.blank_to_null(c).isNotNull(), F.array_join(text.comparison_key(c, "organisation", compatibility), ";")) for c in columns]
    return F.struct(first_populated(*columns, blank_is_missing=True).alias("value"), disagrees(*sets).alias("disagree"))


def fill_issn(issns: list[Column], eissns: list[Column]) -> Column:
    """struct(issn, eissn, disagree): a missing one of the pair is filled when one candidate is left.

    Values are "; " lists; disagreement means that two sources have ISSNs but none in common.
    """
    as_set = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    everything = F.array_distinct(F.flatten(F.array(*[as_set(c) for c in [*issns, *eissns]])))
    issn, eissn = first_populated(*issns, blank_is_missing=True), first_populated(*eissns, blank_is_missing=True)
    left_for_issn = F.array_except(everything, as_set(eissn))
    left_for_eissn = F.array_except(everything, as_set(issn))
    per_source = [F.array_distinct(F.concat(as_set(a), as_set(b))) for a, b in zip(issns, eissns)]
    clashes = [(F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b) for i, a in enumerate(per_source) for b in per_source[i + 1 :]]
    return F.struct(
        F.coalesce(issn, F.when(eissn.isNotNull() & (F.size(left_for_issn) == 1), F.get(left_for_issn, 0))).alias("issn"),
        F.coalesce(eissn, F.when(issn.isNotNull() & (F.size(left_for_eissn) == 1), F.get(left_for_eissn, 0))).alias("eissn"),
        (reduce(lambda a, b: a | b, clashes) if clashes else F.lit(False)).alias("disagree"),
    )


def source_title(titles: list[Column], journals: list[Column], compatibility: bool = True) -> Column:
    """struct(value, disagree): the first source title, then the first journal."""
    keys = [text.comparison_key(ids.blank_to_null(c), "source_title", compatibility) for c in [*titles, *journals]]
    return F.struct(first_populated(*titles, *journals, blank_is_missing=True).alias("value"), disagrees(*keys).alias("disagree"))


def final_url(urls: list[Column], valid: list[Column] | None, doi: Column) -> Column:
    """The first URL (found valid, where that is known), else that of the DOI; null if there is none."""
    there = [ids.blank_to_null(u) for u in urls]
    if valid is not None:
        there = [F.when(F.coalesce(v, F.lit(False)), u) for u, v in zip(there, valid)]
    return F.coalesce(*there, ids.doi_url(doi, strip=False))


def keyword_coverage(df: DataFrame, *columns: str) -> DataFrame:
    """For each column ``column, n_rows, n_entries``: rows with an entry, and entries in all."""
    entries = lambda c: F.size(F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda x: F.trim(x) != ""))
    one = df.agg(*[F.count_if(entries(c) > 0).alias(f"r_{c}") for c in columns], *[F.coalesce(F.sum(entries(c)), F.lit(0)).alias(f"e_{c}") for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r_{c}").alias("n_rows"), F.col(f"e_{c}").alias("n_entries")) for c in columns])
    return one.select(F.explode(rows).alias("x")).select("x.*")


# ------------------------------------------------------------------ projects
def merge_projects(left: DataFrame, right: DataFrame, key: str = "project_id", description: str = "abstract_text_clean", other: str = "description_clean", extra: tuple[str, ...] = ()) -> DataFrame:
    """Every left row with the right side's extra columns; the longer description wins, null counting as length 0."""
    side = right.select(F.col(key), F.col(other).alias("__other"), *extra).dropDuplicates([key])
    joined = left.join(side, key, "left")
    mine, theirs = F.coalesce(F.length(description), F.lit(0)), F.coalesce(F.length("__other"), F.lit(0))
    return joined.withColumn(description, F.when(theirs > mine, F.col("__other")).otherwise(F.col(description))).drop("__other")


def amount_band(a: Column, b: Column) -> Column:
    """How far two amounts differ."""
    gap = F.abs(a - b)
    return F.when(gap.isNull(), None).when(gap == 0, "equal").when(gap <= 1, "within_1").when(gap <= 1000, "within_1000").otherwise("over_1000")


def compare_projects(left: DataFrame, right: DataFrame, key: str, amount: str, start: str, kind: str) -> DataFrame:
    """Rows of projects on both sides with agreement of amount, start date (days apart) and type."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, key)
    days = F.datediff(F.col(f"b.{start}"), F.col(f"a.{start}"))
    same = F.lower(F.trim(F.regexp_replace(f"a.{kind}", "_", " "))) == F.lower(F.trim(F.regexp_replace(f"b.{kind}", "_", " ")))
    return both.select(key, amount_band(F.col(f"a.{amount}"), F.col(f"b.{amount}")).alias("amount_band"), days.alias("days_apart"), same.alias("same_type"))


def attach_sources(outcome_map: DataFrame, sources: dict[str, DataFrame], null_keys_match: bool = False) -> DataFrame:
    """Each source's attributes, prefixed, joined on ``<source>_outcome_id``; the right side has one row for each id.

    Null ids match nothing, unless asked for.
    """
    out = outcome_map
    for name, df in sources.items():
        key = f"{name}_outcome_id"
        side = df.withColumn("outcome_id", F.trim(F.col("outcome_id").cast("string")))
        side = side.select(*[F.col(c).alias(key if c == "outcome_id" else f"{name}_{c}") for c in side.columns if c != "project_id"])
        side = side.dropDuplicates([key])
        out = out.withColumn(key, F.trim(F.col(key).cast("string")))
        if null_keys_match:
            out = out.join(side.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
        else:
            out = out.join(side, key, "left")
    return out
