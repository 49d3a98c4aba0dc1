"""Organisations: entities from observed names, lookup decisions, overrides and consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

# Thresholds of lookup scores, and types from most to least telling.
ACCEPT, REVIEW_FLOOR = 0.90, 0.70
TYPE_PREFERENCE = ("education", "healthcare", "government", "facility", "nonprofit", "company", "archive", "other", "funder")


def canonical(name: str, count: str) -> Column:
    """The most frequent name of a group, then the one with most lower-case letters, then the first."""
    lower = F.length(F.regexp_replace(name, r"[^\p{Ll}]", ""))
    return F.min_by(name, F.struct(-F.col(count), -lower, F.col(name)))


def entities(observations: DataFrame, fold: bool = True) -> DataFrame:
    """``key, canonical_name, org_type, n_observations, n_variants, n_sources, sources, variants`` from ``name, source``.

    Companies are keyed without their legal suffixes. Names are counted first, so a name seen many times is one row
    from then on.
    """
    seen = observations.where("name is not null and trim(name) <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.collect_set("source").alias("srcs"))
    kind = text.organisation_type(F.col("name"))
    keyed = seen.withColumn("key", F.when(kind == "company", text.company_key(F.col("name"), fold)).otherwise(text.organisation_key(F.col("name"), fold))).where("key <> ''")
    grouped = keyed.groupBy("key").agg(
        canonical("name", "n").alias("canonical_name"),
        F.sum("n").alias("n_observations"),
        F.array_sort(F.collect_set("name")).alias("variants"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("srcs")))).alias("sources"),
    )
    return grouped.select(
        "key", "canonical_name", text.organisation_type_of_variants(F.col("variants")).alias("org_type"), "n_observations", F.size("variants").alias("n_variants"), F.size("sources").alias("n_sources"), F.array_join("sources", "; ").alias("sources"), "variants"
    )


def best_candidate(candidates: Column) -> Column:
    """The candidate with the highest score."""
    return F.array_max(F.transform(candidates, lambda c: F.struct(c["score"].alias("score"), c.alias("c"))))["c"]


def preferred_type(types: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, t in enumerate(TYPE_PREFERENCE) for x in (t, i)])
    return F.array_min(F.transform(types, lambda t: F.struct(F.coalesce(F.try_element_at(ranks, t), F.lit(99)).alias("r"), t.alias("t"))))["t"]


def apply_lookup(df: DataFrame, lookup: DataFrame, domestic: str = "GB", funded: str = "seen_in_gtr") -> DataFrame:
    """match_method unmatched, review, review_non_uk or auto by score; only auto takes the registry's id, type and place."""
    out = df.join(lookup, "key", "left")
    score = F.coalesce("score", F.lit(0.0))
    method = (
        F.when(F.col("ror_id").isNull() | (score < REVIEW_FLOOR), "unmatched")
        .when((score < ACCEPT) | ~F.coalesce("chosen", F.lit(False)), "review")
        .when((F.coalesce("country_code", F.lit("")) != domestic) & F.coalesce(F.col(funded), F.lit(False)), "review_non_uk")
        .otherwise("auto")
    )
    out = out.withColumn("match_method", method)
    auto = F.col("match_method") == "auto"
    return out.withColumns(
        {
            "institution_id": F.when(auto, F.col("ror_id")).otherwise(F.concat(F.lit("local:"), text.slug(F.col("key")))),
            "id_type": F.when(auto, "ror").otherwise("local"),
            "org_type": F.when(auto, F.coalesce(preferred_type(F.col("ror_types")), "org_type")).otherwise(F.col("org_type")),
            "type_source": F.when(auto & F.col("ror_types").isNotNull(), "registry").otherwise("name"),
        }
    )


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual decisions by institution_id, applied last: accept or reject an id, or set a type."""
    out = df.join(overrides.dropDuplicates(["institution_id"]), "institution_id", "left")
    d = F.col("decision_type")
    return out.withColumns(
        {
            "org_type": F.when(d.isNotNull() & ~d.isin("accept", "reject"), d).otherwise(F.col("org_type")),
            "match_method": F.when(d == "accept", "manual").when(d == "reject", "rejected").otherwise(F.col("match_method")),
            "ror_id": F.when(d == "reject", None).otherwise(F.coalesce("decision_ror", "ror_id")),
        }
    ).drop("decision_ror")


def stale_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    return overrides.join(df.select("institution_id"), "institution_id", "left_anti")


def consolidate(df: DataFrame) -> DataFrame:
    """One row for each institution_id: the base row by provenance then observations, variants and sources united."""
    rank = F.when(F.col("match_method") == "manual", 3).when(F.col("match_method") == "auto", 2).when(F.col("match_method") == "review", 1).otherwise(0)
    return df.groupBy("institution_id").agg(
        F.max_by("canonical_name", F.struct(rank, "n_observations", "canonical_name")).alias("canonical_name"),
        F.max_by("org_type", F.struct(rank, "n_observations", "canonical_name")).alias("org_type"),
        F.max_by("match_method", F.struct(rank, "n_observations", "canonical_name")).alias("match_method"),
        F.sum("n_observations").alias("n_observations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("variants")))).alias("variants"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("sources", "; "))))), "; ").alias("sources"),
    )


def review_queue(df: DataFrame) -> DataFrame:
    """rows that someone should look at, with the first reason that holds; adjudicated ones are left out."""
    uk = F.exists("variants", lambda v: F.lower(v).rlike(r"\buk\b")) & F.exists("variants", lambda v: ~F.lower(v).rlike(r"\buk\b"))
    research = F.col("canonical_name").rlike(f"(?i){text.RESEARCH_WORDS}")
    reason = (
        F.when(F.col("match_method").isin("manual", "rejected"), None)
        .when(F.col("match_method") == "review_non_uk", "match outside the country")
        .when(F.col("match_method") == "review", "uncertain match")
        .when(F.col("org_type") == "unknown", "unknown type")
        .when((F.col("org_type") == "company") & research, "company named like a research body")
        .when(uk, "merged with and without UK")
    )
    return df.withColumn("reason", reason).where("reason is not null")


def identity_rollup(df: DataFrame) -> DataFrame:
    """One row for each identity: the fullest name, distinct outcomes, sources and variants."""
    tokens = F.filter(F.split(F.regexp_replace("raw_name", "[.,]", " "), r"\s+"), lambda t: F.length(t) > 1)
    names = df.groupBy("identity_id", "raw_name").agg(F.count(F.lit(1)).alias("n"), F.first("identity_type").alias("identity_type"), F.collect_set("outcome_id").alias("outs"), F.collect_set("source").alias("srcs"))
    return names.groupBy("identity_id").agg(
        F.min("identity_type").alias("identity_type"),
        F.max_by("raw_name", F.struct(F.size(tokens), F.length("raw_name"), "n", "raw_name")).alias("canonical_name"),
        F.size(F.array_distinct(F.flatten(F.collect_list("outs")))).alias("n_outcomes"),
        F.size(F.array_distinct(F.flatten(F.collect_list("srcs")))).alias("n_sources"),
        F.count(F.lit(1)).alias("n_name_variants"),
    )


def key_collisions(df: DataFrame, a: str, b: str, least: int = 2) -> DataFrame:
    """Values of ``a`` with so many distinct values of ``b``."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.count_distinct(b).alias("n")).where(F.col("n") >= least)
