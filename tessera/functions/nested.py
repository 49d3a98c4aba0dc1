"""Nested records: tags with weights, inverted indexes, links and distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_tags(c: Column) -> Column:
    """``A (60%); B`` to an array of (subject, weight); a tag without a weight has 100."""
    items = F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")
    pattern = r"^(.*?)\s*\((\d+(?:\.\d+)?)\s*%\)$"

    def one(x: Column) -> Column:
        name, weight = F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)
        return F.struct(F.when(weight != "", name).otherwise(x).alias("subject"), F.coalesce(weight.try_cast("double"), F.lit(100.0)).alias("weight"))

    return F.coalesce(F.transform(items, one), F.array().cast("array<struct<subject:string,weight:double>>"))


def format_tags(tags: Column) -> Column:
    """(subject, weight) as ``A (60%); B``; a weight of zero isn't written."""
    one = lambda t: F.when(F.coalesce(t["weight"], F.lit(0.0)) > 0, F.concat(t["subject"], F.lit(" ("), F.format_string("%.0f", t["weight"]), F.lit("%)"))).otherwise(t["subject"])
    return F.array_join(F.transform(tags, one), "; ")


def primary_mapped_tag(df: DataFrame, key: str, tags: str, mapping: DataFrame) -> DataFrame:
    """``key, field``: the mapped field of the heaviest tag that has one; the first of equals."""
    each = df.select(key, F.posexplode(tags).alias("pos", "tag")).select(key, "pos", F.col("tag.subject").alias("subject"), F.col("tag.weight").alias("weight"))
    mapped = each.join(mapping.select("subject", "field"), "subject").where(F.col("field").isNotNull())
    best = mapped.groupBy(key).agg(F.max_by("field", F.struct("weight", -F.col("pos"))).alias("field"))
    return df.select(key).join(best, key, "left")


def tag_distribution(df: DataFrame, key: str, tags: str, mapping: DataFrame) -> DataFrame:
    """``key, field, p``: weights of mapped tags summed by field, adding up to one."""
    each = df.select(key, F.explode(tags).alias("tag")).select(key, F.col("tag.subject").alias("subject"), F.col("tag.weight").alias("weight"))
    sums = each.join(mapping.where("field is not null").select("subject", "field"), "subject").groupBy(key, "field").agg(F.sum("weight").alias("w"))
    from pyspark.sql import Window

    return sums.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy(key))).select(key, "field", "p")


def inverted_index_text(index: Column) -> Column:
    """``{word: [positions]}`` back to text."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.sort_array(places)["w"], " ")


def work_url(doi: Column, locations: Column) -> Column:
    """The DOI, else the first landing page, else the first PDF."""
    first = lambda f: F.get(F.filter(F.transform(locations, lambda x: x[f]), lambda u: u.isNotNull()), 0)
    return F.coalesce(doi, first("landing_page_url"), first("pdf_url"))


def linked(links: Column, rel: str, field: str = "href") -> Column:
    """The targets of links of one relation, in order."""
    return F.transform(F.filter(links, lambda x: x["rel"] == rel), lambda x: x[field])


def flatten_project(df: DataFrame) -> DataFrame:
    """A project record (schema in FIXTURES.md, 1) with its tags, identifiers, dates and links as columns."""
    fund = F.get(F.filter("links.link", lambda x: x["rel"] == "FUND"), 0)
    day = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")
    ids = F.col("identifiers.identifier")
    tags = lambda c: format_tags(F.transform(c, lambda t: F.struct(t["text"].alias("subject"), t["percentage"].alias("weight"))))
    preferred = F.get(F.filter(ids, lambda x: x["type"] == "RCUK"), 0)["value"]
    return df.select(
        F.col("id").alias("project_id"),
        F.coalesce(preferred, F.get(ids, 0)["value"]).alias("grant_reference"),
        "title",
        F.col("abstractText").alias("abstract_text"),
        F.col("techAbstractText").alias("tech_abstract"),
        F.col("potentialImpact").alias("potential_impact"),
        "status",
        F.col("grantCategory").alias("grant_category"),
        F.col("leadFunder").alias("lead_funder"),
        tags(F.col("researchSubjects.researchSubject")).alias("research_subjects"),
        tags(F.col("researchTopics.researchTopic")).alias("research_topics"),
        day(fund["start"]).alias("start_date"),
        day(fund["end"]).alias("end_date"),
        F.get(linked(F.col("links.link"), "LEAD_ORG"), 0).alias("lead_href"),
        linked(F.col("links.link"), "PARTICIPANT_ORG").alias("participant_hrefs"),
        F.get(linked(F.col("links.link"), "PI_PER"), 0).alias("investigator_href"),
        fund["href"].alias("fund_href"),
    )


def top_two(distribution: Column) -> Column:
    """(field, p) of the largest and second largest, ties to the first in the array."""
    ordered = F.array_sort(F.transform(distribution, lambda x, i: F.struct((-x["p"]).alias("neg"), i.alias("i"), x["field"].alias("field"))))
    pick = lambda k: F.get(ordered, k)
    return F.struct(pick(0)["field"].alias("first"), (-pick(0)["neg"]).alias("p_first"), pick(1)["field"].alias("second"), (-pick(1)["neg"]).alias("p_second"))


def rank_of(distribution: Column, field: Column) -> Column:
    """1-based place of a field in descending order of weight, 0 if absent."""
    ordered = F.array_sort(F.transform(distribution, lambda x, i: F.struct((-x["p"]).alias("neg"), i.alias("i"), x["field"].alias("field"))))
    return F.coalesce(F.array_position(F.transform(ordered, lambda x: x["field"]), field), F.lit(0))


def soft_vote(p: Column, q: Column) -> Column:
    """The mean of two aligned probability vectors."""
    return F.zip_with(p, q, lambda a, b: (a + b) / 2)


def ordered_distinct(c: Column) -> Column:
    """Distinct values by first appearance, nulls and blanks dropped."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (F.trim(x) != "")))


def author_list(authors: Column, name: str, ident: str) -> Column:
    """Authors with their identifiers, aligned by construction: an array of (position, name, id)."""
    return F.transform(authors, lambda a, i: F.struct((i + 1).alias("position"), a[name].alias("name"), a[ident].alias("id")))


def explode_references(df: DataFrame, key: str, references: str) -> DataFrame:
    """A row for each cited reference with its place."""
    return df.select(key, F.posexplode_outer(references).alias("pos", "reference")).where("reference is not null").select(key, (F.col("pos") + 1).alias("position"), "reference.*")


def as_list(variant: Column, path: str, kind: str) -> Column:
    """The node at a path of a VARIANT, one or many, as an array."""
    many = F.try_variant_get(variant, path, f"array<{kind}>")
    return F.coalesce(many, F.array_compact(F.array(F.try_variant_get(variant, path, kind))))


def split_roles(df: DataFrame, key: str, lists: dict[str, str], separator: str = ";") -> DataFrame:
    """Delimited columns to rows ``key, item, role``; blanks dropped."""
    parts = []
    for column, role in lists.items():
        items = F.filter(F.transform(F.split(F.col(column), separator), lambda x: F.trim(x)), lambda x: x != "")
        parts.append(df.select(key, F.explode(items).alias("item"), F.lit(role).alias("role")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
