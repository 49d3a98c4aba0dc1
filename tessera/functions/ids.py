"""Identifiers, URLs and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def extract_doi(c: Column) -> Column:
    """``10.nnnn/...``, null if there is none."""
    found = F.regexp_extract(c, r"(10\.\d{4,9}/[-._;()/:A-Za-z0-9]+)", 1)
    return F.when(found != "", found)


def doi_key(c: Column) -> Column:
    """Lower case, resolver removed, null if empty."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"^https?://(dx\.)?doi\.org/", ""), F.lit(""))


def strict_doi_key(c: Column) -> Column:
    """As doi_key, and null unless it starts with 10."""
    key = doi_key(c)
    return F.when(key.startswith("10."), key)


def doi_url(c: Column, strip: bool = True) -> Column:
    """``strip`` removes resolver and ``doi:`` prefixes first; null and blank give null."""
    key = F.trim(c)
    if strip:
        key = F.regexp_replace(key, r"(?i)^(https?://)?(dx\.)?doi\.org/", "")
        key = F.regexp_replace(key, r"(?i)^doi:\s*", "")
    return F.when(key != "", F.concat(F.lit("https://doi.org/"), key))


def coalesce_url(*columns: Column, doi: Column) -> Column:
    """The first URL that is there, else that of the DOI."""
    return F.coalesce(*[blank_to_null(c) for c in columns], doi_url(doi, strip=False))


def issn(c: Column) -> Column:
    """``1234-567X``; other values without their hyphens."""
    return F.regexp_replace(F.regexp_replace(c, "-", ""), r"^(\d{4})(\d{3}[\dXx])$", "$1-$2")


def issn_list(c: Column) -> Column:
    """All ISSNs in a text, upper case, in order of first appearance, joined by "; "; null if none."""
    found = F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{4}-?\d{3}[\dXx])(?!\d)"), F.lit(1))
    formed = F.transform(found, lambda x: F.regexp_replace(F.upper(F.replace(x, F.lit("-"), F.lit(""))), r"^(.{4})", "$1-"))
    return F.when(F.size(formed) > 0, F.array_join(F.array_distinct(formed), "; "))


def strip_prefix(c: Column, prefix: str) -> Column:
    """A prefix such as ``WOS:`` removed, any case."""
    return F.regexp_replace(c, f"(?i)^{prefix}", "")


def last_segment(c: Column) -> Column:
    """The last part of a URL's path."""
    return F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)


def native_id_key(c: Column) -> Column:
    """Without a trailing ``.0`` and leading zeros; all zeros give ``0``; blank gives null."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(text != "", F.coalesce(F.nullif(F.regexp_replace(text, "^0+", ""), F.lit("")), F.lit("0")))


def source_outcome_id(source: Column, key: Column) -> Column:
    """An outcome's id as its source writes it."""
    return (
        F.when(source == "openalex", last_segment(key))
        .when(source == "scopus", F.regexp_replace(key, r"^2-s2\.0-", ""))
        .when(source == "wos", F.regexp_replace(key, "^WOS:", ""))
        .otherwise(key)
    )


def orcid(c: Column) -> Column:
    """The bare identifier in upper case, empty if there is none."""
    return F.coalesce(F.upper(F.regexp_extract(c, r"(\d{4}-\d{4}-\d{4}-\d{3}[\dXx])", 1)), F.lit(""))


def usable_url(url: Column, status: Column) -> Column:
    """there, looked up, and found valid."""
    return (F.coalesce(F.trim(url), F.lit("")) != "") & F.coalesce(status == "valid", F.lit(False))


def url_syntax(c: Column) -> Column:
    """Whether a URL has a scheme that can be fetched."""
    return F.coalesce(c.rlike("(?i)^https?://[^\\s/]+"), F.lit(False))


def url_status(code: Column) -> Column:
    """404 and 410 are invalid; every other answer, and none, is valid."""
    return F.when(code.isin(404, 410), "invalid").otherwise("valid")


# ------------------------------------------------------------------ dates
def valid_year(c: Column) -> Column:
    """Four digits from 1000 to 2100, as text; a trailing ``.0`` is dropped."""
    text = F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")
    return F.when(text.rlike(r"^\d{4}$") & text.try_cast("int").between(1000, 2100), text)


def year_list(c: Column) -> Column:
    """The valid years of a list, in order."""
    return F.filter(F.transform(F.split(c, r"\s*[,;]\s*"), valid_year), lambda y: y.isNotNull())


def unified_years(publication, fallbacks: list[Column], start_ms: Column, end_ms: Column, dissemination: Column) -> tuple[Column, Column, Column]:
    """P10: (year, start year, end year)."""
    years = year_list(dissemination)
    of_ms = lambda c: F.year(F.timestamp_millis(c.cast("string").try_cast("double").cast("bigint"))).cast("string")
    start = F.coalesce(F.get(years, 0), of_ms(start_ms))
    end = F.coalesce(F.when(F.size(years) > 0, F.element_at(years, -1)), of_ms(end_ms))
    year = F.coalesce(F.year(publication).cast("string"), *[valid_year(c) for c in fallbacks], start, end)
    return year, start, end


def parse_date(*columns: Column) -> Column:
    """The first text that is an ISO date or time, as a timestamp without zone."""
    return F.coalesce(*[F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM")), F.try_to_timestamp(c, F.lit("yyyy"))) for c in columns]).cast("timestamp_ntz")


def project_times(df, start: str, end: str, amount: str, reference_date: str):
    """start_year, end_year, duration_months, elapsed_months, is_complete, has_funding.

    Months are whole days by 30.44, to one decimal, half to even. An open project is measured to the
    reference date.
    """
    s, e, ref = F.col(start).cast("timestamp_ntz"), F.col(end).cast("timestamp_ntz"), F.lit(reference_date).cast("timestamp_ntz")
    months = lambda a, b: F.bround(F.floor((F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(86_400_000_000.0)) / 30.44, 1)
    return df.withColumns(
        {
            "start_year": F.year(s),
            "end_year": F.year(e),
            "duration_months": months(s, e),
            "elapsed_months": months(s, F.coalesce(F.least(e, ref), ref)),
            "is_complete": F.coalesce(e <= ref, F.lit(False)),
            "has_funding": F.coalesce(F.col(amount) > 0, F.lit(False)),
        }
    )
