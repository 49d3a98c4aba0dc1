"""Cleaning of outcome tables, by one specification for each type of outcome."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import ids, names, text
from tessera.operators import quality
from tessera.operators.match import keep_first


@dataclass(frozen=True)
class Spec:
    """What a type of outcome needs beyond the common steps. Names are those after renaming."""

    rename: dict[str, str] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    publication: bool = False


# Columns whose names change otherwise than from camel to snake case, and kinds of columns, by type.
SPECS = {
    "artisticandcreativeproducts": Spec({"yearFirstProvided": "year"}),
    "collaborations": Spec({"parentOrganisation": "parent_org", "childOrganisation": "child_org", "principalInvestigatorContribution": "pi_contribution"}, dates=("start", "end")),
    "disseminations": Spec({"typeOfPresentation": "presentation_type"}, flags=("part_of_official_scheme",)),
    "furtherfundings": Spec({"fundingId": "further_funding_id", "amount.currencyCode": "currency_code", "amount.amount": "amount"}, dates=("start", "end"), numbers=("amount",)),
    "intellectualproperties": Spec({"yearProtectionGranted": "year"}, dates=("start", "end"), flags=("licensed",)),
    "policyinfluences": Spec({"area.item": "policy_areas"}, flags=("licensed",), texts=("influence", "guideline_title", "methods")),
    "products": Spec({"ukcrnIsctnId": "clinical_trial_id", "yearDevelopmentCompleted": "year"}),
    "publications": Spec(
        {"abstractText": "abstract", "otherInformation": "other_info", "datePublished": "publication_date", "publicationUrl": "url", "pubMedId": "pubmed_id", "seriesNumber": "series_num", "volumeTitle": "vol_title", "volumeNumber": "vol_num", "chapterNumber": "chapter_num", "pageReference": "page_ref", "conferenceEvent": "conference", "conferenceNumber": "conference_num"},
        dates=("publication_date",),
        numbers=("total_pages",),
        texts=("abstract", "other_info", "series_title", "sub_title", "vol_title", "chapter_title"),
        publication=True,
    ),
    "researchdatabaseandmodels": Spec({"yearFirstProvided": "year"}, flags=("provided_to_others",)),
    "researchmaterials": Spec({"yearFirstProvided": "year"}, flags=("provided_to_others", "software_developed", "software_open_sourced")),
    "softwareandtechnicalproducts": Spec({"yearFirstProvided": "year"}, flags=("software_open_sourced",)),
    "spinouts": Spec({"website": "url", "registrationNumber": "reg_num", "yearEstablished": "year"}, flags=("ip_exploited", "joint_venture"), texts=("company_description",)),
    "all_outcomes": Spec({}, dates=("publication_date",), publication=True),
}
COMMON_TEXT = ("title", "description", "impact")


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def clean_frame(df: DataFrame, key: str = "outcome_id", order: str | None = None) -> DataFrame:
    """One row for each id (the first in order), placeholders and ``[]`` to null, columns without values dropped."""
    out = keep_first(df, [key], [order or key])
    out = text.each_string(out, lambda c: text.null_placeholders(F.when(F.trim(c) != "[]", c)))
    return quality.drop_empty_columns(out)


def canonical_names(df: DataFrame, rename: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """P25: listed names replaced, others from camel to snake case; names that aren't there are passed over."""
    kept = [c for c in df.columns if c not in drop]
    return df.select(*[F.col(f"`{c}`").alias(rename.get(c, snake(c))) for c in kept])


def apply_spec(df: DataFrame, kind: str, drop: tuple[str, ...] = (), ms_only: bool = False) -> DataFrame:
    """Rename, cast, clean and check years as the type of outcome asks.

    Dates are epoch milliseconds or ISO texts; ``ms_only`` reads the first alone.
    """
    spec = SPECS[kind]
    out = canonical_names(df, spec.rename, drop)
    has = set(out.columns)
    changes = {}
    for c in spec.dates:
        if c in has:
            ms = F.timestamp_millis(F.col(c).cast("string").try_cast("double").cast("bigint")).cast("timestamp_ntz")
            changes[c] = ms if ms_only else F.coalesce(ms, ids.parse_date(F.col(c).cast("string")))
    changes |= {c: text.to_boolean(F.col(c)) for c in spec.flags if c in has}
    changes |= {c: text.to_number(F.col(c)) for c in spec.numbers if c in has}
    if "year" in has:
        changes["year"] = ids.valid_year(F.col("year"))
    if "policy_areas" in has and isinstance(out.schema["policy_areas"].dataType, T.ArrayType):
        changes["policy_areas"] = F.array_join("policy_areas", "; ")
    if spec.publication:
        if "author" in has:
            changes["author_clean"] = names.normalise_name(F.col("author"))
        if "issn" in has:
            changes["issn"] = ids.issn(F.trim("issn"))
        if "doi" in has:
            doi = ids.extract_doi(F.col("doi"))
            urls = [F.col(c) for c in ("supporting_url", "url", "website", "patent_url") if c in has]
            changes |= {"doi": doi, "url": ids.coalesce_url(*urls, doi=doi)}
    out = text.trim_all(out.withColumns(changes)) if changes else text.trim_all(out)
    return text.clean_copies(out, *COMMON_TEXT, *spec.texts)


def single_currency(df: DataFrame, currency: str, amount: str, code: str = "GBP", to: str = "value_gbp") -> DataFrame:
    """Where one currency is all there is, its column goes and the amount says so in its name."""
    found = [r[currency] for r in df.where(F.col(currency).isNotNull()).select(currency).distinct().limit(2).collect()]
    return df.drop(currency).withColumnRenamed(amount, to) if found == [code] else df


def numeric(df: DataFrame, name: str) -> DataFrame:
    """The column as numbers, all null where it is absent."""
    return df.withColumn(name, text.to_number(F.col(name)) if name in df.columns else F.lit(None).cast("double"))
