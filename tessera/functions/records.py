"""Records of collected works as VARIANT: nodes that may be one value, a list of values or absent.

Every function here is a column expression, so a table of records is flattened in one pass without a shuffle.
A path through a list, or to a node of another kind than asked for, is absent. Null records give null or empty
columns. Authors stay aligned with their identifiers, whatever is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = "; "

# Where the citation index keeps what is read.
META = "$.static_data.fullrecord_metadata"
SUMMARY = "$.static_data.summary"
CITED = "$.dynamic_data.citation_related"
CONTENT = "$.content"

# Scalars of a citation-index record that are taken as they are.
CITATION_SCALARS = {
    "pub_year": f"{SUMMARY}.pub_info.pubyear",
    "pub_month": f"{SUMMARY}.pub_info.pubmonth",
    "cover_date": f"{SUMMARY}.pub_info.coverdate",
    "sort_date": f"{SUMMARY}.pub_info.sortdate",
    "early_access_year": f"{SUMMARY}.pub_info.early_access_year",
    "open_access_gold": f"{SUMMARY}.pub_info.journal_oas_gold",
    "publisher": f"{SUMMARY}.publishers.publisher.names.name.display_name",
    "reference_count": f"{META}.refs.count",
    "n_addresses": f"{META}.addresses.count",
}

# Scalars of a funded-award record.
AWARD_SCALARS = {
    "project_openalex_url": "$.id",
    "description": "$.description",
    "funding_amount": "$.amount",
    "currency": "$.currency",
    "funding_type": "$.funding_type",
    "start_date": "$.start_date",
    "end_date": "$.end_date",
    "ukri_url": "$.landing_page_url",
    "primary_topic": "$.primary_topic.display_name",
    "primary_topic_score": "$.primary_topic.score",
    "subfield": "$.primary_topic.subfield.display_name",
    "field": "$.primary_topic.field.display_name",
    "domain": "$.primary_topic.domain.display_name",
}

# Scalars of a work record.
WORK_SCALARS = {
    "title": "$.title",
    "type": "$.type",
    "publication_date": "$.publication_date",
    "cited_by": "$.cited_by_count",
    "fwci": "$.fwci",
    "domain": "$.primary_topic.domain.display_name",
    "field": "$.primary_topic.field.display_name",
    "subfield": "$.primary_topic.subfield.display_name",
    "openalex_url": "$.id",
}


# ------------------------------------------------------------------ the walker
# A list is read once into records of the fields that are asked for; a value of another kind becomes null there.
def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)`` with the value found once, however often it is used: as a lambda's variable."""
    return F.get(F.transform(F.array(value), make), 0)


def text_at(node: Column, path: str = "$") -> Column:
    """The value at a path as text; null where it is absent or null."""
    return F.try_variant_get(node, path, "string")


def filled(node: Column, path: str = "$") -> Column:
    """As ``text_at``, and null for empty text."""
    return blank_null(text_at(node, path))


def blank_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def listed(node: Column, path: str) -> Column:
    """The list at a path, null where there is none."""
    return F.try_variant_get(node, path, "array<variant>")


def nodes(node: Column, path: str) -> Column:
    """What is at a path as an array: a list's values, one value alone, none if absent or null."""
    one = F.try_variant_get(node, path, "variant")
    return F.coalesce(listed(node, path), F.filter(F.array(one), lambda x: x.isNotNull() & ~F.is_variant_null(x)))


def shape(*fields: str) -> str:
    """The type of a record of texts; ``name type`` is a field of that type."""
    return "struct<" + ", ".join(f"`{f}` string" if " " not in f else "`{}` {}".format(*f.split(" ", 1)) for f in fields) + ">"


def many(node: Column, path: str, kind: str) -> Column:
    """As ``nodes``, with values of one type; one of another type, or absent, is null."""
    return F.coalesce(F.try_variant_get(node, path, f"array<{kind}>"), F.array(F.try_variant_get(node, path, kind)))


def records_at(node: Column, path: str, *fields: str) -> Column:
    """The records at a path, with the fields that are named."""
    return F.array_compact(many(node, path, shape(*fields)))


def words_with(node: Column, path: str, *fields: str) -> Column:
    """What is at a path, texts or records with a ``content``, as (word, record), the record null for a text."""
    one = lambda x, t: F.struct(F.when(x.isNotNull(), x["content"]).otherwise(t).alias("word"), x.alias("record"))
    return F.zip_with(many(node, path, shape("content", *fields)), many(node, path, "string"), one)


def words_at(node: Column, path: str) -> Column:
    """Texts at a path whose values are texts or records with a ``content``; blanks are dropped."""
    return present(words_with(node, path)["word"])


def present(texts: Column) -> Column:
    """Texts that are neither null nor empty."""
    return F.filter(texts, lambda x: x != "")


def joined(texts: Column, separator: str = SEPARATOR) -> Column:
    """Texts joined, nulls and blanks left out."""
    return F.array_join(F.array_remove(texts, ""), separator)


def aligned(texts: Column) -> Column:
    """Texts joined, each in its place: null as an empty one."""
    return F.array_join(texts, SEPARATOR, "")


def chosen(values: Column, test: Callable[[Column], Column], field: str = "content", last: bool = False) -> Column:
    """A field of the first (or last) record that passes a test."""
    return F.try_element_at(F.filter(values, test), F.lit(-1 if last else 1))[field]


def letters(c: Column) -> Column:
    """The letters a to z of a lower-cased text, empty for null."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]", "")


# ------------------------------------------------------------------ P39: citation index
def contributors(record: Column) -> Column:
    """People named with identifiers in a record, with surname and forename as letters; no surname, no entry."""

    def one(x: Column) -> Column:
        name = x["name"]
        return F.struct(
            letters(name["last_name"]).alias("surname"),
            letters(name["first_name"]).alias("forename"),
            F.coalesce(name["r_id"], F.lit("")).alias("researcher_id"),
            F.coalesce(name["orcid_id"], F.lit("")).alias("orcid"),
        )

    found = records_at(record, "$.static_data.contributors.contributor", f"name {shape('last_name', 'first_name', 'r_id', 'orcid_id')}")
    return F.filter(F.transform(found, one), lambda p: p["surname"] != "")


def authors(record: Column) -> Column:
    """Authors in order as (author, surname, forename); names of another role are left out."""
    role = lambda x: F.coalesce(blank_null(x["role"]), F.lit("author"))

    def one(x: Column) -> Column:
        shown = F.coalesce(blank_null(x["display_name"]), blank_null(x["full_name"]), F.lit(""))
        return F.struct(shown.alias("author"), letters(x["last_name"]).alias("surname"), letters(x["first_name"]).alias("forename"))

    found = many(record, f"{SUMMARY}.names.name", shape("role", "display_name", "full_name", "last_name", "first_name"))
    return F.transform(F.filter(found, lambda x: x.isNotNull() & (role(x) == "author")), one)


def identified(people: Column, known: Column) -> Column:
    """Authors with the identifiers of the contributor of the same name (the last of several), else of the only
    contributor with that surname and initial; an author with none keeps empty texts, so places stay aligned."""

    def one(p: Column) -> Column:
        same = F.filter(known, lambda k: (k["surname"] == p["surname"]) & (k["forename"] == p["forename"]))
        near = F.filter(known, lambda k: (k["surname"] == p["surname"]) & (k["forename"] != "") & (F.left(k["forename"], F.lit(1)) == F.left(p["forename"], F.lit(1))))
        alone = F.when(p["forename"] != "", once(near, lambda n: F.when(F.size(n) == 1, F.get(n, 0))))
        hit = once(same, lambda s: F.when(F.size(s) > 0, F.try_element_at(s, F.lit(-1))).otherwise(alone))
        return once(hit, lambda h: F.struct(p["author"].alias("author"), F.coalesce(h["researcher_id"], F.lit("")).alias("researcher_id"), F.coalesce(h["orcid"], F.lit("")).alias("orcid")))

    return F.transform(people, one)


def institution_name(c: Column) -> Column:
    """A name without a country at its end, blanks collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)\s*-\s*UK$", ""), r"(?i)\s*-\s*United Kingdom$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def addresses(record: Column) -> Column:
    """Addresses in order; ``institution`` is the preferred name (the last of several), else the first other one."""
    preferred = lambda o: F.coalesce(o["record"]["pref"] == "Y", F.lit(False))

    def one(x: Column) -> Column:
        spec = x["address_spec"]

        def named(names: Column) -> Column:
            raw = F.get(F.filter(names, lambda o: ~preferred(o) & (o["word"] != "")), 0)["word"]
            best = blank_null(chosen(names, preferred, "word", last=True))
            return F.struct(F.coalesce(best, raw).alias("institution"), raw.alias("institution_raw"), *[spec[f].alias(f) for f in ("city", "country", "full_address")])

        return once(words_with(spec["organizations"]["organization"], "$", "pref"), named)

    spec = shape("city", "country", "full_address", f"organizations {shape('organization variant')}")
    found = many(record, f"{META}.addresses.address_name", shape(f"address_spec {spec}"))
    return F.transform(F.filter(found, lambda x: x["address_spec"].isNotNull()), one)


def flatten_citation_records(df: DataFrame, record: str) -> DataFrame:
    """A row for each row of ``df`` with all columns but the VARIANT ``record``, its fields, and two arrays:
    ``people`` (author, researcher_id, orcid, aligned) and ``address_rows``. The joined ``researcher_ids`` and
    ``orcids`` list only those that are present."""
    r = F.col(record)
    kind = lambda name, value: lambda x: F.coalesce(x[name] == value, F.lit(False))
    base = df.withColumns(
        {
            "__titles": many(r, f"{SUMMARY}.titles.title", shape("type", "content")),
            "__ids": many(r, "$.dynamic_data.cluster_related.identifiers.identifier", shape("type", "value")),
            "__silos": many(r, f"{CITED}.tc_list.silo_tc", shape("coll_id", "local_count")),
            "__subjects": many(r, f"{META}.category_info.subjects.subject", shape("ascatype", "content")),
            "__topics": many(r, f"{CITED}.citation_topics['subj-group'].subject", shape("content-type", "content")),
            "__grants": many(r, f"{META}.fund_ack.grants.grant", shape("grant_agency", f"grant_ids {shape('grant_id variant')}")),
            "__known": contributors(r),
            "__authors": authors(r),
            "address_rows": addresses(r),
        }
    )
    base = base.withColumn("people", identified(F.col("__authors"), F.col("__known")))
    t, ids, silos, subjects, topics, grants = (F.col(f"__{x}") for x in ("titles", "ids", "silos", "subjects", "topics", "grants"))
    ident = lambda name: chosen(ids, kind("type", name), "value")
    category = lambda test: joined(F.filter(subjects, test)["content"])
    columns = {
        "wos_uid": text_at(r, "$.UID"),
        "doi": F.coalesce(blank_null(ident("doi")), ident("xref_doi")),
        "issn": ident("issn"),
        "eissn": ident("eissn"),
        "title": chosen(t, kind("type", "item")),
        "source_title": chosen(t, kind("type", "source")),
        **{name: text_at(r, path) for name, path in CITATION_SCALARS.items()},
        "type": joined(words_at(r, f"{SUMMARY}.doctypes.doctype")),
        "times_cited_core": chosen(silos, kind("coll_id", "WOS"), "local_count", last=True),
        "cited_by": chosen(silos, kind("coll_id", "WOK"), "local_count", last=True),
        "author": aligned(F.col("people")["author"]),
        "researcher_ids": joined(F.col("people")["researcher_id"]),
        "orcids": joined(F.col("people")["orcid"]),
        "institutions": F.array_join(F.transform("address_rows", lambda a: institution_name(blank_null(a["institution"]))), SEPARATOR),
        "funding_agencies": joined(grants["grant_agency"]),
        "funding_grant_ids": joined(F.flatten(F.transform(grants, lambda g: words_at(g["grant_ids"]["grant_id"], "$")))),
        "funding_text": joined(words_at(r, f"{META}.fund_ack.fund_text.p"), " "),
        "abstract": joined(words_at(r, f"{META}.abstracts.abstract.abstract_text.p"), " "),
        "author_keywords": joined(words_at(r, f"{META}.keywords.keyword")),
        "keywords": joined(words_at(r, "$.static_data.item.keywords_plus.keyword")),
        "categories_traditional": category(kind("ascatype", "traditional")),
        "categories_extended": category(lambda x: ~kind("ascatype", "traditional")(x)),
        **{f"citation_topic_{level}": chosen(topics, kind("content-type", level), last=True) for level in ("macro", "meso", "micro")},
        "sdg_categories": aligned(records_at(r, f"{CITED}.SDG.sdg_category", "content")["content"]),
    }
    kept = [f"`{x}`" for x in df.columns if x != record and x not in columns and x not in ("people", "address_rows")]
    return base.select(*kept, *[v.alias(k) for k, v in columns.items()], "people", "address_rows")


# ------------------------------------------------------------------ P37: bibliographic source
def flatten_bibliographic_records(df: DataFrame, author: str = "author", institutions: str = "institutions", subject_areas: str = "subject_areas", keywords: str = "indexed_keywords") -> DataFrame:
    """VARIANT columns of a bibliographic record as text. ``author`` lists the names there are; ``author_names``,
    ``author_ids`` and ``author_given_names`` have a place for each author. What isn't a list gives null, but for one
    institution alone. ``institution_rows`` keeps the institutions as records."""
    only_list = lambda c, *fields: F.try_variant_get(c, "$", f"array<{shape(*fields)}>")
    place = {"institution": "affilname", "city": "affiliation-city", "country": "affiliation-country", "institution_id": "@id"}
    alone = F.try_variant_get(institutions, "$", shape(*place.values()))
    places = F.coalesce(only_list(institutions, *place.values()), F.when(alone.isNotNull(), F.array(alone)))
    person = lambda a: F.struct(F.coalesce(blank_null(a["ce:indexed-name"]), blank_null(a["ce:surname"])).alias("name"), a["@auid"].alias("id"), a["ce:given-name"].alias("given"))
    people = F.transform(F.array_compact(only_list(author, "ce:indexed-name", "ce:surname", "@auid", "ce:given-name")), person)
    read = free(df, "__people"), free(df, "__places")
    rows = F.array_compact(places).cast(f"array<{shape(*place)}>")
    df = df.withColumns(dict(zip(read, (people, rows))))
    p, rows = (F.col(x) for x in read)
    columns = {
        "author": joined(p["name"]),
        "author_names": aligned(p["name"]),
        "author_ids": aligned(p["id"]),
        "author_given_names": aligned(p["given"]),
        "institutions": blank_null(F.array_join(F.sort_array(F.array_distinct(F.array_remove(rows["institution"], ""))), SEPARATOR)),
        "institution_rows": F.coalesce(rows, F.array().cast(f"array<{shape(*place)}>")),
        "subject_areas": joined(only_list(subject_areas, "$")["$"]),
        "keywords": joined(only_list(keywords, "$")["$"]),
    }
    taken = {author, institutions, subject_areas, keywords, *read, *columns}
    return df.select(*[f"`{x}`" for x in df.columns if x not in taken], *[v.alias(k) for k, v in columns.items()])


def free(df: DataFrame, name: str) -> str:
    """A column name that the table hasn't."""
    while name in df.columns:
        name += "_"
    return name


# ------------------------------------------------------------------ P36: works and awards
def flatten_awards(df: DataFrame, record: str) -> DataFrame:
    """A funded award's fields beside the other columns of ``df``; absent ones are null."""
    kept = [f"`{x}`" for x in df.columns if x != record and x not in AWARD_SCALARS]
    return df.select(*kept, *[text_at(F.col(record), p).alias(k) for k, p in AWARD_SCALARS.items()])


def flatten_works(df: DataFrame, record: str) -> DataFrame:
    """A work's fields beside the other columns of ``df``. ``author`` lists each name once; ``author_names``,
    ``author_ids`` and ``author_orcids`` have a place for each author, and an ORCID only beside an id."""
    from tessera.functions.nested import inverted_index_text

    r = F.col(record)
    # all fields of an author, since one with none isn't an author
    df = df.withColumn("__a", many(r, "$.authorships", shape("author map<string,string>", "institutions variant")))
    some = F.filter(F.col("__a")["author"], lambda p: F.size(p) > 0)
    person = lambda p: F.struct(p["display_name"].alias("display_name"), p["id"].alias("id"), F.when(blank_null(p["id"]).isNotNull(), p["orcid"]).alias("orcid"))
    df = df.withColumns({"__p": F.transform(some, person), "__l": many(r, "$.locations", shape("landing_page_url", "pdf_url"))})
    p, places = F.col("__p"), F.col("__l")
    shown = lambda names: F.array_join(F.array_distinct(F.array_remove(names, "")), SEPARATOR)
    named = lambda node, path: many(node, path, shape("display_name"))["display_name"]
    first = lambda texts: F.get(present(texts), 0)
    index = F.try_variant_get(r, "$.abstract_inverted_index", "map<string,array<int>>")
    columns = {
        **{k: text_at(r, path) for k, path in WORK_SCALARS.items()},
        "author": shown(p["display_name"]),
        "author_names": aligned(p["display_name"]),
        "author_ids": aligned(p["id"]),
        "author_orcids": aligned(p["orcid"]),
        "institutions": shown(F.flatten(F.transform(F.col("__a")["institutions"], lambda x: named(x, "$")))),
        "abstract": F.when(F.size(index) > 0, inverted_index_text(index)),
        "topics": shown(named(r, "$.topics")),
        "url": F.coalesce(filled(r, "$.doi"), first(places["landing_page_url"]), first(places["pdf_url"])),
        "doi": F.replace(filled(r, "$.doi"), F.lit("https://doi.org/"), F.lit("")),
    }
    kept = [f"`{x}`" for x in df.columns if x not in (record, "__a", "__p", "__l", *columns)]
    return df.select(*kept, *[v.alias(k) for k, v in columns.items()])
