"""Flattened records: one value, a list or none at any node; authors stay aligned with their identifiers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import records


def variants(spark, rows):
    df = spark.createDataFrame([(i, None if r is None else json.dumps(r)) for i, r in enumerate(rows)], "k int, j string")
    return df.select("k", F.try_parse_json("j").alias("rec"))


def person(last, first, **ids):
    return {"name": {"last_name": last, "first_name": first, **ids}}


def cited(**parts):
    rec = {"UID": "U1", "static_data": {"summary": {}, "fullrecord_metadata": {}}, "dynamic_data": {}}
    rec["static_data"]["summary"] |= parts.get("summary", {})
    rec["static_data"]["fullrecord_metadata"] |= parts.get("meta", {})
    rec["dynamic_data"] |= parts.get("dynamic", {})
    rec["static_data"] |= parts.get("static", {})
    return rec


def flat(spark, rows):
    return [r.asDict(recursive=True) for r in records.flatten_citation_records(variants(spark, rows), "rec").orderBy("k").collect()]


def test_nodes_of_three_shapes(spark):
    rows = [{"a": {"b": 1}}, {"a": {"b": [1, "x", None]}}, {"a": {"b": None}}, {"a": {}}, {"a": [{"b": 1}]}, "text", [], None]
    got = variants(spark, rows).select("k", F.transform(records.nodes(F.col("rec"), "$.a.b"), lambda x: records.text_at(x)).alias("v")).orderBy("k").collect()
    assert [r["v"] for r in got] == [["1"], ["1", "x", None], [], [], [], [], [], []]


def test_authors_keep_their_identifiers(spark):
    names = [
        {"role": "author", "display_name": "Wang, Li", "last_name": "Wang", "first_name": "Li", "orcid_id": "wrong"},
        {"role": "editor", "display_name": "Ed, A", "last_name": "Ed", "first_name": "A"},
        {"display_name": "", "full_name": "Wang, Y.", "last_name": "Wang", "first_name": "Y."},
        {"role": "author", "display_name": "O'Hara, M", "last_name": "O'Hara", "first_name": "M."},
        {"role": "author", "last_name": None},
        "Anon",
    ]
    people = [person("Wang", "Li", r_id="L-1"), person("Wang", "Yan", orcid_id="0-1"), person("Wang", "Yue", orcid_id="0-2"), person("OHara", "Mary", r_id="M-1", orcid_id="0-3"), person("Wang", "LI", r_id="L-2"), person("", "M", r_id="none"), {"name": "text"}]
    full = cited(summary={"names": {"name": names}}, static={"contributors": {"contributor": people}})
    full["static_data"]["summary"] = {"names": {"name": names}}
    one = cited(static={"contributors": {"contributor": person("Ray", "A", r_id="R")}})
    one["static_data"]["summary"] = {"names": {"name": {"display_name": "Ray, A", "last_name": "Ray", "first_name": "Anna"}}}
    got = flat(spark, [full, one, cited(), None])
    assert [tuple(p.values()) for p in got[0]["people"]] == [("Wang, Li", "L-2", ""), ("Wang, Y.", "", ""), ("O'Hara, M", "M-1", "0-3"), ("", "", "")]
    assert (got[0]["author"], got[0]["researcher_ids"], got[0]["orcids"]) == ("Wang, Li; Wang, Y.; O'Hara, M; ", "L-2; M-1", "0-3")
    assert [tuple(p.values()) for p in got[1]["people"]] == [("Ray, A", "R", "")]
    assert got[2]["people"] == [] and got[2]["author"] == "" and got[3]["author"] in (None, "")


def test_fields_of_a_citation_record(spark):
    rec = cited(
        summary={
            "titles": {"title": [{"type": "source", "content": "J"}, {"type": "item", "content": "T"}, {"type": "item", "content": "T2"}]},
            "pub_info": {"pubyear": 2020, "pubmonth": "MAY"},
            "doctypes": {"doctype": ["Article", {"content": "Data"}, ""]},
            "publishers": {"publisher": {"names": {"name": {"display_name": "P"}}}},
        },
        meta={
            "category_info": {"subjects": {"subject": [{"ascatype": "traditional", "content": "A"}, {"ascatype": "extended", "content": "B"}, {"content": "C"}, {"ascatype": "traditional", "content": ""}]}},
            "keywords": {"keyword": "only"},
            "abstracts": {"abstract": {"abstract_text": {"p": ["One.", {"content": "Two."}]}}},
            "fund_ack": {"grants": {"grant": [{"grant_agency": "F", "grant_ids": {"grant_id": ["g1", {"content": "g2"}]}}, {"grant_ids": {"grant_id": "g3"}}, {"grant_agency": "G"}]}, "fund_text": {"p": "thanks"}},
            "addresses": {"count": 2, "address_name": [{"address_spec": {"city": "Leeds", "organizations": {"organization": ["Univ  Leeds", {"pref": "Y", "content": "University of Leeds - UK"}]}}}, {"address_spec": {"organizations": {"organization": {"content": "Raw"}}}}, {"address_spec": "x"}]},
            "refs": {"count": 31},
        },
        dynamic={
            "cluster_related": {"identifiers": {"identifier": [{"type": "xref_doi", "value": "10.1/x"}, {"type": "issn", "value": "1"}, {"type": "issn", "value": "2"}]}},
            "citation_related": {
                "tc_list": {"silo_tc": [{"coll_id": "WOS", "local_count": 4}, {"coll_id": "WOK", "local_count": 7}]},
                "citation_topics": {"subj-group": {"subject": [{"content-type": "macro", "content": "M"}, {"content-type": "micro", "content": "m"}]}},
                "SDG": {"sdg_category": {"content": "03"}},
            },
        },
    )
    got = flat(spark, [rec])[0]
    want = {"wos_uid": "U1", "doi": "10.1/x", "issn": "1", "eissn": None, "title": "T", "source_title": "J", "pub_year": "2020", "type": "Article; Data", "publisher": "P"}
    want |= {"times_cited_core": "4", "cited_by": "7", "reference_count": "31", "n_addresses": "2", "institutions": "University of Leeds; Raw", "funding_agencies": "F; G", "funding_grant_ids": "g1; g2; g3"}
    want |= {"funding_text": "thanks", "abstract": "One. Two.", "author_keywords": "only", "keywords": "", "categories_traditional": "A", "categories_extended": "B; C"}
    want |= {"citation_topic_macro": "M", "citation_topic_meso": None, "citation_topic_micro": "m", "sdg_categories": "03"}
    assert {k: got[k] for k in want} == want
    assert [tuple(a.values()) for a in got["address_rows"]] == [("University of Leeds - UK", "Univ  Leeds", "Leeds", None, None), ("Raw", "Raw", None, None, None)]


def test_bibliographic_records(spark):
    author = [{"ce:indexed-name": "Smith J.", "@auid": "1", "ce:given-name": "Jane"}, {"@auid": 2}, "x", {"ce:indexed-name": "", "ce:surname": "Roe"}]
    place = [{"affilname": "B", "affiliation-city": "York", "@id": "9"}, {"affilname": "A"}, {"affilname": "B"}, {"@id": "3"}]
    rows = [(1, author, place, [{"$": "S"}, {"$": ""}, {"$": "T"}], None), (2, {"ce:surname": "X"}, {"affilname": "One"}, {"$": "S"}, [{"$": "k"}]), (3, [], [], [], [])]
    df = spark.createDataFrame([(k, *[None if v is None else json.dumps(v) for v in r]) for k, *r in rows], "k int, author string, institutions string, subject_areas string, indexed_keywords string")
    for x in df.columns[1:]:
        df = df.withColumn(x, F.parse_json(x))
    a, b, e = (r.asDict(recursive=True) for r in records.flatten_bibliographic_records(df).orderBy("k").collect())
    assert (a["author"], a["author_names"], a["author_ids"], a["author_given_names"]) == ("Smith J.; Roe", "Smith J.; ; Roe", "1; 2; ", "Jane; ; ")
    assert (a["institutions"], len(a["institution_rows"]), a["subject_areas"], a["keywords"]) == ("A; B", 4, "S; T", None)
    assert (b["author"], b["institutions"], b["subject_areas"], b["keywords"]) == (None, "One", None, "k")
    assert (e["author"], e["institutions"], e["institution_rows"], e["keywords"]) == ("", None, [], "")


def test_works_and_awards(spark):
    people = [{"author": {"id": "A1", "display_name": "Ann", "orcid": "o1"}, "institutions": [{"display_name": "U"}, {"display_name": "V"}]}, {"author": {"display_name": "Bob", "orcid": "o2"}, "institutions": [{"display_name": "U"}]}, {"author": None}, {"author": {}}, {"author": {"id": "A3", "display_name": "Ann"}}]
    work = {"id": "W1", "title": "T", "authorships": people, "topics": [{"display_name": "x"}, {"display_name": "x"}], "primary_topic": {"domain": {"display_name": "D"}}, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "locations": [{"landing_page_url": None, "pdf_url": "p"}, {"landing_page_url": "l"}], "cited_by_count": 3}
    rows = variants(spark, [work, {"doi": "https://doi.org/10.1/a", "abstract_inverted_index": {}, "primary_topic": None}, None]).withColumn("title", F.lit("clash"))
    a, b, e = (r.asDict() for r in records.flatten_works(rows, "rec").orderBy("k").collect())
    assert (a["author"], a["author_names"], a["author_ids"], a["author_orcids"]) == ("Ann; Bob", "Ann; Bob; Ann", "A1; ; A3", "o1; ; ")
    assert (a["institutions"], a["topics"], a["abstract"], a["url"], a["doi"], a["domain"], a["cited_by"], a["title"]) == ("U; V", "x", "a b a", "l", None, "D", "3", "T")
    assert (b["url"], b["doi"], b["abstract"], b["author"]) == ("https://doi.org/10.1/a", "10.1/a", None, "")
    assert e["title"] is None
    award = {"id": "G", "amount": 5.5, "primary_topic": {"score": 0.5, "field": {"display_name": "F"}}}
    got = records.flatten_awards(variants(spark, [award, None]), "rec").orderBy("k").collect()
    assert (got[0]["project_openalex_url"], got[0]["funding_amount"], got[0]["field"], got[0]["domain"], got[1]["field"]) == ("G", "5.5", "F", None, None)


def test_records_are_dealt_however_few_bytes_their_rows_have(spark):
    """Merging small partitions by their bytes would leave all records to one task."""
    from tessera.plans import records as plans

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    used = plans.people(spark, sf).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_once(spark):
    rows = spark.createDataFrame([(None,), ([],), (["1"],), (["1", "2"],)], "v array<string>")
    from tessera.plans import records as plans

    assert [r[0] for r in rows.select(plans.shaped(F.col("v"))).collect()] == ["null", "null", "1", "[1,2]"]


def test_fields_of_a_list_are_read_together(spark):
    """A read of the VARIANT for each field of each value made the CPU of a record grow with both."""

    def reads(df):  # within lambdas: of a list's values one by one
        return df._jdf.queryExecution().analyzed().toString().count("variant_get(lambda")

    rec = variants(spark, [None])
    assert reads(rec.select(F.transform(records.nodes(F.col("rec"), "$"), lambda x: records.text_at(x)))) == 1
    assert reads(records.flatten_works(rec, "rec")) <= 2  # institutions, a list within a list
    four = rec.select(*[F.col("rec").alias(x) for x in ("author", "institutions", "subject_areas", "indexed_keywords")])
    assert reads(records.flatten_bibliographic_records(four)) == 0


def test_values_of_other_kinds_in_a_list(spark):
    """Texts, numbers, lists and nulls among records; authors with fields that aren't read."""
    work = {"authorships": ["x", 5, None, [], {"author": []}, {"author": {"other": 1}}, {"author": {"id": 7, "display_name": ""}, "institutions": {"display_name": "U"}}], "locations": [None, "x", {"pdf_url": ""}, {"pdf_url": ["p"]}]}
    a, b = (r.asDict() for r in records.flatten_works(variants(spark, [work, {"authorships": {"author": {"id": "A"}}}]), "rec").orderBy("k").collect())
    assert (a["author"], a["author_names"], a["author_ids"], a["institutions"], a["url"]) == ("", "; ", "; 7", "U", '["p"]')
    assert (b["author"], b["author_names"], b["author_ids"]) == ("", "", "A")
    rec = cited(meta={"keywords": {"keyword": ["a", 1, None, [], {"content": ["c"]}, {"x": 1}, ""]}})
    assert flat(spark, [rec])[0]["author_keywords"] == 'a; 1; []; ["c"]'


def test_bibliographic_values_of_other_kinds(spark):
    author = ["x", 5, None, [], {}, {"ce:surname": "", "@auid": 7}, {"ce:indexed-name": ["n"], "ce:given-name": ""}]
    place = [None, "x", {}, {"affilname": ""}, {"affilname": 3}]
    rows = [(1, author, place, [{"$": 1}, "x", None]), (2, "x", "y", 3)]
    df = spark.createDataFrame([(k, *[json.dumps(v) for v in r]) for k, *r in rows], "k int, author string, institutions string, subject_areas string")
    df = df.select("k", F.lit("kept").alias("__people"), F.lit(None).cast("variant").alias("indexed_keywords"), *[F.parse_json(x).alias(x) for x in df.columns[1:]])
    a, b = (r.asDict(recursive=True) for r in records.flatten_bibliographic_records(df).orderBy("k").collect())
    assert (a["author"], a["author_names"], a["author_ids"], a["author_given_names"]) == ('["n"]', '; ; ["n"]', "; 7; ", "; ; ")
    assert (a["institutions"], [r["institution"] for r in a["institution_rows"]], a["subject_areas"], a["__people"]) == ("3", [None, "", "3"], "1", "kept")
    assert (b["author"], b["institutions"], b["institution_rows"], b["subject_areas"]) == (None, None, [], None)
