from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import audit, outcomes
from tessera.streaming import incremental


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_outcome_specs(spark):
    df = spark.createDataFrame([("1", "N/A", "[]", "2001.0", "yes", " A b ", 0), ("1", "late", None, None, None, None, 1), ("2", "x", "[]", "3001", "no", "tbc", 2)], "outcome_id string, title string, refs string, yearFirstProvided string, providedToOthers string, impact string, ord int")
    clean = outcomes.clean_frame(df, order="ord").drop("ord")
    assert "refs" not in clean.columns and clean.count() == 2
    got = outcomes.apply_spec(clean, "researchmaterials")
    assert rows(got, "outcome_id", "title", "year", "provided_to_others", "impact_clean") == [("1", None, "2001", True, "A b"), ("2", "x", None, False, None)]
    pub = spark.createDataFrame([("doi 10.1234/x", "1234567x", "Jane Smith", "2020-05-01", " 12 ")], "doi string, issn string, author string, datePublished string, totalPages string")
    r = outcomes.apply_spec(pub, "publications").first()
    assert (r["doi"], r["issn"], r["author_clean"], r["publication_date"].year, r["total_pages"], r["url"]) == ("10.1234/x", "1234-567x", "Smith J", 2020, 12.0, "https://doi.org/10.1234/x")
    assert outcomes.apply_spec(pub, "publications", ms_only=True).first()["publication_date"] is None
    money = spark.createDataFrame([("GBP", 1.0), (None, 2.0)], "currency string, amount double")
    assert outcomes.single_currency(money, "currency", "amount").columns == ["value_gbp"]
    assert outcomes.numeric(money, "absent").first()["absent"] is None


def test_audits(spark):
    df = spark.createDataFrame([("Smith J", "a"), ("smith j", "b"), ("Lee K", "a"), (None, "a")], "name string, source string")
    assert rows(audit.name_fragmentation(df, "name", "source", {"lower": F.lower("name")}), "n_names", "n_keys", "n_cross_source") == [(3, 2, 1)]
    people = spark.createDataFrame([("k", "J Smith", "J"), ("k", "Jane Smith", "Jane"), ("z", "A", "Ann"), ("z", "B", "Amy")], "key string, raw string, given string")
    assert rows(audit.merge_review(people, "key", "raw", "given"), "key", "reason") == [("k", "initials beside a given name"), ("z", "several given names")]
    hits = spark.createDataFrame([("t", "1", True), ("t", "2", True), ("t", "3", False)], "term string, id string, ok boolean")
    known = spark.createDataFrame([("1",)], "id string")
    assert rows(audit.term_yield(hits, "term", "id", "ok", known), "hits", "passed", "net_new") == [(3, 2, 1)]
    texts = spark.createDataFrame([("Reuse it", None, None), ("no", "reuse", None), (None, None, None)], "title string, raw string, tags string")
    assert rows(audit.search_claims(texts, ["reuse"], ["title"], ["raw", "tags"]), "n", "n_without", "n_in_raw", "n_in_tags") == [(3, 2, 1, 0)]


def test_contributors(spark):
    a = spark.createDataFrame([("r", "Smith", "Jane"), ("r", "Smith", "J."), ("r", "Lee", "K"), ("q", "Lee", "K")], "rec string, surname string, given string")
    c = spark.createDataFrame([("r", "SMITH", "Jane", "1"), ("r", "Lee", "Kim", "2"), ("r", "Lee", "Ken", "3")], "rec string, surname string, given string, identifier string")
    assert rows(audit.contributor_ids(a, c, "rec"), "rec", "surname", "given", "identifier") == [("q", "Lee", "K", None), ("r", "Lee", "K", None), ("r", "Smith", "J.", "1"), ("r", "Smith", "Jane", "1")]


def test_corrected_shares():
    got = audit.corrected_shares({"a": 0.6, "b": 0.4}, {"a": {"a": 0.8, "b": 0.2}, "b": {"a": 0.2, "b": 0.8}})
    assert abs(got["a"] - 2 / 3) < 1e-9


def test_incremental(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("t", T.StringType())])
    src, sink = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([("1", "a"), ("1", "b"), (None, "c")], schema).coalesce(1).write.mode("append").json(src)
    incremental.append_new_keys(spark, src, schema, sink, f"{tmp_path}/cp", "id")
    spark.createDataFrame([("1", "z"), ("2", "y")], schema).coalesce(1).write.mode("append").json(src)
    incremental.append_new_keys(spark, src, schema, sink, f"{tmp_path}/cp", "id")
    assert rows(spark.read.parquet(sink), "id") == [("1",), ("2",)]
    incremental.append_new(spark, src, schema, f"{tmp_path}/all", f"{tmp_path}/cp2", lambda df: df.withColumn("t", F.upper("t")))
    incremental.append_new(spark, src, schema, f"{tmp_path}/all", f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/all").count() == 5


def test_tables(spark):
    import pytest

    from tessera.operators import tables

    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(2, 5), (1, 6)], "k int, w int")
    assert rows(tables.align(a, b, "k"), "k", "v", "w") == [(1, "x", 6), (2, None, 5)]
    with pytest.raises(ValueError):
        tables.align(a, b.limit(1), "k")
    assert rows(tables.union_all(a, b), "k", "v", "w") == sorted([(1, "x", None), (2, None, None), (2, None, 5), (1, None, 6)], key=repr)
    assert [r["k"] for r in tables.top(b, 1, "-w").collect()] == [1]
    same = spark.createDataFrame([(None, "b"), ("a", "c")], "t0 string, t1 string")
    assert [r["t"] for r in tables.first_of_same_name(same, ["t0", "t1"], "t").collect()] == ["b", "a"]
    mapping = spark.createDataFrame([("A", "f"), ("B", None)], "subject string, field string")
    done, unknown = tables.apply_crosswalk(spark.createDataFrame([(1, "A; Z"), (2, "B"), (3, None)], "k int, tags string"), "k", "tags", mapping)
    assert rows(done, "k", "field") == [(1, "f"), (2, None), (3, None)] and rows(unknown, "subject") == [("Z",)]
    assert rows(tables.merged_after(a, "v", {"x": "y"}), "v") == [("y",), (None,)] or rows(tables.merged_after(a, "v", {"x": "y"}), "v") == [(None,), ("y",)]


def test_paged_collection(spark):
    import pytest

    from tessera.sources import rest

    waits, calls = [], []

    def flaky(query, page):
        calls.append(page)
        return (200, None, ["r"]) if len(calls) > 2 else (503, 7.0 if len(calls) == 1 else None, [])

    assert rest.with_retries(flaky, "q", 0, base=2.0, sleep=waits.append) == ["r"] and waits == [7.0, 4.0]
    with pytest.raises(RuntimeError):
        rest.with_retries(lambda q, p: (404, None, []), "q", 0)

    def pages(query, page):
        return 200, None, [f"{query}{page}{i}" for i in range(2 if page < 2 else 1)]

    queries = spark.createDataFrame([("a",), ("b",), (None,)], "query string")
    got = rest.collect_pages(queries, pages, page_size=2)
    assert got.count() == 10 and got.where("query = 'a' and page = 2").first()["record"] == "a20"
    assert rest.missing_queries(queries.where("query is not null"), got.where("query = 'a'")).first()["query"] == "b"
    ids = spark.createDataFrame([(f"i{n:02d}",) for n in range(7)], "k string")
    assert rows(rest.id_batches(ids, "k", 3), "query") == [("i00|i01|i02",), ("i03|i04|i05",), ("i06",)]
