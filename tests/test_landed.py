"""Landed pages: batches, increments, failures, resumption."""

import json

from pyspark.sql import functions as F

from tessera.sources import landed


def _land(spark, path, rows):
    return landed.land_responses(spark.createDataFrame(rows, "query string, page int, status int, records array<string>"), path)


def _rows(df):
    return sorted((r["query"], r["page"], r["ord"], r["record"]) for r in df.collect())


def test_increments_read_each_page_once(spark, tmp_path):
    path, sink, state = (f"file://{tmp_path}/{x}" for x in ("landing", "sink", "state"))
    odd = 'a/b "ü" OR c=1'
    hot = [("hot", p, 200, [json.dumps({"p": p})]) for p in range(150)]
    assert _land(spark, path, [(odd, 0, 200, ["x", "y"]), (odd, 1, 503, None), (odd, 2, 200, ["z"]), ("none", 0, 200, None), (None, 0, 200, ["w"]), ("bad", 0, 429, []), *hot]) == 153
    landed.append_landed(spark, path, sink, state, 1, 16)
    first = spark.read.parquet(sink)
    assert _rows(first.where(F.col("query") != "hot")) == [(odd, 0, 0, "x"), (odd, 0, 1, "y")]
    assert first.where("query = 'hot'").count() == 150
    asked = spark.createDataFrame([(odd,), ("bad",), ("hot",), (None,)], "query string")
    assert sorted(map(tuple, landed.failed_pages(spark, path, asked).collect())) == sorted([(odd, 1), ("bad", 0)])

    landed.append_landed(spark, path, sink, state, 2, 16)  # nothing new
    assert spark.read.parquet(sink).count() == 152
    _land(spark, path, [(odd, 1, 200, ["late", None]), ("new", 0, 200, ["n"]), ("hot", 150, 200, ["{}"])])
    landed.append_landed(spark, path, sink, state, 3, 16)
    got = spark.read.parquet(sink)
    assert _rows(got.where("run = 3").na.fill("null", ["record"])) == sorted([(odd, 1, 0, "late"), (odd, 1, 1, "null"), (odd, 2, 0, "z"), ("new", 0, 0, "n"), ("hot", 150, 0, "{}")])
    assert got.count() == got.select("query", "page", "ord").distinct().count() == 157
    whole = landed.read_landed(spark, path, 16)
    assert _rows(whole.na.fill("", ["record"])) == _rows(got.drop("run").na.fill("", ["record"]))
    assert whole.rdd.getNumPartitions() >= 10  # the hot query is read by many tasks


def test_an_empty_landing(spark, tmp_path):
    assert landed.read_landed(spark, f"file://{tmp_path}/nothing").count() == 0
    assert _land(spark, f"file://{tmp_path}/nothing", []) == 0


def test_landing_goes_on_at_the_page_that_failed(spark, tmp_path):
    path, broken = f"file://{tmp_path}/landing", tmp_path / "broken"
    broken.write_text("")
    flag = str(broken)

    def fetch(query, page):
        import os

        if query == "b" and page == 1 and os.path.exists(flag):
            return 500, 0.0, []
        return 200, None, [f"{query}{page}{i}" for i in range(3 if page < 2 else 1)]

    queries = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "query string")
    run = lambda: sorted(map(tuple, landed.land_pages(queries, fetch, path, 3, 2, 0.0).collect()))
    assert run() == [("a", 3, None), ("b", 1, 1)]
    broken.unlink()
    assert run() == [("a", 0, None), ("b", 2, None)]
    assert run() == [("a", 0, None), ("b", 0, None)]
    assert landed.read_landed(spark, path).count() == 14
    assert landed.failed_pages(spark, path, queries).count() == 0
