"""Every registered query of the engine against its DuckDB twin on the smallest tables."""

import math
import os
import re
from glob import glob

import duckdb
import pytest

from tessera.plans import catalog, experiments, more, records, roundtrips  # noqa: F401

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v if isinstance(v, (int, bool, str)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    rel = duck.sql(catalog.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_issn_of_all_parts(spark, tmp_path):
    keys = [1, 200, 9_999, 10_000, 20_003, 1_234_567]
    spark.createDataFrame([(k, 7) for k in keys], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["p_partkey"]: (r["issn"], r["issns"]) for r in catalog.QUERIES["p11_p12_issn"](spark, str(tmp_path)).collect()}
    assert got == {k: (f"{k % 10_000:04}-007x", f"{k % 10_000:04}-007X") for k in keys}


def test_screening_of_all_documents(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert any(not x.isascii() for x in docs.values())
    got = {r["doc_id"]: (r["n1"], r["n2"], r["n3"], r["decision"]) for r in catalog.QUERIES["p32_screening"](spark, SF).collect()}
    want = {}
    for i, x in docs.items():
        n = [sum(re.search(rf"(?i)\b{p}", x) is not None for p in tier) for tier in catalog.TIERS]
        want[i] = (*n, "keep" if n[0] or n[1] >= 2 or n[1] and n[2] else "drop")
    assert got == want
