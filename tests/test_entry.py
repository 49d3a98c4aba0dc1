"""The driver's contract: names, twins and the flagship query."""

import os

import pytest

import __spark_entry__ as entry


def test_names_and_twins():
    names, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(names) and len(names) > 100
    assert all(callable(f) for f in names.values())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
    assert "duration_months" in df.columns
