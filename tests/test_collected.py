"""Samples that add up over runs, projected texts, and names with titles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import projection, sampling


def _sample(rows, k):
    """Brute force: a group's first keys by hash, the smallest row of each."""
    best = {}
    for g, key, x in rows:
        if key is not None:
            known = best.setdefault(g, {})
            known[key] = min(known.get(key, (x is not None, x or "")), (x is not None, x or ""))
    return best


def test_bottom_k_adds_up(spark, tmp_path):
    rows = [("hot", i % 3000, f"x{i}") for i in range(9000)] + [("b", 1, "y"), ("b", 1, None), ("b", None, "z"), (None, 7, "n"), (None, 7, "n"), (None, 8, "m")]
    df = spark.createDataFrame(rows, "g string, key long, body string")
    order = {r["key"]: r["h"] for r in df.select("key", sampling.lot("key", 42).alias("h")).distinct().collect()}
    want = {(g, key) for g, known in _sample(rows, 50).items() for key in sorted(known, key=lambda x: (order[x], x))[:50]}
    once = sampling.bottom_k(df.repartition(7), "g", "key", 50)
    assert {(r["g"], r["key"]) for r in once.collect()} == want and once.count() == len(want) == 53
    for r in once.collect():
        is_set, body = _sample(rows, 50)[r["g"]][r["key"]]
        assert r["body"] == (body if is_set else None)
    path = f"file://{tmp_path}/samples"
    for run, part in ((0, "key % 2 = 0"), (1, "key > 5000"), (1, "key % 3 = 0"), (2, "true")):
        sampling.sample_run(df.where(part), "g", "key", 50, path, run)
    assert sorted(map(str, sampling.sampled(spark, path, "g", "key", 50).collect())) == sorted(map(str, once.collect()))
    assert sampling.bottom_k(df.limit(0), "g", "key", 5).count() == 0
    assert "WindowGroupLimit" in once._jdf.queryExecution().toString()  # tasks let only their first keys through
    share = {r["g"]: (r["n"], r["n_has"], r["share"]) for r in sampling.coverage(once, "g", F.col("body") == "n").collect()}
    assert share[None] == (2, 1, 0.5) and share["b"] == (1, 0, 0.0)


@pytest.mark.parametrize("dims, error", [(256, 0.09), (2048, 0.035)])
def test_projection_keeps_cosines(spark, dims, error):
    rng = np.random.default_rng(3)
    exact = np.zeros((40, 400))
    for i in range(40):  # groups of ten that share terms
        exact[i, (i // 10) * 60 + rng.permutation(60)[:40]] = rng.random(40) + 0.1
        exact[i, 240 + rng.permutation(160)[:30]] = rng.random(30)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    rows = [(int(i), f"term {j}", float(exact[i, j])) for i, j in zip(*exact.nonzero())] + [(50, None, 1.0), (51, "term 1", None)]
    weights = spark.createDataFrame(rows, "id long, term string, weight double")
    vectors = projection.unit_vectors(projection.project(weights, "id", dims), "id", dims)
    got = {r["id"]: np.array(r["embedding"]) for r in vectors.collect()}
    assert sorted(got) == list(range(40))
    found = np.stack([got[i] for i in range(40)])
    assert found.shape == (40, dims) and np.allclose(np.linalg.norm(found, axis=1), 1)
    off = (found @ found.T - exact @ exact.T)[np.triu_indices(40, 1)]
    assert np.sqrt((off**2).mean()) < error
    again = projection.unit_vectors(projection.project(weights.repartition(5), "id", dims), "id", dims)
    assert all((np.array(r["embedding"]) == got[r["id"]]).all() for r in again.collect())


def test_projection_refuses_odd_sizes(spark):
    with pytest.raises(ValueError):
        projection.project(spark.createDataFrame([], "id long, term string, weight double"), "id", 100)


def test_titles_are_no_names(spark):
    forms = {"Jane Smith": "Smith J", "Cllr Smith": "Cllr Smith", "Senator Jones": "Senator Jones", "Dr. Brown": "Dr Brown", "Sister Agnes": "Sister Agnes", "John Jnr": "John Jnr", "Ann Esquire": "Ann Esquire", "Smith JA": "Smith JA", "van Gogh": "Gogh v", "Anna Maria Lopez": "Anna Maria Lopez", "Dean": "Dean", "": "", None: None}
    df = spark.createDataFrame([(x,) for x in forms], "name string")
    assert {r[0]: r[1] for r in df.select("name", names.normalise_name(F.col("name"))).collect()} == forms


@pytest.mark.parametrize("most_places", [0, 1 << 20])
def test_projection_adds_where_rows_are(spark, monkeypatch, most_places):
    """Eight places of a term are added up by a task, not as eight rows; sums are those of a plain loop, for null keys too."""
    import hashlib

    monkeypatch.setattr(projection, "MOST_PLACES", most_places)
    data = [(None if i % 5 == 4 else f"k{i % 5}", f"wört {i % 90}", ((i * 37) % 101 - 40) / 64.0) for i in range(3000)] + [("k0", None, 1.0), ("k0", "x", None)]
    weights = spark.createDataFrame(data, "id string, term string, weight double").repartition(3)
    want = {}
    for key, term, weight in data[:3000]:
        h = hashlib.md5(term.encode()).hexdigest()
        for j in range(8):
            g = int(h[4 * j : 4 * j + 4], 16)
            place = key, j * 4 + (g >> 1) % 4
            want[place] = want.get(place, 0) + int(weight * (1 << 20)) * (1 if g % 2 == 0 else -1)
    got = projection.project(weights, "id", 32)
    assert {(r["id"], r["pos"]): r["total"] for r in got.collect()} == {k: v for k, v in want.items() if v}
    assert got.schema.simpleString() == "struct<id:string,pos:int,total:bigint>"
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
