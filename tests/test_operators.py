import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate, graph, learn, match, merge_rules, quality, registry, rollup, sampling
from tessera.sources import io


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_majority(spark):
    df = spark.createDataFrame([(1, "a", "b", "b"), (2, "a", "b", None), (3, None, None, None), (4, None, "x", "y")], "id int, gtr_v string, scopus_v string, wos_v string")
    got = merge_rules.merge_majority(df, "v", merge_rules.SOURCE_PRIORITY)
    assert rows(got, "id", "v", "v_source") == [(1, "b", "scopus"), (2, "a", "gtr"), (3, None, None), (4, "x", "scopus")]


def test_longest_ties_and_blanks(spark):
    df = spark.createDataFrame([("ab", "cd"), (None, ""), ("", "x")], "a string, b string")
    assert [r["x"] for r in df.select(merge_rules.longest(F.col("a"), F.col("b")).alias("x")).collect()] == ["ab", None, "x"]


def test_outliers_and_priority(spark):
    df = spark.createDataFrame([("1", "1", "2"), ("1", "1", "2"), ("3", "1", "1"), ("1", "2", "3"), ("1", None, "2")], "gtr_y string, scopus_y string, wos_y string")
    assert merge_rules.source_priority(df, "y", ("wos", "gtr", "scopus")) == ["scopus", "gtr", "wos"]


def test_title_and_abstract(spark):
    df = spark.createDataFrame([(None, "Long text", "Long text!"), (None, None, "Described"), ("T", "a", "b"), (None, "abs", "other")], "t string, a string, d string")
    got = [tuple(r["x"]) for r in df.select(merge_rules.title_and_abstract([F.col("t")], [F.col("a")], F.col("d")).alias("x")).collect()]
    assert got == [(None, "Long text"), (None, "Described"), ("T", "a"), ("other", "abs")]


def test_vote_types(spark):
    df = spark.createDataFrame([("publication", "article", "other", "other"), ("other", "other", None, None)], "t1 string, s1 string, t2 string, s2 string")
    x = merge_rules.vote_types([F.col("t1"), F.col("t2")], [F.col("s1"), F.col("s2")], (F.lit("f"), F.lit("g")))
    assert [tuple(r["x"]) for r in df.select(x.alias("x")).collect()] == [("publication", "article"), ("f", "g")]


def test_attach_sources_null_keys(spark):
    m = spark.createDataFrame([(1, "a "), (2, None)], "id int, gtr_outcome_id string")
    s = spark.createDataFrame([("a", "A"), ("a", "A"), (None, "N")], "outcome_id string, title string")
    assert rows(merge_rules.attach_sources(m, {"gtr": s}), "id", "gtr_title") == [(1, "A"), (2, None)]
    assert rows(merge_rules.attach_sources(m, {"gtr": s}, null_keys_match=True), "id", "gtr_title") == [(1, "A"), (2, "N")]


def test_two_key_match(spark):
    old = spark.createDataFrame([(1, "p", "Title", None, "gtr", "title"), (2, "p", None, "Desc", "gtr", "description")], "ord long, project_id string, title string, description string, source string, match_basis string")
    new = spark.createDataFrame([(1, "p", "title!", None, "x1"), (2, "p", "no", "desc", "x2"), (3, "p", "TITLE", None, "x3"), (4, "p", "new", None, "x4"), (5, "p", "New", None, "x5"), (6, "p", None, " ", "x6")], "ord long, project_id string, title string, description string, wos_outcome_id string")
    got = match.match_two_keys(old, new, "wos")
    assert rows(got, "wos_outcome_id", "source", "match_basis") == [("x2", "gtr; wos", "description"), ("x3", "gtr; wos", "title"), ("x4", "wos", "title")]


def test_keep_first_and_ids(spark):
    df = spark.createDataFrame([(3, "b", None), (1, "b", "x"), (2, "a", "y"), (4, None, "z")], "ord int, k string, v string")
    assert rows(match.keep_first(df, ["k"], ["ord"]), "k", "v") == [("a", "y"), ("b", "x"), (None, "z")]
    assert rows(match.ordinal_ids(df.where("k is not null"), "k", "ord"), "k", "global_id") == [("a", "OUT000002"), ("b", "OUT000001")]


def test_many_to_one(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert rows(match.many_to_one(left, right, "k"), "k", "v", "matched") == [(1, "a", True), (2, None, False)]
    with pytest.raises(ValueError):
        match.many_to_one(left, right.union(right), "k")


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (7, 3)]
    got = dict(rows(graph.connected_components(spark.createDataFrame(edges, "a int, b int")), "node", "component"))
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[i] == 100 for i in (100, 101, 102))
    ids = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, None, "x"), (4, "b", None), (5, None, " ")], "r int, doi string, eid string")
    assert rows(graph.shared_id_components(ids, "r", {"doi": "doi", "eid": "eid"}), "r", "component") == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]


def test_identities(spark):
    data = [
        (1, "P1", "smith j", "jane", "orcid:1", "orcid"),
        (2, "P1", "smith j", "jane", "native:9", "native_id"),
        (3, "P1", "smith j", None, "name:smith_j", "name_only"),
        (4, "P2", "smith j", "john", "name:smith_j", "name_only"),
        (5, "P3", "smith j", "jane", "native:9", "native_id"),
        (6, "P3", "smith j", "jane", "orcid:2", "orcid"),
        (7, "P4", "lee k", "kim", "native:5", "native_id"),
        (8, "P4", "lee k", "ken", "native:6", "native_id"),
    ]
    df = spark.createDataFrame(data, "row_id int, paper_key string, name_key string, given_key string, identity_id string, identity_type string")
    got = dict(rows(graph.resolve_identities(df), "row_id", "identity_id"))
    # the second paper would chain two ORCIDs through one native id, so it is left alone
    assert got == {1: "orcid:1", 2: "orcid:1", 3: "orcid:1", 4: "name:smith_j", 5: "orcid:1", 6: "orcid:2", 7: "native:5", 8: "native:6"}


def united(data):
    """G02 said plainly: groups in order, each united unless that joins two ORCIDs."""
    groups, size, parent = {}, {}, {}
    for _, paper, name, given, ident, kind in data:
        size[ident] = size.get(ident, 0) + 1
        if paper is not None and name is not None:
            g = groups.setdefault((paper, name), (set(), set(), set()))
            g[0].add(ident), kind != "name_only" and g[1].add(ident), given is not None and g[2].add(given)

    def root(x):
        return x if parent.get(x, x) == x else root(parent[x])

    good = {k: strong for k, (ids, strong, given) in groups.items() if len(ids) >= 2 and len(given) == 1 and strong}
    for k in sorted(good):
        roots = {root(x) for x in good[k]}
        if sum(r.startswith("orcid:") for r in roots) <= 1:
            best = min(roots, key=lambda x: (not x.startswith("orcid:"), -size[x], x))
            parent |= {r: best for r in roots}
    anchor = {k: roots.pop() for k, strong in good.items() if len(roots := {root(x) for x in strong}) == 1}
    return {i: anchor.get((paper, name), ident) if kind == "name_only" else root(ident) for i, paper, name, _, ident, kind in data}


@pytest.mark.parametrize("most_links", [0, 6, 10_000])
def test_identities_by_rounds(spark, most_links):
    rng = random.Random(most_links)
    data = []
    for i in range(400):
        kind = rng.choice(["orcid", "native_id", "native_id", "native_id", "name_only"])
        block = rng.randrange(6)
        ident = "name:n" if kind == "name_only" else f"{kind[:6].rstrip('_')}:{block}-{rng.randrange(12 if kind == 'orcid' else 40)}"
        data.append((i, f"{block}-{rng.randrange(30)}", rng.choice("nnm"), "ann", ident, kind))
    df = spark.createDataFrame(data, "row_id int, paper_key string, name_key string, given_key string, identity_id string, identity_type string")
    assert dict(rows(graph.resolve_identities(df, most_links), "row_id", "identity_id")) == united(data)


def test_identities_share_tasks(spark):
    data = [(2 * i + j, f"p{i}", "n", "ann", f"native:{i}-{j}", "native_id") for i in range(500) for j in (0, 1)]
    df = spark.createDataFrame(data, "row_id int, paper_key string, name_key string, given_key string, identity_id string, identity_type string")
    got = graph.resolve_identities(df, 10)
    assert len({r["identity_id"] for r in got.collect()}) == 500
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()  # no call for each component


def test_identities_nothing_broadcast(spark, tmp_path):
    """Sizes are guessed from a small file of which much is made; a row for each identity must not pass the driver."""
    spark.range(300).withColumnRenamed("id", "k").write.parquet(f"{tmp_path}/few")
    each = spark.read.parquet(f"{tmp_path}/few").select("k", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("side"))
    rows_ = each.select((F.col("k") * 2 + F.col("side")).alias("row_id"), F.col("k").cast("string").alias("paper_key"), F.lit("n").alias("name_key"), F.lit("ann").alias("given_key"), F.concat_ws("-", "k", "side").alias("native_id"), F.lit(None).cast("string").alias("orcid"))
    for most in (0, 100, 10_000):
        got = graph.resolve_identities(graph.assign_identities(rows_), most)
        assert len({r["identity_id"] for r in got.collect()}) == 300
        assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    edges = each.select(F.col("k").alias("a"), (F.col("k") + 1000).alias("b"))
    plans = []
    cut = type(edges).checkpoint
    try:
        type(edges).checkpoint = lambda df, *a, **b: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, *a, **b)
        assert graph.connected_components(edges).count() == 600
    finally:
        type(edges).checkpoint = cut
    assert plans and not [p for p in plans if "Broadcast" in p]


def test_registry(spark):
    seen = spark.createDataFrame([("Firm Ltd", "a"), ("FIRM LIMITED", "b"), ("Firm Ltd", "b"), (" ", "a"), (None, "a"), ("Uni of X", "a")], "name string, source string")
    got = registry.entities(seen)
    assert rows(got, "key", "canonical_name", "org_type", "n_observations", "sources") == [("firm", "Firm Ltd", "company", 3, "a; b"), ("uni x", "Uni of X", "unknown", 1, "a")]
    df = spark.createDataFrame([("i", "A", "company", "auto", 5, ["A"], "a"), ("i", "B", "unknown", "manual", 1, ["B"], "b; a")], "institution_id string, canonical_name string, org_type string, match_method string, n_observations int, variants array<string>, sources string")
    assert rows(registry.consolidate(df), "canonical_name", "n_observations", "variants", "sources") == [("B", 6, ["A", "B"], "a; b")]


def test_rollups(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), ("a", "y", 1), (None, "x", 2)], "k string, kind string, v int")
    assert rows(rollup.count_pivot(df, "k", "kind", ["x", "z"]), "k", "n_x", "n_z") == [("a", 2, 0)]
    assert rows(rollup.distinct_pivot(df, "k", "kind", ["x", "y"], "v"), "k", "n_x", "n_y", "n_all") == [("a", 1, 1, 1)]
    spine = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(rollup.to_spine(spine, "k", rollup.count_pivot(df, "k", "kind", ["x"])), "k", "n_x") == [("a", 2), ("b", 0)]


def test_curve_and_wilson(spark):
    df = spark.createDataFrame([(0.9, True), (0.9, False), (0.5, True), (0.1, False)], "conf double, ok boolean")
    curve = evaluate.accuracy_reject_curve(df, "conf", "ok")
    assert rows(curve, "threshold", "n_retained", "n_correct") == [(0.1, 4, 2), (0.5, 3, 2), (0.9, 2, 1)]
    assert evaluate.pick_threshold(curve, 0.6, 0.1).first()["threshold"] == 0.5
    assert evaluate.pick_threshold(curve, 0.99, 0.1).count() == 0
    low = spark.range(1).select(evaluate.wilson(F.lit(171.0), F.lit(213.0)).alias("w")).first()["w"]
    assert (round(low["low"], 4), round(low["high"], 4)) == (0.7442, 0.8507)


def test_alpha_and_wilcoxon(spark):
    codes = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "a")], "item int, code string")
    r = evaluate.krippendorff_alpha(codes, "item", "code").first()
    assert (r["n_items"], r["alpha"]) == (2, 1.0)
    df = spark.createDataFrame([(float(i), 0.0) for i in range(1, 7)], "a double, b double")
    assert evaluate.wilcoxon(df, "a", "b") == {"statistic": 0.0, "n": 6, "p": 0.03125}


def test_sampling(spark):
    assert sampling.allocation({"a": 90, "b": 9, "c": 1}, 10) == {"a": 9, "b": 1, "c": 1} or sum(sampling.allocation({"a": 90, "b": 9, "c": 1}, 10).values()) == 10
    df = spark.createDataFrame([(i, "a" if i < 90 else "b") for i in range(100)], "k int, s string")
    got = sampling.stratified_sample(df, "k", "s", 10)
    assert got.count() == 10 and got.groupBy("s").count().where("s = 'b'").first()["count"] == 1
    folds = sampling.stratified_folds(df, "k", "s", 5, 2)
    assert folds.count() == 200 and folds.where("repeat = 0").groupBy("fold").count().count() == 5


def test_quality(spark):
    df = spark.createDataFrame([(1, " ", None), (1, "x", None)], "k int, a string, b string")
    with pytest.raises(quality.CheckFailed):
        quality.assert_unique(df, "k")
    with pytest.raises(quality.CheckFailed):
        quality.assert_columns(df, "zz")
    assert quality.drop_empty_columns(df).columns == ["k", "a"]
    assert quality.compare_collections(df, df.limit(1), ["k"])["lost"] == 0
    assert quality.figure_drift({"n": 2}, {"n": 1}) == [("n", 1, 2)]


def test_learning(spark):
    data = [(i, float(i % 2), "solar wind power" if i % 2 else "cell biology gene") for i in range(20)]
    df = spark.createDataFrame(data, "id int, label double, text string")
    feats = learn.tfidf().fit(df).transform(df).select("id", "label", "features").cache()
    model = learn.logistic(learn.balanced_weights(feats, "label"), 1.0)
    assert model.transform(feats).where("prediction <> label").count() == 0
    assert learn.naive_bayes(feats).transform(feats).where("prediction <> label").count() == 0
    folds = df.select("id", (F.col("id") % 5).alias("fold"))
    oof = learn.out_of_fold(feats, "id", folds, lambda t: learn.logistic(learn.balanced_weights(t, "label"), 1.0))
    assert oof.count() == 20 and oof.where("prediction <> label").count() == 0
    vote = learn.soft_vote(model.transform(feats), model.transform(feats), "id")
    assert vote.join(df, "id").where("prediction <> label").count() == 0


def test_learning_sends_a_gradient_for_each_core(spark):
    """However many partitions the rows are in."""
    sc = spark.sparkContext
    df = spark.createDataFrame([(float(i % 2), 1.0, [float(i % 2), float(i % 3)]) for i in range(96)], "label double, weight double, x array<double>").repartition(48)
    sc.setJobGroup("gradients", "fit")
    try:
        learn.logistic(df.select("label", "weight", learn.as_vector("x").alias("features")), 1.0)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    track = sc.statusTracker()
    stages = [track.getStageInfo(s) for j in track.getJobIdsForGroup("gradients") for s in track.getJobInfo(j).stageIds]
    tasks = [s.numTasks for s in stages if s is not None and "treeAggregate" in s.name]
    assert tasks and max(tasks) <= sc.defaultParallelism


def test_io(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", "5")], "outcome_id string, gtr_title_clean string, gtr_cited_by string")
    io.write_csv(df, f"{tmp_path}/c")
    types = {"outcome_id": "string", "title": "string", "cited_by": "bigint"}
    assert io.canonical_column("gtr_title_clean", types) == "title"
    back = io.read_typed_csv(spark, f"{tmp_path}/c", types)
    assert dict(back.dtypes) == {"outcome_id": "string", "gtr_title_clean": "string", "gtr_cited_by": "bigint"}
    with pytest.raises(FileNotFoundError):
        io.read_checked_csv(spark, f"{tmp_path}/none")
    io.write_jsonl(df, f"{tmp_path}/j")
    assert io.read_complete_jsonl(spark, f"{tmp_path}/j", df.schema).count() == 1
    assert io.read_complete_jsonl(spark, f"{tmp_path}/nothing", df.schema) is None
    nested = spark.createDataFrame([((1, ("a",)),)], "r struct<x: int, y: struct<z: string>>")
    assert io.flatten(nested).columns == ["r.x", "r.y.z"]
    cache = spark.createDataFrame([("p:1", json.dumps({"k": 1})), ("p:2", "{broken"), ("q:1", "{}")], "key string, payload string")
    assert io.read_cache(cache, "p:", "k int").select("value.k").collect()[0][0] == 1 and io.read_cache(cache, "p:").count() == 1
    io.write_database(spark, {"t_projects": df.withColumn("flag", F.lit(True))}, {"v_projects": "SELECT flag FROM t_projects"}, f"{tmp_path}/db")
    assert spark.table("v_projects").first()["flag"] == 1
    assert io.manifest(spark, {"c": f"{tmp_path}/c"}, {"n": 1}, {"n": 2}).count() >= 1
    sheet = spark.createDataFrame([("title", None), ("project_id", "code"), ("p1", "A"), ("", "B")], "a string, b string")
    assert rows(io.coded_sheet(sheet.coalesce(1)), "project_id", "code") == [("p1", "A")]


def test_extract_keeps_every_row(spark):
    df = spark.range(200_001).select("id", F.lit("abcdef").alias("s"), F.lit("x").alias("long"))
    got = io.extract(df, drop=("long",), characters=5)
    assert got.columns == ["id", "s"] and got.count() == 200_001 and got.first()["s"] == "abcde"
