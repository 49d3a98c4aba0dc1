"""Further registered queries: the rest of the operators that SQL can say as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import ids, nested, text
from tessera.operators import audit, evaluate, learn, match, merge_rules, quality, registry, rollup, sampling, tables
from tessera.plans.catalog import PAIRS, four_sources, pairs, query, t
from tessera.sources import io

c = F.col


@query(
    "p03_casts",
    """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TRUE WHEN event_id % 4 = 1 THEN FALSE END AS flag, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS num, strftime(to_timestamp(event_id * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day FROM events
""",
)
def p03_casts(spark, sf_dir):
    k = c("event_id") % 4
    flag = F.when(k == 0, " Yes").when(k == 1, "0.0").when(k == 2, "maybe")
    num = F.when(c("event_id") % 3 == 0, "n/k").otherwise(c("value").cast("string"))
    ms = F.concat((c("event_id") * 86_400_000).cast("string"), F.lit(".0"))
    return t(spark, sf_dir, "events").select("event_id", text.to_boolean(flag).alias("flag"), text.to_number(num).alias("num"), text.day_text(text.to_timestamp_ms(ms)).alias("day"))


@query(
    "p10_unified_years",
    """
SELECT o_orderkey, CAST(CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN EXTRACT(year FROM o_orderdate) WHEN 1 THEN 1999 WHEN 2 THEN 2001 ELSE 1970 END AS VARCHAR) AS year,
 CASE WHEN o_orderkey % 4 = 2 THEN '2001' ELSE '1970' END AS start_year, CASE WHEN o_orderkey % 4 = 2 THEN '2003' ELSE '1971' END AS end_year FROM orders
""",
)
def p10_unified_years(spark, sf_dir):
    k = c("o_orderkey") % 4
    date = F.when(k == 0, c("o_orderdate"))
    listed = F.when(k == 2, "2001; x, 2003")
    year, start, end = ids.unified_years(date, [F.when(k == 1, "1999.0"), F.lit("n/a")], F.lit("1000.0"), F.lit("31536000000"), listed)
    return t(spark, sf_dir, "orders").select("o_orderkey", year.alias("year"), start.alias("start_year"), end.alias("end_year"))


@query(
    "p19_comparison_keys",
    r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '\s*&\s*', ' and ', 'g'), '\s+', ' ', 'g')) AS journal, lower(p_name) || lower(p_brand) AS doi,
 least(lower(p_brand), lower(p_name)) || '|' || greatest(lower(p_brand), lower(p_name)) AS organisations FROM part
""",
)
def p19_comparison_keys(spark, sf_dir):
    journal = text.comparison_key(F.concat("p_name", F.lit(" & "), "p_type", F.lit(" (Print): vol. 1 - x")), "journal")
    doi = text.comparison_key(F.concat(F.lit(" "), F.regexp_replace("p_name", " ", "~"), F.lit("  "), "p_brand"), "doi", compatibility=False)
    org = text.comparison_key(F.concat("p_name", F.lit(" (UK); "), "p_brand", F.lit(";"), "p_name"), "organisation", compatibility=False)
    return t(spark, sf_dir, "part").select("p_partkey", journal.alias("journal"), F.regexp_replace(doi, "~", " ").alias("doi"), F.array_join(org, "|").alias("organisations"))


@query("p28_dates", "SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE date_trunc('month', o_orderdate) END, '%Y-%m-%d') AS day FROM orders")
def p28_dates(spark, sf_dir):
    cover = F.when(c("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    sort = F.date_format("o_orderdate", "yyyy-MM")
    return t(spark, sf_dir, "orders").select("o_orderkey", F.date_format(ids.parse_date(cover, sort), "yyyy-MM-dd").alias("day"))


@query("p33_titles", "SELECT p_partkey, p_name || ' ' || p_brand AS searched, p_name AS simple FROM part")
def p33_titles(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.search_title(F.concat("p_name", F.lit(" |  "), "p_brand")).alias("searched"), text.simplified_title(F.concat(F.regexp_replace("p_name", " ", ", "), F.lit(": a "), "p_brand")).alias("simple"))


@query("p35_work_urls", "SELECT page_id, CASE CAST(page_id % 3 AS INTEGER) WHEN 0 THEN 'doi' WHEN 1 THEN url ELSE url || '.pdf' END AS work_url FROM pages")
def p35_work_urls(spark, sf_dir):
    k = c("page_id") % 3
    places = F.array(
        F.struct(F.lit(None).cast("string").alias("landing_page_url"), F.concat("url", F.lit(".pdf")).alias("pdf_url")),
        F.struct(F.when(k == 1, c("url")).alias("landing_page_url"), F.lit("later").alias("pdf_url")),
    )
    return t(spark, sf_dir, "pages").select("page_id", nested.work_url(F.when(k == 0, "doi"), places).alias("work_url"))


@query(
    "p36_p38_nested",
    "SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS line, 'S' || CAST(l_suppkey AS VARCHAR) AS name FROM lineitem",
)
def p36_p38_nested(spark, sf_dir):
    """Lines gathered by order as nested references, then one row for each again."""
    gathered = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(c("l_linenumber").alias("line"), F.concat(F.lit("S"), c("l_suppkey").cast("string")).alias("name"))).alias("refs"))
    return nested.explode_references(gathered, "l_orderkey", "refs").select("l_orderkey", "line", "name")


@query("p60_p61_tiers", "SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 1 WHEN n_chars >= 2000 THEN 2 ELSE 3 END AS tier, COALESCE(quality, CAST(n_chars AS INTEGER)) AS best, CASE WHEN quality IS NOT NULL THEN 'merged' ELSE 'alternative' END AS best_source FROM documents d LEFT JOIN labels l USING (doc_id)")
def p60_p61_tiers(spark, sf_dir):
    df = t(spark, sf_dir, "documents").select("doc_id", "n_chars").join(t(spark, sf_dir, "labels"), "doc_id", "left").withColumn("other", c("n_chars").cast("int"))
    best, source = rollup.best_citations("quality", "other")
    return df.select("doc_id", learn.tiers(c("quality").isNotNull(), c("n_chars"), 2000).alias("tier"), best.alias("best"), source.alias("best_source"))


@query("p62_name_shapes", "SELECT CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN 'comma form' WHEN 1 THEN 'surname + initials' WHEN 2 THEN 'two parts' WHEN 3 THEN 'three or more parts' END AS shape, COUNT(*) AS n FROM part GROUP BY 1")
def p62_name_shapes(spark, sf_dir):
    k = c("p_partkey") % 5
    name = F.when(k == 0, "Smith, J").when(k == 1, "Smith J.A.").when(k == 2, "Jane Smith").when(k == 3, "Ana Maria Lopez")
    return audit.shapes(t(spark, sf_dir, "part").select(name.alias("name")), "name")


@query("p65_match_basis", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'title' WHEN doc_id % 3 = 1 THEN 'description' ELSE 'other' END AS basis, COUNT(*) AS n FROM documents GROUP BY 1")
def p65_match_basis(spark, sf_dir):
    k = c("doc_id") % 3
    basis = match.match_basis(F.when(k == 0, "A title").otherwise(" .,"), F.when(k == 1, "words"))
    return t(spark, sf_dir, "documents").groupBy(basis.alias("basis")).agg(F.count(F.lit(1)).alias("n"))


@query("s02_s12_columns", "SELECT page_id, url LIKE 'http://%' OR url LIKE 'https://%' AS fetchable, CASE WHEN page_id % 4 IN (0, 1) THEN 'invalid' ELSE 'valid' END AS status FROM pages")
def s02_s12_columns(spark, sf_dir):
    code = F.when(c("page_id") % 4 == 0, 404).when(c("page_id") % 4 == 1, 410).when(c("page_id") % 4 == 2, 503)
    return t(spark, sf_dir, "pages").select("page_id", ids.url_syntax(c("url")).alias("fetchable"), ids.url_status(code).alias("status"))


@query("s17_extract", "SELECT p_partkey, substr(p_name, 1, 5) AS p_name FROM part")
def s17_extract(spark, sf_dir):
    return io.extract(t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), drop=("p_type",), characters=5)


@query("f02_formats", r"SELECT p_brand, COUNT(*) AS n FROM part WHERE regexp_full_match(p_brand, 'Brand#1[0-9]') GROUP BY 1")
def f02_formats(spark, sf_dir):
    return t(spark, sf_dir, "part").where(c("p_brand").rlike(r"\ABrand#1[0-9]\z")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("f03_f04_guards", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def f03_f04_guards(spark, sf_dir):
    spine = t(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(c("c_custkey").alias("o_custkey"))
    kept = rollup.semi(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), spine, "o_custkey")
    return learn.leakage_guard(kept, t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query(
    "a31_type_vote",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE 'fallback' END AS type FROM orders
""",
)
def a31_type_vote(spark, sf_dir):
    two, three = c("o_orderkey") % 2 == 0, c("o_orderkey") % 3 == 0
    types = [F.lit("other"), F.when(two, c("o_orderstatus")).when(three, c("o_orderpriority")), F.when(two & three, c("o_orderpriority"))]
    subs = [F.lit("other"), F.lit("s"), F.lit("s")]
    return t(spark, sf_dir, "orders").select("o_orderkey", merge_rules.vote_types(types, subs, (F.lit("fallback"), F.lit("s")))["type"].alias("type"))


@query(
    "a32_a35_attributes",
    """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_type END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS abstract, p_brand AS organisation, p_partkey % 2 = 0 AS org_disagree,
 CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_type END AS source_title FROM part
""",
)
def a32_a35_attributes(spark, sf_dir):
    k = c("p_partkey")
    x = merge_rules.title_and_abstract([F.when(k % 2 == 0, c("p_name"))], [F.when(k % 3 == 0, c("p_brand"))], c("p_type"))
    org = merge_rules.organisations(F.lit(" "), c("p_brand"), F.when(k % 2 == 0, F.concat("p_brand", F.lit("; X"))).otherwise(F.upper("p_brand")), compatibility=False)
    title = merge_rules.source_title([F.when(k % 5 == 0, c("p_name"))], [c("p_type")], compatibility=False)
    return t(spark, sf_dir, "part").select("p_partkey", x["title"].alias("title"), x["abstract"].alias("abstract"), org["value"].alias("organisation"), org["disagree"].alias("org_disagree"), title["value"].alias("source_title"))


@query(
    "a43_multilabel",
    """
WITH a AS (SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS k, CAST(o_orderkey % 3 AS INTEGER) AS j FROM orders)
SELECT ROUND(AVG(CASE WHEN k = 0 THEN 1.0 ELSE 0 END), 8) AS strict, ROUND(AVG(CASE WHEN k IN (0, 1) THEN 1.0 ELSE 0 END), 8) AS secondary, ROUND(AVG(CASE WHEN k = 0 OR (k = 1 AND j > 0) THEN 1.0 ELSE 0 END), 8) AS any_tagged,
 ROUND(AVG(CASE WHEN k = 0 THEN CASE WHEN j > 0 THEN 0.7 ELSE 1.0 END WHEN k = 1 AND j > 0 THEN 0.3 ELSE 0 END), 8) AS partial, ROUND(AVG(CASE WHEN j > 0 THEN 0.7 ELSE 1.0 END), 8) AS achievable, ROUND(AVG(CASE WHEN j > 0 THEN 1.0 ELSE 0 END), 8) AS multi_field FROM a
""",
)
def a43_multilabel(spark, sf_dir):
    k, j = c("o_orderkey") % 4, c("o_orderkey") % 3
    one = lambda f, p: F.struct(F.lit(f).alias("field"), F.lit(p).alias("p"))
    df = t(spark, sf_dir, "orders").select(
        F.when(k == 0, "a").when(k == 1, "b").otherwise("z").alias("predicted"), F.lit("a").alias("main"), F.when(j > 0, F.array(one("a", 0.7), one("b", 0.3))).otherwise(F.array(one("a", 1.0))).alias("d"), F.array(F.lit("b")).alias("second")
    )
    out = evaluate.multilabel_scores(df, "predicted", "main", "d", "second")
    return out.select(*[F.round(x, 8).alias(x) for x in out.columns])


@query("a44_fragmentation", "SELECT 'lower' AS normaliser, CAST(SUM(n) AS BIGINT) AS n_names, COUNT(*) AS n_keys, COUNT(*) FILTER (WHERE s > 1) AS n_cross_source FROM (SELECT lower(role) || CAST(turn % 2 AS VARCHAR) AS k, COUNT(DISTINCT role || CAST(turn AS VARCHAR)) AS n, COUNT(DISTINCT turn) AS s FROM conversations GROUP BY 1)")
def a44_fragmentation(spark, sf_dir):
    df = t(spark, sf_dir, "conversations").select(F.concat("role", c("turn").cast("string")).alias("name"), "turn", F.concat(F.lower("role"), (c("turn") % 2).cast("string")).alias("k"))
    return audit.name_fragmentation(df, "name", "turn", {"lower": c("k")}).drop("collapsed")


@query("a47_term_yield", "SELECT event_type, COUNT(DISTINCT user_id) AS hits, COUNT(DISTINCT CASE WHEN value > 50 THEN user_id END) AS passed, COUNT(DISTINCT CASE WHEN value > 50 AND user_id % 2 = 1 THEN user_id END) AS net_new, ROUND(COUNT(DISTINCT CASE WHEN value > 50 THEN user_id END) / COUNT(DISTINCT user_id), 8) AS \"precision\" FROM events GROUP BY 1")
def a47_term_yield(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_type", "user_id", (c("value") > 50).alias("ok"))
    return audit.term_yield(e, "event_type", "user_id", "ok", e.where("user_id % 2 = 0")).withColumn("precision", F.round("precision", 8))


@query("a48_search_claims", "SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE NOT contains(lower(text), 'ertion')) AS n_without, COUNT(*) FILTER (WHERE NOT contains(lower(text), 'ertion') AND contains(lang, 'en')) AS n_in_lang FROM (SELECT text, replace(lang, 'en', 'ertion en') AS lang FROM documents)")
def a48_search_claims(spark, sf_dir):
    df = t(spark, sf_dir, "documents").select("text", F.when(c("lang") == "en", "ertion").otherwise(c("lang")).alias("lang"))
    return audit.search_claims(df, ["Ertion"], ["text"], ["lang"])


@query("j17_first_equal", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 WHEN o_orderpriority = '5-LOW' THEN 2 END AS found FROM orders")
def j17_first_equal(spark, sf_dir):
    candidates = F.array(*[F.struct(F.lit(a).alias("award"), F.lit(n).alias("n")) for a, n in (("1-URGENT", 1), ("5-LOW", 2), ("1-URGENT", 3))])
    df = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", candidates.alias("candidates"))
    return match.first_equal(df, "o_orderkey", "candidates", "award", "o_orderpriority").select("o_orderkey", c("found.n").alias("found"))


@query("j19_overlap_pairs", f"SELECT label, field, COUNT(*) AS n FROM (SELECT lang AS label, quality AS field FROM ({PAIRS}) UNION ALL SELECT source, quality FROM ({PAIRS})) GROUP BY 1, 2")
def j19_overlap_pairs(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ; ", "lang", "source").alias("labels"))
    return audit.overlap_pairs(docs, t(spark, sf_dir, "labels"), "doc_id", "labels", "quality").groupBy("label", c("quality").alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query("j22_coders", f"SELECT doc_id, quality AS code_1, toxic AS code_2, CASE WHEN doc_id % 2 = 0 THEN quality END AS code_3 FROM ({PAIRS})")
def j22_coders(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return audit.coders(p, p.select("doc_id", c("toxic").alias("quality")), p.where("doc_id % 2 = 0"), key="doc_id", code="quality")


@query("m05_soft_vote", "SELECT vec_id, ROUND((embedding[1] + embedding[2]) / 2.0, 6) AS first, ROUND((embedding[3] + embedding[4]) / 2.0, 6) AS second FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)")
def m05_soft_vote(spark, sf_dir):
    v = c("embedding").cast("array<double>")
    mean = nested.soft_vote(F.array(v[0], v[2]), F.array(v[1], v[3]))
    return t(spark, sf_dir, "embeddings").select("vec_id", F.round(mean[0], 6).alias("first"), F.round(mean[1], 6).alias("second"))


@query("m09_folds", "SELECT c_mktsegment, (rn - 1) % 5 AS fold, COUNT(*) AS n FROM (SELECT c_mktsegment, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) GROUP BY 1, 2")
def m09_folds(spark, sf_dir):
    folds = sampling.stratified_folds(t(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", 5, 1)
    return folds.join(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").groupBy("c_mktsegment", c("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query("m11_matrix", "SELECT l_orderkey, CAST(SUM(CASE WHEN l_returnflag='A' THEN l_quantity ELSE 0 END) AS DOUBLE) AS A, CAST(SUM(CASE WHEN l_returnflag='N' THEN l_quantity ELSE 0 END) AS DOUBLE) AS N, CAST(SUM(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0 END) AS DOUBLE) AS R FROM lineitem GROUP BY 1")
def m11_matrix(spark, sf_dir):
    return learn.probability_matrix(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_quantity", ("A", "N", "R"))


@query("w12_matched_sample", "SELECT p_partkey, p_type FROM (SELECT p_partkey, p_type, ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) WHERE (p_type = 'ECONOMY' AND r <= 7) OR (p_type = 'SMALL' AND r <= 3)")
def w12_matched_sample(spark, sf_dir):
    """A sampling operator: given numbers of two classes, in order of the key."""
    return sampling.matched_sample(t(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey", "p_type", {"ECONOMY": 7, "SMALL": 3}, order=c("p_partkey"))


@query("a46_collections", "SELECT COUNT(*) AS n_old, COUNT(*) FILTER (WHERE o_orderstatus <> 'F') AS n_new, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS lost, 0 AS gained FROM orders")
def a46_collections(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    got = quality.compare_collections(o, o.where("o_orderstatus <> 'F'"), ["o_orderkey"])
    return spark.createDataFrame([(got["old"], got["new"], got["lost"], got["gained"])], "n_old long, n_new long, lost long, gained int")


@query(
    "p47_overrides",
    """
SELECT s_suppkey, CASE CAST(s_suppkey % 4 AS INTEGER) WHEN 0 THEN 'manual' WHEN 1 THEN 'rejected' ELSE 'auto' END AS match_method, CASE WHEN s_suppkey % 4 = 2 THEN 'education' ELSE 'company' END AS org_type, CASE WHEN s_suppkey % 4 = 1 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'r' END AS ror_id FROM supplier
""",
)
def p47_overrides(spark, sf_dir):
    k = c("s_suppkey") % 4
    base = t(spark, sf_dir, "supplier").select("s_suppkey", c("s_name").alias("institution_id"), F.lit("company").alias("org_type"), F.lit("auto").alias("match_method"), F.lit("r").alias("ror_id"))
    decisions = t(spark, sf_dir, "supplier").where(k < 3).select(c("s_name").alias("institution_id"), F.when(k == 0, "accept").when(k == 1, "reject").otherwise("education").alias("decision_type"), F.when(k == 0, "new").alias("decision_ror"))
    return registry.apply_overrides(base, decisions).select("s_suppkey", "match_method", "org_type", "ror_id")


@query("u04_u06_sets", "SELECT o_custkey, len(list_distinct(list(o_orderstatus))) AS n_status, CAST(COUNT(*) AS INTEGER) AS n FROM orders GROUP BY 1")
def u04_u06_sets(spark, sf_dir):
    g = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("s"))
    return g.select("o_custkey", F.size(nested.ordered_distinct(c("s"))).cast("bigint").alias("n_status"), F.size("s").alias("n"))


@query("a15_consolidate", "SELECT s_nationkey, COUNT(*) AS n_observations, CAST(COUNT(*) AS INTEGER) AS n_variants, arg_max(s_name, s_suppkey) AS canonical_name FROM supplier GROUP BY 1")
def a15_consolidate(spark, sf_dir):
    df = t(spark, sf_dir, "supplier").select(c("s_nationkey").alias("institution_id"), c("s_name").alias("canonical_name"), F.lit("company").alias("org_type"), F.lit("auto").alias("match_method"), F.lit(1).alias("n_observations"), F.array("s_name").alias("variants"), F.lit("gtr").alias("sources"))
    return registry.consolidate(df).select(c("institution_id").alias("s_nationkey"), "n_observations", F.size("variants").alias("n_variants"), "canonical_name")


@query("a23_combinations", "SELECT concat_ws('; ', CASE WHEN a THEN 'gtr' END, CASE WHEN b THEN 'scopus' END) AS sources, COUNT(*) AS n FROM (SELECT o_custkey, bool_or(o_orderkey % 4 = 0) AS a, bool_or(o_orderkey % 4 = 1) AS b FROM orders GROUP BY 1) GROUP BY 1")
def a23_combinations(spark, sf_dir):
    df = four_sources(spark, sf_dir)
    return df.groupBy(F.concat_ws("; ", F.when(c("gtr_v").isNotNull(), "gtr"), F.when(c("scopus_v").isNotNull(), "scopus")).alias("sources")).agg(F.count(F.lit(1)).alias("n"))


@query("u01_u05_sets", "SELECT doc_id, 'documents' AS origin, quality FROM (SELECT doc_id, NULL::INTEGER AS quality FROM documents) UNION ALL SELECT doc_id, 'labels', quality FROM labels")
def u01_u05_sets(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.lit("documents").alias("origin"))
    return tables.union_all(d, t(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("origin"), "quality"))


@query("u05_common_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u05_common_keys(spark, sf_dir):
    return tables.common_keys(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id")


@query("w09_top_report", "SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 12")
def w09_top_report(spark, sf_dir):
    """A report of twelve rows."""
    return tables.top(t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), 12, "-n", "l_suppkey")


@query("f07_a04_filters", "SELECT lang, COUNT(DISTINCT source) AS n FROM documents WHERE length(trim(text || ' ' || lang)) > 400 GROUP BY 1")
def f07_a04_filters(spark, sf_dir):
    return tables.distinct_per_group(tables.long_enough(t(spark, sf_dir, "documents"), "text", "lang", more_than=400), "lang", "source")


@query("j07_lookups", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j07_lookups(spark, sf_dir):
    df = t(spark, sf_dir, "customer").select("c_custkey", c("c_nationkey").alias("n_nationkey"))
    named = tables.lookup(df, t(spark, sf_dir, "nation"), "n_nationkey", ["n_name", "n_regionkey"]).withColumnRenamed("n_regionkey", "r_regionkey")
    return tables.lookup(named, t(spark, sf_dir, "region"), "r_regionkey", ["r_name"]).select("c_custkey", "n_name", "r_name")


@query("m18_crosswalk", "SELECT p_partkey, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'few' WHEN p_type = 'SMALL' THEN 'small' END AS field FROM part")
def m18_crosswalk(spark, sf_dir):
    mapping = io.crosswalk(spark, [("Brand#1", "few", None), ("Brand#2", "few", None), ("SMALL", "small", None), ("ECONOMY", "EXCLUDED", None)])
    df = t(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(" (80%); "), "p_type", F.lit(" (20%)")).alias("tags"))
    return tables.apply_crosswalk(df, "p_partkey", "tags", mapping)[0].select("p_partkey", "field")
