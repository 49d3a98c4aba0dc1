"""Registered queries on the driver's tables, each with a DuckDB twin where SQL can say the same.

The tables stand in for the engine's own: customers for projects, orders for links,
line items for outcomes, parts for publications, suppliers for organisations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids, nested, text
from tessera.operators import evaluate, graph, learn, match, merge_rules, quality, registry, rollup, sampling
from tessera.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


c = F.col
FLAGS = ("A", "N", "R")


# ------------------------------------------------------------------ the flagship view
@query(
    "project_view",
    """
WITH o AS (SELECT o_custkey AS project_id, COUNT(*) AS n_links, MIN(o_orderdate) AS s, MAX(o_orderdate) AS e FROM orders GROUP BY 1),
l AS (SELECT o_custkey AS project_id, COUNT(*) FILTER (WHERE l_returnflag='A') AS n_A, COUNT(*) FILTER (WHERE l_returnflag='N') AS n_N, COUNT(*) FILTER (WHERE l_returnflag='R') AS n_R,
 COUNT(DISTINCT l_partkey) AS n_publications, COUNT(DISTINCT CASE WHEN l_discount = 0 THEN l_partkey END) AS n_full FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS project_id, COALESCE(n_links,0) AS n_links, COALESCE(n_A,0) AS n_A, COALESCE(n_N,0) AS n_N, COALESCE(n_R,0) AS n_R, COALESCE(n_publications,0) AS n_publications, COALESCE(n_full,0) AS n_full,
 COALESCE(n_A,0)+COALESCE(n_R,0) AS n_outputs, COALESCE(n_A,0)+COALESCE(n_R,0) > 0 AS has_outputs, CAST(EXTRACT(year FROM s) AS INTEGER) AS start_year,
 ROUND_EVEN(FLOOR((epoch_us(e)-epoch_us(s))/86400000000.0)/30.44, 1) AS duration_months, COALESCE(c_acctbal > 0, FALSE) AS has_funding
FROM customer LEFT JOIN o ON c_custkey = o.project_id LEFT JOIN l ON c_custkey = l.project_id
""",
)
def project_view(spark, sf_dir):
    """Inputs and outputs of each project."""
    spine = t(spark, sf_dir, "customer").select(c("c_custkey").alias("project_id"), "c_acctbal")
    orders = t(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("project_id"), "o_orderdate")
    links = orders.groupBy("project_id").agg(F.count(F.lit(1)).alias("n_links"), F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    items = t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_partkey", "l_discount").join(orders.select("o_orderkey", "project_id"), "o_orderkey")
    # distinct parts of a project once, then plain sums: no expansion for the two distinct counts
    parts = items.groupBy("project_id", "l_partkey").agg(*[F.count_if(c("l_returnflag") == f).alias(f"n_{f}") for f in FLAGS], F.max((c("l_discount") == 0).cast("int")).alias("full"))
    counts = parts.groupBy("project_id").agg(*[F.sum(f"n_{f}").alias(f"n_{f}") for f in FLAGS], F.count(F.lit(1)).alias("n_publications"), F.sum("full").alias("n_full"))
    out = rollup.to_spine(spine, "project_id", links, counts)
    out = rollup.totals_and_flags(out, ["n_A", "n_R"], "n_outputs", "has_outputs")
    out = ids.project_times(out, "start", "end", "c_acctbal", "2001-01-01")
    return out.select("project_id", "n_links", "n_A", "n_N", "n_R", "n_publications", "n_full", "n_outputs", "has_outputs", "start_year", "duration_months", "has_funding")


# ------------------------------------------------------------------ text, ids, dates
@query(
    "p01_clean_text",
    r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[*_`#]+', '', 'g'), '[•●▪◦]', '-', 'g') AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '%{3,}', ' ', 'g'), 'https?://[^\s]+|www\.[^\s]+', '', 'g'), '\b[\w\.-]+@[\w\.-]+\.\w+\b', '', 'g') AS x FROM a),
d AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '\[[^\]]+\]\[\d+\]', '', 'g'), '\[\d+\]:[^\n]*', '', 'g'), '[\[\]]', '', 'g') AS x FROM b),
e AS (SELECT doc_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS x FROM d)
SELECT doc_id, CASE WHEN regexp_matches(x, '[^\pP\pS\s]') THEN x END AS cleaned FROM e
""",
)
def p01_clean_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", text.clean_text(c("text")).alias("cleaned"))


@query(
    "p05_placeholders",
    r"""
WITH a AS (SELECT p_partkey, CASE CAST(p_partkey % 9 AS INTEGER) WHEN 0 THEN 'N/A' WHEN 1 THEN '  ' WHEN 2 THEN 'tbc' WHEN 3 THEN 'Abstract ' || p_name WHEN 4 THEN 'Not Available' WHEN 5 THEN NULL WHEN 6 THEN 'none' ELSE p_name END AS v FROM part)
SELECT p_partkey, CASE WHEN v IS NULL OR regexp_matches(v, '(?i)^(\s*|nil|null|none|n/?a\.?|n\.?a\.?|tbc|not available|not provided|not applicable)$') THEN NULL ELSE regexp_replace(v, '(?i)^abstract\s*', '') END AS v FROM a
""",
)
def p05_placeholders(spark, sf_dir):
    k = c("p_partkey") % 9
    v = F.when(k == 0, "N/A").when(k == 1, "  ").when(k == 2, "tbc").when(k == 3, F.concat(F.lit("Abstract "), "p_name")).when(k == 4, "Not Available").when(k == 5, None).when(k == 6, "none").otherwise(c("p_name"))
    return t(spark, sf_dir, "part").select("p_partkey", text.null_placeholders(v).alias("v"))


@query(
    "p20_match_keys",
    r"""
SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{Nd}\p{Pc}\s]', '', 'g'), '\s+', ' ', 'g')) AS k, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS ident,
 'P' || CAST(conv_id AS VARCHAR) || '||' || role AS project_key FROM conversations
""",
)
def p20_match_keys(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.match_text(c("text")).alias("k"), text.match_identifier(c("text")).alias("ident"), text.match_key(F.concat(F.lit("P"), c("conv_id").cast("string")), c("role")).alias("project_key")
    )


@query("p45_slug", "SELECT p_partkey, COALESCE(NULLIF(regexp_replace(substr(regexp_replace(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 12), '-+$', ''), ''), 'unnamed') AS slug FROM part")
def p45_slug(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws(" & ", "p_name", "p_brand"), 12).alias("slug"))


@query(
    "p08_years",
    r"""
WITH a AS (SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN CAST(EXTRACT(year FROM o_orderdate) AS VARCHAR) || '.0' WHEN 1 THEN CAST(EXTRACT(year FROM o_orderdate) AS VARCHAR) WHEN 2 THEN '9999' ELSE 'c. 1990' END AS y FROM orders),
b AS (SELECT o_orderkey, regexp_replace(trim(y), '\.0$', '') AS y FROM a)
SELECT o_orderkey, CASE WHEN regexp_full_match(y, '\d{4}') AND TRY_CAST(y AS INTEGER) BETWEEN 1000 AND 2100 THEN y END AS year FROM b
""",
)
def p08_years(spark, sf_dir):
    y, k = F.year("o_orderdate").cast("string"), c("o_orderkey") % 4
    raw = F.when(k == 0, F.concat(y, F.lit(".0"))).when(k == 1, y).when(k == 2, "9999").otherwise("c. 1990")
    return t(spark, sf_dir, "orders").select("o_orderkey", ids.valid_year(raw).alias("year"))


@query(
    "p09_year_lists",
    """
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(1990 + p_size AS VARCHAR) || ';' || CAST(1991 + p_size AS VARCHAR) ELSE CAST(1990 + p_size AS VARCHAR) END AS years,
 CAST(1990 + p_size AS VARCHAR) AS start_year, CASE WHEN p_size % 2 = 0 THEN CAST(1991 + p_size AS VARCHAR) ELSE CAST(1990 + p_size AS VARCHAR) END AS end_year FROM part
""",
)
def p09_year_lists(spark, sf_dir):
    raw = F.when(c("p_size") % 2 == 0, F.concat_ws(", ", (c("p_size") + 1990).cast("string"), F.lit("n.d."), (c("p_size") + 1991).cast("string"))).otherwise(F.concat((c("p_size") + 1990).cast("string"), F.lit(" ; 99")))
    years = ids.year_list(raw)
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(years, ";").alias("years"), F.get(years, 0).alias("start_year"), F.element_at(years, -1).alias("end_year"))


@query(
    "p11_p12_issn",
    """
WITH a AS (SELECT p_partkey, lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '-' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS i FROM part)
SELECT p_partkey, i || 'x' AS issn, i || 'X' AS issns FROM a
""",
)
def p11_p12_issn(spark, sf_dir):
    """Single and listed ISSNs, made of the last four digits of part keys."""
    raw = F.concat(F.lpad((c("p_partkey") % 10000).cast("string"), 4, "0"), F.lpad(c("p_size").cast("string"), 3, "0"), F.lit("x"))
    listed = F.concat_ws(" and ", raw, F.concat(F.substring(raw, 1, 4), F.lit("-"), F.substring(raw, 5, 4)), F.lit("123456789"))
    return t(spark, sf_dir, "part").select("p_partkey", ids.issn(raw).alias("issn"), ids.issn_list(listed).alias("issns"))


@query(
    "p14_p18_identifiers",
    r"""
WITH a AS (SELECT page_id, url, 'HTTPS://DX.DOI.ORG/10.1000/' || CAST(page_id AS VARCHAR) AS d FROM pages)
SELECT page_id, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) AS last_part, '10.1000/' || CAST(page_id AS VARCHAR) AS doi, 'https://doi.org/10.1000/' || CAST(page_id AS VARCHAR) AS doi_url,
 CASE WHEN page_id = 0 THEN '0' ELSE CAST(page_id AS VARCHAR) END AS native_id,
 CASE CAST(page_id % 3 AS INTEGER) WHEN 0 THEN 'W' || CAST(page_id AS VARCHAR) ELSE CAST(page_id AS VARCHAR) END AS outcome_id,
 CASE WHEN page_id % 2 = 0 THEN '0000-0001-2345-678X' ELSE '' END AS orcid FROM a
""",
)
def p14_p18_identifiers(spark, sf_dir):
    n = c("page_id").cast("string")
    doi = F.concat(F.lit("HTTPS://DX.DOI.ORG/10.1000/"), n)
    source = F.when(c("page_id") % 3 == 0, "openalex").when(c("page_id") % 3 == 1, "scopus").otherwise("wos")
    key = F.when(source == "openalex", F.concat(F.lit("https://example.org/W"), n)).when(source == "scopus", F.concat(F.lit("2-s2.0-"), n)).otherwise(F.concat(F.lit("WOS:"), n))
    return t(spark, sf_dir, "pages").select(
        "page_id",
        ids.last_segment(c("url")).alias("last_part"),
        ids.strict_doi_key(doi).alias("doi"),
        ids.doi_url(doi).alias("doi_url"),
        ids.native_id_key(F.concat(F.lit("00"), n, F.lit(".0"))).alias("native_id"),
        ids.source_outcome_id(source, key).alias("outcome_id"),
        ids.orcid(F.when(c("page_id") % 2 == 0, "id 0000-0001-2345-678x").otherwise("none")).alias("orcid"),
    )


@query("p22_remap", "SELECT o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 'low' WHEN '1-URGENT' THEN 'urgent' ELSE o_orderpriority END AS mapped, COUNT(*) AS n FROM orders GROUP BY 1, 2")
def p22_remap(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select("o_orderpriority", text.remap(c("o_orderpriority"), {"5-LOW": "low", "1-URGENT": "urgent"}).alias("mapped"), "n")


@query("p23_name_lists", "SELECT p_partkey, string_split(p_name, ' ')[2] || ' ' || substr(string_split(p_name, ' ')[1], 1, 1) || '; Smith JA' AS names FROM part")
def p23_name_lists(spark, sf_dir):
    from tessera.functions.names import normalise_name

    return t(spark, sf_dir, "part").select("p_partkey", text.map_list(F.concat(c("p_name"), F.lit(" ;; Smith, JA; ")), normalise_name).alias("names"))


TIERS = ((r"ertion", r"ththing"), (r"reading\w*", r"eaan\w*", r"der\b"), (r"the\b", r"une\b"))


@query(
    "p32_screening",
    # boundaries by Unicode letters, marks, digits and connectors: \\b knows ASCII only there
    r"""
WITH w AS (SELECT doc_id, COALESCE(text, '') AS x, '(?i)(?:^|[^\p{L}\p{M}\p{N}\p{Pc}])' AS b, '(?:$|[^\p{L}\p{M}\p{N}\p{Pc}])' AS e FROM documents),
a AS (SELECT doc_id, regexp_matches(x, b || 'ertion')::INT + regexp_matches(x, b || 'ththing')::INT AS t1,
 regexp_matches(x, b || 'reading')::INT + regexp_matches(x, b || 'eaan')::INT + regexp_matches(x, b || 'der' || e)::INT AS t2, regexp_matches(x, b || 'the' || e)::INT + regexp_matches(x, b || 'une' || e)::INT AS t3 FROM w)
SELECT doc_id, t1 AS n1, t2 AS n2, t3 AS n3, CASE WHEN t1 >= 1 OR t2 >= 2 OR (t2 >= 1 AND t3 >= 1) THEN 'keep' ELSE 'drop' END AS decision FROM a
""",
)
def p32_screening(spark, sf_dir):
    """P32 F01 on all texts, by Unicode word boundaries."""
    out = text.screen(t(spark, sf_dir, "documents"), "text", tiers=TIERS)
    return out.select("doc_id", *[F.size(f"tier{i}").alias(f"n{i}") for i in (1, 2, 3)], "decision")


@query(
    "p41_organisation_keys",
    r"""
SELECT s_suppkey, trim(regexp_replace(regexp_replace(regexp_replace(lower('The University of ' || s_name || ' and Co.'), '[^a-z0-9 ]', ' ', 'g'), '\b(the|of|and)\b', ' ', 'g'), '\s+', ' ', 'g')) AS k,
 'supplier ' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS company FROM supplier
""",
)
def p41_organisation_keys(spark, sf_dir):
    return t(spark, sf_dir, "supplier").select("s_suppkey", text.organisation_key(F.concat(F.lit("The University of "), "s_name", F.lit(" and Co."))).alias("k"), text.company_key(F.concat(c("s_name"), F.lit(" U.K. P.L.C."))).alias("company"))


@query(
    "p42_organisation_types",
    """
SELECT s_suppkey, CASE CAST(s_suppkey % 7 AS INTEGER) WHEN 0 THEN 'healthcare' WHEN 1 THEN 'education' WHEN 2 THEN 'company' WHEN 3 THEN 'government' WHEN 4 THEN 'nonprofit' WHEN 5 THEN 'company' ELSE 'unknown' END AS kind,
 CAST(s_suppkey % 7 AS INTEGER) NOT IN (2) AS lookup FROM supplier
""",
)
def p42_organisation_types(spark, sf_dir):
    k = c("s_suppkey") % 7
    name = F.concat(
        c("s_name"), F.when(k == 0, " University Hospital").when(k == 1, " College").when(k == 2, " P.L.C.").when(k == 3, " Borough Council").when(k == 4, " Institute").when(k == 5, " CENTRE CO.LIMITED").otherwise("")
    )
    kind = text.organisation_type(name)
    return t(spark, sf_dir, "supplier").select("s_suppkey", kind.alias("kind"), text.needs_lookup(kind, name).alias("lookup"))


@query(
    "p55_p57_tags",
    """
WITH tags AS (SELECT p_partkey, p_brand AS subject, 60.0 AS w, 0 AS pos FROM part UNION ALL SELECT p_partkey, p_type, 100.0, 1 FROM part UNION ALL SELECT p_partkey, 'Brand#' || CAST(1 + p_size % 25 AS VARCHAR), 40.0, 2 FROM part),
m AS (SELECT *, CASE WHEN subject LIKE 'Brand#1%' THEN 'one' WHEN subject LIKE 'Brand#2%' THEN 'two' WHEN subject LIKE 'Brand#%' THEN 'rest' END AS field FROM tags),
f AS (SELECT p_partkey, field, SUM(w) AS w FROM m WHERE field IS NOT NULL GROUP BY 1, 2),
p AS (SELECT p_partkey, arg_max(field, w - pos) AS main_field FROM m WHERE field IS NOT NULL GROUP BY 1)
SELECT f.p_partkey, f.field, ROUND(f.w / SUM(f.w) OVER (PARTITION BY f.p_partkey), 6) AS p, main_field FROM f JOIN p ON f.p_partkey = p.p_partkey
""",
)
def p55_p57_tags(spark, sf_dir):
    raw = F.concat(c("p_brand"), F.lit(" (60%); "), c("p_type"), F.lit("; Brand#"), (1 + c("p_size") % 25).cast("string"), F.lit(" (40%)"))
    parts = t(spark, sf_dir, "part").select("p_partkey", nested.weighted_tags(raw).alias("tags"))
    rows = [(f"Brand#{i}", "one" if str(i).startswith("1") else "two" if str(i).startswith("2") else "rest", None) for i in range(0, 100)]
    mapping = io.crosswalk(spark, rows)
    return nested.tag_distribution(parts, "p_partkey", "tags", mapping).join(nested.primary_mapped_tag(parts, "p_partkey", "tags", mapping).withColumnRenamed("field", "main_field"), "p_partkey").select("p_partkey", "field", F.round("p", 6).alias("p"), "main_field")


@query("s24_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def s24_json(spark, sf_dir):
    events = t(spark, sf_dir, "events").select(c("event_id").cast("string").alias("key"), c("props").alias("payload"), "event_id")
    return io.read_cache(events, schema="k bigint").select("event_id", c("value.k").alias("k"))


@query("p34_inverted_index", "SELECT p_partkey, p_name || ' ' || string_split(p_name, ' ')[1] AS abstract FROM part WHERE string_split(p_name, ' ')[1] <> string_split(p_name, ' ')[2]")
def p34_inverted_index(spark, sf_dir):
    w = F.split("p_name", " ")
    index = F.map_from_arrays(F.array(w[1], w[0]), F.array(F.array(F.lit(1)), F.array(F.lit(0), F.lit(2))))
    return t(spark, sf_dir, "part").where(w[0] != w[1]).select("p_partkey", nested.inverted_index_text(index).alias("abstract"))


# ------------------------------------------------------------------ merge rules: four sources per customer
FOUR = """WITH s AS (SELECT o_custkey, o_orderkey % 4 AS k, MIN(o_orderkey) AS ok FROM orders GROUP BY 1, 2),
w AS (SELECT o_custkey AS id, MAX(CASE WHEN k=0 THEN o_orderpriority END) AS gtr_v, MAX(CASE WHEN k=1 THEN o_orderpriority END) AS scopus_v, MAX(CASE WHEN k=2 THEN o_orderpriority END) AS wos_v, MAX(CASE WHEN k=3 THEN o_orderpriority END) AS openalex_v,
 MAX(CASE WHEN k=0 THEN o_totalprice END) AS gtr_n, MAX(CASE WHEN k=1 THEN o_totalprice END) AS scopus_n
 FROM (SELECT s.o_custkey, s.k, o.o_orderpriority, o.o_totalprice FROM s JOIN orders o ON s.ok = o.o_orderkey) GROUP BY 1)
"""


def four_sources(spark, sf_dir) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice", (c("o_orderkey") % 4).alias("k"))
    firsts = o.groupBy("o_custkey").agg(*[F.min_by(F.struct("o_orderpriority", "o_totalprice"), F.when(c("k") == i, c("o_orderkey"))).alias(f"s{i}") for i in range(4)])
    names = merge_rules.SOURCE_PRIORITY
    return firsts.select(c("o_custkey").alias("id"), *[c(f"s{i}.o_orderpriority").alias(f"{n}_v") for i, n in enumerate(names)], *[c(f"s{i}.o_totalprice").alias(f"{n}_n") for i, n in enumerate(names[:2])])


@query(
    "a28_a30_majority",
    FOUR
    + """, u AS (SELECT id, unnest([gtr_v, scopus_v, wos_v, openalex_v]) AS v, unnest([1,2,3,4]) AS pos FROM w),
p AS (SELECT * FROM u WHERE v IS NOT NULL), n AS (SELECT id, COUNT(*) AS n FROM p GROUP BY 1), q AS (SELECT id, v, COUNT(*) AS k, MIN(pos) AS pos FROM p GROUP BY 1, 2),
best AS (SELECT q.id, arg_min(q.v, CASE WHEN 2*q.k > n.n THEN 0 ELSE 10 END + q.pos) AS v, arg_min(q.pos, CASE WHEN 2*q.k > n.n THEN 0 ELSE 10 END + q.pos) AS pos FROM q JOIN n ON q.id = n.id GROUP BY 1)
SELECT w.id, best.v AS v, ['gtr','scopus','wos','openalex'][best.pos] AS v_source, COALESCE(gtr_v, scopus_v, wos_v, openalex_v) AS first_v FROM w LEFT JOIN best ON w.id = best.id
""",
)
def a28_a30_majority(spark, sf_dir):
    df = four_sources(spark, sf_dir)
    names = merge_rules.source_columns(df, merge_rules.SOURCE_PRIORITY, "v")
    return merge_rules.merge_majority(df, "v", merge_rules.SOURCE_PRIORITY).select("id", "v", "v_source", merge_rules.first_populated(*[c(n) for n in names]).alias("first_v"))


@query(
    "a29_longest",
    FOUR
    + """, u AS (SELECT id, unnest([gtr_v, scopus_v, wos_v, openalex_v]) AS v, unnest([1,2,3,4]) AS pos FROM w)
SELECT w.id, x.v AS longest FROM w LEFT JOIN (SELECT id, arg_max(v, length(v) * 10 - pos) AS v FROM u WHERE v IS NOT NULL GROUP BY 1) x ON w.id = x.id""",
)
def a29_longest(spark, sf_dir):
    df = four_sources(spark, sf_dir)
    return df.select("id", merge_rules.longest(*[c(f"{s}_v") for s in merge_rules.SOURCE_PRIORITY]).alias("longest"))


@query(
    "a26_agreement",
    FOUR
    + """, u AS (SELECT id, COUNT(v) AS n, COUNT(DISTINCT v) AS d FROM (SELECT id, unnest([gtr_v, scopus_v, wos_v, openalex_v]) AS v FROM w) GROUP BY 1)
SELECT COUNT(*) FILTER (WHERE n > 0) AS n_present, COUNT(*) FILTER (WHERE n > 0) AS n_with_fallback, COUNT(*) FILTER (WHERE n >= 2 AND d > 1) AS n_disagree FROM u""",
)
def a26_agreement(spark, sf_dir):
    return merge_rules.agreement(four_sources(spark, sf_dir), "v", merge_rules.SOURCE_PRIORITY, kind="doi", compatibility=False)


@query(
    "a27_outliers",
    FOUR
    + """, u AS (SELECT id, unnest([gtr_v, scopus_v, wos_v, openalex_v]) AS v, unnest(['gtr','scopus','wos','openalex']) AS source FROM w),
p AS (SELECT * FROM u WHERE v IS NOT NULL), q AS (SELECT id, v, COUNT(*) AS k, MIN(source) AS source FROM p GROUP BY 1, 2), r AS (SELECT id, SUM(k) AS n, COUNT(*) AS d, COUNT(*) FILTER (WHERE k = 1) AS singles, MIN(CASE WHEN k = 1 THEN source END) AS source FROM q GROUP BY 1),
z AS (SELECT source, COUNT(*) AS n FROM r WHERE n >= 3 AND d = 2 AND singles = 1 GROUP BY 1)
SELECT s.source, COALESCE(z.n, 0) AS n_outlier FROM (VALUES ('gtr'), ('scopus'), ('wos'), ('openalex')) s(source) LEFT JOIN z ON s.source = z.source""",
)
def a27_outliers(spark, sf_dir):
    return merge_rules.outlier_counts(four_sources(spark, sf_dir), "v", merge_rules.SOURCE_PRIORITY).select("source", "n_outlier")


@query(
    "a25_numbers",
    FOUR
    + """SELECT COUNT(*) AS n_both, COUNT(*) FILTER (WHERE gtr_n > scopus_n) AS n_left_higher, COUNT(*) FILTER (WHERE scopus_n > gtr_n) AS n_right_higher, COUNT(*) FILTER (WHERE gtr_n = scopus_n) AS n_equal,
 COUNT(*) FILTER (WHERE abs(gtr_n - scopus_n) BETWEEN 1 AND 2) AS n_gap_1_2, COUNT(*) FILTER (WHERE abs(gtr_n - scopus_n) >= 3) AS n_gap_3, ROUND(median(gtr_n - scopus_n), 4) AS median_gap, ROUND(median(abs(gtr_n - scopus_n)), 4) AS median_abs_gap
 FROM w WHERE gtr_n IS NOT NULL AND scopus_n IS NOT NULL""",
)
def a25_numbers(spark, sf_dir):
    out = merge_rules.compare_numbers(four_sources(spark, sf_dir), "gtr_n", "scopus_n")
    return out.withColumns({m: F.round(m, 4) for m in ("median_gap", "median_abs_gap")})


@query(
    "a34_issn_fill",
    """
WITH a AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'i' || CAST(p_size AS VARCHAR) END AS i1, CASE WHEN p_size % 5 > 0 THEN 'e' || CAST(p_size % 4 AS VARCHAR) END AS e1, CASE WHEN p_size % 2 = 0 THEN 'i' || CAST(p_size AS VARCHAR) END AS i2 FROM part)
SELECT p_partkey, COALESCE(i1, i2) AS issn, e1 AS eissn, COALESCE(i1 IS NOT NULL AND i2 IS NOT NULL AND i1 <> i2, FALSE) OR (i1 IS NULL AND e1 IS NOT NULL AND i2 IS NOT NULL) AS disagree FROM a
""",
)
def a34_issn_fill(spark, sf_dir):
    s = c("p_size")
    i = lambda cond: F.when(cond, F.concat(F.lit("i"), s.cast("string")))
    e = F.when(s % 5 > 0, F.concat(F.lit("e"), (s % 4).cast("string")))
    none = F.lit(None).cast("string")
    x = merge_rules.fill_issn([i(s % 3 > 0), i(s % 2 == 0)], [e, none])
    return t(spark, sf_dir, "part").select("p_partkey", x["issn"].alias("issn"), x["eissn"].alias("eissn"), x["disagree"].alias("disagree"))


@query(
    "a36_final_url",
    """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 'https://doi.org/10.1/' || CAST(page_id AS VARCHAR) END AS final_url, CAST(page_id % 3 AS INTEGER) = 0 AS usable FROM pages
""",
)
def a36_final_url(spark, sf_dir):
    k = c("page_id") % 3
    doi = F.when(k == 1, F.concat(F.lit("10.1/"), c("page_id").cast("string")))
    status = F.when(k == 0, "valid").when(k == 1, "invalid")
    url = merge_rules.final_url([F.lit(" "), c("url")], [F.lit(True), status == "valid"], doi)
    return t(spark, sf_dir, "pages").select("page_id", url.alias("final_url"), ids.usable_url(c("url"), status).alias("usable"))


@query("a37_keywords", "SELECT 'p_name' AS \"column\", COUNT(*) AS n_rows, CAST(SUM(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n_entries FROM part UNION ALL SELECT 'none', 0, 0")
def a37_keywords(spark, sf_dir):
    df = t(spark, sf_dir, "part").select(F.when(c("p_size") % 2 == 0, F.regexp_replace("p_name", " ", "; ")).otherwise(F.concat(c("p_name"), F.lit("; ;"))).alias("p_name"), F.lit(None).cast("string").alias("none"))
    return merge_rules.keyword_coverage(df, "p_name", "none")


@query(
    "p30_type_map",
    """
WITH a AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN ' ' ELSE upper(event_type) || ' ' END AS raw FROM events)
SELECT CASE WHEN trim(raw) = '' THEN NULL WHEN lower(trim(raw)) = 'click' THEN 'use' WHEN lower(trim(raw)) = 'view' THEN 'use' ELSE 'other' END AS type, CASE WHEN trim(raw) = '' THEN NULL WHEN lower(trim(raw)) = 'click' THEN 'active' WHEN lower(trim(raw)) = 'view' THEN 'passive' ELSE 'other' END AS subtype, COUNT(*) AS n FROM a GROUP BY 1, 2
""",
)
def p30_type_map(spark, sf_dir):
    df = t(spark, sf_dir, "events").select(F.when(c("event_id") % 10 == 0, " ").otherwise(F.concat(F.upper("event_type"), F.lit(" "))).alias("raw"))
    table = spark.createDataFrame([("web", "click", "use", "active"), ("web", "view", "use", "passive")], "source string, raw string, type string, subtype string")
    return merge_rules.map_types(df, "raw", F.lit("web"), table).groupBy("type", "subtype").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j01_j02_projects",
    """
SELECT c_custkey AS project_id, CASE WHEN length(COALESCE(n_name, '')) > length(c_mktsegment) THEN n_name ELSE c_mktsegment END AS description, s_acctbal AS other_amount,
 CASE WHEN s_acctbal IS NULL THEN NULL WHEN abs(c_acctbal - s_acctbal) = 0 THEN 'equal' WHEN abs(c_acctbal - s_acctbal) <= 1 THEN 'within_1' WHEN abs(c_acctbal - s_acctbal) <= 1000 THEN 'within_1000' ELSE 'over_1000' END AS band
FROM customer LEFT JOIN (SELECT s_suppkey, s_acctbal, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON c_custkey = s_suppkey
""",
)
def j01_j02_projects(spark, sf_dir):
    left = t(spark, sf_dir, "customer").select(c("c_custkey").alias("project_id"), c("c_mktsegment").alias("abstract_text_clean"), c("c_acctbal").alias("amount"))
    right = t(spark, sf_dir, "supplier").join(t(spark, sf_dir, "nation"), c("s_nationkey") == c("n_nationkey")).select(c("s_suppkey").alias("project_id"), c("n_name").alias("description_clean"), c("s_acctbal").alias("other_amount"))
    merged = merge_rules.merge_projects(left, right, extra=("other_amount",))
    return merged.select("project_id", c("abstract_text_clean").alias("description"), "other_amount", merge_rules.amount_band(c("amount"), c("other_amount")).alias("band"))


@query(
    "j03_attach_sources",
    """
SELECT o_orderkey, o_custkey, c_mktsegment AS cust_segment, c_acctbal AS cust_balance FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND o_orderkey % 3 > 0
""",
)
def j03_attach_sources(spark, sf_dir):
    links = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(c("o_orderkey") % 3 > 0, F.concat(F.lit(" "), c("o_custkey").cast("string"))).alias("cust_outcome_id"))
    side = t(spark, sf_dir, "customer").select(c("c_custkey").alias("outcome_id"), c("c_mktsegment").alias("segment"), c("c_acctbal").alias("balance"))
    return merge_rules.attach_sources(links, {"cust": side}).select("o_orderkey", "o_custkey", "cust_segment", "cust_balance")


# ------------------------------------------------------------------ matching
@query("w03_keep_first", "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1")
def w03_keep_first(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return match.keep_first(rows, ["l_partkey"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]).drop("l_extendedprice")


@query(
    "a01_a03_first_non_null",
    """
SELECT user_id, arg_min(CASE WHEN event_type = 'click' THEN value END, event_id) FILTER (WHERE event_type = 'click') AS first_click, arg_min(CASE WHEN event_type = 'purchase' THEN value END, event_id) FILTER (WHERE event_type = 'purchase') AS first_purchase,
 COUNT(*) AS n_rows, COUNT(DISTINCT CASE WHEN event_type <> 'view' THEN event_type END) + MAX(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS n_types FROM events GROUP BY 1
""",
)
def a01_a03_first_non_null(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(c("event_type") == "click", c("value")).alias("first_click"), F.when(c("event_type") == "purchase", c("value")).alias("first_purchase"), F.when(c("event_type") != "view", c("event_type")).alias("kind")
    )
    firsts = rollup.first_non_null(e, "user_id", "event_id", ["first_click", "first_purchase"])
    return firsts.join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), rollup.distinct_with_null("kind").alias("n_types")), "user_id")


@query(
    "j15_match_two_keys",
    """
WITH old AS (SELECT p_partkey AS ord, p_size AS project_id, p_name AS title, p_brand AS description FROM part WHERE p_partkey % 2 = 0),
ext AS (SELECT p_partkey AS ord, p_size AS project_id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE upper(p_name) || '.' END AS title, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS description FROM part WHERE p_partkey % 2 = 1),
ok AS (SELECT ord, project_id, title AS t, replace(lower(description), '#', '') AS d FROM old), xk AS (SELECT ord, project_id, lower(replace(title, '.', '')) AS t, COALESCE(replace(lower(description), '#', ''), '') AS d FROM ext),
lt AS (SELECT project_id, t, MIN(ord) AS o FROM ok GROUP BY 1, 2), ld AS (SELECT project_id, d, MIN(ord) AS o FROM ok GROUP BY 1, 2),
hit AS (SELECT xk.*, COALESCE(CASE WHEN xk.t <> '' THEN lt.o END, CASE WHEN xk.d <> '' THEN ld.o END) AS o FROM xk LEFT JOIN lt ON xk.project_id = lt.project_id AND xk.t = lt.t LEFT JOIN ld ON xk.project_id = ld.project_id AND xk.d = ld.d),
w AS (SELECT o, arg_max(ord, ord) AS id FROM hit WHERE o IS NOT NULL GROUP BY 1),
fresh AS (SELECT project_id, CASE WHEN t <> '' THEN 't' || t ELSE 'd' || d END AS k, MIN(ord) AS ord, MIN(CASE WHEN t <> '' THEN 'title' ELSE 'description' END) AS basis FROM hit WHERE o IS NULL AND (t <> '' OR d <> '') GROUP BY 1, 2)
SELECT CAST(old.ord AS BIGINT) AS ord, old.project_id, 'x' || CAST(w.id AS VARCHAR) AS ext_outcome_id, CASE WHEN w.id IS NULL THEN 'old' ELSE 'old; ext' END AS source, 'title' AS match_basis FROM old LEFT JOIN w ON old.ord = w.o
UNION ALL SELECT CAST(fresh.ord + (SELECT MAX(ord) FROM old) + 1 AS BIGINT), project_id, 'x' || CAST(ord AS VARCHAR), 'ext', basis FROM fresh
""",
)
def j15_match_two_keys(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    old = part.where("p_partkey % 2 = 0").select(c("p_partkey").alias("ord"), c("p_size").alias("project_id"), c("p_name").alias("title"), c("p_brand").alias("description"), F.lit("old").alias("source"), F.lit("title").alias("match_basis"))
    ext = part.where("p_partkey % 2 = 1").select(
        c("p_partkey").alias("ord"),
        c("p_size").alias("project_id"),
        F.when(c("p_partkey") % 3 == 0, "").otherwise(F.concat(F.upper("p_name"), F.lit("."))).alias("title"),
        F.when(c("p_partkey") % 5 == 0, None).otherwise(c("p_brand")).alias("description"),
        F.concat(F.lit("x"), c("p_partkey").cast("string")).alias("ext_outcome_id"),
    )
    return match.match_two_keys(old, ext, "ext").select(c("ord").cast("bigint").alias("ord"), "project_id", "ext_outcome_id", "source", "match_basis")


@query("j04_anti_join", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F')")
def j04_anti_join(spark, sf_dir):
    gone = t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    return match.without_removed(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, ["l_orderkey"])


@query("j05_many_to_one", "SELECT o_orderkey, n_name, n_nationkey IS NOT NULL AS matched FROM orders LEFT JOIN nation ON o_custkey % 30 = n_nationkey")
def j05_many_to_one(spark, sf_dir):
    left = t(spark, sf_dir, "orders").select("o_orderkey", (c("o_custkey") % 30).cast("int").alias("n_nationkey"))
    return match.many_to_one(left, t(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("o_orderkey", "n_name", "matched")


@query("j16_absent_by_all", "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)")
def j16_absent_by_all(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", c("doc_id").alias("item_id"))
    seen = match.absent_by_all(docs, t(spark, sf_dir, "labels"), ["doc_id"])
    return match.absent_by_all(seen, t(spark, sf_dir, "benchmark"), ["item_id"]).select("doc_id", "lang")


@query(
    "j10_global_ids",
    """
SELECT source, CAST(k AS VARCHAR) AS outcome_id_norm, MIN(g) AS global_id FROM (SELECT 'gtr' AS source, o_custkey AS k, o_orderkey AS g FROM orders UNION ALL SELECT 'wos', o_orderkey % 100, o_orderkey FROM orders) GROUP BY 1, 2
""",
)
def j10_global_ids(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(c("o_orderkey").alias("global_id"), F.concat(F.lit("0"), c("o_custkey").cast("string"), F.lit(".0")).alias("gtr_outcome_id"), F.concat(F.lit("00"), (c("o_orderkey") % 100).cast("string")).alias("wos_outcome_id"))
    return match.global_ids(o, "global_id", ("gtr", "wos"))


@query(
    "j18_participants",
    """
WITH n AS (SELECT o_orderkey, o_custkey % 25 AS lead FROM orders), l AS (SELECT DISTINCT l_orderkey, l_suppkey % 25 AS h FROM lineitem)
SELECT o_orderkey, a.n_name AS lead_name, COALESCE((SELECT string_agg(DISTINCT b.n_name, '; ' ORDER BY b.n_name) FROM l JOIN nation b ON l.h = b.n_nationkey WHERE l.l_orderkey = n.o_orderkey AND l.h <> n.lead), '') AS participants FROM n JOIN nation a ON n.lead = a.n_nationkey
""",
)
def j18_participants(spark, sf_dir):
    lists = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set((c("l_suppkey") % 25).cast("int")).alias("hrefs"))
    o = t(spark, sf_dir, "orders").select("o_orderkey", (c("o_custkey") % 25).cast("int").alias("lead")).join(lists, c("o_orderkey") == c("l_orderkey"), "left").select("o_orderkey", "lead", F.coalesce("hrefs", F.array().cast("array<int>")).alias("hrefs"))
    names = F.broadcast(t(spark, sf_dir, "nation").select(c("n_nationkey").alias("href"), c("n_name").alias("name")))
    return match.participants(o, "o_orderkey", "hrefs", "lead", names)


@query("j24_orphans", "SELECT COUNT(*) AS n_rows, COUNT(DISTINCT doc_id) AS n_keys FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j24_orphans(spark, sf_dir):
    return quality.orphans(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels"), "doc_id")


@query("g01_components", "SELECT o_orderkey, MIN(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
def g01_components(spark, sf_dir):
    return graph.shared_id_components(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", {"o_custkey": "cust"})


@query("w06_global_ids", "SELECT o_custkey, printf('OUT%06d', CAST(ROW_NUMBER() OVER (ORDER BY MIN(o_orderkey)) AS INTEGER)) AS global_id FROM orders GROUP BY 1")
def w06_global_ids(spark, sf_dir):
    return match.ordinal_ids(t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("u02_tagged_union", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'round2_only' ELSE 'both' END AS provenance FROM documents d LEFT JOIN (SELECT doc_id FROM labels) l USING (doc_id)")
def u02_tagged_union(spark, sf_dir):
    return match.tagged_union(t(spark, sf_dir, "documents").select("doc_id"), t(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("u03_terms", "SELECT user_id, arg_min(value, event_id) AS value, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS terms FROM events GROUP BY 1")
def u03_terms(spark, sf_dir):
    return match.union_with_terms(t(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type"), "user_id", "event_id", "event_type").select("user_id", "value", "terms")


@query("u07_roles", "SELECT p_partkey, string_split(p_name, ' ')[1] AS item, 'first' AS role FROM part UNION ALL SELECT p_partkey, string_split(p_name, ' ')[2], 'first' FROM part UNION ALL SELECT p_partkey, p_brand, 'brand' FROM part")
def u07_roles(spark, sf_dir):
    df = t(spark, sf_dir, "part").select("p_partkey", F.regexp_replace("p_name", " ", " ; ; ").alias("a"), "p_brand")
    return nested.split_roles(df, "p_partkey", {"a": "first", "p_brand": "brand"})


# ------------------------------------------------------------------ roll-ups and views
@query(
    "a05_a08_institutions",
    """
WITH l AS (SELECT l_orderkey AS k, l_suppkey AS inst, l_returnflag AS kind, CASE WHEN l_linenumber = 1 THEN 'lead' ELSE 'partner' END AS role FROM lineitem),
a AS (SELECT k, MIN(inst) AS lead_institution FROM l WHERE role = 'lead' GROUP BY 1), p AS (SELECT k, COUNT(DISTINCT CASE WHEN kind='A' THEN inst END) AS n_partners_A, COUNT(DISTINCT CASE WHEN kind='N' THEN inst END) AS n_partners_N, COUNT(DISTINCT CASE WHEN kind='R' THEN inst END) AS n_partners_R, COUNT(DISTINCT inst) AS n_partners_all FROM l WHERE role <> 'lead' GROUP BY 1)
SELECT s.k, a.lead_institution, COALESCE(n_partners_A, 0) AS n_partners_A, COALESCE(n_partners_N, 0) AS n_partners_N, COALESCE(n_partners_R, 0) AS n_partners_R, COALESCE(n_partners_all, 0) AS n_partners_all FROM (SELECT DISTINCT k FROM l) s LEFT JOIN a ON s.k = a.k LEFT JOIN p ON s.k = p.k
""",
)
def a05_a08_institutions(spark, sf_dir):
    links = t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("k"), c("l_suppkey").alias("inst"), c("l_returnflag").alias("kind"), F.when(c("l_linenumber") == 1, "lead").otherwise("partner").alias("role"))
    return rollup.institution_summary(links, "k", "inst", "role", "kind", FLAGS).drop("lead_type")


@query(
    "a11_activity",
    """
SELECT s_suppkey, s_name, COUNT(DISTINCT l_orderkey) AS n_projects, CAST(SUM(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_lead, CAST(SUM(CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_partner FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2
""",
)
def a11_activity(spark, sf_dir):
    t(spark, sf_dir, "supplier").createOrReplaceTempView("tessera_supplier")
    t(spark, sf_dir, "lineitem").createOrReplaceTempView("tessera_lineitem")
    # links are reduced to a row for each organisation and project before names are joined
    return spark.sql(
        """
        WITH l AS (SELECT l_suppkey, l_orderkey, SUM(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS a, SUM(CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END) AS b FROM tessera_lineitem GROUP BY 1, 2),
        p AS (SELECT l_suppkey, COUNT(*) AS n_projects, SUM(a) AS n_lead, SUM(b) AS n_partner FROM l GROUP BY 1)
        SELECT s_suppkey, s_name, n_projects, n_lead, n_partner FROM tessera_supplier JOIN p ON s_suppkey = l_suppkey
        """
    )


@query("a12_yearly", "SELECT CAST(EXTRACT(year FROM o_orderdate) AS INTEGER) AS start_year, COUNT(*) AS n, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_finished, ROUND(SUM(o_totalprice), 2) AS amount FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1")
def a12_yearly(spark, sf_dir):
    return t(spark, sf_dir, "orders").where("o_orderdate is not null").groupBy(F.year("o_orderdate").alias("start_year")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("o_orderstatus") == "F").alias("n_finished"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query("j21_view_joins", "SELECT o_orderkey, c_name, n_name, COUNT(*) AS n_outcomes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2, 3")
def j21_view_joins(spark, sf_dir):
    for name in ("lineitem", "orders", "customer", "nation"):
        t(spark, sf_dir, name).createOrReplaceTempView(f"tessera_{name}")
    return spark.sql(
        "WITH l AS (SELECT l_orderkey, COUNT(*) AS n_outcomes FROM tessera_lineitem GROUP BY 1) SELECT o_orderkey, c_name, n_name, n_outcomes FROM l JOIN tessera_orders ON l_orderkey = o_orderkey"
        " JOIN tessera_customer ON o_custkey = c_custkey JOIN tessera_nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'"
    )


@query(
    "a14_entities",
    """
WITH o AS (SELECT CASE CAST(s_suppkey % 3 AS INTEGER) WHEN 0 THEN upper('Firm ' || CAST(s_suppkey // 3 AS VARCHAR)) || ' LTD' WHEN 1 THEN 'Firm ' || CAST(s_suppkey // 3 AS VARCHAR) || ' Limited' ELSE 'Firm ' || CAST(s_suppkey // 3 AS VARCHAR) || ' plc' END AS name, CAST(s_nationkey % 2 AS VARCHAR) AS source, 'firm ' || CAST(s_suppkey // 3 AS VARCHAR) AS key FROM supplier)
SELECT key, COUNT(*) AS n_observations, CAST(COUNT(DISTINCT name) AS INTEGER) AS n_variants, string_agg(DISTINCT source, '; ' ORDER BY source) AS sources, 'company' AS org_type FROM o GROUP BY 1
""",
)
def a14_entities(spark, sf_dir):
    k, n = c("s_suppkey") % 3, F.floor(c("s_suppkey") / 3).cast("string")
    name = F.when(k == 0, F.concat(F.lit("FIRM "), n, F.lit(" LTD"))).when(k == 1, F.concat(F.lit("Firm "), n, F.lit(" Limited"))).otherwise(F.concat(F.lit("Firm "), n, F.lit(" plc")))
    seen = t(spark, sf_dir, "supplier").select(name.alias("name"), (c("s_nationkey") % 2).cast("string").alias("source"))
    return registry.entities(seen, fold=False).select("key", "n_observations", "n_variants", "sources", "org_type")


@query(
    "p46_lookup_tiers",
    """
WITH a AS (SELECT s_suppkey, (s_suppkey % 50) / 50.0 AS score, s_suppkey % 4 > 0 AS chosen, CASE WHEN s_suppkey % 5 = 0 THEN 'FR' ELSE 'GB' END AS cc, s_suppkey % 2 = 0 AS funded FROM supplier)
SELECT s_suppkey, CASE WHEN score < 0.7 THEN 'unmatched' WHEN score < 0.9 OR NOT chosen THEN 'review' WHEN cc <> 'GB' AND funded THEN 'review_non_uk' ELSE 'auto' END AS match_method FROM a
""",
)
def p46_lookup_tiers(spark, sf_dir):
    s = t(spark, sf_dir, "supplier").select(c("s_suppkey"), c("s_name").alias("key"), (c("s_suppkey") % 2 == 0).alias("seen_in_gtr"), F.lit("unknown").alias("org_type"))
    lookup = t(spark, sf_dir, "supplier").select(
        c("s_name").alias("key"), F.concat(F.lit("r"), c("s_suppkey").cast("string")).alias("ror_id"), ((c("s_suppkey") % 50) / F.lit(50.0)).alias("score"), (c("s_suppkey") % 4 > 0).alias("chosen"), F.when(c("s_suppkey") % 5 == 0, "FR").otherwise("GB").alias("country_code"), F.array(F.lit("funder"), F.lit("government")).alias("ror_types")
    )
    return registry.apply_lookup(s, lookup).select("s_suppkey", "match_method")


# ------------------------------------------------------------------ evaluation
PAIRS = "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"


def pairs(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(t(spark, sf_dir, "labels"), "doc_id")


@query(
    "w01_accuracy_reject",
    """
WITH a AS (SELECT d.n_chars AS conf, l.quality AS ok FROM documents d JOIN labels l ON d.doc_id = l.doc_id), r AS (SELECT conf, COUNT(*) OVER w AS n_retained, SUM(ok) OVER w AS n_correct, COUNT(*) OVER () AS total FROM a WINDOW w AS (ORDER BY conf DESC RANGE UNBOUNDED PRECEDING))
SELECT DISTINCT conf AS threshold, n_retained, CAST(n_correct AS BIGINT) AS n_correct, ROUND(n_retained / total, 8) AS coverage, ROUND(n_correct / n_retained, 8) AS accuracy FROM r
""",
)
def w01_accuracy_reject(spark, sf_dir):
    curve = evaluate.accuracy_reject_curve(pairs(spark, sf_dir), "n_chars", "quality")
    return curve.withColumns({"coverage": F.round("coverage", 8), "accuracy": F.round("accuracy", 8)})


@query(
    "w02_threshold",
    """
WITH a AS (SELECT d.n_chars AS conf, l.quality AS ok FROM documents d JOIN labels l ON d.doc_id = l.doc_id), r AS (SELECT conf, COUNT(*) OVER w AS n, SUM(ok) OVER w AS k, COUNT(*) OVER () AS total FROM a WINDOW w AS (ORDER BY conf DESC RANGE UNBOUNDED PRECEDING))
SELECT MIN(conf) AS threshold FROM r WHERE k / n >= 0.8 AND n / total >= 0.1 HAVING MIN(conf) IS NOT NULL
""",
)
def w02_threshold(spark, sf_dir):
    return evaluate.pick_threshold(evaluate.accuracy_reject_curve(pairs(spark, sf_dir), "n_chars", "quality"), 0.8, 0.1).select("threshold")


@query(
    "a38_a39_confusion",
    f"""
WITH a AS ({PAIRS}), k AS (SELECT COUNT(*) FILTER (WHERE quality=1 AND toxic=1) AS tp, COUNT(*) FILTER (WHERE quality=1 AND toxic=0) AS fp, COUNT(*) FILTER (WHERE quality=0 AND toxic=1) AS fn, COUNT(*) FILTER (WHERE quality=0 AND toxic=0) AS tn FROM a)
SELECT tp, fp, fn, tn, ROUND(tp/(tp+fp), 8) AS "precision", ROUND(tn/(tn+fn), 8) AS npv, ROUND((tp+tn)/(tp+fp+fn+tn), 8) AS agreement,
 ROUND(((tp+tn)/(tp+fp+fn+tn) - ((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/((tp+fp+fn+tn)*(tp+fp+fn+tn))) / (1 - ((tp+fp)*(tp+fn)+(fn+tn)*(fp+tn))/((tp+fp+fn+tn)*(tp+fp+fn+tn))), 8) AS kappa,
 ROUND(greatest(0.0, (tp/(tp+fp) + 1.96*1.96/(2*(tp+fp)) - 1.96*sqrt(tp/(tp+fp)*(1-tp/(tp+fp))/(tp+fp) + 1.96*1.96/(4*(tp+fp)*(tp+fp)))) / (1 + 1.96*1.96/(tp+fp))), 8) AS low FROM k
""",
)
def a38_a39_confusion(spark, sf_dir):
    out = evaluate.confusion(pairs(spark, sf_dir), c("quality") == 1, c("toxic") == 1)
    low = evaluate.wilson(c("tp").cast("double"), (c("tp") + c("fp")).cast("double"))["low"]
    return out.select("tp", "fp", "fn", "tn", *[F.round(x, 8).alias(x) for x in ("precision", "npv", "agreement", "kappa")], F.round(low, 8).alias("low"))


@query(
    "a40_kappa",
    f"""
WITH a AS ({PAIRS}), g AS (SELECT lang, COUNT(*) AS n, COUNT(*) FILTER (WHERE quality = toxic) AS same, COUNT(*) FILTER (WHERE quality=1) AS q1, COUNT(*) FILTER (WHERE toxic=1) AS t1 FROM a GROUP BY 1)
SELECT lang, n, ROUND(same / n, 8) AS agreement, ROUND((same/n - (q1*t1 + (n-q1)*(n-t1))/(n*n)) / NULLIF(1 - (q1*t1 + (n-q1)*(n-t1))/(n*n), 0), 8) AS kappa FROM g
""",
)
def a40_kappa(spark, sf_dir):
    return evaluate.kappa(pairs(spark, sf_dir), "quality", "toxic", ["lang"]).select("lang", "n", F.round("agreement", 8).alias("agreement"), F.round("kappa", 8).alias("kappa"))


@query(
    "a41_alpha",
    f"""
WITH a AS ({PAIRS}), u AS (SELECT doc_id, quality AS code FROM a UNION ALL SELECT doc_id, toxic FROM a), m AS (SELECT code, COUNT(*) AS t FROM u GROUP BY 1), s AS (SELECT COUNT(*) AS items, SUM(CASE WHEN quality = toxic THEN 2 ELSE 0 END) AS same FROM a)
SELECT items AS n_items, 2*items AS n_codes, ROUND(1 - (1 - same/(2*items)) / (1 - (SELECT SUM(t*(t-1)) FROM m)/((2*items)*(2*items-1))), 8) AS alpha FROM s
""",
)
def a41_alpha(spark, sf_dir):
    p = pairs(spark, sf_dir)
    codes = p.select("doc_id", c("quality").alias("code")).unionByName(p.select("doc_id", c("toxic").alias("code")))
    return evaluate.krippendorff_alpha(codes, "doc_id", "code").withColumn("alpha", F.round("alpha", 8))


@query(
    "a19_a20_learned_map",
    """
WITH k AS (SELECT source, lang, COUNT(*) AS k FROM documents GROUP BY 1, 2), r AS (SELECT source, lang, k, SUM(k) OVER (PARTITION BY source) AS n, ROW_NUMBER() OVER (PARTITION BY source ORDER BY k DESC, lang) AS r FROM k)
SELECT source, lang AS field, CAST(n AS BIGINT) AS n, ROUND(k / n, 8) AS share FROM r WHERE r = 1 AND n >= 5 AND k / n >= 0.5
""",
)
def a19_a20_learned_map(spark, sf_dir):
    return evaluate.learned_map(t(spark, sf_dir, "documents"), "source", "lang").withColumn("share", F.round("share", 8))


@query("a20_shares", "SELECT source, lang, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY source), 8) AS p FROM documents GROUP BY 1, 2")
def a20_shares(spark, sf_dir):
    return evaluate.conditional_shares(t(spark, sf_dir, "documents"), "source", "lang").withColumn("p", F.round("p", 8))


@query("a21_modal_vote", "SELECT l_suppkey, (array_agg(l_returnflag ORDER BY k DESC, l_returnflag))[1] AS l_returnflag FROM (SELECT l_suppkey, l_returnflag, COUNT(*) AS k FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a21_modal_vote(spark, sf_dir):
    return evaluate.modal_vote(t(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


@query("a22_summary", "SELECT event_type, ROUND_EVEN(AVG(value), 3) AS value_mean, ROUND_EVEN(STDDEV_SAMP(value), 3) AS value_std FROM events GROUP BY 1")
def a22_summary(spark, sf_dir):
    return evaluate.summary(t(spark, sf_dir, "events"), "event_type", "value")


@query("a24_disagreements", f"SELECT quality, toxic, COUNT(*) AS n FROM ({PAIRS}) WHERE quality <> toxic GROUP BY 1, 2")
def a24_disagreements(spark, sf_dir):
    return evaluate.disagreements(pairs(spark, sf_dir), "quality", "toxic")


CENTROIDS = """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, AVG(CAST(x AS DOUBLE)) AS x FROM e GROUP BY 1, 2), n AS (SELECT label, SQRT(SUM(x*x)) AS norm FROM m GROUP BY 1),
s AS (SELECT e.vec_id, e.label AS actual, m.label, SUM(CAST(e.x AS DOUBLE) * m.x / n.norm) AS s FROM e JOIN m ON e.i = m.i JOIN n ON m.label = n.label GROUP BY 1, 2, 3), p AS (SELECT vec_id, actual, arg_max(label, s) AS predicted, MAX(s) AS top FROM s GROUP BY 1, 2)
"""


@query("m04_nearest_centroid", CENTROIDS + "SELECT p.vec_id, predicted, ROUND(1 / SUM(EXP((s.s - p.top) * 10)), 6) AS confidence FROM p JOIN s ON p.vec_id = s.vec_id GROUP BY 1, 2")
def m04_nearest_centroid(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "label", c("embedding").cast("array<double>").alias("v"))
    return learn.nearest_centroid(e, "vec_id", "v", learn.centroids(e, "label", "v"), "label").withColumn("confidence", F.round("confidence", 6))


@query(
    "m13_scores",
    CENTROIDS
    + """, c AS (SELECT label, SUM(nx) AS nx, SUM(ny) AS ny, SUM(tp) AS tp FROM (SELECT actual AS label, 1 AS nx, 0 AS ny, CASE WHEN actual = predicted THEN 1 ELSE 0 END AS tp FROM p UNION ALL SELECT predicted, 0, 1, 0 FROM p) GROUP BY 1)
SELECT ROUND(SUM(tp)/SUM(nx), 8) AS accuracy, ROUND(AVG(2*tp/(nx+ny)), 8) AS macro_f1, ROUND(SUM(2*tp/(nx+ny)*nx)/SUM(nx), 8) AS weighted_f1 FROM c""",
)
def m13_scores(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", "label", c("embedding").cast("array<double>").alias("v"))
    p = learn.nearest_centroid(e, "vec_id", "v", learn.centroids(e, "label", "v"), "label").join(e.select("vec_id", "label"), "vec_id")
    return evaluate.class_scores(p, "label", "predicted").select(*[F.round(x, 8).alias(x) for x in ("accuracy", "macro_f1", "weighted_f1")])


@query("m14_curve_fit", "SELECT ROUND(regr_slope(p_retailprice, log2(p_size + 1)), 6) AS slope_per_doubling, ROUND(regr_intercept(p_retailprice, log2(p_size + 1)), 6) AS intercept, ROUND(regr_r2(p_retailprice, log2(p_size + 1)), 6) AS r2 FROM part")
def m14_curve_fit(spark, sf_dir):
    out = evaluate.learning_curve_fit(t(spark, sf_dir, "part").select("p_retailprice", (c("p_size") + 1).alias("n")), "n", "p_retailprice")
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


@query(
    "m12_cascade",
    """
SELECT doc_id, COALESCE(CASE WHEN quality = 0 THEN 'bad' END, CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN source LIKE 'src1%' THEN 'one' END) AS field, CASE WHEN quality = 0 THEN 'direct' WHEN lang = 'en' THEN 'topic' WHEN source LIKE 'src1%' THEN 'subject' END AS route FROM documents LEFT JOIN labels USING (doc_id)
""",
)
def m12_cascade(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    routes = [
        ("direct", t(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("bad").alias("field"))),
        ("topic", docs.where("lang = 'en'").select("doc_id", F.lit("english").alias("field"))),
        ("subject", docs.where("source like 'src1%'").select("doc_id", F.lit("one").alias("field"))),
    ]
    return learn.label_cascade(docs, "doc_id", routes)


@query(
    "a42_distribution",
    """
WITH h AS (SELECT lang, COUNT(*) / (SELECT COUNT(*) FROM documents) AS truth FROM documents GROUP BY 1), s AS (SELECT lang, SUM(n_chars) / (SELECT SUM(n_chars) FROM documents) AS est FROM documents GROUP BY 1)
SELECT ROUND(SUM(abs(est - truth)) / 2, 8) AS tvd, ROUND(AVG(abs(est - truth)) * 100, 8) AS mae_points, arg_max(h.lang, abs(est - truth)) AS worst FROM h JOIN s ON h.lang = s.lang
""",
)
def a42_distribution(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("lang", "n_chars", F.lit(1).alias("one"))
    soft = evaluate.soft_shares(docs, "lang", "n_chars").withColumnRenamed("share", "est")
    hard = evaluate.soft_shares(docs, "lang", "one").withColumnRenamed("share", "truth")
    out = evaluate.distribution_error(soft.join(hard, "lang"), "lang", "est", "truth")
    return out.select(F.round("tvd", 8).alias("tvd"), F.round("mae_points", 8).alias("mae_points"), "worst")


@query(
    "w04_w05_ranks",
    """
WITH u AS (SELECT id, unnest(['a','b','c']) AS f, unnest([x, y, z]) AS p, unnest([1,2,3]) AS i FROM (SELECT o_orderkey AS id, (o_orderkey % 7)/10.0 AS x, (o_orderkey % 5)/10.0 AS y, (o_orderkey % 3)/10.0 AS z FROM orders)),
r AS (SELECT id, f, p, ROW_NUMBER() OVER (PARTITION BY id ORDER BY p DESC, i) AS r FROM u)
SELECT id, MAX(CASE WHEN r=1 THEN f END) AS first, MAX(CASE WHEN r=2 THEN f END) AS second, MAX(CASE WHEN r=1 THEN p END) AS p_first, MAX(CASE WHEN f='b' THEN r END) AS rank_b FROM r GROUP BY 1
""",
)
def w04_w05_ranks(spark, sf_dir):
    d = F.array(*[F.struct(F.lit(f).alias("field"), ((c("o_orderkey") % m) / F.lit(10.0)).alias("p")) for f, m in (("a", 7), ("b", 5), ("c", 3))])
    top = nested.top_two(d)
    return t(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), top["first"].alias("first"), top["second"].alias("second"), top["p_first"].alias("p_first"), nested.rank_of(d, F.lit("b")).cast("bigint").alias("rank_b"))


@query(
    "w10_stratified_sample",
    """
WITH n AS (SELECT c_mktsegment AS s, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, c_mktsegment) AS r, COUNT(*) OVER () AS k FROM customer GROUP BY 1), a AS (SELECT *, greatest(1, 100 * n // total) AS base, 100 - SUM(greatest(1, 100 * n // total)) OVER () AS rest FROM n),
q AS (SELECT s, base + CASE WHEN r <= rest THEN 1 ELSE 0 END AS want FROM a)
SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, ROW_NUMBER() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) JOIN q ON c_mktsegment = q.s WHERE r <= want
""",
)
def w10_stratified_sample(spark, sf_dir):
    """A sampling operator: 100 rows, by segment, in order of the key."""
    return sampling.stratified_sample(t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 100, order=c("c_custkey"))


@query("a17_collisions", "SELECT o_custkey, COUNT(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1 HAVING COUNT(DISTINCT o_orderpriority) >= 2")
def a17_collisions(spark, sf_dir):
    return registry.key_collisions(t(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query("a18_coverage", "SELECT source, COUNT(*) AS n_rows, COUNT(quality) AS n_quality, COUNT(toxic) AS n_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a18_coverage(spark, sf_dir):
    df = t(spark, sf_dir, "documents").select("doc_id", "source").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    return quality.group_coverage(df, "source", "quality", "toxic")


@query("a49_missing", "SELECT 'text' AS \"column\", COUNT(text) AS n_present, COUNT(*) FILTER (WHERE trim(text) = '') AS n_blank FROM documents UNION ALL SELECT 'lang', COUNT(lang), COUNT(*) FILTER (WHERE trim(lang) = '') FROM documents")
def a49_missing(spark, sf_dir):
    return quality.coverage(t(spark, sf_dir, "documents"), "text", "lang")


@query("q01_repeated_keys", "SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1")
def q01_repeated_keys(spark, sf_dir):
    return quality.repeated_keys(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("q06_mass", "WITH k AS (SELECT source, COUNT(*) AS n FROM documents GROUP BY 1) SELECT COUNT(*) AS n_keys, ROUND(CAST(COUNT(*) AS DOUBLE), 6) AS mass FROM k")
def q06_mass(spark, sf_dir):
    shares = evaluate.conditional_shares(t(spark, sf_dir, "documents"), "source", "lang")
    return quality.probability_mass(shares, "source", "p").withColumn("mass", F.round("mass", 6))


@query("f05_rare_classes", "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 HAVING COUNT(*) >= 80)")
def f05_rare_classes(spark, sf_dir):
    return sampling.rare_classes_out(t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 80)


@query(
    "a16_identities",
    """
WITH n AS (SELECT o_custkey AS identity_id, o_orderpriority AS raw_name, COUNT(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_custkey AS identity_id, CAST(COUNT(DISTINCT o_orderkey) AS INTEGER) AS n_outcomes, CAST(COUNT(DISTINCT o_orderstatus) AS INTEGER) AS n_sources, COUNT(DISTINCT o_orderpriority) AS n_name_variants FROM orders GROUP BY 1
""",
)
def a16_identities(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(c("o_custkey").alias("identity_id"), F.lit("orcid").alias("identity_type"), c("o_orderpriority").alias("raw_name"), c("o_orderkey").alias("outcome_id"), c("o_orderstatus").alias("source"))
    return registry.identity_rollup(rows).select("identity_id", "n_outcomes", "n_sources", "n_name_variants")


@query("w07_ordinals", "SELECT p_partkey, string_split(p_name, ' ')[1] AS name, 1 AS position FROM part UNION ALL SELECT p_partkey, string_split(p_name, ' ')[2], 2 FROM part")
def w07_ordinals(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "name")).select("p_partkey", "name", (c("i") + 1).alias("position"))


# ------------------------------------------------------------------ rows only: no SQL twin
@query("p52_display_names")
def p52_display_names(spark, sf_dir):
    from tessera.functions import names

    raw = F.concat(F.upper(F.split("p_name", " ")[1]), F.lit(", "), F.substring(F.upper("p_name"), 1, 1))
    df = t(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    shown = df.select("p_partkey", "raw", names.display_column(F.lit(None).cast("string"), F.lit(None).cast("string"), c("raw")).alias("display"), names.key_column(c("raw")).alias("name_key"))
    return shown.withColumn("completeness", names.completeness(c("display")))


@query("g02_identities")
def g02_identities(spark, sf_dir):
    """Orders as authorships: papers are customers, name keys their priorities."""
    rows = t(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("row_id"),
        c("o_custkey").cast("string").alias("paper_key"),
        c("o_orderpriority").alias("name_key"),
        F.lit("ann").alias("given_key"),
        F.when(c("o_orderkey") % 5 == 0, c("o_orderkey").cast("string")).alias("orcid"),
        F.when(c("o_orderkey") % 3 == 0, (c("o_orderkey") % 1000).cast("string")).alias("native_id"),
    )
    return graph.resolve_identities(graph.assign_identities(rows)).select("row_id", "identity_id", "identity_type")


@query(
    "g02_chains",
    """
WITH l AS (SELECT c_custkey AS k, p, side FROM customer, range(7) p(p), range(3) s(side)),
x AS (SELECT *, CASE k % 3 WHEN 0 THEN 0 ELSE 7 END AS top, CASE k % 3 WHEN 0 THEN 7 WHEN 1 THEN 0 ELSE -1 END AS alone, p + LEAST(side, 1) AS pos FROM l),
y AS (SELECT *, CASE WHEN side = 2 AND (p = alone OR p + 1 = alone) THEN 'name:n' WHEN side < 2 AND pos = alone THEN 'orcid:' || k || '-' || pos ELSE 'orcid:' || k || '-' || top END AS identity_id FROM x)
SELECT k * 21 + p * 3 + side AS row_id, identity_id, CASE WHEN identity_id = 'name:n' THEN 'name_only' ELSE 'orcid' END AS identity_type FROM y
""",
)
def g02_chains(spark, sf_dir):
    """A chain of eight people for each customer, linked by seven papers, with an ORCID at its end and mostly at both.

    Papers go up the chain or, where the key leaves a rest of 1, down; the last of them would join two ORCIDs and is
    refused, and so is its row known by name only.
    """
    k, p, side = c("k"), c("p"), c("side")
    people = t(spark, sf_dir, "customer").select(c("c_custkey").alias("k")).repartition(spark.sparkContext.defaultParallelism)  # a small file of which much is made
    links = people.select("k", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("p")).select("k", "p", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("side"))
    at = p + F.least(side, F.lit(1))
    ident = F.concat_ws("-", k, at)
    rows = links.select(
        (k * 21 + p * 3 + side).alias("row_id"),
        F.concat_ws("-", k, F.when(k % 3 == 1, 6 - p).otherwise(p)).alias("paper_key"),
        F.lit("n").alias("name_key"),
        F.lit("ann").alias("given_key"),
        F.when((side < 2) & ((at == 7) | (at == 0) & (k % 3 != 2)), ident).alias("orcid"),
        F.when(side < 2, ident).alias("native_id"),
    )
    return graph.resolve_identities(graph.assign_identities(rows)).select("row_id", "identity_id", "identity_type")


@query("m01_m02_text_classifier")
def m01_m02_text_classifier(spark, sf_dir):
    """TF-IDF and weighted logistic regression on labelled documents; predictions for all labelled ones."""
    rows = pairs(spark, sf_dir).select("doc_id", c("quality").cast("double").alias("label")).join(t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").persist()  # fitting reads them several times
    features = learn.tfidf().fit(rows).transform(rows).select("doc_id", "label", "features").persist()
    weighted = learn.balanced_weights(features, "label")
    model = learn.logistic(weighted, 1.0)
    rows.unpersist()
    return model.transform(features).select("doc_id", "label", "prediction")


