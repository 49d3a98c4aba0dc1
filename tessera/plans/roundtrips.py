"""Registered queries of sources and sinks (written, read back and compared) and of operators without a query so far."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from tessera.functions import ids, names, text
from tessera.operators import audit, evaluate, learn, outcomes, quality, rollup, tables
from tessera.plans.catalog import query, t
from tessera.sources import io
from tessera.streaming import incremental

c = F.col


def folder(spark, name: str) -> str:
    """A new path in the shared folder."""
    return f"{io.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources and sinks
@query("s01_s04_csv", """SELECT CAST(n_nationkey AS VARCHAR) AS gtr_project_id, 'say "' || n_name || '", twice' AS project_title_clean, CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey * 1.5 AS DOUBLE) END AS funding_amount FROM nation""")
def s01_s04_csv(spark, sf_dir):
    """Types follow the canonical names; what is no number becomes null; quotes and commas survive."""
    funding = F.when(c("n_nationkey") % 3 > 0, (c("n_nationkey") * 1.5).cast("string")).otherwise("n/a")
    rows = t(spark, sf_dir, "nation").select(c("n_nationkey").cast("string").alias("gtr_project_id"), F.concat(F.lit('say "'), "n_name", F.lit('", twice')).alias("project_title_clean"), funding.alias("funding_amount"))
    path = folder(spark, "csv")
    io.write_csv(rows, path)
    return io.read_typed_csv(spark, path, io.PROJECT_TYPES)


@query("s02_canonical_names", "SELECT * FROM (VALUES ('gtr_funding_amount', 'funding_amount'), ('funding_amount_clean', 'funding_amount'), ('ukri_url', 'ukri_url'), ('openalex_nothing', 'openalex_nothing')) v(name, canonical)")
def s02_canonical_names(spark, sf_dir):
    found = ("gtr_funding_amount", "funding_amount_clean", "ukri_url", "openalex_nothing")
    return spark.createDataFrame([(n, io.canonical_column(n, io.PROJECT_TYPES)) for n in found], "name string, canonical string")


@query("s05_s22_jsonl", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def s05_s22_jsonl(spark, sf_dir):
    """Written in two runs, the second appends."""
    rows = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = folder(spark, "jsonl")
    io.write_jsonl(rows.where("o_orderkey % 3 = 0"), path)
    io.write_jsonl(rows.where("o_orderkey % 3 <> 0"), path, append=True)
    return io.read_complete_jsonl(spark, path, rows.schema)


@query("s21_remaining", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 1")
def s21_remaining(spark, sf_dir):
    """What a checkpoint doesn't hold yet."""
    todo = t(spark, sf_dir, "orders").select("o_orderkey")
    path = folder(spark, "checkpoint")
    io.write_jsonl(todo.where("o_orderkey % 4 = 1"), path)
    _, done = io.read_checkpoint(spark, path, todo.schema, "o_orderkey")
    return io.remaining(todo, done, "o_orderkey")


@query("s15_embeddings", "SELECT vec_id, len(embedding) AS dim FROM embeddings")
def s15_embeddings(spark, sf_dir):
    """A matrix and the index of its rows."""
    vectors = t(spark, sf_dir, "embeddings").withColumn("row", c("vec_id") * 2)
    return io.embeddings(vectors.select("row", "embedding"), vectors.select("row", "vec_id"), "row").select("vec_id", F.size("embedding").cast("bigint").alias("dim"))


@query("s16_database", "SELECT r_name, COUNT(*) AS n, CAST(SUM(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_even FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def s16_database(spark, sf_dir):
    """Tables and a view over them; flags are 0 and 1."""
    nation = t(spark, sf_dir, "nation").withColumn("even", c("n_nationkey") % 2 == 0)
    view = "SELECT r_name, COUNT(*) AS n, SUM(even) AS n_even FROM s16_nation JOIN s16_region ON n_regionkey = r_regionkey GROUP BY r_name"
    io.write_database(spark, {"s16_nation": nation, "s16_region": t(spark, sf_dir, "region")}, {"s16_by_region": view}, folder(spark, "database"))
    return spark.table("s16_by_region")


@query("s18_manifest", "SELECT 'nation' AS name, 16 AS digits, TRUE AS has_bytes, '{\"rows\": [24, 25]}' AS drift")
def s18_manifest(spark, sf_dir):
    """An input's digest, and the figures that differ from committed ones."""
    path = folder(spark, "manifest")
    io.write_csv(t(spark, sf_dir, "nation").coalesce(1), path)
    found = io.manifest(spark, {"nation": f"{path}/*.csv"}, {"rows": 25, "keys": 25}, {"rows": 24, "keys": 25})
    return found.select("name", F.length("digest").alias("digits"), (c("bytes") > 0).alias("has_bytes"), "drift")


@query("s23_union_files", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'first' ELSE 'second' END AS origin FROM supplier")
def s23_union_files(spark, sf_dir):
    """A required file, an optional one that overlaps with it, and one that isn't there."""
    rows = t(spark, sf_dir, "supplier").select("s_suppkey")
    base = folder(spark, "union")
    rows.where("s_suppkey % 2 = 0").withColumn("origin", F.lit("first")).write.parquet(f"{base}/a")
    rows.withColumn("origin", F.lit("second")).write.parquet(f"{base}/b")
    return io.union_files(spark, [f"{base}/a"], [f"{base}/b", f"{base}/none"], lambda s, p: s.read.parquet(p), "s_suppkey", "s_suppkey").select("s_suppkey", "origin")


@query("s24_flatten", "SELECT s_suppkey AS id, s_name AS \"a.name\", s_acctbal AS \"a.b.balance\" FROM supplier")
def s24_flatten(spark, sf_dir):
    """Nested structs to dotted columns."""
    rows = t(spark, sf_dir, "supplier")
    return io.flatten(rows.select(c("s_suppkey").alias("id"), F.struct(c("s_name").alias("name"), F.struct(c("s_acctbal").alias("balance")).alias("b")).alias("a")))


@query("s14_coded_sheet", "SELECT CAST(n_nationkey AS VARCHAR) AS project_id, n_name AS code FROM nation")
def s14_coded_sheet(spark, sf_dir):
    """A sheet with a line above its header."""
    body = t(spark, sf_dir, "nation").select(c("n_nationkey").cast("string").alias("_c0"), c("n_name").alias("_c1")).coalesce(1)
    head = spark.createDataFrame([("please fill in", None), ("project_id", "code")], body.schema).coalesce(1)
    return io.coded_sheet(head.union(body))


@query("t01_append_new", "SELECT event_id, event_type FROM events")
def t01_append_new(spark, sf_dir):
    """Files that arrive in two runs are appended once each."""
    rows = t(spark, sf_dir, "events").select("event_id", "event_type")
    base = folder(spark, "stream")
    for part in (0, 1):
        rows.where(f"event_id % 2 = {part}").write.mode("append").json(f"{base}/in")
        incremental.append_new(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/seen")
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


@query("t01_windows", "SELECT to_timestamp(floor(epoch(ts) / 3600) * 3600) AT TIME ZONE 'UTC' AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def t01_windows(spark, sf_dir):
    """Hourly counts; the same expression serves streams."""
    return incremental.yearly_counts(t(spark, sf_dir, "events"), "ts", "event_type").withColumn("start", c("start").cast("timestamp_ntz"))


# ------------------------------------------------------------------ columns
@query(
    "p01_entities",
    """
SELECT p_partkey, CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN p_name || ' – café' WHEN 1 THEN p_name || ' & 5 < 6 ©' WHEN 2 THEN p_name || ' read' ELSE p_name END AS cleaned FROM part
""",
)
def p01_entities(spark, sf_dir):
    """References with and without semicolons, old codes, links, addresses and markup."""
    k = c("p_partkey") % 4
    tail = F.when(k == 0, " &#150; caf&eacute").when(k == 1, " &amp 5 &lt 6 &copy").when(k == 2, " <b>read</b> https://example.org/x?y=1 a.b@example.org").otherwise("  **")
    return t(spark, sf_dir, "part").select("p_partkey", text.clean_text(F.concat("p_name", tail)).alias("cleaned"))


@query("p02_names", "SELECT p_partkey, CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN 'Smith A' WHEN 1 THEN 'Dr Smith' WHEN 2 THEN 'Smith JA' ELSE 'Ann Bea Smith' END AS name FROM part")
def p02_names(spark, sf_dir):
    k = c("p_partkey") % 4
    raw = F.when(k == 0, "Ann  Smith").when(k == 1, "Dr. Smith").when(k == 2, "Smith, J.A.").otherwise("Ann Bea Smith")
    return t(spark, sf_dir, "part").select("p_partkey", names.normalise_name(raw).alias("name"))


_WORDS = "string_split(p_name, ' ')"


@query(
    "p48_p52_names",
    f"""
WITH w AS (SELECT p_partkey, {_WORDS}[1] AS a, {_WORDS}[2] AS b, CAST(p_partkey % 5 AS INTEGER) AS k FROM part), u AS (SELECT *, upper(substr(a, 1, 1)) || substr(a, 2) AS ua, upper(substr(b, 1, 1)) || substr(b, 2) AS ub FROM w)
SELECT p_partkey, CASE k WHEN 0 THEN b || ' ' || substr(a, 1, 1) WHEN 1 THEN 'st ' || b || ' ' || substr(a, 1, 1) WHEN 2 THEN b || ' z' WHEN 3 THEN a || ' ' || b || ' l' ELSE b || ' ' || substr(a, 1, 1) END AS key,
 CASE k WHEN 0 THEN ub || ', ' || ua WHEN 1 THEN ub || ', ' || ua || ' St' WHEN 2 THEN 'zu ' || ub WHEN 3 THEN ub || ' Li, ' || ua ELSE ub || ', ' || ua END AS display FROM u
""",
)
def p48_p52_names(spark, sf_dir):
    """P48 P52 on one raw name each: their particles, titles and initials differ."""
    a, b, k = F.get(F.split("p_name", " "), 0), F.get(F.split("p_name", " "), 1), c("p_partkey") % 5
    sp = F.lit(" ")
    raw = F.when(k == 0, F.concat(a, sp, b)).when(k == 1, F.concat(a, F.lit(" st "), b)).when(k == 2, F.concat(F.lit("zu "), b)).when(k == 3, F.concat(a, sp, b, F.lit(" li"))).otherwise(F.concat(F.lit("Dr "), a, sp, b, F.lit(" Jr")))
    given = F.when(k == 3, a)
    surname = F.when(k == 3, F.concat(b, F.lit(" li")))
    return t(spark, sf_dir, "part").select("p_partkey", names.key_column(raw).alias("key"), names.display_column(given, surname, raw).alias("display"))


@query("p04_clean_copies", "SELECT s_suppkey, ' <i>' || s_name || '</i> ' AS title, replace(s_name, '#', '') AS title_clean FROM supplier")
def p04_clean_copies(spark, sf_dir):
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit(" <i>"), "s_name", F.lit("</i> ")).alias("title"))
    return text.clean_copies(rows, "title", "absent")


@query("p07_p13_identifiers", "SELECT page_id, '10.1234/ab.' || CAST(page_id AS VARCHAR) AS doi, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) ELSE 'x' || CAST(page_id AS VARCHAR) END AS bare FROM pages")
def p07_p13_identifiers(spark, sf_dir):
    """P07 P13"""
    n = c("page_id").cast("string")
    marked = F.when(c("page_id") % 2 == 0, F.concat(F.lit("wos:"), n)).otherwise(F.concat(F.lit("x"), n))
    return t(spark, sf_dir, "pages").select("page_id", ids.extract_doi(F.concat(F.lit("see https://doi.org/10.1234/ab."), n, F.lit(" there"))).alias("doi"), ids.strip_prefix(marked, "WOS:").alias("bare"))


@query("p50_p51_names", f"SELECT p_partkey, {_WORDS}[1] AS given, {_WORDS}[2] AS surname, {_WORDS}[1] AS evidence FROM part")
def p50_p51_names(spark, sf_dir):
    """P50 P51"""
    a, b = F.get(F.split("p_name", " "), 0), F.get(F.split("p_name", " "), 1)
    parts = names.split_display_name(F.when(c("p_partkey") % 2 == 0, F.concat(b, F.lit(", "), a)).otherwise(F.concat(a, F.lit(" "), b)))
    return t(spark, sf_dir, "part").select("p_partkey", parts["given"].alias("given"), parts["surname"].alias("surname"), names.given_name_key(F.concat(F.upper(a), F.lit(" J."))).alias("evidence"))


@query("p53_p54_names", "SELECT s_suppkey, 'Lee, Ann' AS name, '0000-0001-2345-678X' AS orcid, 'full_forename' AS completeness, 'identifier_in_name' AS flags FROM supplier")
def p53_p54_names(spark, sf_dir):
    """P53 P54"""
    raw = F.when(c("s_suppkey") % 2 == 0, "Lee, Ann; id_orcid 0000-0001-2345-678x").otherwise("Lee, Ann ORCID: 0000–0001–2345–678X")
    found = t(spark, sf_dir, "supplier").select("s_suppkey", names.strip_identifiers(raw).alias("p"), raw.alias("raw"))
    plain = F.translate("raw", names.DASHES, "-" * len(names.DASHES))
    return found.select("s_suppkey", "p.name", "p.orcid", names.completeness(c("p.name")).alias("completeness"), names.flags(plain, c("p.name")).alias("flags"))


@query("p06_p27_frames", "SELECT n_nationkey AS outcome_id, n_name AS title FROM nation")
def p06_p27_frames(spark, sf_dir):
    """Rows twice, a column of placeholders only and one of blanks."""
    rows = t(spark, sf_dir, "nation").select(c("n_nationkey").alias("outcome_id"), c("n_name").alias("title"), F.lit("N/A").alias("impact"), F.lit(" [] ").alias("areas"), F.lit(None).cast("string").alias("gone"))
    return outcomes.clean_frame(rows.union(rows))


@query("p25_p29_p63_frames", "SELECT s_suppkey AS outcome_id, s_acctbal AS value_gbp, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS DOUBLE) END AS times_cited, CAST(NULL AS DOUBLE) AS fwci FROM supplier")
def p25_p29_p63_frames(spark, sf_dir):
    """P25 P29 P63"""
    rows = t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("outcomeId"), c("s_acctbal").alias("amount"), F.lit("GBP").alias("currencyCode"), F.when(c("s_suppkey") % 2 == 0, c("s_suppkey").cast("string")).otherwise("none").alias("timesCited"), F.lit(1).alias("links"))
    out = outcomes.canonical_names(rows, {"outcomeId": "outcome_id"}, drop=("links", "absent"))
    out = outcomes.single_currency(out, "currency_code", "amount")
    return outcomes.numeric(outcomes.numeric(out, "times_cited"), "fwci")


@query("p26_outcome_types", "SELECT n_nationkey AS outcome_id, n_name AS title, replace(n_name, '_', '') AS title_clean, CASE WHEN n_nationkey % 2 = 0 THEN '2019' END AS year FROM nation")
def p26_outcome_types(spark, sf_dir):
    """One of the twelve, with a year out of range."""
    rows = t(spark, sf_dir, "nation").select(c("n_nationkey").alias("outcome_id"), F.concat(F.lit("  "), "n_name", F.lit(" ")).alias("title"), F.when(c("n_nationkey") % 2 == 0, "2019").otherwise("0").alias("year"))
    kind = next(k for k, s in outcomes.SPECS.items() if not s.publication)
    out = outcomes.apply_spec(rows, kind)
    return out.select("outcome_id", "title", "title_clean", c("year").cast("string").alias("year"))


@query("p59_same_names", "SELECT s_suppkey, COALESCE(CASE WHEN s_suppkey % 2 = 0 THEN 'a' END, CASE WHEN s_suppkey % 3 = 0 THEN 'b' END) AS url FROM supplier")
def p59_same_names(spark, sf_dir):
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", F.when(c("s_suppkey") % 2 == 0, "a").alias("url_0"), F.when(c("s_suppkey") % 3 == 0, "b").alias("url_1"))
    return tables.first_of_same_name(rows, ["url_0", "url_1"], "url").select("s_suppkey", "url")


# ------------------------------------------------------------------ tables
@query("a05_count_pivot", "SELECT o_custkey, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_F, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS n_O, COUNT(*) FILTER (WHERE o_orderstatus = 'X') AS n_X FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1")
def a05_count_pivot(spark, sf_dir):
    return rollup.count_pivot(t(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "X"])


@query("a45_merge_review", "SELECT CAST(p_partkey % 3 AS BIGINT) AS k, CASE CAST(p_partkey % 3 AS INTEGER) WHEN 0 THEN 'several given names' WHEN 1 THEN 'initials beside a given name' ELSE 'initials only' END AS reason FROM part GROUP BY 1, 2")
def a45_merge_review(spark, sf_dir):
    k, odd = (c("p_partkey") % 3).cast("bigint"), F.floor(c("p_partkey") / 3) % 2 == 1
    given = F.when(k == 0, F.when(odd, "Ann M.").otherwise("Bea")).when(k == 1, F.when(odd, "Ann").otherwise("A.")).otherwise("J.")
    return audit.merge_review(t(spark, sf_dir, "part").select(k.alias("k"), "p_name", given.alias("given")), "k", "p_name", "given").select("k", "reason")


@query("a51_identifier_coverage", "SELECT event_type, CAST(2 * COUNT(*) AS BIGINT) AS n_slots, COUNT(*) FILTER (WHERE event_id % 2 = 0) AS n_ids, COUNT(*) AS n_given, CASE WHEN 0.5 * COUNT(*) FILTER (WHERE event_id % 2 = 0) / COUNT(*) >= 0.40 THEN 'good' WHEN 0.5 * COUNT(*) FILTER (WHERE event_id % 2 = 0) / COUNT(*) >= 0.15 THEN 'partial' ELSE 'poor' END AS verdict FROM events GROUP BY 1")
def a51_identifier_coverage(spark, sf_dir):
    one = F.struct(F.when(c("event_id") % 2 == 0, "0000").otherwise(" ").alias("orcid"), F.lit("Ann").alias("given"))
    rows = t(spark, sf_dir, "events").select("event_type", F.array(one, F.struct(F.lit(None).cast("string").alias("orcid"), F.lit("").alias("given"))).alias("authors"))
    return audit.identifier_coverage(rows, "event_type", "authors", "orcid", "given").drop("share")


@query("p40_contributor_ids", "SELECT s_suppkey AS record, CASE WHEN s_suppkey % 3 < 2 THEN 'id' || CAST(s_suppkey AS VARCHAR) END AS identifier FROM supplier")
def p40_contributor_ids(spark, sf_dir):
    """By whole names, then by an initial that only one contributor has."""
    s = t(spark, sf_dir, "supplier")
    k = c("s_suppkey") % 3
    authors = s.select(c("s_suppkey").alias("record"), F.lit("O'Neil").alias("surname"), F.when(k == 0, "Ann").otherwise("A.").alias("given"))
    one = s.select(c("s_suppkey").alias("record"), F.lit("ONEIL").alias("surname"), F.lit("ann").alias("given"), F.concat(F.lit("id"), "s_suppkey").alias("identifier"))
    two = s.where(k == 2).select(c("s_suppkey").alias("record"), F.lit("oneil").alias("surname"), F.lit("Abe").alias("given"), F.lit("other").alias("identifier"))
    return audit.contributor_ids(authors, one.unionByName(two), "record").select("record", "identifier")


@query("j23_refresh_sample", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 = 0")
def j23_refresh_sample(spark, sf_dir):
    pool = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return audit.refresh_sample(pool, pool.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit("old").alias("note")), "o_orderkey", ["o_orderstatus"])


@query("j25_align", "SELECT o_orderkey, o_totalprice AS a, o_totalprice * 2 AS b FROM orders")
def j25_align(spark, sf_dir):
    """Equal keys on both sides, in whatever order."""
    rows = t(spark, sf_dir, "orders")
    return tables.align(rows.select("o_orderkey", c("o_totalprice").alias("a")), rows.orderBy(F.desc("o_orderkey")).select("o_orderkey", (c("o_totalprice") * 2).alias("b")), "o_orderkey").select("o_orderkey", "a", "b")


@query("m15_wilcoxon", "SELECT 10 AS n, CAST(3 AS DOUBLE) AS statistic, CAST(0.009766 AS DOUBLE) AS p")
def m15_wilcoxon(spark, sf_dir):
    """Ten pairs whose differences are 1 to 10, of which 1 and 2 are negative: exact p = 10 / 1024."""
    n = t(spark, sf_dir, "nation").where("n_nationkey between 1 and 10").select(F.when(c("n_nationkey") < 3, -c("n_nationkey")).otherwise(c("n_nationkey")).cast("double").alias("a"), F.lit(0.0).alias("b"))
    out = evaluate.wilcoxon(n, "a", "b")
    return spark.createDataFrame([(out["n"], out["statistic"], round(out["p"], 6))], "n int, statistic double, p double")


@query("q02_q05_gates", "SELECT * FROM (VALUES ('columns', 'stops'), ('count', 'stops'), ('range', 'passes'), ('unique', 'passes')) v(gate, outcome)")
def q02_q05_gates(spark, sf_dir):
    """Q01 Q02 Q03 Q05: what each gate does with the nations."""
    nation = t(spark, sf_dir, "nation")
    gates = {"columns": lambda: quality.assert_columns(nation, "n_name", "absent"), "count": lambda: quality.assert_same_count(nation, nation.limit(3)), "range": lambda: quality.assert_count_between(nation, 1, 1000), "unique": lambda: quality.assert_unique(nation, "n_nationkey")}
    out = []
    for name, gate in gates.items():
        try:
            gate()
            out.append((name, "passes"))
        except (ValueError, AssertionError, KeyError):
            out.append((name, "stops"))
    return spark.createDataFrame(out, "gate string, outcome string")



@query(
    "m07_setups",
    """
WITH p AS (SELECT o_orderpriority AS label FROM orders WHERE o_orderkey % 5 = 0 AND o_orderpriority < '4'), b AS (SELECT o_orderpriority AS label FROM orders WHERE o_orderkey % 5 = 1), k AS (SELECT o_orderpriority AS label FROM orders WHERE o_orderkey % 5 > 1),
c AS (SELECT label, COUNT(*) AS n FROM k GROUP BY 1), w AS (SELECT label, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS m FROM p GROUP BY 1),
f AS (SELECT c.label, CAST(least(c.n, greatest(1, round_even(w.n / w.m * (SELECT SUM(n) FROM c), 0))) AS BIGINT) AS n FROM c JOIN w ON c.label = w.label),
a AS (SELECT 'A' AS s, label, COUNT(*) AS n, 1.0 AS w FROM p GROUP BY 2 UNION ALL SELECT 'B', label, COUNT(*), 1 FROM b GROUP BY 2 UNION ALL SELECT 'C', label, COUNT(*), 1 FROM (FROM p UNION ALL FROM b) GROUP BY 2 UNION ALL SELECT 'D', label, n, 1 FROM c
 UNION ALL SELECT 'E', label, COUNT(*), 1 FROM (FROM p UNION ALL FROM k) GROUP BY 2 UNION ALL SELECT 'F', label, n, 1 FROM f UNION ALL SELECT 'G', label, n, 1 FROM c UNION ALL SELECT 'G', label, n, 50 FROM w)
SELECT s AS setup, label, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(n * w) AS DOUBLE) AS weight FROM a GROUP BY 1, 2
""",
)
def m07_setups(spark, sf_dir):
    """Rows and weights of each class in each set-up."""
    o = t(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("label"))
    parts = o.where("id % 5 = 0 AND label < '4'"), o.where("id % 5 = 1"), o.where("id % 5 > 1")
    out = [learn.setup(s, *parts).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")).select(F.lit(s).alias("setup"), "label", "n", "weight") for s in "ABCDEFG"]
    return reduce(lambda x, y: x.unionByName(y), out)
