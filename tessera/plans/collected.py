"""Registered queries of landed pages, of samples over runs and of projected texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import experiments, projection, sampling
from tessera.plans.catalog import query, t
from tessera.plans.experiments import STOPS
from tessera.plans.roundtrips import folder
from tessera.sources import landed

c = F.col
DIMS = 64


@query(
    "s07_landed_pages",
    """
WITH n AS (SELECT page_id, page_id % 32 AS q, ROW_NUMBER() OVER (PARTITION BY page_id % 32 ORDER BY page_id) - 1 AS i FROM pages),
p AS (SELECT page_id, q, i // 8 AS page, i % 8 AS ord FROM n), f AS (SELECT q, MIN(page) AS first FROM p WHERE (7 * page + q) % 11 = 3 GROUP BY 1)
SELECT 'query ' || q AS query, CAST(page AS INTEGER) AS page, CAST(ord AS INTEGER) AS ord, page_id, CASE WHEN first IS NULL OR page < first THEN 1 ELSE 2 END AS run FROM p LEFT JOIN f USING (q)
""",
)
def s07_landed_pages(spark, sf_dir):
    """Pages as answers to 32 queries, eight to an answer; some fail at first, and what follows them comes by the second run."""
    path, sink, state = (folder(spark, f"landed-{x}") for x in ("pages", "sink", "state"))
    q = F.pmod("page_id", F.lit(32))
    rows = t(spark, sf_dir, "pages").select("page_id", q.alias("q"), (F.row_number().over(Window.partitionBy(q).orderBy("page_id")) - 1).alias("i"))
    records = F.transform(F.array_sort(F.collect_list("page_id")), lambda x: F.to_json(F.struct(x.alias("id"))))
    pages = rows.groupBy("q", F.floor(c("i") / 8).cast("int").alias("page")).agg(records.alias("records"))
    answers = pages.select(F.concat(F.lit("query "), "q").alias("query"), "page", F.when((7 * c("page") + c("q")) % 11 == 3, 503).otherwise(200).alias("status"), "records")
    landed.land_responses(answers, path)
    landed.append_landed(spark, path, sink, state, 1)
    landed.land_responses(answers.where("status = 503").withColumn("status", F.lit(200)), path)
    landed.append_landed(spark, path, sink, state, 2)
    return spark.read.parquet(sink).select("query", "page", "ord", F.get_json_object("record", "$.id").cast("bigint").alias("page_id"), "run")


@query(
    "s26_run_samples",
    """
WITH d AS (SELECT lang, doc_id, MIN(n_chars) AS n_chars FROM documents WHERE doc_id IS NOT NULL GROUP BY 1, 2)
SELECT lang, doc_id, n_chars FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= 100
""",
)
def s26_run_samples(spark, sf_dir):
    """A hundred documents of each language, by three runs over parts that overlap; the second is made twice."""
    path, order = folder(spark, "samples"), F.md5(c("doc_id").cast("string"))
    docs = t(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    for run, part in ((1, "doc_id % 3 = 0"), (2, "doc_id % 5 = 0"), (2, "doc_id % 2 = 0"), (3, "doc_id % 3 <> 0")):
        sampling.sample_run(docs.where(part), "lang", "doc_id", 100, path, run, order)
    return sampling.sampled(spark, path, "lang", "doc_id", 100, order)


@query(
    "s26_coverage",
    """
WITH s AS (SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) <= 500)
SELECT o_orderpriority, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_totalprice > 150000) AS n_has, ROUND(COUNT(*) FILTER (WHERE o_totalprice > 150000) / COUNT(*), 9) AS share FROM s GROUP BY 1
""",
)
def s26_coverage(spark, sf_dir):
    """How many of a sample of each priority's orders are large ones."""
    orders = t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    sample = sampling.bottom_k(orders, "o_orderpriority", "o_orderkey", 500, F.md5(c("o_orderkey").cast("string")))
    return sampling.coverage(sample, "o_orderpriority", c("o_totalprice") > 150000).withColumn("share", F.round("share", 9))


@query(
    "m17_projection",
    f"""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(COALESCE(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN {STOPS}) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), n AS (SELECT COUNT(*) AS n FROM documents),
f AS (SELECT doc_id, term, COUNT(*) AS tf FROM g GROUP BY 1, 2), v AS (SELECT term, COUNT(*) AS df FROM f GROUP BY 1 HAVING COUNT(*) >= 2),
r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1 + df)) + 1) AS raw FROM f JOIN v USING (term), n),
u AS (SELECT doc_id, md5(term) AS h, CAST(ROUND(raw / sqrt(SUM(raw * raw) OVER (PARTITION BY doc_id)) * {projection.UNIT}) AS BIGINT) AS a FROM r),
b AS (SELECT doc_id, j, CAST('0x' || substr(h, CAST(4 * j + 1 AS BIGINT), 4) AS INTEGER) AS g, a FROM u, range({projection.BLOCKS}) j(j)),
s AS (SELECT doc_id, CAST(j * {DIMS // projection.BLOCKS} + (g >> 1) % {DIMS // projection.BLOCKS} AS INTEGER) AS pos, CAST(SUM(CASE WHEN g % 2 = 0 THEN a ELSE -a END) AS BIGINT) AS total FROM b GROUP BY 1, 2 HAVING SUM(CASE WHEN g % 2 = 0 THEN a ELSE -a END) <> 0)
SELECT doc_id, pos, ROUND(total / sqrt(SUM(CAST(total AS DOUBLE) * total) OVER (PARTITION BY doc_id)), 6) AS value FROM s
""",
)
def m17_projection(spark, sf_dir):
    """The vectors' places that aren't zero."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text")
    counts = experiments.term_counts(docs, "doc_id", "text", STOPS)
    weights = experiments.term_weights(counts, experiments.vocabulary(counts, 2, None), "doc_id", docs.count())
    vectors = projection.unit_vectors(projection.project(weights, "doc_id", DIMS), "doc_id", DIMS)
    return vectors.select("doc_id", F.posexplode("embedding").alias("pos", "value")).where("value <> 0").withColumn("value", F.round("value", 6))
