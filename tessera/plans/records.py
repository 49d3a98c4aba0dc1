"""Registered queries of nested records: lines of orders as authors of a work, gathered as JSON and flattened again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import records
from tessera.plans.catalog import query, t

c = F.col

#: Lines in order with a surname, a forename and their place; shared by the twins.
LINES = """a AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, chr(CAST(97 + l_suppkey % 3 AS INTEGER)) || 'mith' AS last, chr(CAST(97 + l_partkey % 2 AS INTEGER)) || chr(CAST(97 + l_partkey % 5 AS INTEGER)) AS first,
ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)"""


def people(spark, sf_dir, **made) -> DataFrame:
    """A row for each order with its lines in order as ``people``, and beside it an array of what each function makes of a line.

    Rows are few bytes, but much is made of each: dealt into a fixed number of parts, which aren't merged by their bytes.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    line = t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("o_orderkey"), F.struct(c("l_linenumber").alias("n"), c("l_partkey").alias("p"), c("l_suppkey").alias("s")).alias("x"))
    line = line.repartition(parts, "o_orderkey").select("o_orderkey", F.struct("x.*", *[make(c("x")).alias(k) for k, make in made.items()]).alias("x"))
    gathered = line.groupBy("o_orderkey").agg(F.sort_array(F.collect_list("x")).alias("people"))
    out = t(spark, sf_dir, "orders").select("o_orderkey").repartition(parts, "o_orderkey").join(gathered, "o_orderkey", "left")
    return out.select("o_orderkey", "people", *[c("people")[k].alias(k) for k in made])


def last(x: Column) -> Column:
    return F.concat(F.char(97 + x["s"] % 3), F.lit("mith"))


def first(x: Column) -> Column:
    return F.concat(F.char(97 + x["p"] % 2), F.char(97 + x["p"] % 5))


def shaped(values: Column) -> Column:
    """JSON texts as a node: a list, one value alone, or null for none."""
    return F.coalesce(F.when(F.size(values) > 1, F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))), F.get(values, 0), F.lit("null"))


def node(values: Column) -> Column:
    """As ``shaped``, of records that aren't JSON yet."""
    text = F.to_json(values)
    return F.when(F.size(values) > 1, text).when(F.size(values) == 1, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise("null")


@query(
    "p39_citation_records",
    f"""
WITH {LINES}, b AS (SELECT *, 'r' || p AS rid, CASE WHEN n = 3 THEN 'o' || s ELSE '' END AS orcid FROM a WHERE n % 2 = 1),
same AS (SELECT k, last, first, arg_max(rid, i) AS rid, arg_max(orcid, i) AS orcid FROM b GROUP BY 1, 2, 3),
near AS (SELECT k, last, left(first, 1) AS initial, MIN(rid) AS rid, MIN(orcid) AS orcid FROM b GROUP BY 1, 2, 3 HAVING COUNT(*) = 1),
found AS (SELECT a.k, a.i, a.n, a.p, a.last || ', ' || a.first AS author, CASE WHEN same.k IS NOT NULL THEN same.rid ELSE COALESCE(near.rid, '') END AS rid, CASE WHEN same.k IS NOT NULL THEN same.orcid ELSE COALESCE(near.orcid, '') END AS orcid
  FROM a LEFT JOIN same ON a.k = same.k AND a.last = same.last AND a.first = same.first LEFT JOIN near ON a.k = near.k AND a.last = near.last AND left(a.first, 1) = near.initial),
each AS (SELECT k, string_agg(author, '; ' ORDER BY i) AS author, string_agg(rid, '; ' ORDER BY i) AS aligned, string_agg(NULLIF(rid, ''), '; ' ORDER BY i) AS researcher_ids, string_agg(NULLIF(orcid, ''), '; ' ORDER BY i) AS orcids,
  string_agg('k' || n, '; ' ORDER BY i) AS keywords, string_agg('g' || p, '; ' ORDER BY i) FILTER (WHERE n <> 2) AS grants, MAX(p) AS doi FROM found GROUP BY 1)
SELECT o_orderkey, 'R' || o_orderkey AS wos_uid, CASE WHEN o_orderkey % 5 <> 0 THEN 'T' || o_orderkey END AS title, CASE WHEN o_orderkey % 5 <> 0 THEN COALESCE(author, '') ELSE '' END AS author, CASE WHEN o_orderkey % 5 <> 0 THEN COALESCE(aligned, '') ELSE '' END AS aligned,
CASE WHEN o_orderkey % 5 <> 0 THEN COALESCE(researcher_ids, '') ELSE '' END AS researcher_ids, CASE WHEN o_orderkey % 5 <> 0 THEN COALESCE(orcids, '') ELSE '' END AS orcids, COALESCE(keywords, '') AS author_keywords, COALESCE(grants, '') AS funding_grant_ids, '10.1/' || doi AS doi
FROM orders LEFT JOIN each ON k = o_orderkey
""",
)
def p39_citation_records(spark, sf_dir):
    """Contributors are the lines of odd numbers; a fifth of the records has no summary at all."""
    named = lambda x: (last(x).alias("last_name"), first(x).alias("first_name"))
    word = lambda x: F.concat(F.lit("k"), x["n"])
    df = people(
        spark, sf_dir,
        name=lambda x: F.struct(F.when(x["n"] % 2 == 0, "author").alias("role"), F.concat_ws(", ", last(x), first(x)).alias("display_name"), *named(x)),
        known=lambda x: F.when(x["n"] % 2 == 1, F.struct(F.struct(*named(x), F.concat(F.lit("r"), x["p"]).alias("r_id"), F.when(x["n"] == 3, F.concat(F.lit("o"), x["s"])).alias("orcid_id")).alias("name"))),
        keyword=lambda x: F.when(x["p"] % 2 == 0, F.to_json(F.struct(word(x).alias("content")))).otherwise(F.concat(F.lit('"'), word(x), F.lit('"'))),
        grant=lambda x: F.struct(F.struct(F.when(x["n"] != 2, F.concat(F.lit("g"), x["p"])).alias("grant_id")).alias("grant_ids")),
    ).withColumn("known", F.array_compact("known"))
    doi = F.coalesce(F.concat(F.lit('{"type":"xref_doi","value":"10.1/'), F.array_max(c("people")["p"]), F.lit('"}')), F.lit("null"))
    summary = F.when(c("o_orderkey") % 5 == 0, "null").otherwise(F.format_string('{"titles":{"title":{"type":"item","content":"T%d"}},"names":{"name":%s}}', "o_orderkey", node(c("name"))))
    text = F.format_string(
        '{"UID":"R%d","static_data":{"summary":%s,"contributors":{"contributor":%s},"fullrecord_metadata":{"keywords":{"keyword":%s},"fund_ack":{"grants":{"grant":%s}}}},"dynamic_data":{"cluster_related":{"identifiers":{"identifier":%s}}}}',
        "o_orderkey", summary, node(c("known")), shaped(c("keyword")), node(c("grant")), doi,
    )
    flat = records.flatten_citation_records(df.select("o_orderkey", F.parse_json(text).alias("rec")), "rec")
    aligned = F.array_join(c("people")["researcher_id"], "; ")
    return flat.select("o_orderkey", "wos_uid", "title", "author", aligned.alias("aligned"), "researcher_ids", "orcids", "author_keywords", "funding_grant_ids", "doi")


@query(
    "p37_bibliographic_records",
    f"""
WITH {LINES}, each AS (SELECT k, string_agg(last, '; ' ORDER BY i) FILTER (WHERE n <> 4) AS author, string_agg(CASE WHEN n <> 4 THEN last ELSE '' END, '; ' ORDER BY i) AS author_names, string_agg(CASE WHEN p % 3 <> 0 THEN CAST(p AS VARCHAR) ELSE '' END, '; ' ORDER BY i) AS author_ids,
  string_agg(CASE WHEN n % 2 = 1 THEN first ELSE '' END, '; ' ORDER BY i) AS author_given_names, list_sort(list_distinct(list('I' || s % 10))) AS institutions, string_agg('S' || n, '; ' ORDER BY i) AS subject_areas, COUNT(*) AS n FROM a GROUP BY 1)
SELECT o_orderkey, COALESCE(author, '') AS author, COALESCE(author_names, '') AS author_names, COALESCE(author_ids, '') AS author_ids, COALESCE(author_given_names, '') AS author_given_names, array_to_string(institutions, '; ') AS institutions, CASE WHEN n > 1 THEN subject_areas END AS subject_areas, COALESCE(n, 0) AS n_rows FROM orders LEFT JOIN each ON k = o_orderkey
""",
)
def p37_bibliographic_records(spark, sf_dir):
    """Authors always as a list; institutions as a list, alone or absent; a subject alone isn't read."""
    made = people(
        spark, sf_dir,
        author=lambda x: F.struct(F.when(x["n"] != 4, last(x)).alias("ce:surname"), F.when(x["p"] % 3 != 0, x["p"]).alias("@auid"), F.when(x["n"] % 2 == 1, first(x)).alias("ce:given-name")),
        place=lambda x: F.struct(F.concat(F.lit("I"), x["s"] % 10).alias("affilname")),
        subject=lambda x: F.struct(F.concat(F.lit("S"), x["n"]).alias("$")),
    )
    parts = {"author": F.coalesce(F.to_json("author"), F.lit("[]")), "institutions": node(c("place")), "subject_areas": node(c("subject")), "indexed_keywords": F.lit("null")}
    df = made.select("o_orderkey", *[F.parse_json(v).alias(k) for k, v in parts.items()])
    flat = records.flatten_bibliographic_records(df)
    return flat.select("o_orderkey", "author", "author_names", "author_ids", "author_given_names", "institutions", "subject_areas", F.size("institution_rows").cast("bigint").alias("n_rows"))


@query(
    "p36_works",
    f"""
WITH {LINES}, d AS (SELECT k, last, MIN(i) AS i FROM a GROUP BY 1, 2), e AS (SELECT k, string_agg(last, '; ' ORDER BY i) AS author FROM d GROUP BY 1),
each AS (SELECT k, string_agg(last, '; ' ORDER BY i) AS author_names, string_agg(CASE WHEN p % 4 <> 0 THEN 'A' || p ELSE '' END, '; ' ORDER BY i) AS author_ids, string_agg(CASE WHEN p % 4 <> 0 AND n % 2 = 1 THEN 'o' || s ELSE '' END, '; ' ORDER BY i) AS author_orcids, arg_min(p, i) FILTER (WHERE n > 2) AS page, arg_min(s, i) AS pdf FROM a GROUP BY 1)
SELECT o_orderkey, COALESCE(author, '') AS author, COALESCE(author_names, '') AS author_names, COALESCE(author_ids, '') AS author_ids, COALESCE(author_orcids, '') AS author_orcids, CASE WHEN o_orderkey % 4 = 0 THEN '10.1/' || o_orderkey END AS doi,
CASE WHEN o_orderkey % 4 = 0 THEN 'https://doi.org/10.1/' || o_orderkey ELSE COALESCE('u' || page, 'f' || pdf) END AS url, 'n' || o_orderkey || ' of works' AS abstract, CAST(o_orderkey AS VARCHAR) AS cited_by FROM orders LEFT JOIN each ON each.k = o_orderkey LEFT JOIN e ON e.k = o_orderkey
""",
)
def p36_works(spark, sf_dir):
    """An ORCID beside no id isn't kept; the address is the DOI, else a page, else a file."""
    made = people(
        spark, sf_dir,
        author=lambda x: F.struct(F.struct(last(x).alias("display_name"), F.when(x["p"] % 4 != 0, F.concat(F.lit("A"), x["p"])).alias("id"), F.when(x["n"] % 2 == 1, F.concat(F.lit("o"), x["s"])).alias("orcid")).alias("author")),
        place=lambda x: F.struct(F.when(x["n"] > 2, F.concat(F.lit("u"), x["p"])).alias("landing_page_url"), F.concat(F.lit("f"), x["s"]).alias("pdf_url")),
    )
    doi = F.when(c("o_orderkey") % 4 == 0, F.format_string('"https://doi.org/10.1/%d"', "o_orderkey")).otherwise("null")
    text = F.format_string('{"authorships":%s,"locations":%s,"doi":%s,"abstract_inverted_index":{"works":[2],"n%d":[0],"of":[1]},"cited_by_count":%d}', node(c("author")), node(c("place")), doi, "o_orderkey", "o_orderkey")
    flat = records.flatten_works(made.select("o_orderkey", F.parse_json(text).alias("rec")), "rec")
    return flat.select("o_orderkey", "author", "author_names", "author_ids", "author_orcids", "doi", "url", "abstract", "cited_by")
