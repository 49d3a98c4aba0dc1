"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Lines: pairs that share a word are counted; a line goes if an earlier one is similar enough.
OP2 = rf"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
s AS (SELECT doc_id, pos, line, list_sort(list_distinct(regexp_extract_all(line, '{_BLANK}'))) AS w FROM l),
k AS (SELECT w, len(w) AS n, MIN((doc_id, pos)) AS first, row_number() OVER () AS k FROM s WHERE len(w) > 0 GROUP BY w),
e AS (SELECT k, n, first, unnest(w) AS t FROM k),
p AS (SELECT a.k, COUNT(*) AS c, ANY_VALUE(a.n) AS na, ANY_VALUE(b.n) AS nb FROM e a JOIN e b ON a.t = b.t AND b.first < a.first AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.k, b.k),
late AS (SELECT DISTINCT k FROM p WHERE 9 * c >= 4 * (na + nb)),
r AS (SELECT s.doc_id, s.pos, s.line, k.k IS NOT NULL AND ((s.doc_id, s.pos) <> k.first OR late.k IS NOT NULL) AS gone FROM s LEFT JOIN k ON s.w = k.w LEFT JOIN late ON k.k = late.k)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (WHERE gone) AS n_removed, COALESCE(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM r GROUP BY doc_id
"""

OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BLANK}') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS k, ANY_VALUE(a.n) AS na, ANY_VALUE(b.n) AS nb FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * k >= 90 * (na + nb - k)), b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, seen) AS (SELECT x, x FROM b UNION SELECT r.node, b.y FROM r JOIN b ON r.seen = b.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, COALESCE(c.c, s.doc_id) AS component_id FROM s LEFT JOIN (SELECT node, MIN(seen) AS c FROM r GROUP BY 1) c ON s.doc_id = c.node
"""

OP7 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '{_BLANK}') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20),
k AS (SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY array_to_string(w[i : i + 19], chr(1)) ORDER BY doc_id, i) AS r FROM i),
g AS (SELECT doc_id, list(DISTINCT p) AS g FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM k WHERE r > 1) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(COALESCE(len(g.g), 0) AS BIGINT) AS n_removed,
 sha256(COALESCE(array_to_string(CASE WHEN g.g IS NULL THEN w.w ELSE list_filter(w.w, lambda x, n: NOT list_contains(g.g, n)) END, ' '), '')) AS kept_sha256 FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0), p AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM bw),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n), h AS (SELECT dw.doc_id, dw.i, dw.n, p.item_id FROM dw JOIN p ON dw.n = p.n AND array_to_string(dw.w[dw.i : dw.i + dw.n - 1], ' ') = p.k),
c AS (SELECT doc_id, COUNT(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY 1), t AS (SELECT doc_id, COUNT(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY 1)
SELECT d.doc_id, CAST(COALESCE(len(d.w), 0) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

#: The checksum is computed byte by byte from the table of its polynomial.
OP10 = """
WITH RECURSIVE j(doc_id, key, j) AS (SELECT doc_id, CAST(CASE WHEN doc_id < 0 THEN doc_id + 18446744073709551616 ELSE doc_id END AS HUGEINT), CAST(0 AS BIGINT) FROM documents
 UNION ALL SELECT doc_id, k, CAST(floor((j + 1) * (2147483648.0 / ((k // 8589934592) + 1)::DOUBLE)) AS BIGINT) FROM (SELECT doc_id, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM j WHERE j <= 40)),
s AS (SELECT doc_id, MAX(j) FILTER (WHERE j < 40) AS shard, MAX(j) FILTER (WHERE j < 41) AS grown FROM j GROUP BY 1),
t AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
h AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents),
y AS (SELECT doc_id, list_transform(string_split(regexp_replace(h, '(..)', '\\1,', 'g'), ','), lambda p: CASE WHEN p = '' THEN NULL ELSE CAST('0x' || p AS BIGINT) END) AS y, len(h) // 2 AS n FROM h),
c AS (SELECT doc_id, n, xor(list_reduce(list_prepend(4294967295, list_filter(y, lambda v: v IS NOT NULL)), lambda a, v: xor(a >> 8, t[xor(a, v) % 256 + 1])), 4294967295) AS crc FROM y, t),
n AS (SELECT COUNT(*) AS total, greatest(64, CAST(ceil(COUNT(*) / 2000000) AS BIGINT)) AS buckets FROM documents),
r AS (SELECT c.doc_id, CAST(c.n + 16 AS BIGINT) AS size, CAST(c.crc AS BIGINT) AS text_crc32, s.shard, s.grown, CAST('0x' || substr(md5(concat_ws(':', c.doc_id, CAST(c.crc AS BIGINT))), 1, 8) AS BIGINT) % n.buckets AS bucket FROM c JOIN s ON c.doc_id = s.doc_id, n)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, ROW_NUMBER() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM r
"""

#: What op6 fixes exactly, without the model's own score.
LM_BASE = rf"""
WITH t AS (SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(c, range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
i AS (SELECT doc_id, list_append(regexp_extract_all({_LOWER.replace('text', "COALESCE(text, '')")}, '{_BLANK}'), ' ') AS w, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM documents),
d AS (SELECT doc_id, w, xor(list_reduce(list_prepend(4294967295, b), lambda a, v: xor(a >> 8, t[xor(a, v) % 256 + 1])), 4294967295) % 5 = 1 AS held FROM i, t),
k AS (SELECT doc_id, held, unnest(w) AS k FROM d), c AS (SELECT k, COUNT(*) AS c FROM k WHERE NOT held GROUP BY 1), n AS (SELECT SUM(c) AS n, COUNT(*) AS v FROM c)
SELECT k.doc_id, k.held AS held_out, COUNT(*) AS n_tokens, COUNT(c.c) AS n_known, CAST(ANY_VALUE(n.n) AS BIGINT) AS train_tokens, round(SUM(log10((COALESCE(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))), 5) AS base_score
FROM k LEFT JOIN c ON k.k = c.k, n GROUP BY 1, 2
"""

OP11 = rf"""
WITH t AS (SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t), n AS (SELECT lang, CAST(SUM(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
i AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS p FROM w, range(1, 4) v(k)),
g AS MATERIALIZED (SELECT lang, k, p, COUNT(*) AS f FROM i GROUP BY ALL HAVING COUNT(*) >= 10),
c AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS s, unnest(range(1, k)) AS j FROM g WHERE k > 1),
d AS MATERIALIZED (SELECT lang, k, p, a, j, array_to_string(s[1 : j], ' ') AS lp, array_to_string(s[j + 1 : k], ' ') AS rp FROM c),
cut AS (SELECT d.lang, d.k, d.p, d.a, d.j, l.f AS l, r.f AS r, CAST((CAST(d.a AS HUGEINT) * d.a * 1000000) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
 FROM d JOIN g l ON l.lang = d.lang AND l.p = d.lp JOIN g r ON r.lang = d.lang AND r.p = d.rp),
b AS (SELECT lang, k, p, a, l, r, score FROM cut QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
x AS (SELECT lang, p, MAX(a) AS f FROM (SELECT lang, lp AS p, a FROM d WHERE k = 3 AND j = 2 UNION ALL SELECT lang, rp, a FROM d WHERE k = 3 AND j = 1) GROUP BY 1, 2),
s AS (SELECT b.lang, b.p AS phrase, a, l, r, score FROM b LEFT JOIN x ON b.lang = x.lang AND b.p = x.p WHERE x.f IS NULL OR 100 * x.f < 50 * a)
SELECT s.lang, ROW_NUMBER() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM s JOIN n ON s.lang = n.lang QUALIFY rank <= 2000
"""

OP12 = (
    OP4.replace("len(w) >= 3", "len(w) >= 4").replace("len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])", "len(w) - 2), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] || chr(1) || w[i + 3])")
    .replace("10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)", "5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)")
    .replace("100 * k >= 90 *", "100 * k >= 80 *")
    .replace("AS component_id FROM", "AS component_id, s.doc_id = COALESCE(c.c, s.doc_id) AS kept FROM")
)


def _assigned(k: int) -> str:
    """Parts with their nearest entry of the k-th codebooks; all products are exact in doubles."""
    d = "CAST(p.q - 2 * list_inner_product(p.x, c.x) + c.q AS BIGINT)"
    return f"a{k} AS MATERIALIZED (SELECT vec_id, label, part, v, x, m.e AS entry, m.d AS d FROM (SELECT p.row, ANY_VALUE(p.vec_id) AS vec_id, ANY_VALUE(p.label) AS label, p.part, ANY_VALUE(p.v) AS v, ANY_VALUE(p.x) AS x, MIN({{'d': {d}, 'e': c.entry}}) AS m FROM p JOIN c{k} c ON p.part = c.part GROUP BY p.row, p.part))"


def _codebooks(k: int) -> str:
    return (
        f"s{k} AS (SELECT part, entry, i, CAST(floor(SUM(x[i]) / COUNT(*)) AS DOUBLE) AS y FROM a{k - 1}, (SELECT unnest(range(1, size + 1)) AS i FROM z) GROUP BY 1, 2, 3),"
        f"n{k} AS (SELECT part, entry, list(y ORDER BY i) AS x FROM s{k} GROUP BY 1, 2),"
        f"c{k} AS MATERIALIZED (SELECT part, entry, x, list_inner_product(x, x) AS q FROM (SELECT c.part, c.entry, COALESCE(n.x, c.x) AS x FROM c{k - 1} c LEFT JOIN n{k} n ON c.part = n.part AND c.entry = n.entry))"
    )


#: Four rounds written out; sums of integers under 2^53 are exact in doubles.
OP13 = f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda y: floor(1024 * CAST(y AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY vec_id, v) - 1 AS row FROM k), z AS (SELECT MAX(len(v)) // 4 AS size FROM r),
p AS MATERIALIZED (SELECT row, vec_id, label, part, v, x, list_inner_product(x, x) AS q FROM (SELECT row, vec_id, label, v, part, v[part * size + 1 : part * size + size] AS x FROM r, z, range(4) t(part))),
c0 AS MATERIALIZED (SELECT part, row AS entry, x, q FROM p WHERE row < 256),
{", ".join(f"{_assigned(k)}, {_codebooks(k + 1)}" for k in range(4))}, {_assigned(4)},
h AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM c4)),
o AS (SELECT vec_id, v, label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(SUM(d) AS BIGINT) AS error FROM a4 GROUP BY vec_id, v, label)
SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM o, h
"""

ORACLE = {
    "lm_base_scores": LM_BASE,
    "op2_line_dedup": OP2,
    "op4_ngram_jaccard_join": OP4,
    "op7_substring_dedup": OP7,
    "op9_benchmark_decontamination": OP9,
    "op10_sharding": OP10,
    "op11_phrase_collocations": OP11,
    "op12_minhash_dedup": OP12,
    "op13_vector_codes": OP13,
}
