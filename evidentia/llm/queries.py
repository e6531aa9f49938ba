"""Registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, blocks, contamination, licenses, lines, merkle, near, packing, quality, sharding, substrings, tokens, topk
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    put = sharding.shard(table(spark, sf_dir, "documents"), shards=24)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"), width=5, similarity=0.75)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lines.apply(docs, lines.keep_bitmaps(docs, mode="common", min_docs=10))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.repeated(table(spark, sf_dir, "documents"), width=5, similarity=0.75)
    return out.select("doc_id", "start", "n_words", "cluster_id", "n_docs", "removed")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"))
    return tokens.limit_totals(tokens.length_histogram(counts))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), window=2048, end_id=1)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_minhash_near_dedup, op3_quality_rules, op4_line_dedup, op5_substring_dedup, op6_license_scan, op7_token_counts, op8_decontamination, op9_packing, op10_html_extraction, op11_filter_audit, op12_merkle_manifest, op13_exact_topk)}

_BLANK = r"\x09-\x0D\x20"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


#: unsigned crc32 of the decimal id, bit by bit
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, c: list_reduce(list_concat([xor(a, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda s, t: xor(s >> 1, (s & 1) * 3988292384))), 4294967295)"""

ORACLES = {
    "op2_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^{_BLANK}]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
r AS (SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.seen)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) m USING (doc_id)""",
    "op8_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[k:k+12], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, k, array_to_string(ws[k:k+n-1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, ns WHERE len(ws) >= n)),
m AS (SELECT r, k, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(k, k + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op3_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^{_BLANK}]+') AS ws FROM d),
g AS (SELECT r, i, ws[i:i+4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i+1, i+2, i+3, i+4]) AS p FROM c WHERE n > 1) GROUP BY r),
l AS (SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^{_BLANK}]') GROUP BY r, line),
dup AS (SELECT r, sum(n - 1) AS n, sum(n) AS total FROM l GROUP BY r),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(dup.total, 0) AS n_lines, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters
  FROM w LEFT JOIN rep USING (r) LEFT JOIN dup USING (r))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words
    OR (2 * up > letters AND letters >= 20) OR 2 * n_dup_lines > n_lines OR 10 * n_stutter > 3 * n_words
    OR NOT (word_chars BETWEEN 2 * n_words AND 15 * n_words)) AS kept
FROM f""",
    "op4_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT r, doc_id, string_split(t, chr(10)) AS ls FROM d)),
k AS (SELECT *, translate(regexp_replace(line, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (hot.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN hot ON k.key = hot.key GROUP BY r, doc_id""",
    "op11_filter_audit": rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS ws FROM documents),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
y AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
  + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS fails
  FROM d JOIN m USING (t) LEFT JOIN y USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM l a, l b, l c, l d, l e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS f, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS p FROM o, range(1, 6) AS t(step)),
r AS (SELECT part, filter_order, step::INT AS step, f, coalesce(sum(n) FILTER (fails & (p + f) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & p = 0 AND fails & f > 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails & p > 0 AND fails & f > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails & p = 0 AND fails & f > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails & p = 0 AND fails & f > 0), 0)::BIGINT AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, {_field("doc_id")} || {_field("source")} || {_field("lang")} || {_field("n_chars")} AS head, text FROM documents),
h AS (SELECT r, doc_id, source, sha256(head || {_field("text")}) AS leaf, CASE WHEN {_CRC} % 5 = 0 THEN sha256(head || {_field("lower_text")}) END AS forged
  FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM d)),
t AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h),
a AS (SELECT tree, 0 AS level, i, n, leaf AS digest FROM t
  UNION ALL SELECT tree, level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY tree, level, i // 16, n),
b AS (SELECT 0 AS level, tree AS i, count(*) OVER () AS n, digest FROM a WHERE n = 1
  UNION ALL SELECT level + 1, i // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY level, i // 16, n),
nodes AS (SELECT * FROM a UNION ALL SELECT -1 AS tree, level, i, n, digest FROM b),
s AS (SELECT x.tree, x.level, x.i, coalesce(string_agg(y.digest, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS before, coalesce(string_agg(y.digest, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS after
  FROM nodes x JOIN nodes y ON x.tree = y.tree AND x.level = y.level AND x.i // 16 = y.i // 16 WHERE x.n > 1 GROUP BY x.tree, x.level, x.i),
w AS (SELECT r, tree, 0 AS level, i, '' AS proof, coalesce(forged, leaf) AS now FROM t
  UNION ALL SELECT r, w.tree, w.level + 1, w.i // 16, proof || before || after, sha256(before || now || after) FROM w JOIN s ON w.tree = s.tree AND w.level = s.level AND w.i = s.i),
v AS (SELECT r, 0 AS level, arg_max(tree, level) AS i, arg_max(proof, level) AS proof, arg_max(now, level) AS now FROM w GROUP BY r
  UNION ALL SELECT r, v.level + 1, v.i // 16, proof || before || after, sha256(before || now || after) FROM v JOIN s ON s.tree = -1 AND v.level = s.level AND v.i = s.i),
z AS (SELECT r, arg_max(proof, level) AS proof, arg_max(now, level) AS now FROM v GROUP BY r)
SELECT doc_id, leaf, a.digest AS subroot, b.digest AS root, sha256(z.proof) AS proof_sha256, z.now AS folded_root, z.now = b.digest AS verified
FROM t JOIN z USING (r) JOIN a ON a.tree = t.tree AND a.n = 1 JOIN b ON b.n = 1""",
    "op13_exact_topk": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT r, vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM e),
p AS (SELECT q.r AS qr, q.vec_id AS query_id, o.r, o.vec_id, sum(q.x * o.x)::BIGINT AS score FROM c q JOIN c o ON q.i = o.i AND q.r <> o.r WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
}
