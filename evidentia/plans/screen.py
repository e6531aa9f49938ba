"""Evidence queries.  Match rows are ``lineitem``: sample = l_suppkey, protein = l_partkey % 10,
profile = l_returnflag (``R`` is the specific one), domain score = l_extendedprice, full
score = l_quantity.  The sample table is ``supplier`` with its place in the world as lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evidence as E
from ..operators import joins as J
from .registry import query, spread, table

MATCHES = """
m AS (SELECT l_suppkey AS sample, l_partkey % 10 AS protein, l_returnflag AS profile, l_extendedprice AS dom_score,
  l_quantity AS full_score, l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem)"""
TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def matches(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 10).alias("protein"), F.col("l_returnflag").alias("profile"),
        F.col("l_extendedprice").alias("dom_score"), F.col("l_quantity").alias("full_score"), *TIES, "l_discount", "l_tax",
    )


@query(f"""
WITH {MATCHES}
SELECT sample, protein, profile, dom_score, full_score, n_matches, coverage FROM (
 SELECT *, count(*) OVER (PARTITION BY sample, protein, profile) AS n_matches,
  round(((l_linenumber + full_score - l_linenumber + 1) / 51.0)::FLOAT::DOUBLE, 5) AS coverage,
  row_number() OVER (PARTITION BY sample, protein, profile ORDER BY dom_score DESC, l_orderkey, l_linenumber, l_partkey, l_shipdate) AS k FROM m)
WHERE k = 1 AND coverage >= 0.1""")
def best_match_per_item(spark, sf_dir):
    rows = matches(spark, sf_dir)
    best = E.best_match(rows, ["sample", "protein", "profile"], "dom_score", TIES)
    cover = S.profile_coverage(F.col("l_linenumber"), F.col("l_linenumber") + F.col("full_score"), F.lit(51.0))
    best = best.withColumn("coverage", F.round(cover.cast("double"), 5)).where("coverage >= 0.1")
    return best.select("sample", "protein", "profile", "dom_score", "full_score", "n_matches", "coverage")


TIERS = f"""
{MATCHES},
h AS (SELECT sample, protein, profile FROM m WHERE full_score >= 35 AND dom_score >= 20000),
t AS (SELECT sample, protein, string_agg(DISTINCT profile, ',' ORDER BY profile) AS profiles_hit, count(DISTINCT profile) AS n_profiles_hit FROM h GROUP BY ALL)"""


def tiers(spark, sf_dir):
    rows = matches(spark, sf_dir).where("full_score >= 35 and dom_score >= 20000")
    sets = E.profile_sets(rows, ["sample", "protein"], "profile")
    return sets.withColumn("evidence", E.tier(F.col("profiles_hit"), "R"))


@query(f"""
WITH {TIERS}
SELECT *, CASE WHEN list_contains(string_split(profiles_hit, ','), 'R') THEN 'specific' ELSE 'ssf_only' END AS evidence FROM t""")
def evidence_tiering(spark, sf_dir):
    return tiers(spark, sf_dir)


@query(f"""
WITH {TIERS}
SELECT unnest(['match_rows', 'items', 'samples', 'specific_items', 'family_items', 'samples_specific', 'all_profiles']) AS metric,
 unnest([(SELECT count(*) FROM h), count(*), count(DISTINCT sample), count(*) FILTER (list_contains(string_split(profiles_hit, ','), 'R')),
  count(*) FILTER (list_has_any(string_split(profiles_hit, ','), ['A', 'R'])), count(DISTINCT sample) FILTER (list_contains(string_split(profiles_hit, ','), 'R')),
  count(*) FILTER (n_profiles_hit = 3)]) AS value FROM t""")
def screening_funnel(spark, sf_dir):
    items = tiers(spark, sf_dir).withColumn("_rows", F.lit(0))
    specific = F.col("evidence") == "specific"
    counts = items.agg(
        F.count("*").alias("items"), F.count_distinct("sample").alias("samples"), F.count_if(specific).alias("specific_items"),
        F.count_if(E.in_family(F.col("profiles_hit"), ["A", "R"])).alias("family_items"), F.count_distinct(F.when(specific, F.col("sample"))).alias("samples_specific"),
        F.count_if(F.col("n_profiles_hit") == 3).alias("all_profiles"),
    )
    rows = matches(spark, sf_dir).where("full_score >= 35 and dom_score >= 20000").agg(F.count("*").alias("match_rows"))
    return E.key_values(rows.crossJoin(counts))


BIGRAMS = ("TH", "HE", "AN", "ER", "IN", "ON", "RE", "QU", "CH", "SC")


def bigram_score(s):
    """Occurrences of ordered letter pairs: a score that a reversed sequence does not keep."""
    return sum((F.floor((F.length(s) - F.length(F.replace(s, F.lit(b), F.lit("")))) / 2) for b in BIGRAMS[1:]), F.floor((F.length(s) - F.length(F.replace(s, F.lit(BIGRAMS[0]), F.lit("")))) / 2))


_SQL_SCORE = " + ".join(f"(length(s) - length(replace(s, '{b}', ''))) // 2" for b in BIGRAMS)
CLEAN_SQL = "nullif(regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWYBZXUO]', '', 'g'), '')"


@query(f"""
WITH q AS (SELECT doc_id, lang AS profile, {CLEAN_SQL} AS s FROM documents),
b AS (SELECT profile, 0 AS decoy, s FROM q WHERE s IS NOT NULL UNION ALL SELECT profile, 1, reverse(s) FROM q WHERE s IS NOT NULL),
v AS (SELECT profile, decoy, ({_SQL_SCORE})::DOUBLE AS score FROM b),
e AS (SELECT profile, floor(min(score)) AS lo, ceil(quantile_cont(score, 0.995) FILTER (decoy = 0)) AS hi FROM v GROUP BY profile),
g AS (SELECT profile, lo + k * ((hi - lo) / 59) AS bit_score FROM e, range(0, 60) t(k)),
c AS (SELECT g.profile, bit_score, count(*) FILTER (decoy = 0 AND score >= bit_score) AS n_target, count(*) FILTER (decoy = 1 AND score >= bit_score) AS n_decoy
  FROM g JOIN v ON g.profile = v.profile GROUP BY ALL)
SELECT profile, round(bit_score, 6) AS bit_score, n_target, n_decoy, CASE WHEN n_target > 0 THEN round(n_decoy / n_target, 6) END AS fdr FROM c""")
def decoy_fdr_curve(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("lang", "text")).where(S.has_sequence(F.col("text")))
    seqs = docs.select(F.col("lang").alias("profile"), S.clean_sequence(F.col("text")).alias("s"))
    # one scan makes both the sequence and its reversal; a generated column is computed once
    both = seqs.select("profile", F.posexplode(F.array("s", F.reverse("s"))).alias("decoy", "s"))
    both = both.select("profile", "decoy", bigram_score(F.col("s")).cast("double").alias("score"))
    curve = E.empirical_fdr(both)
    return curve.select("profile", F.round("bit_score", 6).alias("bit_score"), "n_target", "n_decoy", F.round("fdr", 6).alias("fdr"))


@query("""
SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS matched, c_mktsegment, c_acctbal, n.n_name AS nation
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n_nationkey""")
def validated_left_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal", "c_nationkey")
    out = J.left_many_to_one(orders, customers, ["o_custkey"], indicator="matched")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return J.lookup(out, nations, "c_nationkey", "nation").select("o_orderkey", "o_custkey", "o_orderstatus", "matched", "c_mktsegment", "c_acctbal", "nation")


@query("""
SELECT c_custkey AS id, CASE WHEN k.o_custkey IS NULL THEN 0 ELSE 1 END AS has_urgent FROM customer
LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000) k ON k.o_custkey = c_custkey""")
def semi_flags(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.col("o_custkey").alias("id"))
    return J.flagged(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), urgent, ["id"], "has_urgent")


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 150000)""")
def anti_missing(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return J.missing(table(spark, sf_dir, "customer"), seen, ["c_custkey"]).select("c_custkey", "c_name")


@query("""
WITH g AS (SELECT l_returnflag AS profile, least(width_bucket_ , 21) AS bucket FROM (SELECT l_returnflag, CASE WHEN l_extendedprice < 0 THEN 0 WHEN l_extendedprice >= 100000 THEN 21 ELSE floor(l_extendedprice / 5000)::BIGINT + 1 END AS width_bucket_ FROM lineitem))
SELECT profile, bucket, count(*) AS n FROM g GROUP BY ALL""")
def score_histogram(spark, sf_dir):
    rows = matches(spark, sf_dir).select("profile", "dom_score")
    return E.histogram(rows, "dom_score", 0.0, 100000.0, 20, ["profile"])


@query("""
SELECT c_mktsegment, c_custkey, round(1 - (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1) / count(*) OVER (PARTITION BY c_mktsegment), 9) AS survival FROM customer""")
def survival_curve(spark, sf_dir):
    rows = E.survival(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal", ["c_custkey"])
    return rows.select("c_mktsegment", "c_custkey", F.round("survival", 9).alias("survival"))


@query(f"""
WITH {MATCHES}, p AS (SELECT sample, protein, max(dom_score) FILTER (profile = 'A') AS a, max(dom_score) FILTER (profile = 'N') AS n, max(dom_score) FILTER (profile = 'R') AS r FROM m WHERE full_score >= 45 GROUP BY ALL)
SELECT (a IS NOT NULL)::INT AS has_a, (n IS NOT NULL)::INT AS has_n, (r IS NOT NULL)::INT AS has_r, count(*) AS n_items, round(corr(a, r), 6) AS r_ar FROM p GROUP BY 1, 2, 3""")
def profile_overlap(spark, sf_dir):
    rows = matches(spark, sf_dir).where("full_score >= 45")
    wide = rows.groupBy("sample", "protein").pivot("profile", ["A", "N", "R"]).agg(F.max("dom_score"))
    flags = [F.col(c).isNotNull().cast("int").alias(f"has_{c.lower()}") for c in "ANR"]
    # where a profile is absent its column is null throughout, and so is the correlation
    out = wide.groupBy(*flags).agg(F.count("*").alias("n_items"), F.corr("A", "R").alias("_c"), F.count_if(F.col("A").isNotNull() & F.col("R").isNotNull()).alias("_n"))
    return out.select("has_a", "has_n", "has_r", "n_items", F.round(F.when(F.col("_n") > 1, F.nullif("_c", F.lit(float("nan")))), 6).alias("r_ar"))


@query("""
WITH h AS (SELECT o_custkey, count(*) AS copies FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
SELECT n_name AS nation, count(*) AS n_entities, count(h.o_custkey) AS n_with, round(count(h.o_custkey) / count(*), 6) AS prevalence, coalesce(sum(copies), 0)::BIGINT AS n_copies, coalesce(max(copies), 0) AS max_copies
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN h ON h.o_custkey = c_custkey GROUP BY 1""")
def prevalence(spark, sf_dir):
    hits = table(spark, sf_dir, "orders").where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("copies"))
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(hits, "c_custkey", "left")
    # aggregate by key first, so names join a row per nation
    per = base.groupBy("c_nationkey").agg(F.count("*").alias("n_entities"), F.count("copies").alias("n_with"), F.sum("copies").alias("n_copies"), F.max("copies").alias("max_copies"))
    named = per.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy(F.col("n_name").alias("nation")).agg(
        F.sum("n_entities").alias("n_entities"), F.sum("n_with").alias("n_with"), F.round(F.sum("n_with") / F.sum("n_entities"), 6).alias("prevalence"),
        F.coalesce(F.sum("n_copies"), F.lit(0)).alias("n_copies"), F.coalesce(F.max("max_copies"), F.lit(0)).alias("max_copies"),
    )


@query(f"""
WITH q AS (SELECT doc_id, {CLEAN_SQL} AS s FROM documents), g AS (SELECT s, count(*) AS n, min(doc_id) AS rep FROM q WHERE s IS NOT NULL GROUP BY s)
SELECT doc_id AS seq_id, rep AS representative, n AS cluster_size, round(1 / n, 8) AS weight FROM q JOIN g USING (s)""")
def redundancy_weights(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(S.has_sequence(F.col("text")))
    seqs = docs.select(F.col("doc_id").alias("seq_id"), F.sha2(S.clean_sequence(F.col("text")), 256).alias("s"))
    groups = seqs.groupBy("s").agg(F.count("*").alias("cluster_size"), F.min("seq_id").alias("representative"))
    return seqs.join(groups, "s").select("seq_id", "representative", "cluster_size", F.round(1 / F.col("cluster_size"), 8).alias("weight"))


@query("""
SELECT l_suppkey AS sample, threshold, count(*) FILTER (l_quantity >= threshold) AS n FROM lineitem, (SELECT unnest([1.0, 10.0, 20.0, 30.0, 40.0, 50.0]::DOUBLE[]) AS threshold) GROUP BY ALL""")
def threshold_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), "l_quantity")
    return J.threshold_counts(rows, "l_quantity", F.array(*[F.lit(float(t)) for t in (1, 10, 20, 30, 40, 50)]), ["sample"])


@query("""
WITH r AS (SELECT r_name AS dom, n_name AS taxon, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, taxon) AS k FROM (SELECT taxon, sum(n) AS n FROM r GROUP BY taxon)),
l AS (SELECT r.dom, CASE WHEN k.k <= 8 THEN r.taxon ELSE 'Other' END AS taxon, r.n FROM r JOIN k ON k.taxon = r.taxon)
SELECT dom, taxon, sum(n)::BIGINT AS n, round(sum(n) / sum(sum(n)) OVER (PARTITION BY dom), 6) AS share FROM l GROUP BY dom, taxon""")
def taxonomy_composition(spark, sf_dir):
    from pyspark.sql import Window as W

    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    named = per.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ranked = named.groupBy("n_name").agg(F.sum("n").alias("t")).withColumn("k", F.row_number().over(W.orderBy(F.col("t").desc(), "n_name")))
    lab = named.join(ranked, "n_name").select(F.col("r_name").alias("dom"), F.when(F.col("k") <= 8, F.col("n_name")).otherwise("Other").alias("taxon"), "n")
    out = lab.groupBy("dom", "taxon").agg(F.sum("n").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("dom")), 6))


@query("""
SELECT l_returnflag AS profile, count(*) AS n, round(quantile_cont(l_quantity::DOUBLE, 0.25), 6) AS q1, round(quantile_cont(l_quantity::DOUBLE, 0.5), 6) AS median, round(quantile_cont(l_quantity::DOUBLE, 0.75), 6) AS q3, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1""")
def coverage_length(spark, sf_dir):
    q = lambda p, name: F.round(F.percentile("full_score", F.lit(p)), 6).alias(name)
    return matches(spark, sf_dir).groupBy("profile").agg(F.count("*").alias("n"), q(0.25, "q1"), q(0.5, "median"), q(0.75, "q3"), F.round(F.avg("full_score"), 6).alias("mean"))
