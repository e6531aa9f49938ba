"""Lookup, guard, selection and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import density as E
from ..operators import guards as V
from ..operators import models as M
from ..operators import reference_data as R
from ..operators import vectors as D
from .registry import query, table

SPECIES = ["s__Methanobrevibacter ruminantium", "s__Methanobrevibacter smithii", "s__Methanobrevibacter oralis", "s__Methanobacterium congolense", "s__Methanospirillum hungatei", "s__Methanopyrus kandleri", "s__Escherichia coli", "s__Methanobacterium formicicum", None]
_CHEM = ", ".join(f"({', '.join(R.literal(v).replace('cast(null as string)', 'NULL') for v in r)})" for r in R.CHEMISTRY)
CHAIN_SQL = f"""
chem(sp, p1, p1p, lv) AS (VALUES {_CHEM}), gen AS (SELECT 'g__' || string_split(sp[4:], ' ')[1] AS g, count(DISTINCT p1 || p1p) AS kinds, min(p1) AS g1, min(p1p) AS g1p FROM chem GROUP BY 1),
e AS (SELECT c_custkey AS id, [{', '.join(R.literal(s).replace('cast(null as string)', 'NULL') for s in SPECIES)}][c_custkey % 9 + 1] AS species, CASE WHEN c_custkey % 13 = 0 THEN 'glycoprotein' ELSE 'pseudomurein' END AS wall FROM customer),
k AS (SELECT e.*, chem.p1 AS o1, chem.p1p AS o1p, lv, kinds, g1, g1p, CASE WHEN species IS NULL THEN 'none' WHEN species LIKE '%hungat%' THEN 'literature_species' WHEN species IN ('s__Methanosphaera stadtmanae', 's__Methanopyrus kandleri') THEN 'disputed' WHEN chem.sp IS NOT NULL THEN 'literature_' || lv
 WHEN kinds = 1 THEN 'literature_genus_homogeneous' WHEN kinds > 1 THEN 'genus_heterogeneous' ELSE 'none' END AS p1_source FROM e LEFT JOIN chem ON sp = species LEFT JOIN gen ON g = 'g__' || string_split(species[4:], ' ')[1]),
v AS (SELECT id, wall, p1_source, CASE WHEN species LIKE '%hungat%' THEN 'no_pseudomurein' WHEN p1_source = 'disputed' THEN 'unsupported' WHEN p1_source = 'literature_genus_homogeneous' THEN g1 ELSE coalesce(o1, 'unknown') END AS p1,
 CASE WHEN species LIKE '%hungat%' THEN 'no_pseudomurein' WHEN p1_source = 'disputed' THEN 'unsupported' WHEN p1_source = 'literature_genus_homogeneous' THEN g1p ELSE coalesce(o1p, 'unknown') END AS p1_prime FROM k)"""


@query(f"WITH {CHAIN_SQL} SELECT id, p1, p1_prime, p1_source, CASE WHEN wall = 'glycoprotein' THEN 'not_lysed' WHEN p1 IN ('Ala', 'Ser') THEN 'lysed' WHEN p1 = 'Thr' THEN 'not_lysed' ELSE 'unknown' END AS predicted FROM v")
def lookup_chain(spark, sf_dir):
    names = F.array(*[F.lit(s) for s in SPECIES])
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.get(names, (F.col("c_custkey") % 9).cast("int")).alias("species"), F.when(F.col("c_custkey") % 13 == 0, "glycoprotein").otherwise("pseudomurein").alias("wall"))
    out = R.wall_chemistry(c)
    return out.select("id", "p1", "p1_prime", "p1_source", R.predict_lysis(F.col("p1"), F.col("wall")).alias("predicted"))


_PANEL = ", ".join("(" + ", ".join(R.literal(v).replace("cast(null as string)", "NULL") for v in r) + ")" for r in R.PANEL)


@query(f"""
WITH p(strain, species, wall, w, p, ok) AS (VALUES {_PANEL}), l AS (SELECT strain, species, wall, unnest(['PeiW', 'PeiP']) AS enzyme, unnest([w, p]) AS observed FROM p WHERE ok),
d AS (SELECT *, CASE WHEN wall <> 'pseudomurein' THEN 'not_lysed' WHEN species LIKE '%thermautotrophicus' THEN 'lysed' WHEN species LIKE '%ruminantium' THEN 'not_lysed' ELSE 'unknown' END AS predicted FROM l)
SELECT strain, enzyme, wall, observed, predicted, CASE WHEN predicted <> 'unknown' THEN predicted = observed END AS agrees, wall = 'pseudomurein' AS nontrivial FROM d""")
def rule_vs_measured(spark, sf_dir):
    return R.rule_vs_measured(spark).select("strain", "enzyme", "wall", "observed", "predicted", "agrees", "nontrivial")


@query("""
WITH r AS (SELECT p_partkey AS id, upper(p_brand[6:6]) AS x, 'VTSA'[p_partkey % 4 + 1] AS a, 'CVIMW'[p_size % 5 + 1] AS b FROM part)
SELECT id, CASE WHEN a = 'V' AND b = 'C' THEN 'I' WHEN a = 'V' AND b = 'V' THEN 'II' WHEN a IN ('T', 'S') AND b = 'I' THEN 'III' WHEN a = 'A' AND b IN ('M', 'W') THEN 'IV' ELSE 'unassigned' END AS cls FROM r""")
def residue_class(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = F.substring(F.lit("VTSA"), (F.col("p_partkey") % 4).cast("int") + 1, F.lit(1))
    b = F.substring(F.lit("CVIMW"), (F.col("p_size") % 5).cast("int") + 1, F.lit(1))
    return p.select(F.col("p_partkey").alias("id"), R.residue_class(a, b).alias("cls"))


@query("""
WITH c AS (SELECT c_custkey AS id, upper(regexp_replace(c_name || c_mktsegment, '[^A-Za-z]', '', 'g')) AS s FROM customer), h AS (SELECT id, s, unnest(range(1, length(s) + 1)) AS i FROM c)
SELECT id, count(*) FILTER (s[i] = 'E' AND i > 1) AS n_later, count(*) FILTER (s[i] = 'E' AND i > 1 AND abs(i - 1 - 6) <= 2) AS n_admitted FROM h GROUP BY id""")
def spacing_candidates(spark, sf_dir):
    s = F.upper(F.regexp_replace(F.concat("c_name", "c_mktsegment"), "[^A-Za-z]", ""))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), s.alias("s"))
    return c.select("id", F.size(R.spacing_candidates(F.col("s"), F.lit(1), "E")).cast("long").alias("n_later"), F.size(R.spacing_candidates(F.col("s"), F.lit(1), "E", 6, 2)).cast("long").alias("n_admitted"))


@query("""
WITH o AS (SELECT count(*) AS n, count(*) - count(DISTINCT o_custkey) AS d FROM orders), c AS (SELECT count(*) AS n FROM customer), p AS (SELECT count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS k FROM customer),
v AS (SELECT count(*) AS n, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)) AS k FROM customer)
SELECT 'OK' AS level, 'customer: unique key' AS "check", '0 of ' || n || ' rows repeat a key' AS detail FROM c UNION ALL SELECT 'OK', 'customer: null key', '0 of ' || n || ' rows have no key' FROM c UNION ALL SELECT 'OK', 'customer: white space', '0 of ' || n || ' rows have white space in the key' FROM c
UNION ALL SELECT CASE WHEN d > 0 THEN 'ERROR' ELSE 'OK' END, 'orders: unique key', d || ' of ' || n || ' rows repeat a key' FROM o UNION ALL SELECT 'OK', 'orders: null key', '0 of ' || n || ' rows have no key' FROM o UNION ALL SELECT 'OK', 'orders: white space', '0 of ' || n || ' rows have white space in the key' FROM o
UNION ALL SELECT 'OK', 'customer: c_name', n || ' of ' || n || ' rows have a value' FROM c UNION ALL SELECT CASE WHEN k < 0.5 * n THEN 'WARN' ELSE 'OK' END, 'customer: balance', k || ' of ' || n || ' rows have a value' FROM p
UNION ALL SELECT CASE WHEN k < 0.5 * n THEN 'ERROR' ELSE 'OK' END, 'orders: key overlap', k || ' of ' || n || ' keys found' FROM v""")
def preflight_report(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    parts = [
        V.table_checks(c, "c_custkey", "customer"), V.table_checks(o, "o_custkey", "orders"),
        V.completeness(c.withColumn("balance", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal"))), ["c_name", "balance"], "customer"),
        V.overlap(c, "c_custkey", o.where("o_totalprice > 400000"), "o_custkey", "orders", 0.5),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query()
def spherical_kmeans(spark, sf_dir):
    e = C.normalised(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding")
    return C.spherical_kmeans(e, 5).transform(e).select("vec_id", "cluster")


def _unit(spark, sf_dir):
    return C.normalised(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), "embedding")


@query()
def k_sweep(spark, sf_dir):
    """Four scores for each k, and the k that the gap statistic takes."""
    e = _unit(spark, sf_dir)
    k, gaps = C.gap_statistic(e, 1, 4, references=2)
    gap = spark.createDataFrame([(int(r.k), float(r.gap), float(r.se)) for r in gaps.itertuples()], "k int, gap double, gap_se double")
    return C.k_sweep(e, 2, 4).join(F.broadcast(gap), "k").withColumn("k_gap_statistic", F.lit(k))


@query()
def pca_parallel(spark, sf_dir):
    """As many components as pass parallel analysis."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    k, seen, bars = D.parallel_analysis(e, "vec_id", "embedding")
    out, variance = C.pca(e, "embedding", k)
    at = lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in v[:k]]), F.col("component") + 1)
    return out.select("vec_id", F.posexplode("pc").alias("component", "value")).withColumns({"explained": at(variance), "variance": at(seen), "bar": at(bars)})


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT a.vec_id AS id, sqrt(greatest(0, round(list_dot_product(a.v, a.v) + list_dot_product(b.v, b.v) - 2 * list_dot_product(a.v, b.v), 10))) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id),
r AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM d)
SELECT id, round(max(d) FILTER (k <= 4), 6) AS core, round(max(d) FILTER (k <= 10), 6) AS radius FROM r GROUP BY id""")
def core_distance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = E.core_distances(D.neighbours(e, "vec_id", "embedding", 10), 5)
    return out.select("id", F.round("core", 6).alias("core"), F.round("radius", 6).alias("radius"))


@query()
def density_clusters(spark, sf_dir):
    return E.density_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)


@query()
def logit_glm(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"))
    d = c.join(o, "c_custkey", "left").select((F.col("c_acctbal") < 0).cast("int").alias("y"), F.log10(1 + F.coalesce("n_orders", F.lit(0.0))).alias("orders"), F.log10(F.coalesce("mean_price", F.lit(1.0))).alias("price"))
    return M.logit_glm(d, "y", ["orders", "price"])


@query("""
WITH f AS (SELECT l_returnflag AS term, l_linenumber AS r, avg(l_quantity) AS e, stddev_samp(l_quantity) / sqrt(count(*)) AS s FROM lineitem GROUP BY ALL),
g AS (SELECT term, count(*) AS m, avg(e) AS e, avg(s * s) AS w, var_samp(e) AS b FROM f GROUP BY term)
SELECT term, m, round(e, 6) AS estimate, round(sqrt(w + (1 + 1 / m) * b), 6) AS se, round((m - 1) * (1 + w / ((1 + 1 / m) * b)) ** 2, 3) AS df, round((1 + 1 / m) * b / (w + (1 + 1 / m) * b), 6) AS fmi FROM g""")
def rubin_pool(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    fits = li.groupBy(F.col("l_returnflag").alias("term"), F.col("l_linenumber").alias("replicate")).agg(F.avg("l_quantity").alias("estimate"), (F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("se"))
    out = M.rubin_pool(fits)
    return out.select("term", "m", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"), F.round("df", 3).alias("df"), F.round("fmi", 6).alias("fmi"))


@query("SELECT c_nationkey AS grp, count(*) AS n, sum((c_acctbal < -900)::INT)::BIGINT AS n_positive FROM customer GROUP BY 1 HAVING sum((c_acctbal < -900)::INT) = 0 OR sum((c_acctbal < -900)::INT) = count(*)")
def separation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("grp"), (F.col("c_acctbal") < -900).cast("int").alias("y"))
    return M.separated(c, "grp", "y")
