"""Statistics and information queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import information as I
from ..operators import stats as T
from ..operators.staging import staged
from .matrix import BARCODE_SQL, MATRIX_SQL, barcodes, matrix
from .registry import query, table

PAIR_SQL = f"""{BARCODE_SQL},
bx AS (SELECT DISTINCT barcode AS row FROM bc),
pr AS (SELECT i, j, substr(row, i + 1, 1) AS a, substr(row, j + 1, 1) AS b, count(*) AS n FROM bx, range(0, 60) u(i), range(0, 60) v(j) WHERE i < j AND j < length(row) GROUP BY ALL),
pc AS (SELECT *, sum(n) OVER (PARTITION BY i, j) AS t, sum(n) OVER (PARTITION BY i, j, a) AS na, sum(n) OVER (PARTITION BY i, j, b) AS nb FROM pr WHERE a <> '-' AND b <> '-'),
mi AS (SELECT i AS col_i, j AS col_j, sum(n)::BIGINT AS n, greatest(0, sum(n / t * log2(n * t / (na * nb)))) AS mi FROM pc GROUP BY ALL)"""


def _pairs(spark, sf_dir):
    """Pairs of window columns over distinct windows (dereplicated, as the method has it)."""
    m = staged(matrix(spark, sf_dir))
    distinct = barcodes(m.select("row"), m).select(F.col("barcode").alias("row")).distinct()
    return I.pair_information(distinct)


@query(f"WITH {PAIR_SQL} SELECT col_i, col_j, n, round(mi, 6) + 0.0 AS mi_bits FROM mi")
def mutual_information(spark, sf_dir):
    return _pairs(spark, sf_dir).select("col_i", "col_j", "n", (F.round("mi_bits", 6) + 0.0).alias("mi_bits"))


@query(f"""WITH {PAIR_SQL}, b AS (SELECT c, avg(mi) AS m FROM (SELECT col_i AS c, mi FROM mi UNION ALL SELECT col_j, mi FROM mi) GROUP BY c)
SELECT col_i, col_j, round(mi - x.m * y.m / (SELECT avg(mi) FROM mi), 6) + 0.0 AS mi_apc FROM mi JOIN b x ON x.c = col_i JOIN b y ON y.c = col_j""")
def mi_apc(spark, sf_dir):
    return I.average_product(_pairs(spark, sf_dir)).select("col_i", "col_j", (F.round("mi_apc", 6) + 0.0).alias("mi_apc"))


LABEL_SQL = f"""{MATRIX_SQL},
lc AS (SELECT pos, CASE WHEN contains('ACDEFGHIKLMNPQRSTVWY', residue) THEN residue ELSE '-' END AS a, lang AS b, sum(weight) AS m, count(*) AS k FROM lf GROUP BY ALL),
lw AS (SELECT *, sum(m) OVER (PARTITION BY pos) AS t, sum(m) OVER (PARTITION BY pos, a) AS ma, sum(m) OVER (PARTITION BY pos, b) AS mb, sum(k) OVER (PARTITION BY pos, a) AS ka, sum(k) OVER (PARTITION BY pos) AS kt FROM lc),
li AS (SELECT pos, greatest(0, sum(m / t * log2(m * t / (ma * mb)))) AS mi, -sum(k / kt * log2(ka / kt)) AS h FROM lw GROUP BY pos)"""


@query(f"WITH {LABEL_SQL} SELECT pos, round(mi, 6) AS mi_bits, round(h, 6) AS entropy_bits, round(mi - h * (SELECT avg(mi) FROM li) / (SELECT avg(h) FROM li), 6) + 0.0 AS corrected FROM li")
def label_information(spark, sf_dir):
    out = I.entropy_scaled(I.label_information(matrix(spark, sf_dir), "lang", copies="copies"))
    return out.select("pos", F.round("mi_bits", 6).alias("mi_bits"), F.round("entropy_bits", 6).alias("entropy_bits"), (F.round("corrected", 6) + 0.0).alias("corrected"))


@query(f"WITH {MATRIX_SQL} SELECT pos FROM lf GROUP BY pos HAVING avg((residue <> '-')::INT) >= 0.5 AND count(DISTINCT residue) > 1")
def varied_columns(spark, sf_dir):
    return I.varied_columns(matrix(spark, sf_dir), 0.5, copies="copies")


@query("""
WITH t AS (SELECT p_partkey AS id, p_brand AS grp, CASE WHEN p_size % 10 <> 0 THEN p_retailprice / 100000 END AS p FROM part),
r AS (SELECT *, p * count(p) OVER (PARTITION BY grp) / row_number() OVER (PARTITION BY grp, p IS NULL ORDER BY p, id) AS raw FROM t)
SELECT id, round(CASE WHEN p IS NOT NULL THEN least(1, min(raw) OVER (PARTITION BY grp, p IS NULL ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)) END, 9) AS q_bh FROM r""")
def bh_adjust(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.when(F.col("p_size") % 10 != 0, F.col("p_retailprice") / 100000).alias("p"))
    return T.bh_adjust(p, "p", ["id"], ["grp"]).select("id", F.round("q_bh", 9).alias("q_bh"))


@query("""
WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1000000 END AS p FROM orders), r AS (SELECT *, p * count(p) OVER () / row_number() OVER (PARTITION BY p IS NULL ORDER BY p, id) AS raw FROM t)
SELECT id, round(CASE WHEN p IS NOT NULL THEN least(1, min(raw) OVER (PARTITION BY p IS NULL ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)) END, 9) AS q_bh FROM r""")
def bh_adjust_whole(spark, sf_dir):
    """All orders are one family of tests."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice") / 1000000).alias("p"))
    return T.bh_adjust(p, "p", ["id"]).select("id", F.round("q_bh", 9).alias("q_bh"))


FISHER_SQL = """
c AS (SELECT c_mktsegment AS a, c_nationkey AS b, count(*) AS n11 FROM customer GROUP BY ALL),
m AS (SELECT *, (sum(n11) OVER (PARTITION BY a))::BIGINT AS r, (sum(n11) OVER (PARTITION BY b))::BIGINT AS k, (sum(n11) OVER ())::BIGINT AS n FROM c),
z AS (SELECT a, b, n11, r, k, n, unnest(range(n11, least(r, k) + 1)) AS i FROM m),
f AS (SELECT a, b, any_value(n11) AS n11, any_value(r) AS r, any_value(k) AS k, any_value(n) AS n, sum(exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1)
 - lgamma(i + 1) - lgamma(r - i + 1) - lgamma(k - i + 1) - lgamma(n - r - k + i + 1))) AS p FROM z GROUP BY a, b)"""


@query(f"WITH {FISHER_SQL} SELECT a, b, n11, round(CASE WHEN (r - n11) * (k - n11) > 0 THEN n11::DOUBLE * (n - r - k + n11) / ((r - n11) * (k - n11)) END, 6) AS odds_ratio, round(least(1, p), 6) AS p FROM f")
def fisher_enrichment(spark, sf_dir):
    cells = T.contingency(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("a"), F.col("c_nationkey").alias("b")), "a", "b")
    return T.fisher_greater(cells).select("a", "b", "n11", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("p", 6).alias("p"))


@query("""
WITH v AS (SELECT l_returnflag AS grp, l_quantity AS v, (l_discount > 0.05)::INT AS g FROM lineitem),
t AS (SELECT grp, v, count(*) AS t, sum(g) AS k FROM v GROUP BY ALL),
r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY grp ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM t),
s AS (SELECT grp, sum(k)::DOUBLE AS n1, sum(t)::DOUBLE AS n, sum(k * r.rank)::DOUBLE AS r1, sum(t::DOUBLE ** 3 - t) AS ties FROM r GROUP BY grp)
SELECT grp, n1::BIGINT AS n1, (n - n1)::BIGINT AS n2, round(r1 - n1 * (n1 + 1) / 2, 3) AS u,
 round((r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2 - 0.5) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z FROM s""")
def mann_whitney_u(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("v"), (F.col("l_discount") > 0.05).cast("int").alias("g"))
    out = T.mann_whitney(v, "g", "v", ["grp"])
    return out.select("grp", "n1", "n2", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


@query("""
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), a AS (SELECT sum(m * (m - 1) / 2) AS a FROM (SELECT sum(n) AS m FROM c GROUP BY lang)), b AS (SELECT sum(m * (m - 1) / 2) AS b FROM (SELECT sum(n) AS m FROM c GROUP BY source)),
i AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM c)
SELECT n::BIGINT AS n, round((i - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS adjusted_rand FROM i, a, b""")
def adjusted_rand(spark, sf_dir):
    cells = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return T.adjusted_rand(cells, "lang", "source").withColumn("adjusted_rand", F.round("adjusted_rand", 6))


@query("""SELECT o_custkey AS entity, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def crosstab(spark, sf_dir):
    return T.crosstab(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"]).toDF("entity", "f", "o", "p")


@query("""
WITH s AS (SELECT DISTINCT o_orderpriority AS name, o_custkey AS e FROM orders WHERE o_totalprice > 250000), names AS (SELECT unnest(['1-URGENT', '2-HIGH', '5-LOW', 'absent']) AS name),
p AS (SELECT a.name AS a, b.name AS b FROM names a, names b WHERE a.name <= b.name),
c AS (SELECT a, b, (SELECT count(*) FROM (SELECT e FROM s WHERE name = a INTERSECT SELECT e FROM s WHERE name = b)) AS shared, (SELECT count(*) FROM (SELECT e FROM s WHERE name = a UNION SELECT e FROM s WHERE name = b)) AS either FROM p)
SELECT a, b, shared, either, round(CASE WHEN either > 0 THEN shared / either END, 6) AS jaccard FROM c""")
def jaccard_concordance(spark, sf_dir):
    sets = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("e"))
    return T.jaccard_matrix(sets, "name", "e", ["1-URGENT", "2-HIGH", "5-LOW", "absent"]).withColumn("jaccard", F.round("jaccard", 6))


@query("""
SELECT o_custkey AS match_col, count(*) AS n_partitions, string_agg(o_orderpriority, ',' ORDER BY o_orderpriority) AS partitions FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 300000) GROUP BY 1""")
def replication(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("match_col"), F.col("o_orderpriority").alias("partition"), (F.col("o_totalprice") > 300000).alias("significant"))
    return I.replication(calls.where("significant").distinct())


@query("""
WITH p AS (SELECT 'lang' AS partition, doc_id AS seq_id, lang AS label FROM documents UNION ALL SELECT 'source', doc_id, source FROM documents WHERE n_chars > 300 UNION ALL SELECT 'single', doc_id, 'one' FROM documents),
s AS (SELECT partition, label, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 20),
k AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY n DESC, label) AS k FROM s),
w AS (SELECT partition, label FROM k WHERE k <= 8 QUALIFY count(*) OVER (PARTITION BY partition) >= 2 AND sum(n) OVER (PARTITION BY partition) >= 30)
SELECT p.partition, seq_id, p.label FROM p JOIN w ON p.partition = w.partition AND p.label = w.label""")
def label_partitions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), "lang", "source", "n_chars")
    parts = {"lang": d.withColumn("label", F.col("lang")), "source": d.where("n_chars > 300").withColumn("label", F.col("source")), "single": d.withColumn("label", F.lit("one"))}
    return I.partitions(parts, "seq_id", 20, 8)


@query(f"""
WITH p AS (SELECT p_partkey AS id, p_retailprice > (SELECT avg(p_retailprice) FROM part) AS called, p_size <= 10 AS small, p_brand = (SELECT min(p_brand) FROM part) AS first_brand FROM part),
c AS (SELECT 'small' AS region, count(*) FILTER (called AND small) AS a, count(*) FILTER (called) AS r, count(*) FILTER (small) AS k, count(*) AS n FROM p UNION ALL SELECT 'first_brand', count(*) FILTER (called AND first_brand), count(*) FILTER (called), count(*) FILTER (first_brand), count(*) FROM p),
z AS (SELECT *, unnest(range(a, least(r, k) + 1)) AS i FROM c)
SELECT region, a AS n11, round(CASE WHEN any_value((r - a) * (k - a)) > 0 THEN any_value(a::DOUBLE * (n - r - k + a) / ((r - a) * (k - a))) END, 6) AS odds_ratio,
 round(least(1, sum(exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) - lgamma(i + 1) - lgamma(r - i + 1) - lgamma(k - i + 1) - lgamma(n - r - k + i + 1)))), 6) AS p FROM z GROUP BY region, a""")
def region_enrichment(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    one = p.agg(F.avg("p_retailprice").alias("_m"), F.min("p_brand").alias("_b"))
    flags = p.crossJoin(F.broadcast(one)).select((F.col("p_retailprice") > F.col("_m")).alias("called"), (F.col("p_size") <= 10).alias("small"), (F.col("p_brand") == F.col("_b")).alias("first_brand"))
    out = T.region_enrichment(flags, "called", ["small", "first_brand"])
    return out.select("region", "n11", F.round("odds_ratio", 6).alias("odds_ratio"), F.round("p", 6).alias("p"))


WINDOW_SQL = f"""{BARCODE_SQL},
bs AS (SELECT barcode, source, round(sum(weight), 6) AS weight FROM bc GROUP BY ALL),
wn AS (SELECT barcode AS row, arg_max(source, (weight, source)) AS label, sum(weight) AS weight FROM bs GROUP BY barcode)"""


def _windows(spark, sf_dir):
    """Distinct windows, each with its most common source and the weight of its rows; a clade is a window's
    first two letters."""
    m = staged(matrix(spark, sf_dir))
    b = barcodes(m.select("row", "source", "weight"), m).groupBy("barcode", "source").agg(F.round(F.sum("weight"), 6).alias("weight"))
    one = b.groupBy(F.col("barcode").alias("row")).agg(F.max_by("source", F.struct("weight", "source")).alias("label"), F.sum("weight").alias("weight"))
    return one.withColumn("clade", F.substring("row", 1, 2))


def _coupling(spark, sf_dir, replicates):
    return I.coupling_null(staged(_windows(spark, sf_dir).select("row")), replicates=replicates)


@query()
def coupling_permutation(spark, sf_dir):
    return T.bh_adjust(_coupling(spark, sf_dir, 100), "p", ["col_i", "col_j"]).withColumn("significant", F.col("q_bh") < 0.05)


@query(f"""WITH {PAIR_SQL}, b AS (SELECT c, avg(mi) AS m FROM (SELECT col_i AS c, mi FROM mi UNION ALL SELECT col_j, mi FROM mi) GROUP BY c)
SELECT col_i, col_j, round(mi, 6) + 0.0 AS mi_bits, round(mi - x.m * y.m / (SELECT avg(mi) FROM mi), 6) + 0.0 AS mi_apc, true AS tail_is_share FROM mi JOIN b x ON x.c = col_i JOIN b y ON y.c = col_j""")
def coupling_observed(spark, sf_dir):
    """What the null is held against, and that each tail is a share of replicates or of a distribution."""
    out = _coupling(spark, sf_dir, 20)
    share = (F.col("p_empirical") >= F.lit(1 / 21) - 1e-12) & (F.col("p_empirical") <= 1) & (F.col("p") > 0) & (F.col("p") <= 1)
    return out.select("col_i", "col_j", (F.round("mi_bits", 6) + 0.0).alias("mi_bits"), (F.round("mi_apc", 6) + 0.0).alias("mi_apc"), share.alias("tail_is_share"))


@query()
def sdp_within_clade(spark, sf_dir):
    out = I.label_null(staged(_windows(spark, sf_dir)), replicates=100)
    return T.bh_adjust(out, "p", ["match_col"]).withColumn("significant", F.col("q_bh") < 0.05)


@query(f"""WITH {WINDOW_SQL},
lf2 AS (SELECT pos, CASE WHEN contains('ACDEFGHIKLMNPQRSTVWY', substr(row, pos + 1, 1)) THEN substr(row, pos + 1, 1) ELSE '-' END AS a, label AS b, weight FROM wn, range(0, 60) t(pos) WHERE pos < length(row)),
lc AS (SELECT pos, a, b, sum(weight) AS m, count(*) AS k FROM lf2 GROUP BY ALL),
lw AS (SELECT *, sum(m) OVER (PARTITION BY pos) AS t, sum(m) OVER (PARTITION BY pos, a) AS ma, sum(m) OVER (PARTITION BY pos, b) AS mb, sum(k) OVER (PARTITION BY pos, a) AS ka, sum(k) OVER (PARTITION BY pos) AS kt FROM lc),
li AS (SELECT pos, greatest(0, sum(m / t * log2(m * t / (ma * mb)))) AS mi, -sum(k / kt * log2(ka / kt)) AS h FROM lw GROUP BY pos),
md AS (SELECT CASE WHEN sum(n) FILTER (n > 1) * 2 >= sum(n) THEN 'within_clade' ELSE 'global_fallback' END AS mode FROM (SELECT row[1:2], count(*) AS n FROM wn GROUP BY 1))
SELECT pos AS match_col, round(mi - h * (SELECT avg(mi) FROM li) / (SELECT avg(h) FROM li), 6) + 0.0 AS mi_bits, mode AS null_mode FROM li, md""")
def sdp_observed(spark, sf_dir):
    """What the null is held against, and how labels are permuted."""
    return I.label_null(staged(_windows(spark, sf_dir)), replicates=20).select("match_col", (F.round("mi_bits", 6) + 0.0).alias("mi_bits"), "null_mode")
