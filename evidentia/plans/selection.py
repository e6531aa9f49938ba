"""Learned scores, embeddings, selection and fits whose answers SQL has in closed form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.alphabet import RESIDUES
from ..functions.symbols import places
from ..operators import alignment as A
from ..operators import cluster as C
from ..operators import graph as G
from ..operators import guards as V
from ..operators import joins as J
from ..operators import models as M
from ..operators import stats as T
from ..operators.staging import staged
from .matrix import GAPS, LENGTH, MATRIX_SQL, PENALTY, TOLERANCE, TRIPLE_SQL, matrix, rows, scored_triples, stats_of
from .networks import GRAM_SQL, part_names
from .registry import query, table

SCORE_SQL = f"""{MATRIX_SQL},
sn AS (SELECT pos, residue AS a, count(*)::DOUBLE AS n FROM lf WHERE contains('{RESIDUES}', residue) GROUP BY ALL),
sq AS (SELECT x.a AS a, y.a AS b, sum(x.n * CASE WHEN x.a = y.a THEN x.n - 1 ELSE y.n END) AS q FROM sn x JOIN sn y USING (pos) GROUP BY ALL),
sh AS (SELECT a, sum(q) / (SELECT sum(q) FROM sq) AS s FROM sq GROUP BY a),
al AS (SELECT substr('{RESIDUES}', i, 1) AS a, i - 1 AS k FROM range(1, 21) t(i)),
sc AS (SELECT x.a AS a, y.a AS b, y.k AS k, CASE WHEN q > 0 THEN log2(q / (SELECT sum(q) FROM sq) / (u.s * v.s)) ELSE 0.0 END AS score
 FROM al x CROSS JOIN al y LEFT JOIN sq ON sq.a = x.a AND sq.b = y.a LEFT JOIN sh u ON u.a = x.a LEFT JOIN sh v ON v.a = y.a)"""


def _scores(r: DataFrame) -> dict[str, list[float]]:
    return C.log_odds(A.counted(r, [], {"n": None}), RESIDUES)


@query(f"WITH {SCORE_SQL} SELECT a, b, round(score, 6) + 0.0 AS score FROM sc")
def substitution_scores(spark, sf_dir):
    """A substitution matrix from the columns of all rows."""
    scores = [(a, b, x) for a, v in _scores(rows(spark, sf_dir)).items() for b, x in zip(RESIDUES, v, strict=True)]
    return spark.createDataFrame(scores, "a string, b string, score double").withColumn("score", F.round("score", 6) + 0.0)


def _digest(values: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
    """How wide each vector is, and a sum in which each of its places has a weight of 1 to 7."""
    _, row, at = places(length)
    return {"width": length.astype(np.int32), "digest": np.bincount(row, values * (1 + at % 7), len(length))}


def _digests(df: DataFrame, embedding: C.Embedding, keep: list[str]) -> DataFrame:
    out = df.select(*keep, embedding.reduced("row", keep[-1], _digest, "width int, digest double").alias("d"))
    return out.select(*keep, "d.width", (F.round("d.digest", 4) + 0.0).alias("digest"))


WEIGHTS = [1 - i / (2 * LENGTH) for i in range(LENGTH)]
DR_SQL = f"dr AS (SELECT DISTINCT row FROM x), ch AS (SELECT row, pos, substr(row, pos + 1, 1) AS a, 1 - pos / {2 * LENGTH} AS w FROM dr, range(0, {LENGTH}) t(pos))"


@query(f"""WITH {SCORE_SQL}, {DR_SQL}, z AS (SELECT a, k, (score - avg(score) OVER ()) / stddev_pop(score) OVER () AS z FROM sc),
d AS (SELECT row, sum(w * z * (1 + (pos * 20 + k) % 7)) AS d FROM ch JOIN z USING (a) GROUP BY row)
SELECT row, {20 * LENGTH} AS width, round(coalesce(d, 0), 4) + 0.0 AS digest FROM dr LEFT JOIN d USING (row)""")
def embedded_rows(spark, sf_dir):
    """Distinct rows as standardised scores of their residues, a column's weight falling along the row."""
    r = rows(spark, sf_dir).select("row")
    return _digests(r.distinct(), C.Embedding(C.standardised(_scores(r)), WEIGHTS), ["row"])


@query(f"""WITH {MATRIX_SQL}, {DR_SQL}, n AS (SELECT row, sqrt(sum(w * w)) AS norm FROM ch WHERE contains('{RESIDUES}', a) GROUP BY row),
d AS (SELECT row, sum(w / norm * (1 + (pos * 20 + instr('{RESIDUES}', a) - 1) % 7)) AS d FROM ch JOIN n USING (row) WHERE contains('{RESIDUES}', a) GROUP BY row)
SELECT m.row AS row, lang, {20 * LENGTH + 2} AS width, round(coalesce(d, 0) + CASE lang WHEN 'en' THEN {1 + 20 * LENGTH % 7} WHEN 'de' THEN {1 + (20 * LENGTH + 1) % 7} ELSE 0 END, 4) + 0.0 AS digest
FROM (SELECT DISTINCT row, lang FROM x) m LEFT JOIN d ON d.row = m.row""")
def one_hot_panel(spark, sf_dir):
    """Distinct rows and their languages: weighted letters at unit length, and a 0/1 for each of two languages."""
    return _digests(rows(spark, sf_dir).select("row", "lang").distinct(), C.Embedding(C.hot(RESIDUES), WEIGHTS, unit=True, values=["en", "de"]), ["row", "lang"])


@query("SELECT lang, source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1")
def first_members(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars", F.concat_ws("|", "lang", "source").alias("cluster"))
    return C.first_in_cluster(d, "cluster", "doc_id").drop("cluster")


@query("SELECT o_custkey AS key, o_orderkey, o_totalprice AS amount, o_orderstatus AS kind, c_acctbal AS amount_g, c_mktsegment AS kind_g FROM orders JOIN customer ON c_custkey = o_custkey")
def inner_suffixed(spark, sf_dir):
    """Both sides have ``amount`` and ``kind``."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("kind"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("kind"))
    return J.inner_suffixed(o, c, ["key"])


@query("""WITH c AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT) AS cents FROM orders GROUP BY 1), s AS (SELECT *, sum(cents) OVER (ORDER BY cents DESC, o_custkey ROWS UNBOUNDED PRECEDING) - cents AS b FROM c)
SELECT o_custkey, cents::BIGINT AS cents, b::BIGINT AS "before" FROM s WHERE b < 0.8 * (SELECT sum(cents) FROM c)""")
def leading_customers(spark, sf_dir):
    """The customers that make four fifths of the sales."""
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return T.reaching(c, "cents", ["o_custkey"], 0.8)


@query("""WITH o AS (SELECT o_custkey, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS price FROM orders GROUP BY 1)
SELECT c_custkey, price, 'price,segment' AS kept FROM customer JOIN o ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' AND price IS NOT NULL""")
def complete_cases(spark, sf_dir):
    """Customers with orders and a stated segment; a covariate that is the same for all goes."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("price"))
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.crc32(F.col("c_mktsegment").cast("binary")))
    d = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select("c_custkey", "price", segment.alias("segment"), F.lit(1).alias("same"), (F.col("c_acctbal") > 4000).cast("int").alias("y"))
    full, kept = M.usable(d, "y", ["price", "same", "segment"])
    return full.select("c_custkey", "price", F.lit(",".join(kept)).alias("kept"))


@query("""WITH c AS (SELECT c_nationkey % 4 AS g, count(*) FILTER (c_acctbal > 4500) AS k, count(*) FILTER (c_acctbal <= 4500) AS m FROM customer GROUP BY 1),
z AS (SELECT ln(k / m) AS l, 1 / k + 1 / m AS v FROM c WHERE g = 0),
e AS (SELECT '(Intercept)' AS term, l AS estimate, sqrt(v) AS se FROM z UNION ALL SELECT 'g' || g, ln(c.k / c.m) - l, sqrt(1 / c.k + 1 / c.m + v) FROM c, z WHERE g > 0)
SELECT term, round(estimate, 4) + 0.0 AS estimate, round(se, 4) AS se, round(estimate / se, 3) + 0.0 AS z, round(exp(estimate), 4) AS odds_ratio FROM e""")
def logit_groups(spark, sf_dir):
    """A model with a term for each group but one: its estimates are log odds, so SQL has them in closed form."""
    c = table(spark, sf_dir, "customer")
    d = c.select((F.col("c_acctbal") > 4500).cast("int").alias("y"), *[(F.col("c_nationkey") % 4 == g).cast("double").alias(f"g{g}") for g in (1, 2, 3)])
    out = M.logit_glm(d, "y", ["g1", "g2", "g3"])
    return out.select("term", (F.round("estimate", 4) + 0.0).alias("estimate"), F.round("se", 4).alias("se"), (F.round("z", 3) + 0.0).alias("z"), F.round("odds_ratio", 4).alias("odds_ratio"))


PANEL = 8


def _panel_sql() -> str:
    far = lambda v: f"list_distance(v, (SELECT v FROM {v}))"
    parts = ["e AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)", "p0 AS (SELECT id, v, 0.0 AS d FROM e WHERE id = 0)", "p1 AS (SELECT id, v, 0.0 AS d FROM e WHERE id = 1)",
             f"d2 AS MATERIALIZED (SELECT id, v, least({far('p0')}, {far('p1')}) AS d FROM e WHERE id > 1)"]
    for k in range(2, PANEL):
        parts.append(f"p{k} AS MATERIALIZED (SELECT id, v, d FROM d{k} WHERE round(d, 9) > 0 ORDER BY round(d, 9) DESC, id LIMIT 1)")
        parts.append(f"d{k + 1} AS MATERIALIZED (SELECT id, v, least(d, {far(f'p{k}')}) AS d FROM d{k} WHERE id <> (SELECT id FROM p{k}))")
    rows = " UNION ALL ".join(f"SELECT {k} AS step, id, round(d, 6) AS distance FROM p{k}" for k in range(PANEL))
    return f"WITH {', '.join(parts)} {rows}"


@query(_panel_sql())
def maxmin_panel(spark, sf_dir):
    return C.max_min(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", PANEL, [0, 1]).withColumn("distance", F.round("distance", 6))


def _greedy_sql(rounds: int = 12) -> str:
    """Rounds in which each name is decided whose better neighbours are; more than the names need."""
    parts = [f"""{GRAM_SQL.replace('p_partkey AS id', 'min(p_partkey) AS id').replace("AS q FROM part)", "AS q FROM part GROUP BY 2)")},
p AS (SELECT a.id AS u, b.id AS v, count(*) AS shared FROM g a JOIN g b ON a.t = b.t AND a.id <> b.id WHERE a.id IN (SELECT id FROM rp) AND b.id IN (SELECT id FROM rp) GROUP BY ALL),
e AS MATERIALIZED (SELECT u, v, length(b.q) AS lv FROM p JOIN rp x ON x.id = u JOIN rp y ON y.id = v JOIN s a ON a.id = u JOIN s b ON b.id = v
 WHERE shared / (x.n + y.n - shared) >= 0.5 AND (length(b.q) > length(a.q) OR (length(b.q) = length(a.q) AND v < u))),
r0 AS (SELECT id, NULL::BOOLEAN AS rep FROM s)"""]  # fmt: skip
    for k in range(rounds):
        seen = f"SELECT u, bool_or(coalesce(rep, false)) AS hit, bool_or(rep IS NULL) AS wait FROM e JOIN r{k} ON id = v GROUP BY u"
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT r.id, CASE WHEN rep IS NOT NULL THEN rep WHEN hit THEN false WHEN wait THEN NULL ELSE true END AS rep FROM r{k} r LEFT JOIN ({seen}) w ON w.u = r.id)")
    mine = f"SELECT u, arg_min(v, (-lv, v)) AS r FROM e JOIN r{rounds} ON id = v WHERE rep GROUP BY u"
    return f"WITH {', '.join(parts)} SELECT z.id AS member, CASE WHEN rep THEN z.id ELSE m.r END AS representative FROM r{rounds} z LEFT JOIN ({mine}) m ON m.u = z.id"


@query(_greedy_sql())
def greedy_clusters(spark, sf_dir):
    """Names of parts by shared 4-mers, greedy from the longest."""
    one = part_names(spark, sf_dir).groupBy("q").agg(F.min("p_partkey").alias("p_partkey")).withColumn("n", F.length("q"))
    return G.greedy_clusters(one, "p_partkey", "n", G.kmer_similarity(one, "p_partkey", "q", 4, 0.5))


BEST_SQL = "SELECT '{0}' AS spacing, col_1, col_2, col_3, round({1}, 6) AS score FROM (SELECT * FROM tr WHERE hypothesis = 'THD' ORDER BY round({1}, 9) DESC, r1, col_2, col_3 LIMIT 1)"


@query(f"WITH {TRIPLE_SQL} {BEST_SQL.format('prior', 'score')} UNION ALL {BEST_SQL.format('learned', '(freq_1 + freq_2 + freq_3)')}")
def spacing_prior(spark, sf_dir):
    """The best triple of a family whose spacing is known, and of one without a prior."""
    stats = staged(stats_of(matrix(spark, sf_dir)))
    out = None
    for name, prior in (("prior", GAPS), ("learned", None)):
        best = A.best_triple({"THD": scored_triples(stats, "THD", prior, TOLERANCE, PENALTY)})
        one = best.select(F.lit(name).alias("spacing"), "col_1", "col_2", "col_3", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def _raised(check) -> bool:
    try:
        check()
    except V.CheckFailed:
        return True
    return False


@query("""SELECT 'missing keys' AS guard, (SELECT count(*) > 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)) AS raised
UNION ALL SELECT 'report with errors', (SELECT count(*) > count(DISTINCT o_custkey) FROM orders) UNION ALL SELECT 'report without errors', (SELECT count(*) > count(DISTINCT o_orderkey) FROM orders)
UNION ALL SELECT 'structure of another', (SELECT avg((o_orderkey % 3 > 0)::INT) < 0.9 FROM orders) UNION ALL SELECT 'structure of its own', (SELECT avg((o_orderkey % 20 > 0)::INT) < 0.9 FROM orders)
UNION ALL SELECT 'columns that do not map', (SELECT avg((c_acctbal < 0)::INT) < 0.5 FROM customer) UNION ALL SELECT 'repeated right key', (SELECT count(*) > count(DISTINCT o_custkey) FROM orders)""")
def guard_failures(spark, sf_dir):
    """Guards on tables that break them, and two on tables that don't."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    own, key = c.select(F.col("c_custkey").alias("o_custkey")), o.select("o_custkey")
    pairs = lambda n: o.select(F.lit("A").alias("structure"), F.when(F.col("o_orderkey") % n == 0, "C").otherwise("A").alias("sequence"))
    checks = {
        "missing keys": lambda: J.require_none_missing(own, key, ["o_custkey"], "customers"),
        "report with errors": lambda: V.require_ok(V.table_checks(o, "o_custkey", "orders"), strict=True),
        "report without errors": lambda: V.require_ok(V.table_checks(o, "o_orderkey", "orders"), strict=True),
        "structure of another": lambda: V.structure_identity(pairs(3)),
        "structure of its own": lambda: V.structure_identity(pairs(20)),
        "columns that do not map": lambda: V.coverage_check(c.select((F.col("c_acctbal") < 0).alias("mapped")), "mapped"),
        "repeated right key": lambda: J.left_many_to_one(own, o.select("o_custkey", "o_orderkey"), ["o_custkey"]).count(),
    }
    return spark.createDataFrame([(name, _raised(check)) for name, check in checks.items()], "guard string, raised boolean")
