"""Alignment queries.  Sequences are the letters of ``documents`` (residue alphabet), whole; an
aligned row is each stretch of LENGTH letters of one, the last padded with gaps; tier A is
English."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import alignment as A
from ..operators.staging import staged
from .registry import query, spread, table
from .screen import CLEAN_SQL

LENGTH = 60
HALF = 3
MIN_OCC, MIN_FREQ, CAP = 0.5, 0.02, 40
GAPS, TOLERANCE, PENALTY = (14, 9), 5.0, 0.02
MIN_COVERAGE = 0.7

MATRIX_SQL = f"""
q AS (SELECT doc_id, lang, source, {CLEAN_SQL} AS s FROM documents),
w AS (SELECT doc_id * 1000000 + k AS seq_id, lang, source, rpad(substr(s, k * {LENGTH} + 1, {LENGTH}), {LENGTH}, '-') AS row
  FROM (SELECT *, unnest(range(0, (length(s) + {LENGTH - 1}) // {LENGTH})) AS k FROM q WHERE s IS NOT NULL)),
x AS (SELECT seq_id, lang, source, row, round(1 / count(*) OVER (PARTITION BY row), 8) AS weight, CASE WHEN lang = 'en' THEN 'specific' ELSE 'ssf_only' END AS tier FROM w),
lf AS (SELECT seq_id, tier, weight, lang, source, pos, substr(row, pos + 1, 1) AS residue FROM x, range(0, {LENGTH}) t(pos))"""
STATS_SQL = f"""{MATRIX_SQL},
mass AS (SELECT pos, residue, sum(weight) AS mass FROM lf WHERE tier = 'specific' GROUP BY ALL),
occ AS (SELECT pos, sum(mass) AS total, coalesce(sum(mass) FILTER (residue <> '-'), 0) AS filled FROM mass GROUP BY pos),
st AS (SELECT pos, residue, mass / filled AS freq, filled / total AS occupancy FROM mass JOIN occ USING (pos) WHERE contains('ACDEFGHIKLMNPQRSTVWY', residue)),
stats AS (SELECT *, -sum(freq * log2(freq)) OVER (PARTITION BY pos) AS entropy_bits FROM st)"""


def _cands(res: str) -> str:
    return f"(SELECT pos, freq, occupancy, row_number() OVER (ORDER BY round(freq, 9) DESC, pos) AS rk FROM stats WHERE residue = '{res}' AND occupancy >= {MIN_OCC} AND freq >= {MIN_FREQ} QUALIFY rk <= {CAP})"


def _triples(h: str, k: int) -> str:
    return f"""SELECT '{h}' AS hypothesis, {k} AS hk, a.rk AS r1, a.pos AS col_1, b.pos AS col_2, c.pos AS col_3, a.freq AS freq_1, b.freq AS freq_2, c.freq AS freq_3,
 {PENALTY} * (abs(b.pos - a.pos - {GAPS[0]}) + abs(c.pos - b.pos - {GAPS[1]})) / {TOLERANCE} AS spacing_penalty,
 a.freq + b.freq + c.freq - {PENALTY} * (abs(b.pos - a.pos - {GAPS[0]}) + abs(c.pos - b.pos - {GAPS[1]})) / {TOLERANCE} AS score
 FROM cand_{h[0]} a, cand_{h[1]} b, cand_{h[2]} c WHERE a.pos < b.pos AND b.pos < c.pos"""


TRIPLE_SQL = f"""{STATS_SQL},
{', '.join(f'cand_{r} AS {_cands(r)}' for r in 'THDN')},
tr AS ({_triples('THD', 0)} UNION ALL {_triples('THN', 1)}),
best AS (SELECT * FROM tr ORDER BY round(score, 9) DESC, hk, r1, col_2, col_3 LIMIT 1)"""
OUTCOME_SQL = f"""{TRIPLE_SQL},
o AS (SELECT x.*, length(replace(row, '-', '')) / {LENGTH} AS match_coverage,
 substr(row, col_1 + 1, 1) AS a, substr(row, col_2 + 1, 1) AS b, substr(row, col_3 + 1, 1) AS c, hypothesis AS h, col_1, col_2, col_3 FROM x, best),
j AS (SELECT *, CASE WHEN match_coverage < {MIN_COVERAGE} THEN 'low_coverage' WHEN '-' IN (a, b, c) THEN 'gapped' WHEN a || b || c = h THEN 'positive' ELSE 'negative' END AS outcome,
 contains(row, h[1]) AND contains(row, h[2]) AND contains(row, h[3]) AS has_all_anywhere FROM o)"""


def rows(spark, sf_dir):
    """(seq_id, lang, source, tier, row); a document without letters has no row."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    seqs = docs.select("doc_id", "lang", "source", S.clean_sequence(F.col("text")).alias("s"))
    cut = seqs.select("doc_id", "lang", "source", F.posexplode(S.pieces(F.col("s"), LENGTH)).alias("k", "part"))
    row = F.rpad("part", LENGTH, "-")
    return cut.select((F.col("doc_id") * 1000000 + F.col("k")).alias("seq_id"), "lang", "source", F.when(F.col("lang") == "en", "specific").otherwise("ssf_only").alias("tier"), row.alias("row"))


def matrix(spark, sf_dir):
    """(row, lang, source, tier, copies, weight): equal rows of one label set once, with how many
    they are and the sum of their weights (1 / all copies of the row).  What meets per row is a
    count for each label set, so a row of any number of copies is no heavy group."""
    one = rows(spark, sf_dir).groupBy("row", "lang", "source", "tier").agg(F.count("*").alias("copies"))
    share = F.round(1 / F.sum("copies").over(W.partitionBy("row")), 8)
    return one.withColumn("weight", F.col("copies") * share)


def stats_of(m):
    return A.column_stats(m.where("tier = 'specific'"))


def scored_triples(stats, hypothesis, prior, tolerance, penalty):
    parts = [A.candidates(stats, r, MIN_OCC, MIN_FREQ, CAP) for r in hypothesis]
    return A.score_by_prior(*parts, prior, tolerance, penalty).withColumn("score", F.round("score", 9))


def _triple_tables(stats):
    # a few rows per position, read by every candidate list
    stats = staged(stats)
    return {h: scored_triples(stats, h, GAPS, TOLERANCE, PENALTY) for h in ("THD", "THN")}


@query(f"WITH {STATS_SQL} SELECT pos, residue, round(freq, 6) AS freq, round(occupancy, 6) AS occupancy, round(entropy_bits, 6) AS entropy_bits FROM stats")
def column_stats(spark, sf_dir):
    return stats_of(matrix(spark, sf_dir)).select("pos", "residue", *[F.round(c, 6).alias(c) for c in ("freq", "occupancy", "entropy_bits")])


@query(f"""WITH {MATRIX_SQL}, mass AS (SELECT pos, residue, sum(weight) AS m FROM lf WHERE residue <> '-' GROUP BY ALL),
p AS (SELECT pos, m / sum(m) OVER (PARTITION BY pos) AS p FROM mass), h AS (SELECT pos, -sum(p * log2(p)) AS h FROM p GROUP BY pos)
SELECT pos, round(h, 6) + 0.0 AS entropy_bits, round(greatest(0, least(1, 1 - h / log2(20))), 6) AS conservation FROM h""")
def column_entropy(spark, sf_dir):
    out = A.column_entropy(matrix(spark, sf_dir))
    return out.select("pos", (F.round("entropy_bits", 6) + 0.0).alias("entropy_bits"), F.round("conservation", 6).alias("conservation"))


@query(f"WITH {STATS_SQL} SELECT 'T' AS residue, pos, round(freq, 6) AS freq, rk AS rank FROM {_cands('T')} UNION ALL SELECT 'H', pos, round(freq, 6), rk FROM {_cands('H')} UNION ALL SELECT 'D', pos, round(freq, 6), rk FROM {_cands('D')}")
def anchor_candidates(spark, sf_dir):
    stats = stats_of(matrix(spark, sf_dir))
    parts = [A.candidates(stats, r, MIN_OCC, MIN_FREQ, CAP).select(F.lit(r).alias("residue"), "pos", F.round("freq", 6).alias("freq"), "rank") for r in "THD"]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH {TRIPLE_SQL} SELECT hypothesis, rank, col_1, col_2, col_3, round(score, 6) AS score, round(spacing_penalty, 6) AS spacing_penalty FROM
 (SELECT *, row_number() OVER (PARTITION BY hypothesis ORDER BY round(score, 9) DESC, r1, col_2, col_3) AS rank FROM tr) z WHERE z.rank <= 20""")
def anchor_triples(spark, sf_dir):
    parts = [A.ranked_triples(t).withColumn("hypothesis", F.lit(h)) for h, t in _triple_tables(stats_of(matrix(spark, sf_dir))).items()]
    both = parts[0].unionByName(parts[1])
    return both.select("hypothesis", "rank", "col_1", "col_2", "col_3", F.round("score", 6).alias("score"), F.round("spacing_penalty", 6).alias("spacing_penalty"))


def _best(m):
    return A.best_triple(_triple_tables(stats_of(m)))


@query(f"WITH {OUTCOME_SQL} SELECT seq_id, tier, round(match_coverage, 6) AS match_coverage, outcome, has_all_anywhere FROM j")
def anchor_outcomes(spark, sf_dir):
    judged = A.outcomes(rows(spark, sf_dir), _best(matrix(spark, sf_dir)), MIN_COVERAGE)
    return judged.select("seq_id", "tier", F.round("match_coverage", 6).alias("match_coverage"), "outcome", "has_all_anywhere")


@query(f"""WITH {OUTCOME_SQL} SELECT tier, count(*) AS n_aligned, count(*) FILTER (outcome IN ('positive', 'negative')) AS n_testable, count(*) FILTER (outcome = 'low_coverage') AS n_low_coverage,
 count(*) FILTER (outcome = 'gapped') AS n_gapped, count(*) FILTER (outcome = 'negative') AS n_negative, count(*) FILTER (outcome = 'negative' AND has_all_anywhere) AS n_negative_with_all_three,
 count(*) FILTER (outcome = 'positive') AS n_positive, round(sum(weight), 6) AS effective_n, round(coalesce(sum(weight) FILTER (outcome = 'positive'), 0), 6) AS effective_positive,
 round(count(*) FILTER (outcome = 'positive') / nullif(count(*) FILTER (outcome IN ('positive', 'negative')), 0), 6) AS frac_positive,
 round(count(*) FILTER (outcome IN ('positive', 'negative')) / count(*), 6) AS frac_testable FROM j GROUP BY tier""")
def outcomes_by_tier(spark, sf_dir):
    m = staged(matrix(spark, sf_dir))
    out = A.tier_census(A.outcomes(m, _best(m), MIN_COVERAGE), copies="copies")
    rounded = ("effective_n", "effective_positive", "frac_positive", "frac_testable")
    return out.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in out.columns])


BARCODE_SQL = f"""{TRIPLE_SQL},
bc AS (SELECT seq_id, source, weight, substr(row, greatest(0, col_1 - {HALF}) + 1, least({LENGTH - 1}, col_1 + {HALF}) - greatest(0, col_1 - {HALF}) + 1)
 || substr(row, greatest(0, col_2 - {HALF}) + 1, least({LENGTH - 1}, col_2 + {HALF}) - greatest(0, col_2 - {HALF}) + 1)
 || substr(row, greatest(0, col_3 - {HALF}) + 1, least({LENGTH - 1}, col_3 + {HALF}) - greatest(0, col_3 - {HALF}) + 1) AS barcode FROM x, best)"""


def barcodes(df, m):
    """``df`` with a column ``barcode``, around the best triple of the matrix ``m``, in place of ``row``."""
    both = df.crossJoin(F.broadcast(_best(m).select("col_1", "col_2", "col_3")))
    return both.withColumn("barcode", A.anchor_window(F.col("row"), [F.col(f"col_{i}") for i in (1, 2, 3)], HALF)).drop("row", "col_1", "col_2", "col_3")


@query(f"WITH {BARCODE_SQL} SELECT seq_id, barcode FROM bc")
def anchor_window(spark, sf_dir):
    return barcodes(rows(spark, sf_dir), matrix(spark, sf_dir)).select("seq_id", "barcode")


@query(f"""WITH {MATRIX_SQL}, m AS (SELECT source, pos, residue, sum(round(weight * 1e8)::BIGINT) AS w FROM lf GROUP BY ALL),
t AS (SELECT source, pos, sum(w) FILTER (residue <> '-') AS total FROM m GROUP BY ALL),
r AS (SELECT m.source, m.pos, residue, w / total AS share FROM m JOIN t ON m.source = t.source AND m.pos = t.pos
 QUALIFY row_number() OVER (PARTITION BY m.source, m.pos ORDER BY CASE WHEN residue = '-' THEN -1 ELSE w END DESC, ascii(residue)) = 1)
SELECT source, count(*) AS n_positions, string_agg(CASE WHEN residue = '-' THEN '-' WHEN share >= 0.5 THEN upper(residue) ELSE lower(residue) END, '' ORDER BY pos) AS motif FROM r GROUP BY source""")
def consensus_motifs(spark, sf_dir):
    # weights summed in another order differ in their last bits; whole units of 1e-8 make ties exact
    m = matrix(spark, sf_dir).withColumn("weight", F.expr("cast(round(weight * 1e8) as bigint)"))
    return A.consensus(m, "source")


def flagship(spark, sf_dir):
    return outcomes_by_tier(spark, sf_dir)


