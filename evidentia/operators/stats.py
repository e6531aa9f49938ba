"""Tests and adjustments over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import numbered, running_sum, staged

LOG_FACTORIAL_LIMIT = 2_000_000


BUCKET = 100_000


def bh_adjust(df: DataFrame, p: str, ties: list[str], by: list[str] | None = None, out: str = "q_bh") -> DataFrame:
    """Benjamini-Hochberg: p * n / rank, made monotone from the largest p down, 1 at most;
    null p stay out of n.  Without groups the table is ranked over ranges; what is made monotone in one task
    is a bucket of BUCKET ranks and then a row for each bucket."""
    if not by:
        known = df.where(F.col(p).isNotNull())
        placed = staged(numbered(known, [F.col(p), *[F.col(t) for t in ties]], "_r"))
        n = placed.count()
        raw = placed.withColumn("_raw", F.col(p) * n / (F.col("_r") + 1)).withColumn("_b", F.expr(f"_r div {BUCKET}"))
        later = raw.groupBy(F.col("_b").alias("_c")).agg(F.min("_raw").alias("_m"))
        later = later.select("_c", F.min("_m").over(W.orderBy(F.col("_c").desc()).rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
        own = F.min("_raw").over(W.partitionBy("_b").orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0))
        done = raw.withColumn("_own", own).join(later, F.col("_b") == F.col("_c"))
        done = done.withColumn(out, F.least(F.col("_own"), "_later", F.lit(1.0))).select(*df.columns, out)
        return done.unionByName(df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))
    w = W.partitionBy(*by, F.col(p).isNull())
    n, rank = F.count(p).over(w), F.row_number().over(w.orderBy(p, *ties))
    raw = df.withColumn("_raw", F.col(p) * n / rank)
    q = F.min("_raw").over(w.orderBy(F.col(p).desc(), *[F.col(t).desc() for t in ties]).rowsBetween(W.unboundedPreceding, 0))
    return raw.withColumn(out, F.when(F.col(p).isNotNull(), F.least(q, F.lit(1.0)))).drop("_raw")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each pair of labels: (a, b, n11, n1x, nx1, nxx) from one count per cell."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n11"))
    return cells.withColumn("n1x", F.sum("n11").over(W.partitionBy(a))).withColumn("nx1", F.sum("n11").over(W.partitionBy(b))).withColumn("nxx", F.sum("n11").over(W.partitionBy()))


def _log_factorial(n: Column) -> Column:
    """ln n! to double precision: by product to 20, beyond it by Stirling's series."""
    x = n.cast("double")
    small = F.log(F.call_function("double", F.factorial(F.least(n, F.lit(20)).cast("int"))))
    series = (x + 0.5) * F.log(x) - x + 0.91893853320467274178 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return F.when(n <= 20, small).otherwise(series)


def fisher_greater(df: DataFrame, a: str = "n11", row: str = "n1x", column: str = "nx1", total: str = "nxx") -> DataFrame:
    """One-sided exact test of a cell, with the sample odds ratio (infinite is null).

    P(X >= a) sums the hypergeometric terms of a..min(row, column); the first comes from
    log factorials, each next one by the ratio of neighbours, inside one expression.
    """
    a_, r, c, n = F.col(a), F.col(row), F.col(column), F.col(total)
    lf = _log_factorial
    first = F.exp(lf(r) + lf(n - r) + lf(c) + lf(n - c) - lf(n) - lf(a_) - lf(r - a_) - lf(c - a_) - lf(n - r - c + a_))
    steps = F.least(r, c) - a_
    start = F.struct(first.alias("t"), first.alias("s"))

    def add(s: Column, k: Column) -> Column:
        x = a_ + k - 1
        t = s["t"] * ((r - x).cast("double") * (c - x)) / ((x + 1).cast("double") * (n - r - c + x + 1))
        return F.struct(t.alias("t"), (s["s"] + t).alias("s"))

    tail = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), steps.cast("long")), start, add, lambda s: s["s"])).otherwise(first)
    other = (r - a_) * (c - a_)
    odds = F.when(other > 0, a_.cast("double") * (n - r - c + a_) / other)
    return df.withColumn("odds_ratio", odds).withColumn("p", F.least(F.lit(1.0), tail))


def mann_whitney(df: DataFrame, group: str, value: str, by: list[str] | None = None) -> DataFrame:
    """``group`` is 0/1.  U of group 1 with average ranks for ties, and its z with tie and
    continuity correction (one-sided: group 1 greater)."""
    by = by or []
    w = W.partitionBy(*by)
    per = df.groupBy(*by, value).agg(F.count("*").alias("t"), F.sum(group).alias("k"))
    below = F.coalesce(F.sum("t").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("rank", below + (F.col("t") + 1) / 2)
    s = ranked.groupBy(*by).agg(F.sum("k").alias("n1"), F.sum("t").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("r1"), F.sum((F.col("t").cast("double") ** 3) - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((F.col("n") + 1) - F.col("ties") / (F.col("n") * (F.col("n") - 1)))
    return s.select(*by, n1.alias("n1"), n2.alias("n2"), u.alias("u"), F.when(var > 0, (u - n1 * n2 / 2 - 0.5) / F.sqrt(var)).alias("z"))


def adjusted_rand(cells: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """One row (n, adjusted_rand) from counts per pair of labels."""
    pairs = lambda x: x * (x - 1) / 2
    s = cells.agg(F.sum(pairs(F.col(n))).alias("i"), F.sum(n).alias("n"))
    s_a = cells.groupBy(a).agg(F.sum(n).alias("m")).agg(F.sum(pairs(F.col("m"))).alias("a"))
    s_b = cells.groupBy(b).agg(F.sum(n).alias("m")).agg(F.sum(pairs(F.col("m"))).alias("b"))
    one = s.crossJoin(s_a).crossJoin(s_b)
    expected = F.col("a") * F.col("b") / pairs(F.col("n"))
    half = (F.col("a") + F.col("b")) / 2
    return one.select("n", F.when(half != expected, (F.col("i") - expected) / (half - expected)).otherwise(F.lit(1.0)).alias("adjusted_rand"))


def adjusted_mutual_information(cells: DataFrame, a: str, b: str, n: str = "n") -> float:
    """AMI with the arithmetic mean of entropies.  The expectation needs the row and column
    totals only, which are counts per label."""
    import numpy as np

    from ..functions.special import gammaln

    rows = cells.groupBy(a, b).agg(F.sum(n).alias("n")).collect()
    ra = {x: i for i, x in enumerate(dict.fromkeys(r[0] for r in rows))}
    rb = {x: i for i, x in enumerate(dict.fromkeys(r[1] for r in rows))}
    t = np.zeros((len(ra), len(rb)))
    for r in rows:
        t[ra[r[0]], rb[r[1]]] += r["n"]
    total, x, y = t.sum(), t.sum(1), t.sum(0)
    p = t[t > 0] / total
    mi = float((p * np.log(p * total**2 / np.outer(x, y)[t > 0])).sum())
    h = [float(-(v / total * np.log(v / total)).sum()) for v in (x, y)]
    expected = 0.0
    for i in x:
        for j in y:
            k = np.arange(max(1, i + j - total), min(i, j) + 1)
            log_p = gammaln(i + 1) + gammaln(j + 1) + gammaln(total - i + 1) + gammaln(total - j + 1) - gammaln(total + 1) - gammaln(k + 1) - gammaln(i - k + 1) - gammaln(j - k + 1) - gammaln(total - i - j + k + 1)
            expected += float((k / total * np.log(total * k / (i * j)) * np.exp(log_p)).sum())
    top = sum(h) / 2 - expected
    return 1.0 if abs(top) < 1e-12 else (mi - expected) / top


def jaccard_matrix(sets: DataFrame, name: str, element: str, names: list[str]) -> DataFrame:
    """(a, b, shared, either, jaccard) for each pair of named sets, null for two empty ones.
    Elements are grouped to the names that hold them, so no self join meets a hot element."""
    s = sets.select(name, element).distinct()
    held = s.groupBy(element).agg(F.collect_set(name).alias("_in"))
    here = lambda x: F.array_contains("_in", x)
    pairs = [(p, q) for i, p in enumerate(names) for q in names[i:]]
    counts = held.agg(*[F.struct(F.count_if(here(p) & here(q)).alias("shared"), F.count_if(here(p) | here(q)).alias("either")).alias(f"p{k}") for k, (p, q) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"p{k}.shared").alias("shared"), F.col(f"p{k}.either").alias("either")) for k, (p, q) in enumerate(pairs)])
    return counts.select(F.explode(rows).alias("x")).select("x.*").withColumn("jaccard", F.when(F.col("either") > 0, F.col("shared") / F.col("either")))


def region_enrichment(positions: DataFrame, called: str, regions: list[str]) -> DataFrame:
    """Per region flag: called and uncalled positions inside and outside, odds ratio, one-sided p.
    One aggregate for all regions."""
    c = F.col(called)
    cell = lambda r: F.struct(F.lit(r).alias("region"), F.count_if(c & F.col(r)).alias("n11"), F.count_if(c).alias("n1x"), F.count_if(F.col(r)).alias("nx1"), F.count("*").alias("nxx"))
    one = positions.agg(*[cell(r).alias(f"r{i}") for i, r in enumerate(regions)])
    return fisher_greater(one.select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(regions))])).alias("x")).select("x.*"))


def reaching(df: DataFrame, value: str, order: list[str], share: float) -> DataFrame:
    """The leading rows, by descending ``value`` and then ``order`` (together unique), that reach ``share`` of the sum:
    each whose rows before sum to less.  Adds ``before``, their sum; rows are summed over ranges, not in one task."""
    total = df.agg(F.sum(value)).first()[0] or 0
    falling = df.withColumn("_down", -F.col(value)).withColumn("_all", F.lit(0))
    return running_sum(falling, ["_all"], ["_down", *order], value, "before").where(F.col("before") < share * total).drop("_down", "_all")


def cumulative_cut(variance: list[float], share: float) -> int:
    """How many leading components reach a share of the variance."""
    total, run = sum(variance), 0.0
    for k, v in enumerate(variance):
        run += v
        if run >= share * total - 1e-12:
            return k + 1
    return len(variance)
