"""Evidence per item: best match, profile sets, tiers, funnel, empirical false discovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import small
from .staging import numbered, staged


def best_match(rows: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The best-scored row of each key, with ``n_matches`` of the key: one aggregate, so a key of any
    number of rows is reduced in parts."""
    others = [c for c in rows.columns if c not in keys]
    s = F.col(score).cast("double")
    order = F.struct(s.isNull().alias("_0"), (~F.isnan(s)).alias("_1"), (-s).alias("_2"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_b"), F.count("*").alias("n_matches"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in rows.columns], "n_matches")


def profile_sets(rows: DataFrame, item: list[str], profile: str) -> DataFrame:
    """Per item: the sorted distinct profiles as a comma list, and how many."""
    sets = rows.groupBy(*item).agg(F.array_sort(F.collect_set(profile)).alias("_p"))
    return sets.select(*item, F.array_join("_p", ",").alias("profiles_hit"), F.size("_p").alias("n_profiles_hit"))


def tier(profiles_hit: Column, specific: str) -> Column:
    return F.when(F.array_contains(F.split(profiles_hit, ","), specific), "specific").otherwise("ssf_only")


def in_family(profiles_hit: Column, family: list[str]) -> Column:
    return F.arrays_overlap(F.split(profiles_hit, ","), F.array(*[F.lit(x) for x in family]))


def key_values(one_row: DataFrame) -> DataFrame:
    """A one-row table of counts as (metric, value) rows."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as bigint)" for c in one_row.columns)
    return one_row.selectExpr(f"stack({len(one_row.columns)}, {pairs}) as (metric, value)")


def empirical_fdr(scores: DataFrame, points: int = 60) -> DataFrame:
    """``scores``: profile, score, decoy (0/1).  Per profile and cut: n_target, n_decoy, fdr.

    The cuts run evenly from the floor of the least score to the ceiling of the targets'
    99.5th percentile.  Rows are counted, not items; the ratio may pass 1 and is null without
    targets.
    """
    ends = staged(
        scores.groupBy("profile").agg(
            F.floor(F.min("score")).cast("double").alias("lo"),
            F.ceil(F.percentile(F.when(F.col("decoy") == 0, F.col("score").cast("double")), F.lit(0.995))).cast("double").alias("hi"),
        )
    )
    width = (F.col("hi") - F.col("lo")) / (points - 1)
    at = F.floor(F.when(width > 0, (F.col("score") - F.col("lo")) / width).otherwise(F.lit(points - 1)))
    # the division may be off by one step either way; compare with the cut itself
    cut = lambda k: F.col("lo") + k * width
    k = F.least(at, F.lit(points - 1))
    k = F.when(cut(k) > F.col("score"), k - 1).when((k < points - 1) & (cut(k + 1) <= F.col("score")), k + 1).otherwise(k)
    counts = scores.join(small(ends), "profile").withColumn("_k", k.cast("int")).where("_k >= 0")
    counts = counts.groupBy("profile", "_k").agg(F.count_if(F.col("decoy") == 0).alias("t"), F.count_if(F.col("decoy") == 1).alias("d"))
    grid = ends.select("profile", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k"))
    filled = grid.join(counts, ["profile", "_k"], "left")
    above = W.partitionBy("profile").orderBy(F.col("_k").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = filled.select("profile", cut(F.col("_k")).alias("bit_score"), F.sum(F.coalesce("t", F.lit(0))).over(above).alias("n_target"), F.sum(F.coalesce("d", F.lit(0))).over(above).alias("n_decoy"))
    return out.withColumn("fdr", F.when(F.col("n_target") > 0, F.col("n_decoy") / F.col("n_target")))


def top_n_other(rows: DataFrame, label: str, n: int, other: str = "Other", none: str = "Unclassified") -> DataFrame:
    """``rows`` with ``top``: the label if among the n most frequent, else ``other``; null is ``none``."""
    most = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.col("count").desc(), label).limit(n).select(F.col(label).alias("_top"))
    out = rows.join(F.broadcast(most), F.col(label) == F.col("_top"), "left")
    return out.withColumn("top", F.when(F.col(label).isNull(), none).when(F.col("_top").isNotNull(), F.col(label)).otherwise(other)).drop("_top")


def null_census(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, value): nulls of each column."""
    return key_values(rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]))


def survival(rows: DataFrame, group: str, value: str, ties: list[str]) -> DataFrame:
    """Share of a group's rows that score no better than each row's rank: 1 - rank/n from the top."""
    ranked = numbered(rows, [F.col(group), F.col(value), *[F.col(t) for t in ties]], "_r")
    first = ranked.groupBy(group).agg(F.min("_r").alias("_first"), F.count("*").alias("_n")).withColumnRenamed(group, "_g")
    return ranked.join(first, F.col(group).eqNullSafe(F.col("_g"))).withColumn("survival", 1 - (F.col("_r") - F.col("_first")) / F.col("_n")).drop("_r", "_first", "_n", "_g")


def histogram(rows: DataFrame, value: str, lo: float, hi: float, bins: int, by: list[str] | None = None) -> DataFrame:
    """Counts by ``width_bucket``; bucket 0 is below lo, bins + 1 is hi or above."""
    return rows.groupBy(*(by or []), F.width_bucket(value, F.lit(lo), F.lit(hi), F.lit(bins)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def exact_duplicates(rows: DataFrame, row_id: str, value: str) -> DataFrame:
    """member -> representative: rows of equal value, the least id represents.  Values are
    aggregated before they meet the rows, so copies of any number are reduced in parts."""
    one = rows.groupBy(value).agg(F.min(row_id).alias("representative")).withColumnRenamed(value, "_v")
    return rows.join(one, F.col(value).eqNullSafe(F.col("_v"))).select(F.col(row_id).alias("member"), "representative")


def inverse_cluster_weights(rows: DataFrame, row_id: str, cluster: Column) -> DataFrame:
    """Rows (row_id, cluster, cluster_size, weight), weight = 1/size to 8 places.  Sizes are
    aggregated before they meet the rows, so a cluster of any size is counted in parts."""
    keyed = rows.select(row_id, cluster.alias("cluster"))
    sizes = keyed.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    return keyed.join(sizes, "cluster").withColumn("weight", F.round(1 / F.col("cluster_size"), 8))


