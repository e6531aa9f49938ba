"""Joins that check what they promise.

A check is one aggregate over the key columns; a broken promise raises CheckFailed, as a
wrong table that looks plausible is worse than none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A guard found the input to be other than promised."""


BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast once it is measured and found within ``limit`` rows and ``most`` bytes
    of its values as text; beyond it the join it is for shuffles."""
    row = F.octet_length(F.struct(*[F.col(f"`{c}`") for c in df.columns]).cast("string")).cast("long")
    rows, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and size <= most else df


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    dup = df.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if dup:
        raise CheckFailed(f"{what}: {keys} not unique, e.g. {[tuple(r)[:-1] for r in dup]}")
    return df


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def left_many_to_one(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_meta", validate: bool = True, require_match: bool = False, indicator: str | None = None) -> DataFrame:
    """Left join with a right side of one row per key; right columns that clash get ``suffix``.
    ``require_match`` raises where a left row finds none; ``indicator`` adds a 0/1 column."""
    if validate:
        require_unique(right, keys, "right side")
    renamed = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    found = right.withColumnsRenamed(renamed).withColumn("_found", F.lit(1))
    out = left.join(found, keys, "left").withColumn("_found", F.coalesce("_found", F.lit(0)))
    if require_match and (n := out.where("_found = 0").count()):
        raise CheckFailed(f"{n} rows of the left side find no {keys}")
    return out.withColumnRenamed("_found", indicator) if indicator else out.drop("_found")


def left_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_meta") -> DataFrame:
    require_unique(left, keys, "left side")
    return left_many_to_one(left, right, keys, suffix)


def left_first(left: DataFrame, right: DataFrame, left_key: str, right_key: str, order: list[Column]) -> DataFrame:
    """Left join with the first right row of each key; the right key goes."""
    one = first_per_key(right, [right_key], order).withColumnRenamed(right_key, "_key")
    return left.join(one, left[left_key] == F.col("_key"), "left").drop("_key")


def inner_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_g") -> DataFrame:
    renamed = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    return left.join(right.withColumnsRenamed(renamed), keys)


def flagged(left: DataFrame, members: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """0/1 column: whether a row's key is among ``members``."""
    hit = members.select(*keys).distinct().withColumn(flag, F.lit(1))
    return left.join(hit, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def require_none_missing(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> DataFrame:
    rows = missing(left, right, keys).select(*keys).limit(5).collect()
    if rows:
        raise CheckFailed(f"{what}: no match for {[tuple(r) for r in rows]}")
    return left


def variant_join(left: DataFrame, right: DataFrame, key: str, variants: Column, right_key: str) -> DataFrame:
    """Each left row with the right row that its best-ranked variant names, if any."""
    tried = left.select(key, F.posexplode(variants).alias("_rank", "_v")).distinct()
    right = right.withColumnRenamed(right_key, "_rk")
    hits = tried.join(right, F.col("_v") == F.col("_rk"))
    others = [c for c in right.columns if c != "_rk"]
    best = hits.groupBy(key).agg(F.min_by(F.struct("_rk", *others), F.struct("_rank", "_rk")).alias("_best"))
    return left.join(best, key, "left").select(*left.columns, F.col("_best._rk").alias(right_key), *[F.col(f"_best.{c}").alias(c) for c in others])


def lookup(left: DataFrame, table: DataFrame, key: str, value: str, default: str | None = None) -> DataFrame:
    """Map a column through a small table, first row per key, with a default."""
    one = small(table.groupBy(key).agg(F.min(value).alias(value)))
    out = left.join(one, key, "left")
    return out.withColumn(value, F.coalesce(value, F.lit(default))) if default is not None else out


def compose_clusters(first: DataFrame, second: DataFrame) -> DataFrame:
    """member -> representative -> representative of that, where one is given."""
    then = second.select(F.col("member").alias("_m"), F.col("representative").alias("_r"))
    return first.join(then, F.col("representative") == F.col("_m"), "left").select("member", F.coalesce("_r", "representative").alias("representative"))


def threshold_counts(rows: DataFrame, value: str, grid: Column, by: list[str] | None = None, also: dict[str, Column] | None = None) -> DataFrame:
    """For each threshold of ``grid`` (an array), how many rows have ``value`` >= it.

    No range join: a row is counted once in the bucket of the largest threshold that it
    meets, and a suffix sum over the buckets (as many as thresholds) gives every count.
    """
    by, also = by or [], also or {}
    one = rows.sparkSession.range(1).select(F.posexplode(grid).alias("_t", "threshold"))
    bucket = rows.withColumn("_b", F.size(F.filter(grid, lambda t: t <= F.col(value))) - 1).where("_b >= 0")
    sums = bucket.groupBy(*by, "_b").agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in also.items()])
    full = F.broadcast(one).crossJoin(rows.select(*by).distinct()) if by else one
    filled = full.join(sums.withColumnRenamed("_b", "_t"), [*by, "_t"], "left")
    after = W.partitionBy(*by).orderBy(F.col("_t").desc()).rowsBetween(W.unboundedPreceding, 0)
    counted = ["n", *also]
    return filled.select(*by, "threshold", *[F.coalesce(F.sum(c).over(after), F.lit(0)).cast("long").alias(c) for c in counted])
