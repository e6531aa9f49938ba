"""Checks of inputs: a report of (level, check, detail) rows, and errors on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import CheckFailed
from .reference_data import values

ORDER = ("OK", "WARN", "ERROR")


def _line(df: DataFrame, check: str, bad: str, level: str, detail: str) -> DataFrame:
    """One report row from a one-row table with counts ``bad`` and ``n``."""
    return df.select(F.when(F.col(bad) > 0, level).otherwise("OK").alias("level"), F.lit(check).alias("check"), F.format_string(detail, F.col(bad), F.col("n")).alias("detail"))


def table_checks(df: DataFrame, key: str, name: str) -> DataFrame:
    """Uniqueness, nulls and white space of a key, in one aggregate."""
    k = F.col(key).cast("string")
    one = df.agg(F.count("*").alias("n"), (F.count(k) - F.count_distinct(k)).alias("dup"), F.count_if(k.isNull()).alias("nulls"), F.count_if(k.rlike(r"\s")).alias("blank"))
    parts = [_line(one, f"{name}: {what}", col, "ERROR", f"%d of %d rows {say}") for what, col, say in (("unique key", "dup", "repeat a key"), ("null key", "nulls", "have no key"), ("white space", "blank", "have white space in the key"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def completeness(df: DataFrame, columns: list[str], name: str, least: float = 0.5) -> DataFrame:
    """A row per column: WARN where fewer than ``least`` of the rows have a value."""
    one = df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])
    row = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").alias("k")) for c in columns]))
    share = F.col("x.k") / F.greatest(F.col("n"), F.lit(1))
    return one.select("n", row.alias("x")).select(F.when(share < least, "WARN").otherwise("OK").alias("level"), F.concat(F.lit(f"{name}: "), "x.c").alias("check"), F.format_string("%d of %d rows have a value", F.col("x.k"), F.col("n")).alias("detail"))


def overlap(left: DataFrame, key: str, right: DataFrame, right_key: str, name: str, least: float) -> DataFrame:
    """ERROR where fewer than ``least`` of the left keys are on the right."""
    have = right.select(F.col(right_key).alias(key)).distinct().withColumn("_h", F.lit(1))
    one = left.select(key).distinct().join(have, key, "left").agg(F.count("*").alias("n"), F.count("_h").alias("k"))
    return one.select(F.when(F.col("k") < least * F.col("n"), "ERROR").otherwise("OK").alias("level"), F.lit(f"{name}: key overlap").alias("check"), F.format_string("%d of %d keys found", "k", "n").alias("detail"))


def why_empty(name: str, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """One row: name, n_rows of the last of ``steps`` (label, table), and the first step that left nothing as the
    reason for an empty result, else null.  A count for each step, no row comes to the driver."""
    counts = None
    for k, (label, df) in enumerate(steps):
        one = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), F.lit(label).alias("label"), "n")
        counts = one if counts is None else counts.unionByName(one)
    first = F.min_by(F.when(F.col("n") == 0, F.concat(F.lit("no row left after: "), "label")), F.when(F.col("n") == 0, F.col("k")))
    return counts.agg(F.max_by("n", "k").alias("n_rows"), first.alias("reason")).select(F.lit(name).alias("name"), "n_rows", "reason")


def stage_plan(spark: SparkSession, stages: list[tuple[str, bool, str | None]]) -> DataFrame:
    """(stage, status, reason): disabled, waiting for what it names, or ready."""
    rows = [(s, "disabled" if not on else "waiting" if needs else "ready", needs or ("switched off" if not on else "inputs present")) for s, on, needs in stages]
    return values(spark, rows, "stage", "status", "reason")


def require_ok(report: DataFrame, strict: bool = False) -> DataFrame:
    bad = report.where(F.col("level").isin("ERROR", *(["WARN"] if strict else []))).collect()
    if bad:
        raise CheckFailed("; ".join(f"{r['level']} {r['check']}: {r['detail']}" for r in bad))
    return report


def banned_partition(partition: str, defining: list[str], tested: list[str]) -> None:
    """A partition may not be tested on the columns that define it."""
    if both := sorted(set(defining) & set(tested)):
        raise CheckFailed(f"partition {partition} is defined by columns {both} that it would be tested on")


def coverage_check(mapped: DataFrame, flag: str, least: float = 0.5) -> DataFrame:
    r = mapped.agg(F.avg(F.col(flag).cast("double")).alias("s")).first()["s"] or 0.0
    if r < least:
        raise CheckFailed(f"only {r:.0%} of the columns map; at least {least:.0%} must")
    return mapped


def spot_check(df: DataFrame, ok: str, fraction: float, seed: int, name: str) -> DataFrame:
    """A report row from a seeded sample (sampling is the feature): WARN where a sampled row fails."""
    one = df.sample(fraction=fraction, seed=seed).agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("bad"))
    return _line(one, f"{name}: spot check", "bad", "WARN", "%d of %d sampled rows fail")


def seed_checks(seeds: DataFrame, priors: dict[str, int | None], tolerance: int) -> DataFrame:
    """``seeds``: name, family, anchor, next (null where unassigned), candidates (gaps to later
    residues).  ERROR where a family's prior would discard a seed of its own: the assigned gap,
    or every candidate gap, lies outside it.  A family without a prior admits all."""
    prior = F.lit(None).cast("int")
    for family, gap in priors.items():
        prior = F.when(F.col("family") == family, F.lit(gap).cast("int")).otherwise(prior)
    gap = F.col("next") - F.col("anchor")
    inside = lambda g: F.abs(g - prior) <= tolerance
    admitted = F.when(prior.isNull(), True).when(gap.isNotNull(), inside(gap)).otherwise(F.exists("candidates", inside))
    return seeds.select(F.when(F.coalesce(admitted, F.lit(False)), "OK").otherwise("ERROR").alias("level"), F.concat(F.lit("seed: "), "name").alias("check"), F.when(F.coalesce(admitted, F.lit(False)), "found by its family's spacing").otherwise("its family's spacing would discard it").alias("detail"))


def structure_identity(pairs: DataFrame, least: float = 0.9) -> DataFrame:
    """``pairs``: residue of the structure and of the sequence at each mapped column.  Raises
    where they agree in fewer than ``least`` of the columns: the wrong structure was given."""
    r = pairs.agg(F.avg((F.col("structure") == F.col("sequence")).cast("double")).alias("s")).first()["s"] or 0.0
    if r < least:
        raise CheckFailed(f"structure and sequence agree in {r:.0%} of the mapped columns; {least:.0%} are wanted")
    return pairs
