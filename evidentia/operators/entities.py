"""Entities from several sources, their taxonomy, and tables at entity level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .joins import CheckFailed, flagged, left_one_to_one, require_unique, variant_join


def resolve_column(columns: list[str], candidates: list[str], required: bool = False) -> str | None:
    """The first candidate that a table has, whatever its case."""
    have = {c.lower(): c for c in reversed(columns)}
    found = next((have[c.lower()] for c in candidates if c.lower() in have), None)
    if required and not found:
        raise CheckFailed(f"none of {candidates} among {columns}")
    return found


def best_overlap_key(left: DataFrame, key: str, right: DataFrame, candidates: list[str]) -> tuple[str | None, int]:
    """The candidate column of ``right`` whose values cover most of ``left``'s keys: one scan
    of each side, whatever the number of candidates."""
    ids = left.select(F.col(key).cast("string").alias("v")).distinct()
    long = right.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(candidates)])).alias("x")).select("x.i", "x.v").distinct()
    got = {r["i"]: r["n"] for r in long.join(ids, "v").groupBy("i").agg(F.count("*").alias("n")).collect()}
    best = max(range(len(candidates)), key=lambda i: (got.get(i, 0), -i), default=None)
    return (candidates[best], got.get(best, 0)) if best is not None and got.get(best, 0) else (None, 0)


def unify(sources: list[DataFrame], key: str) -> DataFrame:
    """Union by name with nulls for what a source lacks; the key must be unique throughout."""
    out = sources[0]
    for df in sources[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return require_unique(out, [key], "unified table")


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})


def taxon(df: DataFrame, rank: str, explicit: str | None = None, min_populated: float = 0.5, lineage: str = "classification") -> Column:
    """Where to read a rank: the explicit column, ``gtdb_<rank>``, ``<rank>`` if at least
    ``min_populated`` of its rows have a value, else the lineage."""
    if explicit and explicit in df.columns:
        return S.clean_rank(F.col(explicit))
    for name in (f"gtdb_{rank}", rank):
        if name in df.columns:
            share = df.agg(F.avg(S.clean_rank(F.col(name)).isNotNull().cast("double"))).first()[0] or 0.0
            if share >= min_populated:
                return S.clean_rank(F.col(name))
    if lineage in df.columns:
        return S.clean_rank(S.lineage_rank(F.col(lineage), rank[0] + "__"))
    return F.lit(None).cast("string")


def resolve_tips(entities: DataFrame, tips: DataFrame, mode: str, representatives: DataFrame | None = None) -> DataFrame:
    """``entities``: sample, species; ``tips``: tip.  Adds ``tree_tip`` by identity, accession
    variants, species, or the species representative's accession where one's own has none."""
    names = tips.select("tip").distinct()
    if mode == "identity":
        return entities.join(names, F.col("sample") == F.col("tip"), "left").withColumnRenamed("tip", "tree_tip")
    if mode == "gtdb_species":
        ok = F.when(S.valid_species(F.col("species")), F.col("species"))
        return entities.join(names, ok == F.col("tip"), "left").withColumnRenamed("tip", "tree_tip")
    own = variant_join(entities, names, "sample", S.accession_variants(F.col("sample")), "tip").withColumnRenamed("tip", "tree_tip")
    if mode == "gtdb_accession":
        return own
    reps = representatives.where(S.valid_species(F.col("species"))).groupBy("species").agg(F.min("accession").alias("_acc"))
    via = variant_join(reps, names, "species", S.accession_variants(F.col("_acc")), "tip").select(F.col("species").alias("_sp"), F.col("tip").alias("_rep_tip"))
    out = own.join(via, F.col("species") == F.col("_sp"), "left")
    return out.withColumn("tree_tip", F.coalesce("tree_tip", "_rep_tip")).drop("_sp", "_rep_tip")


def tip_match_report(resolved: DataFrame, n_tips: int, min_rate: float = 0.0) -> DataFrame:
    out = resolved.agg(F.count("*").alias("n_samples"), F.count("tree_tip").alias("n_matched"), F.count_distinct("tree_tip").alias("n_distinct_tips_used"))
    if min_rate and (r := out.first()) and r["n_samples"] and r["n_matched"] / r["n_samples"] < min_rate:
        raise CheckFailed(f"only {r['n_matched']} of {r['n_samples']} samples have a tip")
    return out.withColumn("n_tips_in_tree", F.lit(n_tips)).withColumn("frac_matched", F.col("n_matched") / F.col("n_samples")).withColumn("genomes_per_tip", F.col("n_matched") / F.col("n_distinct_tips_used"))


def entity_table(entities: DataFrame, items: DataFrame, key: str, flags: dict[str, Column], counts: dict[str, Column], covariates: dict[str, str]) -> DataFrame:
    """One row per entity: 0/1 flags and counts over its items, log10 covariates (null stays)."""
    per = items.groupBy(key).agg(*[F.max(e.cast("int")).alias(k) for k, e in flags.items()], *[F.sum(e.cast("int")).alias(k) for k, e in counts.items()])
    out = left_one_to_one(entities, per, [key])
    out = out.withColumns({k: F.coalesce(k, F.lit(0)) for k in (*flags, *counts)})
    return out.withColumns({new: S.log10_floor(F.col(old)) for new, old in covariates.items()})


def to_tips(entities: DataFrame, tip: str, flags: list[str], means: list[str], sums: list[str], firsts: list[str], order: str) -> DataFrame:
    """One row per tip: flag if any, mean, sum, value of the first entity."""
    return entities.where(F.col(tip).isNotNull()).groupBy(tip).agg(
        F.count("*").alias("n_entities"), *[F.max(c).alias(c) for c in flags], *[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums], *[F.min_by(c, order).alias(c) for c in firsts]
    )


def indicators(df: DataFrame, key: str, label: str, values: list[str], prefix: str) -> DataFrame:
    """0/1 column for each of a stated list of labels."""
    wide = df.groupBy(key).pivot(label, values).agg(F.lit(1))
    return wide.select(key, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(prefix + v) for v in values])


def batches(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    """Zero-padded batch number of ``size`` rows each, by a row's ordinal (from 0)."""
    return df.withColumn("batch", F.lpad(F.floor(F.col(ordinal) / size).cast("string"), 5, "0"))


__all__ = ["batches", "best_overlap_key", "entity_table", "flagged", "indicators", "numeric", "resolve_column", "resolve_tips", "taxon", "tip_match_report", "to_tips", "unify"]
