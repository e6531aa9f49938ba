"""Gene order, block synteny, and calls on a pathway from markers, taxonomy and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import small

ROLES = ("muramyl_ligase", "mray_like", "cps")
#: Orders whose walls have the polymer.
EXPECTED_ORDERS = ("o__Methanobacteriales", "o__Methanopyrales")
#: Marker catalogue, name fragment to role.
LIGASES = ("OG0001148", "OG0001149", "OG0001150", "OG0001473", "Muralpha", "Murbeta", "Murgamma", "Murdelta")
MRAY = ("OG0001163", "MraY_like")
CPS = ("OG0001014", "CPS_OG1014")
#: Widespread families that share a domain with the markers.
TRAPS = ("MurT", "CapB", "CphA", "FPGS")


def gene_order(genes: DataFrame, entity: str, contig: str, start: str, ties: list[str]) -> DataFrame:
    """Adds ``order``: place of a gene on its contig, from 0."""
    return genes.withColumn("order", F.row_number().over(W.partitionBy(entity, contig).orderBy(start, *ties)) - 1)


def marker_role(name: Column, override: dict[str, str] | None = None) -> Column:
    """ligase / mray / cps / trap / other: the override, then traps, then the catalogue."""
    role = F.lit("other")
    for kind, names in (("cps", CPS), ("mray", MRAY), ("ligase", LIGASES), ("trap", TRAPS)):
        role = F.when(F.coalesce(*[F.when(F.contains(F.lower(name), F.lit(n.lower())), True) for n in names], F.lit(False)), kind).otherwise(role)
    for n, kind in (override or {}).items():
        role = F.when(name == n, kind).otherwise(role)
    return role


def block_synteny(hits: DataFrame, coords: DataFrame, contigs: DataFrame, entity: str, item: str, window_genes: int = 12, max_contigs: int = 200) -> DataFrame:
    """``hits``: entity, item, role; ``coords``: entity, item, contig, start, end, order;
    ``contigs``: entity, n_contigs (null: unknown).  Per entity with hits: status, contig, span
    in genes and bases of the tightest contig that has every role."""
    placed = hits.join(coords, [entity, item], "left")
    have = placed.groupBy(entity).agg(*[F.count_if((F.col("role") == r) & F.col("contig").isNotNull()).alias(f"_{r}") for r in ROLES], F.count_if(F.col("contig").isNull()).alias("n_missing"))
    on = placed.where("contig is not null").groupBy(entity, "contig").agg(
        F.count_distinct("role").alias("_roles"), (F.max("order") - F.min("order")).alias("span_genes"), (F.max("end") - F.min("start")).alias("span_bp")
    )
    best = on.where(F.col("_roles") == len(ROLES)).groupBy(entity).agg(F.min_by(F.struct("contig", "span_genes", "span_bp"), F.struct("span_genes", "contig")).alias("b"))
    out = have.join(best, entity, "left").join(contigs, entity, "left")
    all_roles = (F.col(f"_{ROLES[0]}") > 0) & (F.col(f"_{ROLES[1]}") > 0) & (F.col(f"_{ROLES[2]}") > 0)
    near = F.coalesce(F.col("b.span_genes") <= window_genes, F.lit(False))
    n = F.col("n_contigs")
    status = F.when(~all_roles, "not_evaluable").when(near, "syntenic").when(n.isNull() | (n > max_contigs), "not_evaluable").otherwise("dispersed")
    reason = (
        F.when(~all_roles, F.format_string("a role has no place; %d hits without coordinates", "n_missing"))
        .when(near, F.format_string("all roles on %s within %d genes", F.col("b.contig"), F.col("b.span_genes")))
        .when(n.isNull(), "number of contigs unknown: apart or broken can't be told")
        .when(n > max_contigs, F.format_string("%d contigs: apart or broken can't be told", n))
        .otherwise(F.coalesce(F.format_string("tightest contig spans %d genes", F.col("b.span_genes")), F.lit("never all on one contig")))
    )
    return out.select(entity, status.alias("status"), F.when(all_roles, F.col("b.contig")).alias("contig"), F.when(all_roles, F.col("b.span_genes")).alias("span_genes"), F.when(all_roles, F.col("b.span_bp")).alias("span_bp"), reason.alias("reason"))


def marker_presence(scores: DataFrame, models: DataFrame, entity: str, floor: float) -> DataFrame:
    """``scores``: entity, model, score; ``models``: model, cutoff (null: ``floor``).  Per entity
    and model: best score, and whether it meets the model's own bar."""
    low = F.least(F.lit(floor), F.coalesce(F.col("_least"), F.lit(floor)))
    m = models.withColumn("cutoff", F.coalesce("cutoff", F.lit(floor))).crossJoin(models.agg(F.min("cutoff").alias("_least")))
    rows = scores.join(small(m), "model").where(F.col("score") >= low)
    return rows.groupBy(entity, "model").agg(F.max("score").alias("best_score"), F.max((F.col("score") >= F.col("cutoff")).cast("int")).alias("present"))


def pathway_calls(genomes: DataFrame, ligases: list[str], mray: list[str], cps: list[str], order: Column, completeness: str, min_markers: int = 3, permissive: Column | None = None) -> DataFrame:
    """``genomes`` has a 0/1 column per marker.  Taxonomy first; the block of all three roles
    flags candidates elsewhere."""
    total = lambda names: sum((F.col(n) for n in names), F.lit(0))
    g = genomes.withColumn("n_markers", total([*ligases, *mray, *cps])).withColumn("n_ligases", total(ligases))
    g = g.withColumn("expected_by_taxonomy", F.coalesce(order.isin(*EXPECTED_ORDERS), F.lit(False)).cast("int"))
    block = (F.col("n_ligases") >= 1) & (total(mray) >= 1) & (total(cps) >= 1)
    g = g.withColumn("block_present", block.cast("int")).withColumn("count_pathway", (F.col("n_markers") >= min_markers).cast("int"))
    call = (
        F.when(F.col("expected_by_taxonomy") == 1, "expected_by_taxonomy")
        .when(F.col("block_present") == 1, "candidate_out_of_order")
        .when(F.col("n_markers") > 0, "markers_without_block")
        .when(F.col(completeness) < 90, "indeterminate_low_completeness")
        .otherwise("no_pathway_detected")
    )
    return g.withColumn("pathway_call", call)


def refine_calls(calls: DataFrame, strict: DataFrame, permissive: DataFrame, entity: str) -> DataFrame:
    """Order refines a strict candidate's call in every case; it alone raises an entity whose
    block shows under the permissive bar only, and only where it is syntenic."""
    s = strict.select(entity, F.col("status").alias("_s"))
    p = permissive.select(entity, F.col("status").alias("_p"))
    out = calls.join(s, entity, "left").join(p, entity, "left")
    is_strict = F.col("pathway_call") == "candidate_out_of_order"
    raised = (F.col("expected_by_taxonomy") == 0) & (F.col("block_present") == 0) & (F.col("_p") == "syntenic")
    suffix = F.when(F.col("_s") == "syntenic", "_syntenic").when(F.col("_s") == "dispersed", "_dispersed").otherwise("_synteny_unknown")
    refined = F.when(is_strict, F.concat("pathway_call", suffix)).when(raised, "candidate_out_of_order_divergent_syntenic").otherwise(F.col("pathway_call"))
    tier = F.when(is_strict, "strict").when((F.col("expected_by_taxonomy") == 0) & (F.col("block_present") == 0) & F.col("_p").isNotNull(), "divergent")
    return out.withColumn("synteny_tier", tier).withColumn("pathway_call", refined).drop("_s", "_p")
