"""Literature tables as small dimension tables, and the rules that read them.

Tables are VALUES relations, so they cost no Python on executors and are always broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import genus_of

# Wall chemistry by species: residue at P1, at P1', level of evidence.
CHEMISTRY = [
    ("s__Methanobrevibacter ruminantium", "Thr", "Lys", "type_strain"),
    ("s__Methanobrevibacter smithii", "Ala", "Lys/Orn", "type_strain"),
    ("s__Methanobrevibacter arboriphilus", "Ala", "Lys", "species"),
    ("s__Methanobacterium formicicum", "Ala", "Lys", "species"),
    ("s__Methanobacterium bryantii", "Ala", "Lys", "strain"),
    ("s__Methanothermobacter thermautotrophicus", "Ala", "Lys", "species"),
]
# Species without the wall polymer; species whose chemistry is only claimed.
NO_SACCULUS = ["s__Methanospirillum hungatei", "s__Methanospirillum hungatii"]
DISPUTED = ["s__Methanosphaera stadtmanae", "s__Methanopyrus kandleri"]
# Residues that the enzymes accept and reject at P1; walls without the polymer.
ACCEPTED, REJECTED = ["Ala", "Ser"], ["Thr"]
OTHER_WALLS = ["glycoprotein", "methanochondroitin", "no_pseudomurein", "protein_sheath"]
# Measured lysis: strain, species, wall, by the first enzyme, by the second, verified.
PANEL = [
    ("M. thermautotrophicus dH", "s__Methanothermobacter thermautotrophicus", "pseudomurein", "lysed", "lysed", True),
    ("Methanobrevibacter ruminantium M1", "s__Methanobrevibacter ruminantium", "pseudomurein", "not_lysed", "not_lysed", True),
    ("Methanobrevibacter sp. SM9", None, "pseudomurein", "lysed", "not_lysed", True),
    ("Methanosphaera stadtmanae", "s__Methanosphaera stadtmanae", "pseudomurein", "lysed", "lysed", False),
    ("strain 31A", None, "pseudomurein", "lysed", "lysed", False),
    ("strain BRM9", None, "pseudomurein", "lysed", "lysed", False),
    ("no-pseudomurein control (glycoprotein)", None, "glycoprotein", "not_lysed", "not_lysed", True),
    ("Methanosarcina sp. CM1", None, "methanochondroitin", "not_lysed", "not_lysed", True),
]
ENZYMES = ("PeiW", "PeiP")
# Residue-pair classes, in order: residues at the first and second position.
PAIR_CLASSES = [("I", "V", "C"), ("II", "V", "V"), ("III", "TS", "I"), ("IV", "A", "MW")]


def literal(v) -> str:
    if v is None:
        return "cast(null as string)"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "\\'") + "'"


def values(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    body = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")


def wall_chemistry(df: DataFrame, species: str = "species", chemistry: DataFrame | None = None) -> DataFrame:
    """Adds p1, p1_prime, p1_source: no sacculus, disputed, the species itself, its genus where
    all that is known of it agrees, or unknown."""
    spark = df.sparkSession
    chem = chemistry if chemistry is not None else values(spark, CHEMISTRY, "_sp", "_p1", "_p1p", "_level")
    by_genus = chem.groupBy(genus_of(F.col("_sp")).alias("_g")).agg(F.count_distinct("_p1", "_p1p").alias("_kinds"), F.min("_p1").alias("_g1"), F.min("_p1p").alias("_g1p"))
    out = df.withColumn("_genus", genus_of(F.col(species)))
    out = out.join(F.broadcast(chem), F.col(species) == F.col("_sp"), "left").join(F.broadcast(by_genus), F.col("_genus") == F.col("_g"), "left")
    s = F.col(species)
    kind = (
        F.when(s.isNull(), "none").when(s.isin(NO_SACCULUS), "literature_species").when(s.isin(DISPUTED), "disputed")
        .when(F.col("_sp").isNotNull(), F.concat(F.lit("literature_"), F.col("_level"))).when(F.col("_kinds") == 1, "literature_genus_homogeneous")
        .when(F.col("_kinds") > 1, "genus_heterogeneous").otherwise("none")
    )
    pick = lambda own, shared: F.when(s.isin(NO_SACCULUS), "no_pseudomurein").when(kind == "disputed", "unsupported").when(kind == "literature_genus_homogeneous", F.col(shared)).when(kind.startswith("literature_"), F.col(own)).otherwise("unknown")
    return out.select(*df.columns, pick("_p1", "_g1").alias("p1"), pick("_p1p", "_g1p").alias("p1_prime"), kind.alias("p1_source"))


def predict_lysis(p1: Column, wall: Column) -> Column:
    """The wall decides first, then the residue."""
    return F.when(wall.isin(OTHER_WALLS), "not_lysed").when(p1.isin(ACCEPTED), "lysed").when(p1.isin(REJECTED), "not_lysed").otherwise("unknown")


def rule_vs_measured(spark: SparkSession, panel: list[tuple] | None = None, verified_only: bool = True, chemistry: DataFrame | None = None) -> DataFrame:
    """(strain, enzyme, wall, p1, observed, predicted, agrees, nontrivial): agrees is null where
    nothing is predicted; only rows with the polymer can falsify the rule."""
    rows = values(spark, panel or PANEL, "strain", "species", "wall", *ENZYMES, "verified")
    rows = rows.where("verified") if verified_only else rows
    rows = wall_chemistry(rows, "species", chemistry)
    long = rows.select("strain", "wall", "p1", "p1_source", F.explode(F.array(*[F.struct(F.lit(e).alias("enzyme"), F.col(e).alias("observed")) for e in ENZYMES])).alias("e")).select("strain", "e.enzyme", "wall", "p1", "p1_source", "e.observed")
    long = long.withColumn("predicted", predict_lysis(F.col("p1"), F.col("wall")))
    return long.withColumn("agrees", F.when(F.col("predicted") != "unknown", F.col("predicted") == F.col("observed"))).withColumn("nontrivial", F.col("wall") == "pseudomurein")


def agreement(scored: DataFrame) -> DataFrame:
    """One row: testable, agreeing, and the same among rows that can falsify."""
    ok = F.coalesce("agrees", F.lit(False))
    return scored.agg(F.count("agrees").alias("n_testable"), F.count_if(ok).alias("n_agree"), F.count_if(F.col("nontrivial") & F.col("agrees").isNotNull()).alias("n_nontrivial"), F.count_if(F.col("nontrivial") & ok).alias("n_nontrivial_agree"))


def residue_class(first: Column, second: Column, classes: list[tuple[str, str, str]] | None = None) -> Column:
    """The first class whose residues hold both, else ``unassigned``."""
    out = F.lit("unassigned")
    for name, a, b in reversed(classes or PAIR_CLASSES):
        out = F.when(first.isin(*a) & second.isin(*b), name).otherwise(out)
    return out


def spacing_candidates(seq: Column, anchor: Column, residue: str, gap: int | None = None, tolerance: int = 0) -> Column:
    """Gaps from a 1-based anchor to each later ``residue``, only those within ``gap`` ± tolerance
    where a gap is given."""
    places = F.transform(F.filter(F.sequence(F.lit(1), F.length(seq)), lambda i: (i > anchor) & (F.substring(seq, i, F.lit(1)) == residue)), lambda i: i - anchor)
    return places if gap is None else F.filter(places, lambda g: F.abs(g - gap) <= tolerance)
