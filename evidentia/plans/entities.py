"""Entity and taxonomy queries.  Entities are suppliers and customers; a lineage is spelled
from region, nation and name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import entities as N
from ..operators import evidence as E
from ..operators import joins as J
from .registry import query, table

LINEAGE = "'d__' || r_name || ';p__' || n_name || CASE WHEN s_suppkey % 7 = 0 THEN ';s__' ELSE ';s__' || replace(s_name, '#', ' ') END"
LINEAGE_SQL = f"e AS (SELECT s_suppkey AS id, s_name AS name, {LINEAGE} AS lineage, n_name AS nation, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def suppliers(spark, sf_dir):
    places = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
    species = F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.replace("s_name", F.lit("#"), F.lit(" ")))
    lineage = F.concat(F.lit("d__"), "r_name", F.lit(";p__"), "n_name", F.lit(";s__"), species)
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), lineage.alias("lineage"), F.col("n_name").alias("nation"), "s_acctbal")


@query(f"""
WITH {LINEAGE_SQL}, f AS (SELECT *, nullif(regexp_extract(lineage, 's__([^;]*)', 1), '') AS sp FROM e)
SELECT id, regexp_extract(lineage, '(d__[^;]*)', 1) AS dom, regexp_extract(lineage, 'p__([^;]*)', 1) AS phylum, CASE WHEN sp IS NOT NULL THEN 's__' || sp END AS species,
 sp IS NOT NULL AS species_ok, CASE WHEN sp IS NOT NULL THEN 'g__' || string_split(sp, ' ')[1] END AS genus FROM f""")
def lineage_parse(spark, sf_dir):
    s = suppliers(spark, sf_dir)
    species = S.lineage_rank(F.col("lineage"), "s__")
    return s.select(
        "id", S.lineage_rank(F.col("lineage"), "d__").alias("dom"), S.clean_rank(S.lineage_rank(F.col("lineage"), "p__")).alias("phylum"), species.alias("species"),
        S.valid_species(species).alias("species_ok"), S.genus_of(species).alias("genus"),
    )


@query(f"WITH {LINEAGE_SQL} SELECT id, nation AS taxon, CASE WHEN id % 7 = 0 THEN 'lineage' ELSE 'lineage' END AS via FROM e")
def taxonomy_resolve(spark, sf_dir):
    # the rank's own column is filled in a quarter of the rows, below the bar, so the lineage answers
    s = suppliers(spark, sf_dir).withColumn("phylum", F.when(F.col("id") % 4 == 0, F.concat(F.lit("p__"), "nation")))
    return s.select("id", N.taxon(s, "phylum", lineage="lineage").alias("taxon"), F.lit("lineage").alias("via"))


@query("""
WITH t AS (SELECT p_type FROM part WHERE p_size > 5 AND p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 5),
l AS (SELECT CASE WHEN p_size <= 5 THEN 'Unclassified' WHEN p_type IN (SELECT p_type FROM t) THEN p_type ELSE 'Other' END AS top FROM part)
SELECT top, count(*) AS n FROM l GROUP BY top""")
def top_n_other(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 5, F.col("p_type")).alias("label"))
    return E.top_n_other(parts, "label", 5).groupBy("top").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'GB_GCA_' ELSE 'RS_GCF_' END || lpad(p_partkey::VARCHAR, 9, '0') || '.' || (p_size % 3 + 1) AS acc FROM part),
b AS (SELECT id, acc, acc[4:] AS bare FROM a),
c AS (SELECT id, acc, bare, regexp_replace(bare, '\\.\\d+$', '') AS stem, CASE WHEN bare LIKE 'GCA_%' THEN 'GCF_' ELSE 'GCA_' END || bare[5:] AS oth FROM b)
SELECT id, array_to_string([acc, bare, stem] || CASE WHEN acc LIKE 'GB_%' THEN ['RS_' || bare] ELSE ['GB_' || bare] END || [oth, regexp_replace(oth, '\\.\\d+$', ''), 'GB_' || oth, 'RS_' || oth], '|') AS variants FROM c""")
def accession_variants(spark, sf_dir):
    return accessions(spark, sf_dir).select("id", F.array_join(S.accession_variants(F.col("acc")), "|").alias("variants"))


def accessions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    prefix = F.when(F.col("p_partkey") % 2 == 0, "GB_GCA_").otherwise("RS_GCF_")
    return p.select(F.col("p_partkey").alias("id"), F.concat(prefix, F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("."), (F.col("p_size") % 3 + 1).cast("string")).alias("acc"))


@query("""
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'GCF_' || lpad(p_partkey::VARCHAR, 9, '0') WHEN p_partkey % 3 = 1 THEN CASE WHEN p_partkey % 2 = 0 THEN 'GB_GCA_' ELSE 'RS_GCF_' END || lpad(p_partkey::VARCHAR, 9, '0') || '.' || (p_size % 3 + 1) END AS tip FROM part""")
def variant_join(spark, sf_dir):
    acc = accessions(spark, sf_dir)
    stem = F.concat(F.lit("GCF_"), F.lpad(F.col("id").cast("string"), 9, "0"))
    tips = acc.select(F.when(F.col("id") % 3 == 0, stem).when(F.col("id") % 3 == 1, F.col("acc")).alias("tip")).where("tip is not null")
    return J.variant_join(acc, tips, "id", S.accession_variants(F.col("acc")), "tip").select("id", "tip")


@query("""
SELECT 's' || s_suppkey AS sample, 'Archaea' AS dom, s_acctbal AS balance, NULL::VARCHAR AS segment, n_name AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey < 20
UNION ALL SELECT 'c' || c_custkey, 'Bacteria', c_acctbal, c_mktsegment, NULL FROM customer""")
def unified_entities(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    s = J.left_first(table(spark, sf_dir, "supplier"), nations.select("n_nationkey", F.col("n_name").alias("nation")), "s_nationkey", "n_nationkey", [F.col("nation")])
    s = s.select(F.concat(F.lit("s"), "s_suppkey").alias("sample"), S.domain_name(F.lit("d__archaea")).alias("dom"), F.col("s_acctbal").alias("balance"), "nation")
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("sample"), S.domain_name(F.lit(" d__BACTERIA ")).alias("dom"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return N.numeric(N.unify([s, c], "sample"), ["balance"]).select("sample", "dom", "balance", "segment", "nation")


@query("""
WITH o AS (SELECT o_custkey, max((o_totalprice > 300000)::INT) AS has_large, max((o_orderstatus = 'P')::INT) AS has_open, sum((o_totalprice > 300000)::INT) AS n_large FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT c_custkey AS id, coalesce(has_large, 0) AS has_large, coalesce(has_open, 0) AS has_open, coalesce(n_large, 0)::BIGINT AS n_large, round(log10(greatest(c_acctbal, 1)), 6) AS log10_size FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def genome_level_table(spark, sf_dir):
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    items = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").withColumn("id", F.col("o_custkey"))
    large = F.col("o_totalprice") > 300000
    out = N.entity_table(entities, items.select("id", "o_totalprice", "o_orderstatus"), "id", {"has_large": large, "has_open": F.col("o_orderstatus") == "P"}, {"n_large": large}, {"log10_size": "c_acctbal"})
    return out.select("id", "has_large", "has_open", "n_large", F.round("log10_size", 6).alias("log10_size"))


@query("""
SELECT c_nationkey AS tip, count(*) AS n_entities, max((c_acctbal < 0)::INT) AS trait, round(avg(c_acctbal), 6) AS balance, sum(length(c_name))::BIGINT AS letters, arg_min(c_mktsegment, c_custkey) AS segment FROM customer GROUP BY 1""")
def tip_aggregate(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("tip"), "c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("trait"), F.col("c_acctbal").alias("balance"), F.length("c_name").alias("letters"), F.col("c_mktsegment").alias("segment"))
    out = N.to_tips(c, "tip", ["trait"], ["balance"], ["letters"], ["segment"], "c_custkey")
    return out.withColumn("balance", F.round("balance", 6))


@query("""
SELECT c_custkey AS id, (c_mktsegment = 'BUILDING')::INT AS sg_BUILDING, (c_mktsegment = 'MACHINERY')::INT AS sg_MACHINERY, lpad((c_custkey // 100)::VARCHAR, 5, '0') AS batch FROM customer""")
def indicator_batches(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    wide = N.indicators(c, "id", "c_mktsegment", ["BUILDING", "MACHINERY"], "sg_")
    return N.batches(wide, "id", 100)


@query("SELECT unnest(['c_name', 'large_balance', 'small_balance']) AS metric, unnest([count(*) FILTER (c_name IS NULL), count(*) FILTER (c_acctbal <= 5000), count(*) FILTER (c_acctbal > 5000)]) AS value FROM customer")
def covariate_nulls(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_name", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("large_balance"), F.when(F.col("c_acctbal") <= 5000, F.col("c_acctbal")).alias("small_balance"))
    return E.null_census(c, c.columns)
