"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and reads nothing of its predecessors but ``docs``;
all but the last return the columns of ``documents``.

- quality: rows that a rule rejects go.
- line_dedup: lines found in 10 documents or more go from every document; n_chars follows.
- near_dedup: of documents linked at 0.75 the one with the least doc_id stays, once.
- decontamination: rows that overlap the benchmark by the 13-word rule go.
- packing: pieces of at most 2048 tokens with their places in sequences.

Null doc_ids are never taken for copies of each other; rows that repeat a doc_id are one
document to near_dedup, which keeps one of them, the same in every run.  Empty tables pass through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import contamination, lines, near, packing
from evidentia.llm import quality as rules
from evidentia.llm.common import fresh, staged, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_lines, dropped = fresh(docs, "_n_lines", "_dropped")
    out = lines.apply(docs, lines.keep_bitmaps(docs, mode="common", min_docs=10), counts=(n_lines, dropped))
    n = F.when(F.col(dropped) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, least, node = fresh(docs, "_own", "_least", "_node")
    # of several rows with one doc_id the one with the least hash stays, in any run
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    first = docs.groupBy(F.col("doc_id").alias(node)).agg(F.min(row).alias(least))
    kept = near.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias(node)).distinct()
    # not an equality: the join stays on doc_id alone, so that one shuffle of texts does for both
    once = docs.withColumn(own, row).join(first.join(kept, node), F.col("doc_id") == F.col(node)).where(F.col(own) <= F.col(least))
    return once.dropDuplicates(["doc_id"]).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    node, th = fresh(docs, "_node", "_th")
    found = contamination.contaminated(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    found = staged(found.select(F.col("doc_id").alias(node), F.col("th").alias(th)))
    same = F.col("doc_id").eqNullSafe(F.col(node)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(th))
    return docs.join(found, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, window=2048, end_id=1)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
