"""Round trips through text formats, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.staging import folder
from ..sources import sinks as K
from ..sources import text as X
from .registry import query, table
from .screen import CLEAN_SQL


@query(f"SELECT doc_id::VARCHAR AS seq_id, length(s) AS n, md5(s) AS digest FROM (SELECT doc_id, {CLEAN_SQL} AS s FROM documents) WHERE s IS NOT NULL")
def fasta_roundtrip(spark, sf_dir):
    """Written as wrapped FASTA to the shared folder and read back."""
    path = f"{folder(spark)}/fasta-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(" some words")).alias("name"), S.clean_sequence(F.col("text")).alias("s")).where("s is not null")
    K.fasta(docs, "name", "s", path)
    read = X.fasta(spark, path)
    return read.select(X.first_token(F.col("header")).alias("seq_id"), F.length("seq").alias("n"), F.md5("seq").alias("digest"))


@query("""SELECT l_returnflag AS profile, 'p' || l_partkey AS protein_id, 'g' || l_suppkey AS sample, count(*) AS n, round(max(l_quantity), 3) AS best FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL""")
def match_report_parse(spark, sf_dir):
    """Match rows spelled as report lines and parsed again; a threshold holds on both scores."""
    li = table(spark, sf_dir, "lineitem")
    word = lambda c: F.col(c).cast("string")
    fields = [F.concat(F.lit("b1_s"), word("l_orderkey")), F.lit("-"), F.lit("100"), word("l_returnflag"), F.lit("-"), F.lit("60"), F.lit("1e-9"), word("l_quantity"), F.lit("0.1"), word("l_linenumber"), F.lit("7"), F.lit("1e-8"), F.lit("1e-7"), word("l_quantity"), F.lit("0.0"), *[F.lit(str(k)) for k in (1, 50, 3, 60, 2, 61)], F.lit("0.9")]
    line = F.concat_ws("  ", *fields, F.concat(F.lit("p"), word("l_partkey"), F.lit(" g"), word("l_suppkey")))
    rows = X.match_rows(li.select(line.alias("value"), "l_returnflag"))
    hits = X.typed_hits(rows, "any", 25.0)
    return hits.groupBy(F.col("l_returnflag").alias("profile"), "protein_id", "sample").agg(F.count("*").alias("n"), F.round(F.max("dom_score").cast("double"), 3).alias("best"))
