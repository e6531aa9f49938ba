"""Line dedup: range-partitioned line hashes in, per-document keep bitmaps out.

Lines are reduced to (hash, document, position) entries, which are staged once; texts are
not shuffled to find repeats.  Entries are range-partitioned by (hash, document) and sorted
by position within them, so a line that fills a third of the corpus spreads over many
partitions; each partition streams one row per hash and document, and a partial aggregate
leaves one row per hash and partition.  What is returned per document is a keep bitmap:
64 lines to a word, and only words with a dropped line are present.

Modes: ``first`` keeps the first occurrence (least document, then position) of each line;
``common`` drops every occurrence of a line found in ``min_docs`` documents or more.

Defined cases: null or empty text is one empty line; lines that are blank after stripping
have no key and stay; rows of one doc_id are one document when documents are counted; rows
that repeat (doc_id and text) are treated alike; null doc_ids are one document; an empty
table gives no rows; other columns are ignored by ``keep_bitmaps`` and kept by ``apply``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, ascii_lower, fresh, staged


def _body(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def split_lines(body: Column) -> Column:
    return F.split(body, "\n", -1)


def entries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line with a key: two hashes of the key, document, text hash, position."""
    lines = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _body(text).alias("_body"))
    lines = lines.select("doc_id", F.xxhash64("_body").alias("th"), F.posexplode(split_lines(F.col("_body"))).alias("pos", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACES))).where("line != ''")
    key = ascii_lower(F.col("line"))
    return lines.select(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"), "doc_id", "th", "pos")


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mode: str = "common", min_docs: int = 10) -> DataFrame:
    """Rows (doc_id, th, n_dropped, keep) of documents that lose a line."""
    seen = staged(entries(docs, doc_id, text))
    ranged = seen.repartitionByRange("h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    per_doc = ranged.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    per_hash = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))
    if mode == "common":
        decided = per_hash.where(F.col("docs") >= min_docs)
    else:
        decided = per_hash.where(F.col("n") > 1)
    # a table of its own: the join may then split a line that fills many tasks
    decided = staged(decided.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first"))
    hit = seen.join(decided, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    if mode != "common":
        hit = hit.where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
    words = hit.groupBy("doc_id", "th", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("doc_id", "th").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("kept")))).alias("keep"),
    )


def kept_lines(body: Column, keep: Column) -> Column:
    """The lines of ``body`` whose bit is set; a word that is absent keeps all."""
    bit = lambda i: F.coalesce(F.try_element_at(keep, (i / 64).cast("int")), F.lit(-1).cast("long"))
    lines = F.filter(split_lines(body), lambda _, i: F.expr("1L") == F.call_function("shiftrightunsigned", bit(i), i % 64).bitwiseAND(F.lit(1).cast("long")))
    return F.when(keep.isNull(), body).otherwise(F.array_join(lines, "\n"))


def apply(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("_n_lines", "_dropped")) -> DataFrame:
    """``docs`` with dropped lines taken out of ``text``, and two last columns, named ``counts``:
    lines before dropping and lines dropped.  A column of ``docs`` with such a name goes."""
    own = fresh(docs, "_bm_id", "_bm_th", "_bm_n", "_bm_keep")
    i, th, dropped, keep = map(F.col, own)
    maps = bitmaps.select("doc_id", "th", "n_dropped", "keep").toDF(*own)
    joined = docs.join(maps, F.col(f"`{doc_id}`").eqNullSafe(i) & (F.xxhash64(_body(text)) == th), "left")
    body = F.when(keep.isNull(), F.col(f"`{text}`")).otherwise(kept_lines(_body(text), keep))
    out = [body.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in counts]
    n = F.size(split_lines(_body(text))).cast("long")
    return joined.select(*out, n.alias(counts[0]), F.coalesce(dropped, F.lit(0)).cast("long").alias(counts[1]))
