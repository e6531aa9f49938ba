"""Benchmark decontamination on a distributed positional inverted index.

1. The index holds the postings (document, position, term) of every term of the test items and
   a posting of the end of each document, whose position is its length.  Texts are cut into words
   once, for this table; all else is read from it.
2. Terms are counted over the index.  Each window of ``width`` consecutive item words names its
   two rarest terms; a window with a term that the corpus lacks can't occur.
3. A posting, less its term's place in an item, is the place where that item would start.
   Lists adjusted this way are intersected from the rarest terms on: a (document, item, start) on which
   both rarest terms of a window agree is an alignment.
4. An alignment asks for a posting at each place of its item; those that the index has are
   the words that agree, and runs of ``width`` of them or more are phrase matches.

Item-side tables (terms, windows) are marked for broadcast only when measured and found within
BROADCAST_ROWS and 64 MB; beyond it the same joins shuffle, the words of the corpus after a filter by a bitmap of
the terms.  No corpus-side table is marked (Spark broadcasts one by itself where it has measured it within
its own threshold), and none is grouped by term or item, so a term or passage that fills a third
of the corpus stays spread over its documents.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters.  Defined cases:
null or empty texts and items have no words; an item shorter than ``width`` is one window;
rows that repeat (doc_id and text) get equal results; an empty table or benchmark gives no
hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, discard, fits, maybe_in, staged
from .common import small as _small

WIDTH = 13
BROADCAST_ROWS = 500_000
END = ""  # the term of the posting that ends a document; no word is empty
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def small(df: DataFrame) -> DataFrame:
    return _small(df, BROADCAST_ROWS)


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.col(f"`{text}`")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("th"), body.alias("text"))


def _tokens(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "th", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (item_id, p, term, n)."""
    ws = words(F.col(f"`{text}`"))
    return items.select(F.col(f"`{item_id}`").alias("item_id"), ws.alias("w")).select("item_id", F.size("w").alias("n"), F.posexplode("w").alias("p", "term"))


def index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (doc_id, th, pos, term) of ``terms`` and of the end of each document, as a staged table."""
    tokens = _tokens(_numbered(docs, doc_id, text))
    asked = staged(terms.select("term").unionByName(docs.sparkSession.range(1).select(F.lit(END).alias("term"))).distinct())
    if fits(asked, BROADCAST_ROWS):
        return staged(tokens.join(F.broadcast(asked), "term").select("doc_id", "th", "pos", "term"))
    return staged(maybe_in(tokens, F.col("term"), asked.select(F.col("term").alias("id"))).join(asked, "term").select("doc_id", "th", "pos", "term"))


def frequencies(posted: DataFrame) -> DataFrame:
    """Occurrences in the corpus of each indexed term that occurs."""
    return posted.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("f"))


def anchors(terms: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """Places (term, item_id, p, alone) of each window's two rarest terms; ``alone`` where a
    window is one word."""
    known = terms.join(counts, "term", "left")
    window = F.explode(F.sequence(F.greatest(F.lit(0), F.col("p") - (width - 1)), F.least("p", F.greatest(F.lit(0), F.col("n") - width)))).alias("start")
    inside = known.select("item_id", "n", "p", "term", "f", window)
    by = W.partitionBy("item_id", "start")
    ranked = inside.withColumn("k", F.row_number().over(by.orderBy(F.col("f").asc_nulls_first(), "p"))).withColumn("gone", F.max(F.col("f").isNull()).over(by))
    return ranked.where("not gone and k <= 2").select("term", "item_id", "p", (F.col("n") == 1).alias("alone")).distinct()


def _phrases(posted: DataFrame, terms: DataFrame, width: int) -> DataFrame:
    near = staged(anchors(terms, staged(frequencies(posted)), width))
    started = posted.join(small(near), "term").withColumn("at", F.col("pos") - F.col("p"))
    aligned = started.groupBy("doc_id", "th", "item_id", "at").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.max("alone").alias("alone"))
    aligned = staged(aligned.where("lo < hi or alone").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "item_id", "at"))
    asked = aligned.join(small(terms), "item_id").select("_d", "_t", "item_id", "at", "n", F.col("p").alias("k"), F.col("term").alias("_term"), (F.col("at") + F.col("p")).alias("_pos"))
    held = maybe_in(posted, F.col("th"), aligned.select(F.col("_t").alias("id")))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & (F.col("pos") == F.col("_pos")) & (F.col("term") == F.col("_term"))
    flags = held.join(asked, same).select("doc_id", "th", "item_id", "at", "n", "k").distinct()
    islands = flags.withColumn("run", F.col("k") - F.row_number().over(W.partitionBy("doc_id", "th", "item_id", "at").orderBy("k")))
    runs = islands.groupBy("doc_id", "th", "item_id", "at", "n", "run").agg(F.min("k").alias("first"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= F.least(F.col("n"), F.lit(width))).select("doc_id", "th", "item_id", (F.col("at") + F.col("first")).cast("long").alias("start"), "length").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, th, item_id, start, length): maximal runs of ``width`` equal words or
    more (of the whole item, where it is shorter).  ``th`` is the hash of the text."""
    terms = staged(item_terms(items, item_id, item_text).distinct())
    return _phrases(index(docs, terms, doc_id, text), terms, width)


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 8, share: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, th, item_id, start, found): items of which ``share`` of the distinct terms'
    places stand in a document within ``slop`` words of where one start would put them."""
    terms = staged(item_terms(items, item_id, item_text).distinct())
    started = index(docs, terms, doc_id, text).join(small(terms), "term").withColumn("at", F.col("pos") - F.col("p"))
    spread = started.withColumn("b", F.explode(F.array(F.floor(F.col("at") / slop), F.floor(F.col("at") / slop) + 1)))
    places = spread.groupBy("doc_id", "th", "item_id", "n", "b", "p").agg(F.min("at").alias("at"))
    found = places.groupBy("doc_id", "th", "item_id", "n", "b").agg(F.count("*").alias("found"), F.min("at").alias("start"))
    found = found.where(F.col("found") >= F.lit(share) * F.col("n"))
    return found.groupBy("doc_id", "th", "item_id").agg(F.max_by("start", "found").cast("long").alias("start"), F.max("found").alias("found"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, th, n_words, n_hit, items (sorted ids as strings), contaminated."""
    terms = staged(item_terms(items, item_id, item_text).distinct())
    posted = index(docs, terms, doc_id, text)
    spans = staged(_phrases(posted, terms, width))
    rows = staged(posted.where(F.col("term") == END).select("doc_id", "th", F.col("pos").cast("long").alias("n_words")))
    discard(posted)
    hit = spans.select("doc_id", "th", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy("doc_id", "th").agg(F.count("*").alias("n_hit"))
    named = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = hit.withColumnsRenamed({"doc_id": "_d", "th": "_t"}).join(named, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_t") == F.col("th"))).select("_d", "_t", "n_hit", "items")
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    n = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "th", "n_words", n.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n > 0) & (20 * n >= F.col("n_words"))).alias("contaminated"))
