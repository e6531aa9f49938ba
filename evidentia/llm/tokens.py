"""Encoding by a public tokenizer, and the exact length histogram.

``path`` names a byte-level BPE file of the ``tokenizers`` library.  Where the same folder
has the vocabulary as ranks (``.tiktoken``), texts of plain Latin letters and printable
ASCII are encoded from it, which gives the same ids several times as fast; any other text,
and any that holds a special token's string, goes through ``tokenizers`` itself.

Length histogram: documents are counted by encoded length, so the state is one row per
distinct length; suffix sums over it give, for every context limit, how many documents fit,
the total after truncation, and quantiles.

Defined cases: null or empty text has no tokens; repeated rows count each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Text on which both libraries split words alike.
PLAIN = re.compile("[\n\r\t\\x20-\\x7e\xa1-\xac\xae-ʯ‐-‧‰-⁞₠-₿]*\\Z")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def encoder(path: str):
    """Function from a text to its list of ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    specials = [t.content for t in slow.get_added_tokens_decoder().values()]
    ranks_path = path.removesuffix(".json") + ".tiktoken"
    fast = None
    if os.path.exists(ranks_path):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        if fast and not any(s in text for s in specials) and PLAIN.match(text):
            return fast(text)
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens)."""
    path = path or default_path()
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(encode(x)) for x in batch.column(1).to_pylist()], pa.int64())], schema=out)

    return mapped(docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")), run, "doc_id long, n_tokens long")


def length_histogram(counts: DataFrame) -> DataFrame:
    """Rows (n_tokens, n_docs): one for each distinct encoded length."""
    return counts.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limit_totals(histogram: DataFrame) -> DataFrame:
    """For each context limit at which an answer changes (the distinct lengths), by suffix sums.

    context_limit; n_docs of just that length; n_fit documents of at most that length;
    n_over longer ones; tokens in all; truncated_tokens when each document is cut at the
    limit; quantile, the share of documents that fit.  Between two rows, truncated_tokens
    grows by the n_over of the first for each token of limit.  The histogram has one row per
    distinct length, so the single task that adds it up sees lengths, not documents.
    """
    from pyspark.sql import Window as W

    upto = W.orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    after = W.orderBy("n_tokens").rowsBetween(1, W.unboundedFollowing)
    over = W.partitionBy()
    h = histogram.withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    h = h.select(
        F.col("n_tokens").alias("context_limit"), "n_docs",
        F.sum("n_docs").over(upto).alias("n_fit"),
        F.coalesce(F.sum("n_docs").over(after), F.lit(0)).alias("n_over"),
        F.sum("_t").over(upto).alias("_below"),
        F.sum("_t").over(over).alias("total_tokens"),
    )
    return h.select(
        "context_limit", "n_docs", "n_fit", "n_over", "total_tokens",
        (F.col("_below") + F.col("context_limit") * F.col("n_over")).alias("truncated_tokens"),
        F.round(F.col("n_fit") / (F.col("n_fit") + F.col("n_over")), 9).alias("quantile"),
    )


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Each document's ids with ``end_id`` after them, cut into full windows and a rest.

    Rows (doc_id, start, length, ids_crc32, doc_tokens); the CRC is over little-endian
    unsigned 32-bit ids.
    """
    path = path or default_path()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    out = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(x), end_id], "<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    rows.append((i, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, schema=out)

    return mapped(docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")), run, ", ".join(f"{c} long" for c in names))
