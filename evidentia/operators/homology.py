"""Alignment of sequences: a seed index for candidates, banded local alignment of them in batches.

Candidates share k-mers: a pair with ``min_share`` of the longer's k-mers in common shares one of the rarest
(1 - share) part of either's, so only those are joined.  A pair is aligned around the diagonal that
most of its seeds lie on, BAND residues to each side or a tenth of the longer; all pairs of a batch go through the
recurrence together, a row of the band at a time.  The band and the seeds are where this differs from a full dynamic
programme (``tests`` measure it); no pair of candidates is dropped.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import greedy_clusters

MATCH, MISMATCH, GAP = 2, -1, -2
BAND, PAIRS = 16, 512
_LOW = 20  # bits of the number of matches beside the score


def seed_pairs(seqs: DataFrame, seq_id: str, seq: str, k: int = 4, min_share: float = 0.3) -> DataFrame:
    """(u, v, a, b) with u < v: pairs of sequences that share ``min_share`` of the longer's distinct k-mers, with
    the sequences.  Exact copies are expected to be one row."""
    s = seqs.where(F.length(seq) >= k).select(F.col(seq_id).alias("id"), F.col(seq).alias("s"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(F.col(seq), i, F.lit(k)))).alias("g"))
    long = s.select("id", F.size("g").alias("n"), F.explode("g").alias("t"))
    freq = long.groupBy("t").agg(F.count("*").alias("f"))
    ranked = long.join(freq, "t").withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy("f", "t")))
    prefix = ranked.where((F.col("f") > 1) & (F.col("_k") <= F.col("n") - F.ceil(F.col("n") * min_share) + 1)).select("t", "id", "n")
    other = prefix.select("t", F.col("id").alias("v"), F.col("n").alias("m"))
    pairs = prefix.withColumnRenamed("id", "u").join(other, "t").where("u < v").where(F.least("n", "m") >= F.greatest("n", "m") * min_share).select("u", "v").distinct()
    side = lambda c, x, g: s.select(F.col("id").alias(c), F.col("s").alias(x), F.col("g").alias(g))
    full = pairs.join(side("u", "a", "_g"), "u").join(side("v", "b", "_h"), "v")
    return full.where(F.size(F.array_intersect("_g", "_h")) >= F.greatest(F.size("_g"), F.size("_h")) * min_share).select("u", "v", "a", "b")


def diagonal(a: str, b: str, k: int) -> int:
    """The shift of ``b`` against ``a`` on which most of their shared k-mers lie, of equals the least."""
    at = defaultdict(list)
    for i in range(len(a) - k + 1):
        at[a[i : i + k]].append(i)
    seen = Counter(j - i for j in range(len(b) - k + 1) for i in at.get(b[j : j + k], ()))
    return min(seen, key=lambda d: (-seen[d], abs(d), d)) if seen else 0


def aligned(a: list[str], b: list[str], k: int = 4, band: int = BAND) -> dict[str, np.ndarray]:
    """Best local alignment of each a with each b in its band: score, matches, columns, and the places from and to in
    both (from 0, inclusive; -1 without an alignment).  Of one score, more matches win."""
    n = len(a)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    half = max(band, -(-int(max(la.max(initial=0), lb.max(initial=0))) // 10))
    text = lambda xs, ls: np.frombuffer("".join(x.ljust(max(1, ls.max(initial=0)), "\0") for x in xs).encode("latin-1", "replace"), np.uint8).reshape(n, -1)
    ta, tb = text(a, la), text(b, lb)
    shift = np.array([diagonal(x, y, k) for x, y in zip(a, b, strict=True)])
    c, one = np.arange(2 * half + 1), 1 << _LOW
    zero = lambda: np.zeros((n, len(c)), np.int64)
    value, columns, from_a, from_b = zero(), zero(), zero(), zero()
    out = {x: np.full(n, 0 if x in ("value", "columns") else -1, np.int64) for x in ("value", "columns", "a_from", "a_to", "b_from", "b_to")}
    beyond = np.zeros((n, 1), np.int64)
    for i in range(int(la.max(initial=0))):
        j = i + shift[:, None] + c - half
        there = (j >= 0) & (j < lb[:, None]) & (i < la)[:, None]
        same = np.take_along_axis(tb, np.clip(j, 0, tb.shape[1] - 1), 1) == ta[:, i : i + 1]
        step = np.where(same, MATCH * one + 1, MISMATCH * one)
        old = value >= one
        diag = np.where(old, value, 0) + step
        cols, fa, fb = np.where(old, columns + 1, 1), np.where(old, from_a, i), np.where(old, from_b, j)
        up = np.concatenate((value[:, 1:], beyond), 1) + GAP * one
        better = up > diag
        shifted = lambda x: np.concatenate((x[:, 1:], beyond), 1)
        diag = np.where(better, up, diag)
        cols, fa, fb = np.where(better, shifted(columns) + 1, cols), np.where(better, shifted(from_a), fa), np.where(better, shifted(from_b), fb)
        diag = np.where(there & (diag >= one), diag, 0)
        # gaps along the row: the best of what stands before, less a gap for each place between
        lifted = diag - GAP * one * c
        best = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == best, c, 0), axis=1)
        value = best + GAP * one * c
        pick = lambda x, source=source: np.take_along_axis(x, source, 1)
        columns, from_a, from_b = pick(cols) + c - source, pick(fa), pick(fb)
        value = np.where(there & (value >= one), value, 0)
        top = value.argmax(1)
        high = np.take_along_axis(value, top[:, None], 1)[:, 0]
        new = high > out["value"]
        at = lambda x, top=top: np.take_along_axis(x, top[:, None], 1)[:, 0]
        for name, x in (("value", high), ("columns", at(columns)), ("a_from", at(from_a)), ("b_from", at(from_b)), ("a_to", np.full(n, i)), ("b_to", at(j))):
            out[name] = np.where(new, x, out[name])
    found = out.pop("value")
    return {"score": found >> _LOW, "matches": found & (one - 1), **out}


_ALIGNED = "u long, v long, score long, matches long, columns long, a_from long, a_to long, b_from long, b_to long, la long, lb long"


def alignments(pairs: DataFrame, k: int = 4) -> DataFrame:
    """``pairs`` (u, v, a, b) aligned: score, identity (matches by columns) and coverage (of the sequence that is
    covered less)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                got = aligned(a, b, k) | {"la": np.array([len(x) for x in a]), "lb": np.array([len(x) for x in b])}
                names = [x.split()[0] for x in _ALIGNED.split(", ")][2:]
                yield pa.RecordBatch.from_arrays([part.column("u"), part.column("v"), *[pa.array(got[x].astype(np.int64)) for x in names]], names=["u", "v", *names])

    thin = pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "a", "b")
    out = thin.mapInArrow(run, _ALIGNED)
    share = lambda x, n: (F.col(f"{x}_to") - F.col(f"{x}_from") + 1) / F.col(n)
    identity = F.when(F.col("columns") > 0, F.col("matches") / F.col("columns")).otherwise(0.0)
    coverage = F.when(F.col("columns") > 0, F.least(share("a", "la"), share("b", "lb"))).otherwise(0.0)
    return out.withColumn("identity", identity).withColumn("coverage", coverage).drop("la", "lb")


def similar(seqs: DataFrame, seq_id: str, seq: str, identity: float = 0.9, coverage: float = 0.8, k: int = 4, min_share: float = 0.3) -> DataFrame:
    """Pairs of sequences whose alignment has that identity and coverage."""
    found = alignments(seed_pairs(seqs, seq_id, seq, k, min_share), k)
    return found.where((F.col("identity") >= identity) & (F.col("coverage") >= coverage))


def identity_clusters(seqs: DataFrame, seq_id: str, seq: str, identity: float = 0.9, coverage: float = 0.8, k: int = 4, min_share: float = 0.3) -> DataFrame:
    """member -> representative, greedy from the longest: copies are one first, then a sequence joins the first
    representative that it is aligned to."""
    one = seqs.groupBy(F.col(seq).alias("s")).agg(F.min(seq_id).alias("id")).withColumn("len", F.length("s"))
    found = greedy_clusters(one, "id", "len", similar(one, "id", "s", identity, coverage, k, min_share))
    same = seqs.select(F.col(seq_id).alias("member"), F.col(seq).alias("s")).join(one.select("s", F.col("id").alias("_id")), "s")
    return same.join(found.withColumnRenamed("member", "_id"), "_id").select("member", "representative")
