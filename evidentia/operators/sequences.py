"""Maps between alignment columns, residues and codons."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import translate_codons
from ..functions.symbols import among, places, strings, symbols
from .joins import CheckFailed

GAPS = "-.~"


def _residues(aligned: pa.Array, rf: pa.Array, offset: pa.Array) -> pa.Array:
    (code, n), (mark, k) = symbols(aligned), symbols(rf)
    start, row, col = places(n)
    residue = ~among(code, GAPS)
    before = np.concatenate(([0], np.cumsum(residue)))
    match = np.flatnonzero(col < k[row])
    match = match[~among(mark[(np.cumsum(k) - k)[row[match]] + col[match]], GAPS + "_")]
    at = row[match]
    value = offset.fill_null(0).to_numpy(zero_copy_only=False)[at] + before[match] - before[start[at]]
    there = residue[match] & offset.is_valid().to_numpy(zero_copy_only=False)[at]
    ends = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(n)))))
    out = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value.astype(np.int32), mask=~there))
    return pc.if_else(pc.and_(aligned.is_valid(), rf.is_valid()), out, None)


def residue_index(aligned: Column, rf: Column, offset: Column) -> Column:
    """Array over match columns: the 0-based residue in each, null for a gap.  Inserts consume
    residues, gaps do not; ``offset`` is where the aligned fragment starts in the protein.

    Residues are counted over whole Arrow batches: a fold over each row in Spark makes an array for each column.
    """
    return F.arrow_udf(_residues, "array<int>")(aligned, rf, offset.cast("int"))


def fragment_offset(aligned: Column, protein: Column) -> Column:
    """Where the ungapped fragment starts in the protein, from 0; null if it does not occur."""
    bare = aligned
    for gap in GAPS:
        bare = F.replace(bare, F.lit(gap), F.lit(""))
    at = F.call_function("locate", F.upper(bare), F.upper(protein))
    return F.when(at > 0, at - 1)


def _codons(index: pa.Array, cds: pa.Array) -> pa.Array:
    code, n = symbols(cds)
    size = pc.list_value_length(index).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    _, row, _ = places(size)
    i = index.flatten()
    gap = i.is_null().to_numpy(zero_copy_only=False)
    i = i.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    null = ~pc.and_(index.is_valid(), cds.is_valid()).to_numpy(zero_copy_only=False)
    null[row[~gap & ((i < 0) | (3 * i + 3 > n[row]))]] = True
    size[null] = 0
    kept = ~null[row]
    first, gap = ((np.cumsum(n) - n)[row] + 3 * i)[kept], gap[kept]
    out = np.full((len(gap), 3), ord("-"), code.dtype)
    out[~gap] = code[first[~gap, None] + np.arange(3)]
    return strings(out.ravel(), 3 * size, null)


def codon_row(index: Column, cds: Column) -> Column:
    """Codons by residue index, ``---`` for gaps; null where an index runs past the sequence, or without a sequence."""
    # so marked, it is not computed again for a filter on the codons
    return F.arrow_udf(_codons, "string").asNondeterministic()(index, cds)


def cds_status(cds: Column, protein: Column) -> Column:
    """ok / no_cds / internal_stop / mismatch of a coding sequence against its protein."""
    read = F.regexp_replace(translate_codons(cds), r"\*+$", "")
    return F.when(cds.isNull(), "no_cds").when(F.contains(read, F.lit("*")), "internal_stop").when(read == F.upper(F.regexp_replace(protein, r"\*+$", "")), "ok").otherwise("mismatch")


SEEDS = 10_000


def region_distance(points: DataFrame, seeds: DataFrame, radius: float) -> DataFrame:
    """(point_id, distance, in_region): least distance to a set of seeds (vectors), which goes to
    every task once it is found within SEEDS rows."""
    if seeds.limit(SEEDS + 1).count() > SEEDS:
        raise CheckFailed(f"over {SEEDS} seeds")
    packed = seeds.agg(F.collect_list("vector").alias("_seeds"))
    gap = lambda s: F.sqrt(F.aggregate(F.zip_with(F.col("vector"), s, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    both = points.crossJoin(F.broadcast(packed))
    out = both.select("point_id", F.array_min(F.transform("_seeds", gap)).alias("distance"))
    return out.withColumn("in_region", F.col("distance") <= radius)
