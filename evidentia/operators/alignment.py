"""Redundancy-weighted statistics over an alignment, and the search for an anchor triple.

A matrix is a table (…, row) of strings, as a rule of one length.  Statistics count its symbols by position in
batches of rows (``counted``), so what is shuffled is positions x symbols for each batch, not sequences and not
their characters.  Positions are 0-based.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.alphabet import GAP, RESIDUES

#: Symbols counted at once: what bounds a task's memory, unless one row alone is longer.
COUNTED_SYMBOLS = 1 << 20


def _group_codes(batch: pa.RecordBatch, by: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's values of ``by``, and a row that holds each number's values."""
    code = np.zeros(batch.num_rows, np.int64)
    first = np.zeros(1, np.int64)
    for name in by:
        d = batch.column(name).dictionary_encode(null_encoding="encode")
        code = code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)
        _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _summed(at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``weight`` by place; whole numbers stay exact, as two halves each fit a double."""
    if weight.dtype.kind == "f":
        return np.bincount(at, weight, n)
    low, high = weight & (2**26 - 1), weight >> 26
    return (np.bincount(at, high, n).astype(np.int64) << 26) + np.bincount(at, low, n).astype(np.int64)


def _symbol_sums(batch: pa.RecordBatch, row: str, by: list[str], sums: dict[str, str | None], at_once: int) -> pa.RecordBatch:
    rows = batch.column(row).to_pylist()
    length = np.array([len(r) for r in rows], np.int64)
    text = "".join(rows)
    try:
        symbol, symbols = np.frombuffer(text.encode("latin-1"), np.uint8), None
    except UnicodeEncodeError:
        symbols, symbol = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    k, wide = 256 if symbols is None else len(symbols), int(length.max())
    pos = np.arange(len(text)) - np.repeat(np.cumsum(length) - length, length)
    code, first = _group_codes(batch, by)
    key = (np.repeat(code, length) * wide + pos) * k + symbol
    size = len(first) * wide * k
    if size > 4 * at_once:  # many groups: only the cells that are there get a place
        cells, key = np.unique(key, return_inverse=True)
        there = slice(None)
        size = len(cells)
    else:
        cells = there = np.flatnonzero(np.bincount(key, minlength=size))
    out = [batch.column(c).take(pa.array(first[cells // (wide * k)])) for c in by]
    out += [pa.array((cells // k % wide).astype(np.int32)), pa.array([chr(c) for c in ((cells % k) if symbols is None else symbols[cells % k]).tolist()], pa.string())]
    for weight in sums.values():
        w = np.ones(len(rows), np.int64) if weight is None else batch.column(weight).fill_null(0).to_numpy(zero_copy_only=False)
        w = w.astype(np.float64 if w.dtype.kind == "f" else np.int64)
        out.append(pa.array(_summed(key, np.repeat(w, length), size)[there]))
    return pa.RecordBatch.from_arrays(out, names=[*by, "pos", "residue", *sums])


def counted(matrix: DataFrame, by: list[str], sums: dict[str, str | None], row: str = "row", at_once: int = COUNTED_SYMBOLS) -> DataFrame:
    """(*by, pos, residue, *sums): sums over the rows that hold a symbol at a position.  ``sums`` names the column to
    sum for each output, None for the number of rows; sums of whole numbers are whole and exact.

    A null or empty row holds nothing; rows may differ in length; a null weight counts as 0; a null in ``by`` is
    a value of its own.
    """
    needed = list(dict.fromkeys([row, *by, *[w for w in sums.values() if w]]))
    m = matrix.where(F.length(row) > 0).select(*needed)
    kind = dict(m.dtypes)
    whole = lambda w: w is None or kind[w] in ("tinyint", "smallint", "int", "bigint")
    m = m.withColumns({w: F.col(w).cast("bigint" if whole(w) else "double") for w in sums.values() if w})
    schema = ", ".join([*[f"`{c}` {kind[c]}" for c in by], "pos int", "residue string", *[f"`{c}` {'bigint' if whole(w) else 'double'}" for c, w in sums.items()]])

    def count(batches):
        held, cells = [], 0
        for batch in batches:
            lengths = pc.utf8_length(batch.column(row)).to_numpy(zero_copy_only=False)
            start = 0
            for i, c in enumerate(lengths.tolist()):
                cells += c
                if cells >= at_once:
                    held.append(batch.slice(start, i + 1 - start))
                    yield _symbol_sums(pa.concat_batches(held), row, by, sums, at_once)
                    held, cells, start = [], 0, i + 1
            if start < len(lengths):
                held.append(batch.slice(start))
        if held:
            yield _symbol_sums(pa.concat_batches(held), row, by, sums, at_once)

    return m.mapInArrow(count, schema).groupBy(*by, "pos", "residue").agg(*[F.sum(c).alias(c) for c in sums])


def residue_masses(matrix: DataFrame, weight: str = "weight") -> DataFrame:
    """(pos, residue, mass)."""
    return counted(matrix, [], {"mass": weight})


def column_stats(matrix: DataFrame, weight: str = "weight") -> DataFrame:
    """(pos, residue, freq, occupancy, entropy_bits) for the standard residues present.

    Occupancy is the non-gap share of all mass; a frequency is a residue's share of the mass
    of standard residues; entropy runs over those.
    """
    mass = residue_masses(matrix, weight)
    at = W.partitionBy("pos")
    standard = F.col("residue").isin(*RESIDUES)
    mass = mass.withColumn("_all", F.sum("mass").over(at)).withColumn("_full", F.sum(F.when(F.col("residue") != GAP, F.col("mass")).otherwise(0.0)).over(at))
    own = mass.where(standard).withColumn("_std", F.sum("mass").over(at)).withColumn("freq", F.when(F.col("_full") > 0, F.col("mass") / F.col("_full")))
    h = -F.sum(F.when(F.col("mass") > 0, F.col("freq") * F.log2("freq"))).over(at)
    return own.select("pos", "residue", "freq", (F.col("_full") / F.col("_all")).alias("occupancy"), h.alias("entropy_bits"))


def column_entropy(matrix: DataFrame, weight: str = "weight") -> DataFrame:
    """(pos, entropy_bits, conservation): over every symbol but gaps; conservation is
    1 - H / log2(20), clipped to [0, 1]."""
    mass = residue_masses(matrix, weight).where(F.col("residue") != GAP)
    p = F.col("mass") / F.sum("mass").over(W.partitionBy("pos"))
    h = mass.withColumn("p", p).groupBy("pos").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy_bits"))
    return h.withColumn("conservation", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("entropy_bits") / F.log2(F.lit(20.0)))))


def candidates(stats: DataFrame, residue: str, min_occupancy: float, min_freq: float, cap: int = 40) -> DataFrame:
    """Positions where a residue is frequent: (pos, freq, occupancy, rank), the most frequent
    ``cap`` of them; ties (to 9 places) go to the smaller position.  The cap is part of the method."""
    ok = stats.where((F.col("residue") == residue) & (F.col("occupancy") >= min_occupancy) & (F.col("freq") >= min_freq))
    ranked = ok.withColumn("rank", F.row_number().over(W.orderBy(F.round("freq", 9).desc(), "pos")))
    return ranked.where(F.col("rank") <= cap).select("pos", "freq", "occupancy", "rank")


def score_triples(first: DataFrame, second: DataFrame, third: DataFrame, gap12: int, gap23: int, tolerance: float, penalty: float) -> DataFrame:
    """Increasing triples of candidates: sum of frequencies less the penalised deviation of
    both gaps.  Each side has as many rows as the cap allows, so they are broadcast."""
    a, b, c = (df.select(F.col("pos").alias(f"col_{i}"), F.col("freq").alias(f"freq_{i}"), F.col("occupancy").alias(f"occ_{i}"), F.col("rank").alias(f"_r{i}")) for i, df in ((1, first), (2, second), (3, third)))
    t = a.join(F.broadcast(b), F.col("col_1") < F.col("col_2")).join(F.broadcast(c), F.col("col_2") < F.col("col_3"))
    t = t.withColumn("gap_1_2", F.col("col_2") - F.col("col_1")).withColumn("gap_2_3", F.col("col_3") - F.col("col_2"))
    spacing = penalty * (F.abs(F.col("gap_1_2") - gap12) + F.abs(F.col("gap_2_3") - gap23)) / tolerance
    t = t.withColumn("spacing_penalty", spacing.cast("double"))
    return t.withColumn("score", F.col("freq_1") + F.col("freq_2") + F.col("freq_3") - F.col("spacing_penalty"))


def score_by_prior(first: DataFrame, second: DataFrame, third: DataFrame, prior: tuple[int, int] | None, tolerance: float, penalty: float) -> DataFrame:
    """Triples held against a family's known gaps; without a prior the columns' frequencies alone decide."""
    return score_triples(first, second, third, *(prior or (0, 0)), tolerance, penalty if prior else 0.0)


def ranked_triples(scored: DataFrame, n: int = 20) -> DataFrame:
    """The n best, ties by the first column's frequency rank, then position."""
    best = scored.orderBy(F.col("score").desc(), "_r1", "col_2", "col_3").limit(n)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "_r1", "col_2", "col_3"))).drop("_r1", "_r2", "_r3")


def best_triple(by_hypothesis: dict[str, DataFrame]) -> DataFrame:
    """One row: the best triple over hypotheses named by their residues, such as CHD."""
    parts = [df.withColumn("hypothesis", F.lit(h)).withColumn("_h", F.lit(i)) for i, (h, df) in enumerate(by_hypothesis.items())]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.orderBy(F.col("score").desc(), "_h", "_r1", "col_2", "col_3").limit(1).drop("_h", "_r1", "_r2", "_r3")


def outcomes(matrix: DataFrame, triple: DataFrame, min_coverage: float) -> DataFrame:
    """Per sequence: match_coverage, outcome and whether all three residues occur anywhere.

    low_coverage comes before gapped, gapped before positive and negative.
    """
    t = triple.select("col_1", "col_2", "col_3", "hypothesis")
    m = matrix.crossJoin(F.broadcast(t))
    residue = [F.substring(F.col("row"), F.col(f"col_{i}") + 1, F.lit(1)) for i in (1, 2, 3)]
    wanted = [F.substring("hypothesis", i, 1) for i in (1, 2, 3)]
    coverage = F.length(F.replace("row", F.lit(GAP), F.lit(""))) / F.length("row")
    gapped = (residue[0] == GAP) | (residue[1] == GAP) | (residue[2] == GAP)
    right = (residue[0] == wanted[0]) & (residue[1] == wanted[1]) & (residue[2] == wanted[2])
    anywhere = F.contains(F.col("row"), wanted[0]) & F.contains(F.col("row"), wanted[1]) & F.contains(F.col("row"), wanted[2])
    return m.select(
        *matrix.columns,
        coverage.alias("match_coverage"),
        F.when(coverage < min_coverage, "low_coverage").when(gapped, "gapped").when(right, "positive").otherwise("negative").alias("outcome"),
        anywhere.alias("has_all_anywhere"),
    )


def tier_census(judged: DataFrame, tier: str = "tier", copies: str | None = None) -> DataFrame:
    """Counts and shares by tier; the denominator of the positive share is what is testable.
    ``copies`` names how many sequences a row stands for; ``weight`` is theirs together."""
    is_ = lambda o: F.col("outcome") == o
    testable = is_("positive") | is_("negative")
    n = F.col(copies) if copies else F.lit(1)
    count = lambda which: F.sum(F.when(which, n).otherwise(0)).cast("long")
    out = judged.groupBy(tier).agg(
        F.sum(n).cast("long").alias("n_aligned"), count(testable).alias("n_testable"), count(is_("low_coverage")).alias("n_low_coverage"),
        count(is_("gapped")).alias("n_gapped"), count(is_("negative")).alias("n_negative"),
        count(is_("negative") & F.col("has_all_anywhere")).alias("n_negative_with_all_three"), count(is_("positive")).alias("n_positive"),
        F.sum("weight").alias("effective_n"), F.sum(F.when(is_("positive"), F.col("weight")).otherwise(0.0)).alias("effective_positive"),
    )
    return out.withColumn("frac_positive", F.when(F.col("n_testable") > 0, F.col("n_positive") / F.col("n_testable"))).withColumn("frac_testable", F.col("n_testable") / F.col("n_aligned"))


def anchor_window(row: Column, columns: list[Column], half: int) -> Column:
    """Windows of ``half`` positions around each column, clipped to the row and joined;
    where two overlap, their positions stand twice."""
    parts = []
    for c in columns:
        start = F.greatest(F.lit(0), c - half)
        end = F.least(F.length(row) - 1, c + half)
        parts.append(F.substring(row, start + 1, end - start + 1))
    return F.concat(*parts)


def consensus(matrix: DataFrame, group: str, weight: str = "weight") -> DataFrame:
    """(group, n_positions, motif): the heaviest residue at each position, upper case from
    half the mass of non-gaps on, ``-`` where all are gaps; ties go to the smaller letter."""
    mass = counted(matrix, [group], {"mass": weight})
    full = F.when(F.col("residue") != GAP, F.col("mass"))
    at = mass.groupBy(group, "pos").agg(F.max_by("residue", F.struct(full, -F.ascii("residue"))).alias("r"), F.max(full).alias("top"), F.sum(full).alias("all"))
    letter = F.when(F.col("top").isNull(), GAP).when(F.col("top") / F.col("all") >= 0.5, F.upper("r")).otherwise(F.lower("r"))
    return at.groupBy(group).agg(F.count("*").alias("n_positions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", letter.alias("l")))), lambda x: x["l"]), "").alias("motif"))
