"""Mutual information of alignment columns with each other and with labels, and its nulls.

Pair statistics count (i, j, a, b) in batches of rows: what is shuffled is bounded by pairs x symbols squared for
each batch, not by sequences.  Permutation nulls never see a sequence: a replicate's contingency tables are drawn
from their margins (multivariate hypergeometric), so their cost is replicates x tables x symbols, whatever
the number of sequences.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.alphabet import GAP, RESIDUES
from ..functions.special import gamma_tail, normal_sf
from .alignment import counted
from .staging import staged


def varied_columns(matrix: DataFrame, min_occupancy: float, copies: str | None = None) -> DataFrame:
    """Positions occupied often enough that show more than one symbol, the gap being one."""
    n = counted(matrix, [], {"n": copies})
    at = n.groupBy("pos").agg((F.sum(F.when(F.col("residue") != GAP, F.col("n")).otherwise(0)) / F.sum("n")).alias("occupancy"), F.count("*").alias("symbols"))
    return at.where((F.col("occupancy") >= min_occupancy) & (F.col("symbols") > 1)).select("pos")


COUNTED_ROWS, COUNTED_CELLS = 1 << 16, 1 << 22
_PAIRS = "col_i int, col_j int, a int, b int, n long"


def _pair_cells(rows: list[str]):
    """Arrow batches of (i, j, a, b, n) with i < j over some rows, a column j at a time."""
    wide = max(map(len, rows))
    text = np.frombuffer("".join(r.ljust(wide, "\0") for r in rows).encode("latin-1", "replace"), np.uint8).reshape(-1, wide)
    symbols, code = np.unique(text, return_inverse=True)
    k, code = len(symbols), code.reshape(text.shape).astype(np.int32)
    for j in range(1, wide):
        n = np.bincount((np.arange(j, dtype=np.int32) * (k * k) + code[:, :j] * k + code[:, j : j + 1]).ravel(), minlength=j * k * k)
        at = np.flatnonzero(n)
        a, b = symbols[at // k % k], symbols[at % k]
        there = (a > 0) & (b > 0)
        i = (at // (k * k))[there].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.full(len(i), j, np.int32)), pa.array(a[there].astype(np.int32)), pa.array(b[there].astype(np.int32)), pa.array(n[at][there].astype(np.int64))], names=["col_i", "col_j", "a", "b", "n"])


def _count_pairs(batches):
    held = []
    for batch in batches:
        held += [r for r in batch.column(0).to_pylist() if r and len(r) > 1]
        while held and len(held) >= (take := max(1, min(COUNTED_ROWS, COUNTED_CELLS // len(held[0])))):
            yield from _pair_cells(held[:take])
            held = held[take:]
    if held:
        yield from _pair_cells(held)


def pair_counts(matrix: DataFrame) -> DataFrame:
    """(col_i, col_j, a, b, n) for i < j: rows with each pair of symbols (by code), gaps included; a
    shorter row has no symbols beyond its end."""
    return matrix.select("row").mapInArrow(_count_pairs, _PAIRS).groupBy("col_i", "col_j", "a", "b").agg(F.sum("n").alias("n"))


def pair_information(matrix: DataFrame) -> DataFrame:
    """(col_i, col_j, n, mi_bits) of all column pairs, over rows where both are occupied;
    fewer than two such rows give 0."""
    cells = pair_counts(matrix).where((F.col("a") != ord(GAP)) & (F.col("b") != ord(GAP)))
    at = lambda *c: F.sum("n").over(W.partitionBy("col_i", "col_j", *c))
    c = cells.withColumn("t", at()).withColumn("na", at("a")).withColumn("nb", at("b"))
    term = F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))
    mi = c.groupBy("col_i", "col_j").agg(F.sum("n").alias("n"), F.sum(term).alias("mi_bits"))
    return mi.withColumn("mi_bits", F.when(F.col("n") >= 2, F.greatest(F.lit(0.0), "mi_bits")).otherwise(0.0))


def average_product(mi: DataFrame, value: str = "mi_bits", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``mi_apc``: value less mean_i * mean_j / grand mean over off-diagonal pairs (of each ``by``); as it
    is where the grand mean is not positive."""
    # windows over pairs of columns, so that what made them runs once
    own = [c for c in mi.columns if c not in ("col_i", "col_j", *by)]
    ends = mi.withColumn("_g", F.avg(value).over(W.partitionBy(*by))).select("*", F.explode(F.array("col_i", "col_j")).alias("_c"))
    ends = ends.withColumn("_m", F.avg(value).over(W.partitionBy(*by, "_c")))
    pick = lambda c: F.max(F.when(F.col("_c") == F.col(c), F.col("_m")))
    out = ends.groupBy(*by, "col_i", "col_j").agg(*[F.max(c).alias(c) for c in own], F.max("_g").alias("_g"), pick("col_i").alias("_mi"), pick("col_j").alias("_mj"))
    return out.withColumn("mi_apc", F.when(F.col("_g") > 0, F.col(value) - F.col("_mi") * F.col("_mj") / F.col("_g")).otherwise(F.col(value))).drop("_g", "_mi", "_mj")


def label_information(matrix: DataFrame, label: str, weight: str = "weight", copies: str | None = None) -> DataFrame:
    """(pos, mi_bits, entropy_bits): weighted information of a residue about a label with the
    gap as a symbol of its own, and the unweighted entropy of the column."""
    symbol = F.when(F.col("residue").isin(*RESIDUES), F.col("residue")).otherwise(GAP)
    exact = counted(matrix, [label], {"m": weight, "k": copies})
    cells = exact.groupBy("pos", symbol.alias("a"), F.col(label).alias("b")).agg(F.sum("m").alias("m"), F.sum("k").alias("k"))
    at = lambda x, *c: F.sum(x).over(W.partitionBy("pos", *c))
    c = cells.withColumn("t", at("m")).withColumn("ma", at("m", "a")).withColumn("mb", at("m", "b")).withColumn("ka", at("k", "a")).withColumn("kt", at("k"))
    mi = F.sum(F.when(F.col("m") > 0, F.col("m") / F.col("t") * F.log2(F.col("m") * F.col("t") / (F.col("ma") * F.col("mb")))))
    # each symbol's entropy term is spread over its cells
    h = -F.sum(F.col("k") / F.col("kt") * F.log2(F.col("ka") / F.col("kt")))
    return c.groupBy("pos").agg(F.greatest(F.lit(0.0), mi).alias("mi_bits"), h.alias("entropy_bits"))


def entropy_scaled(info: DataFrame) -> DataFrame:
    """Adds ``corrected``: information less what a column's entropy alone would lead to expect."""
    means = info.agg(F.avg("mi_bits").alias("_s"), F.avg("entropy_bits").alias("_h"))
    return info.crossJoin(F.broadcast(means)).withColumn("corrected", F.when(F.col("_h") > 0, F.col("mi_bits") - F.col("entropy_bits") * F.col("_s") / F.col("_h")).otherwise(F.col("mi_bits"))).drop("_s", "_h")


# --- permutation nulls: replicates are drawn from margins -------------------------------------

BLOCK, PAIRED_PER_CELL = 50, 10
DRAWN_EXACTLY = 10**9  # what numpy draws hypergeometrically; beyond it a normal of the same mean and variance


def _hypergeometric(rng, good: np.ndarray, bad: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    if max(good.max(initial=0), bad.max(initial=0)) < DRAWN_EXACTLY:
        return rng.hypergeometric(good, bad, drawn)
    total = np.maximum(good + bad, 1).astype(float)
    mean = drawn * (good / total)
    var = mean * (bad / total) * ((total - drawn) / np.maximum(total - 1, 1))
    return np.clip(np.rint(rng.normal(mean, np.sqrt(np.maximum(var, 0)))), np.maximum(0, drawn - bad), np.minimum(good, drawn)).astype(np.int64)


def drawn_tables(rng, rows: np.ndarray, columns: np.ndarray, replicates: int) -> np.ndarray:
    """(replicates, len(rows), len(columns)) tables with these margins, each as a random pairing
    of the items gives it.  Few items are paired one by one, which takes as many draws as there are items."""
    total, size = int(rows.sum()), len(rows) * len(columns)
    if total <= PAIRED_PER_CELL * size:
        a, b = np.repeat(np.arange(len(rows)), rows), np.repeat(np.arange(len(columns)), columns)
        moved = rng.permuted(np.broadcast_to(b, (replicates, total)), axis=1)
        at = (np.arange(replicates)[:, None] * len(rows) + a) * len(columns) + moved
        return np.bincount(at.ravel(), minlength=replicates * size).reshape(replicates, len(rows), len(columns))
    out = np.zeros((replicates, len(rows), len(columns)), np.int64)
    left = np.broadcast_to(columns, (replicates, len(columns))).astype(np.int64)
    for a in range(len(rows) - 1):
        need, pool = np.full(replicates, rows[a], np.int64), left.sum(1)
        for b in range(len(columns) - 1):
            pool = pool - left[:, b]
            out[:, a, b] = _hypergeometric(rng, left[:, b], pool, need)
            need = need - out[:, a, b]
        out[:, a, -1] = need
        left = left - out[:, a]
    out[:, -1] = left
    return out


def _bits(tables: np.ndarray) -> np.ndarray:
    """Information of each table of the last two axes."""
    total = tables.sum((-1, -2), keepdims=True)
    share = tables / np.where(total > 0, total, 1)
    expected = share.sum(-1, keepdims=True) * share.sum(-2, keepdims=True)
    ok = share > 0
    return np.where(ok, share * np.log2(np.where(ok, share, 1) / np.where(ok, expected, 1)), 0).sum((-1, -2))


def column_counts(matrix: DataFrame) -> DataFrame:
    """(pos, n): how often each residue and, last, anything else stands at a position."""
    at = F.explode(F.sequence(F.lit(0), F.length("row") - 1)).alias("pos")
    long = matrix.where(F.length("row") > 0).select("row", at)
    found = F.instr(F.lit(RESIDUES), F.substring(F.col("row"), F.col("pos") + 1, F.lit(1)))
    code = F.when(found > 0, found - 1).otherwise(len(RESIDUES))
    cells = long.groupBy("pos", code.alias("_c")).agg(F.count("*").alias("_n"))
    held = F.map_from_entries(F.collect_list(F.struct("_c", "_n")))
    one = F.transform(F.sequence(F.lit(0), F.lit(len(RESIDUES))), lambda c: F.coalesce(F.try_element_at("_m", c), F.lit(0).cast("long")))
    return cells.groupBy("pos").agg(held.alias("_m")).select("pos", one.alias("n"))


def coupling_null(matrix: DataFrame, replicates: int = 200, seed: int = 1) -> DataFrame:
    """Pairs of columns of ``matrix`` (row) with information, APC-corrected information and a permutation null of
    it: mean, sd, skew, z, an empirical p and a gamma (or normal) tail p.

    Columns are shuffled apart from each other, so a pair's table in a replicate is a random pairing of two
    margins; tables of different pairs are drawn apart, which leaves means and variances of APC terms as
    they are (two pairs of one replicate are independent, three that share columns are not quite).
    """
    counts = staged(column_counts(matrix))
    observed = staged(average_product(pair_information(matrix)))
    side = lambda c, n: counts.select(F.col("pos").alias(c), F.col("n").alias(n))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // BLOCK) - 1))).alias("_b")
    work = observed.select("col_i", "col_j").join(side("col_i", "_x"), "col_i").join(side("col_j", "_y"), "col_j").select("*", blocks)

    def draw(batches):
        for p in batches:
            out = []
            for i, j, x, y, b in zip(p.col_i, p.col_j, p["_x"], p["_y"], p["_b"], strict=True):
                n = min(BLOCK, replicates - b * BLOCK)
                rng = np.random.default_rng((seed, i, j, b))
                x, y = np.asarray(x), np.asarray(y)
                # the gap stands last in both and is no symbol of the information
                keep_x, keep_y = np.flatnonzero(x[:-1]), np.flatnonzero(y[:-1])
                tables = drawn_tables(rng, np.append(x[keep_x], x[-1]), np.append(y[keep_y], y[-1]), n)[:, :-1, :-1]
                bits = np.where(tables.sum((1, 2)) >= 2, np.maximum(_bits(tables), 0), 0) if tables.size else np.zeros(n)
                out.append(pd.DataFrame({"r": b * BLOCK + np.arange(n), "col_i": i, "col_j": j, "mi": bits}))
            if out:
                yield pd.concat(out)

    drawn = staged(work.repartition("col_i", "col_j", "_b").mapInPandas(draw, "r int, col_i int, col_j int, mi double"))
    null = average_product(drawn, "mi", by=("r",)).select("r", "col_i", "col_j", F.col("mi_apc").alias("x"))
    target = observed.select("col_i", "col_j", "mi_bits", "mi_apc")
    x = F.col("x")
    sums = null.join(target, ["col_i", "col_j"]).groupBy("col_i", "col_j").agg(
        F.max("mi_bits").alias("mi_bits"), F.max("mi_apc").alias("mi_apc"), F.count_if(x >= F.col("mi_apc")).alias("ge"), F.avg(x).alias("s1"), F.avg(x * x).alias("s2"), F.avg(x * x * x).alias("s3")
    )

    def tail(batches):
        for p in batches:
            var = np.maximum(p.s2 - p.s1**2, 0)
            sd = np.sqrt(var * replicates / (replicates - 1))
            skew = np.where(var > 0, (p.s3 - 3 * p.s1 * p.s2 + 2 * p.s1**3) / np.maximum(var, 1e-300) ** 1.5, 0)
            t = [gamma_tail(*v, floor=1 / (10 * (replicates + 1))) for v in zip(p.mi_apc, p.s1, sd, skew, strict=True)]
            z = np.where(sd > 0, (p.mi_apc - p.s1) / np.where(sd > 0, sd, 1), 0)
            yield pd.DataFrame({"col_i": p.col_i, "col_j": p.col_j, "mi_bits": p.mi_bits, "mi_apc": p.mi_apc, "null_mean": p.s1, "null_sd": sd, "null_skew": skew, "z": z, "p_normal": normal_sf(z), "p_empirical": (1 + p["ge"]) / (replicates + 1), "p": [v[0] for v in t], "tail_model": [v[1] for v in t]})

    return sums.mapInPandas(tail, "col_i int, col_j int, mi_bits double, mi_apc double, null_mean double, null_sd double, null_skew double, z double, p_normal double, p_empirical double, p double, tail_model string")


def null_mode(rows: DataFrame, clade: str = "clade", label: str = "label", least: float = 0.5) -> str:
    """``within_clade`` unless fewer than half of the labelled rows are in clades of two or more."""
    size = rows.where(F.col(label).isNotNull()).groupBy(clade).agg(F.count("*").alias("n"))
    whole, shared = size.agg(F.sum("n"), F.sum(F.when(F.col("n") >= 2, F.col("n")))).first()
    return "within_clade" if whole and (shared or 0) / whole >= least else "global_fallback"


def weight_class(weight: Column) -> Column:
    """Weights that differ by less than a sixteenth of a doubling or so: one class."""
    return F.when(weight > 0, F.round(16 * F.log2(weight))).otherwise(F.lit(None)).cast("int")


def label_null(rows: DataFrame, replicates: int = 200, seed: int = 1) -> DataFrame:
    """``rows``: row, label, weight, clade.  Per column: information about labels, corrected for entropy, against
    labels permuted within clades (or globally, where clades are too small to permute).

    In a clade a replicate pairs its rows with its labels at random.  Rows of one symbol and weight class
    are alike, so their table is drawn from the two margins; a class counts with its mean weight.  Each column of
    each block of replicates is one stream of clades; a task holds the summed tables of its replicates.
    """
    rows = rows.where(F.col("label").isNotNull())
    mode = null_mode(rows)
    rows = staged(rows.withColumn("clade", F.col("clade") if mode == "within_clade" else F.lit(None).cast("string")))
    observed = entropy_scaled(label_information(rows, "label"))
    labels = staged(rows.groupBy("clade", "label").agg(F.count("*").alias("n")))
    names = labels.groupBy("label").agg(F.sum("n").alias("n"))
    numbered = names.select("label", (F.row_number().over(W.orderBy("label")) - 1).alias("g"))  # labels are few (``partitions``)
    k = names.count()
    per_clade = labels.join(F.broadcast(numbered), "label").groupBy("clade").agg(F.array_sort(F.collect_list(F.struct("g", "n"))).alias("labels"))
    symbol = F.when(F.col("residue").isin(*RESIDUES), F.col("residue")).otherwise(GAP)
    cells = counted(rows.withColumn("_w", weight_class(F.col("weight"))), ["clade", "_w"], {"n": None, "m": "weight"})
    cells = cells.groupBy("clade", "pos", symbol.alias("a"), "_w").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    symbols = F.array_sort(F.collect_list(F.struct((F.instr(F.lit(RESIDUES), F.col("a")) - 1).alias("a"), "_w", "n", "m")))
    both = cells.groupBy("clade", "pos").agg(symbols.alias("symbols")).join(per_clade.withColumnRenamed("clade", "_c"), F.col("clade").eqNullSafe(F.col("_c"))).drop("_c")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // BLOCK) - 1))).alias("_b")
    work = both.select("pos", "clade", "symbols", "labels", blocks)

    def streams(batches):
        for batch in batches:
            yield from batch.to_pylist()

    def draw(batches):
        for (pos, b), clades in groupby(streams(batches), key=lambda r: (r["pos"], r["_b"])):
            n = min(BLOCK, replicates - b * BLOCK)
            rng = np.random.default_rng((seed, pos, b))
            sums = np.zeros((n, len(RESIDUES) + 1, k))  # the gap is symbol -1, the last
            for c in clades:
                margin, g = np.array([s["n"] for s in c["symbols"]]), [x["g"] for x in c["labels"]]
                tables = drawn_tables(rng, margin, np.array([x["n"] for x in c["labels"]]), n)
                for s, t in zip(c["symbols"], tables.transpose(1, 0, 2), strict=True):
                    sums[:, s["a"], g] += t * (s["m"] / s["n"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, pos, np.int32)), pa.array((b * BLOCK + np.arange(n)).astype(np.int32)), pa.array(np.maximum(_bits(sums), 0))], names=["pos", "r", "mi"])

    drawn = staged(work.repartition("pos", "_b").sortWithinPartitions("pos", "_b", "clade").mapInArrow(draw, "pos int, r int, mi double"))
    observed = staged(observed.select(F.col("pos").cast("int").alias("pos"), "corrected", "entropy_bits"))
    mean_h = F.broadcast(observed.agg(F.avg("entropy_bits").alias("_h")))
    means = drawn.groupBy("r").agg(F.avg("mi").alias("_s"))
    scored = drawn.join(means, "r").join(observed, "pos").crossJoin(mean_h)
    x = F.when(F.col("_h") > 0, F.col("mi") - F.col("entropy_bits") * F.col("_s") / F.col("_h")).otherwise(F.col("mi"))
    out = scored.groupBy(F.col("pos").alias("match_col")).agg(F.max("corrected").alias("mi_bits"), F.avg(x).alias("null_mean"), F.stddev_samp(x).alias("null_sd"))
    out = out.withColumn("z", F.when(F.col("null_sd") > 0, (F.col("mi_bits") - F.col("null_mean")) / F.col("null_sd")).otherwise(0.0))

    def tail(batches):
        for p in batches:
            yield p.assign(p=normal_sf(p.z.to_numpy()), null_mode=mode)

    return out.mapInPandas(tail, "match_col int, mi_bits double, null_mean double, null_sd double, z double, p double, null_mode string")


def partitions(parts: dict[str, DataFrame], seq_id: str, min_size: int, max_groups: int, min_rows: int = 30) -> DataFrame:
    """(partition, seq_id, label) of named label tables: groups of ``min_size`` or more, the
    ``max_groups`` largest, and only partitions with two groups and ``min_rows`` rows."""
    out = None
    for name, df in parts.items():
        one = df.where(F.col("label").isNotNull()).select(F.lit(name).alias("partition"), seq_id, "label")
        out = one if out is None else out.unionByName(one)
    sizes = out.groupBy("partition", "label").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
    kept = sizes.withColumn("_k", F.row_number().over(W.partitionBy("partition").orderBy(F.col("n").desc(), "label"))).where(F.col("_k") <= max_groups)
    whole = W.partitionBy("partition")
    kept = kept.withColumn("_g", F.count("*").over(whole)).withColumn("_r", F.sum("n").over(whole)).where((F.col("_g") >= 2) & (F.col("_r") >= min_rows))
    return out.join(F.broadcast(kept.select("partition", "label")), ["partition", "label"]).select("partition", seq_id, "label")


def replication(calls: DataFrame) -> DataFrame:
    """(match_col, n_partitions, partitions): where a significant position replicates."""
    return calls.where("significant").groupBy("match_col").agg(F.count("*").alias("n_partitions"), F.array_join(F.array_sort(F.collect_list("partition")), ",").alias("partitions"))
