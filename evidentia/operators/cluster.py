"""Embedding, clustering and selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import places, symbols
from .staging import staged


class Embedding:
    """Rows of letters as vectors: the letters' vectors one after another, zeros for what has none, each position times
    its weight, 0 beyond the weights; with ``unit`` brought to length 1 (zeros stay); then a 0/1 for each of ``values``.
    Works on Arrow batches; ``reduced`` builds the vectors and leaves what is asked of them, so they stay in their task."""

    AT_ONCE = 1024

    def __init__(self, vectors: dict[str, list[float]], weights: list[float] | None = None, unit: bool = False, values: list[str] = ()):
        self.size = len(next(iter(vectors.values())))
        letters = {ord(r): v for r, v in vectors.items() if len(r) == 1}
        self.table = np.zeros((max(letters, default=0) + 2, self.size))
        for code, v in letters.items():
            self.table[code] = v
        self.weights, self.unit, self.values = None if weights is None else np.array(weights, float), unit, list(values)

    def numbers(self, rows: pa.Array, category: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The vectors' numbers one after another, and how many each row has."""
        code, n = symbols(rows)
        _, row, col = places(n)
        out = self.table[np.minimum(code, len(self.table) - 1)]
        if self.weights is not None:
            out *= np.concatenate((self.weights, np.zeros(max(0, int(n.max(initial=0)) - len(self.weights)))))[col, None]
        if self.unit:
            norm = np.sqrt(np.bincount(row, np.einsum("ij,ij->i", out, out), len(n)))
            out /= np.where(norm > 0, norm, 1.0)[row, None]
        if not self.values:
            return out.ravel(), n * self.size
        more = np.stack([pc.equal(category, v).fill_null(False).to_numpy(zero_copy_only=False) for v in self.values], 1).astype(float)
        length = n * self.size + len(self.values)
        ends, full = np.cumsum(length), np.empty(int(length.sum()))
        at = (ends - len(self.values))[:, None] + np.arange(len(self.values))
        full[at] = more
        body = np.ones(len(full), bool)
        body[at] = False
        full[body] = out.ravel()
        return full, length

    def column(self, row: str | Column) -> Column:
        """The vectors as an array column; null for a null row."""
        def make(rows: pa.Array) -> pa.Array:
            values, n = self.numbers(rows)
            out = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(values))
            return pc.if_else(rows.is_valid(), out, None)

        return F.arrow_udf(make, "array<double>")(row)

    def reduced(self, row: str, category: str, reduce, schema: str) -> Column:
        """A struct of what ``reduce(numbers, lengths)`` gives for each row, arrays by the names of ``schema``."""
        def make(rows: pa.Array, kinds: pa.Array) -> pa.Array:
            parts = [reduce(*self.numbers(rows.slice(at, self.AT_ONCE), kinds.slice(at, self.AT_ONCE))) for at in range(0, len(rows), self.AT_ONCE)]
            return pa.StructArray.from_arrays([pa.array(np.concatenate([p[c] for p in parts])) for c in parts[0]], names=list(parts[0]))

        return F.arrow_udf(make, schema)(row, category)


def embed(rows: DataFrame, row: str, vectors: dict[str, list[float]], weights: list[float] | None = None) -> DataFrame:
    """Adds ``vector``: the residues' vectors one after another, zeros for what has none, each
    position times its weight, 0 beyond the weights; null for a null row."""
    return rows.withColumn("vector", Embedding(vectors, weights).column(row))


def standardised(matrix: dict[str, list[float]]) -> dict[str, list[float]]:
    """A substitution matrix's rows with the mean and population sd of all its entries taken out."""
    m = np.array(list(matrix.values()), float)
    m = (m - m.mean()) / m.std()
    return dict(zip(matrix, m.tolist(), strict=True))


def parse_substitution_matrix(text: str) -> dict[str, list[float]]:
    """A matrix file: a header row of residues, then a row per residue."""
    rows = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    return {r[0]: [float(v) for v in r[1:]] for r in rows[1:]}


def pca(df: DataFrame, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """``pc`` of mean-centred vectors (an array), and the explained variance of each component."""
    v = df.withColumn("_v", array_to_vector(vector))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    return model.transform(centred).withColumn("pc", vector_to_array("_p")).drop("_v", "_c", "_p"), model.explainedVariance.toArray().tolist()


def normalised(df: DataFrame, vector: str, out: str = "features") -> DataFrame:
    return Normalizer(inputCol="_v", outputCol=out).transform(df.withColumn("_v", array_to_vector(vector))).drop("_v")


def spherical_kmeans(df: DataFrame, k: int, seed: int = 1, features: str = "features"):
    return KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol=features, predictionCol="cluster").fit(df)


def k_sweep(df: DataFrame, k_min: int, k_max: int, seed: int = 1) -> DataFrame:
    """(k, silhouette_cosine, silhouette_euclidean, inertia, calinski_harabasz, davies_bouldin)."""
    rows = []
    for k in range(k_min, k_max + 1):
        model = spherical_kmeans(df, k, seed)
        out = model.transform(df)
        s = [ClusteringEvaluator(featuresCol="features", predictionCol="cluster", distanceMeasure=m).evaluate(out) for m in ("cosine", "squaredEuclidean")]
        rows.append((k, *s, float(model.summary.trainingCost), *spread(out, "features", "cluster")))
    return df.sparkSession.createDataFrame(rows, "k int, silhouette_cosine double, silhouette_euclidean double, inertia double, calinski_harabasz double, davies_bouldin double")


def spread(df: DataFrame, features: str, cluster: str) -> tuple[float, float]:
    """Calinski-Harabasz and Davies-Bouldin from per-cluster sums: one aggregate over the long
    form, then one over distances; what comes to the driver is k x dimensions."""
    long = df.select(F.monotonically_increasing_id().alias("_id"), F.col(cluster).alias("c"), F.posexplode(vector_to_array(features)).alias("j", "x"))
    cell = {(r["c"], r["j"]): (r["n"], r["s"], r["q"]) for r in long.groupBy("c", "j").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q")).collect()}
    cs, js = sorted({c for c, _ in cell}), sorted({j for _, j in cell})
    n = np.array([cell[c, js[0]][0] for c in cs], float)
    mean = np.array([[cell[c, j][1] / cell[c, j][0] for j in js] for c in cs])
    q = np.array([sum(cell[c, j][2] for j in js) for c in cs])
    within = q - n * (mean**2).sum(1)
    grand = (mean * n[:, None]).sum(0) / n.sum()
    between = (n * ((mean - grand) ** 2).sum(1)).sum()
    k = len(cs)
    ch = between / (k - 1) / (within.sum() / (n.sum() - k)) if k > 1 else float("nan")
    centres = F.create_map(*[x for i, c in enumerate(cs) for x in (F.lit(c), F.array(*[F.lit(float(v)) for v in mean[i]]))])
    gap = F.sqrt(F.aggregate(F.zip_with(vector_to_array(features), F.try_element_at(centres, F.col(cluster)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
    avg = {r[0]: r[1] for r in df.groupBy(cluster).agg(F.avg(gap)).collect()}
    d = np.array([avg[c] for c in cs])
    apart = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(2))
    ratio = (d[:, None] + d[None]) / np.where(apart > 0, apart, np.inf)
    np.fill_diagonal(ratio, 0)
    return float(ch), float(ratio.max(1).mean()) if k > 1 else float("nan")


def inertia(df: DataFrame, k: int, seed: int = 1) -> float:
    """Sum of squared distances to the nearest of k centres; for one centre, to the mean."""
    if k > 1:
        return float(KMeans(k=k, seed=seed, featuresCol="features").fit(df).summary.trainingCost)
    per = df.select(F.posexplode(vector_to_array("features")).alias("j", "x")).groupBy("j").agg((F.var_pop("x") * F.count("x")).alias("ss"))
    return float(per.agg(F.sum("ss")).first()[0] or 0.0)


def gap_statistic(df: DataFrame, k_min: int, k_max: int, references: int = 10, seed: int = 1) -> tuple[int, pd.DataFrame]:
    """Smallest k whose gap is at least the next one's less its standard error, with the table.
    References are uniform draws in the data's box, made on the executors."""
    n = df.count()
    box = df.select(F.posexplode(vector_to_array("features")).alias("j", "x")).groupBy("j").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("j").collect()
    rows = []
    for k in range(k_min, k_max + 1):
        cost = lambda d, k=k: np.log(max(1e-12, inertia(d, k, seed)))
        refs = []
        for r in range(references):
            draw = df.sparkSession.range(n).select(array_to_vector(F.array(*[F.lit(b["lo"]) + F.rand(seed * 1000 + r * 100 + i) * (b["hi"] - b["lo"]) for i, b in enumerate(box)])).alias("features"))
            refs.append(cost(draw))
        rows.append((k, float(np.mean(refs) - cost(df)), float(np.std(refs) * np.sqrt(1 + 1 / references))))
    t = pd.DataFrame(rows, columns=["k", "gap", "se"])
    ok = [i for i in range(len(t) - 1) if t.gap[i] >= t.gap[i + 1] - t.se[i + 1]]
    return int(t.k[ok[0]] if ok else t.k[t.gap.idxmax()]), t


def log_odds(counts: DataFrame, letters: str) -> dict[str, list[float]]:
    """A substitution matrix learned from aligned columns: ``counts`` has (pos, residue, n), the rows of each letter in a
    column.  A pair's score is log2 of how often two rows of a column hold it over what the letters' shares in those
    pairs lead to expect, 0 where it was never seen.  What comes to the driver is letters squared."""
    c = counts.where(F.col("residue").isin(*letters)).select("pos", "residue", F.col("n").cast("double").alias("n"))
    other = c.select("pos", F.col("residue").alias("_b"), F.col("n").alias("_m"))
    # both orders of a pair: n * m for different letters, n * (n - 1) for one
    seen = c.join(other, "pos").groupBy("residue", "_b").agg(F.sum(F.col("n") * F.when(F.col("residue") == F.col("_b"), F.col("n") - 1).otherwise(F.col("_m"))).alias("q"))
    q = {(r["residue"], r["_b"]): r["q"] for r in seen.collect()}
    total = sum(q.values())
    share = {a: sum(q.get((a, b), 0.0) for b in letters) / total if total else 0.0 for a in letters}
    return {a: [float(np.log2(q[a, b] / total / (share[a] * share[b]))) if q.get((a, b)) else 0.0 for b in letters] for a in letters}


def one_hot(df: DataFrame, row: str, letters: str, weights: list[float] | None = None) -> DataFrame:
    """Adds ``vector``: 0/1 per position and letter times the position's weight, then brought to length 1; a row with
    none of the letters stays at zeros."""
    return df.withColumn("vector", Embedding(hot(letters), weights, unit=True).column(row))


def hot(letters: str) -> dict[str, list[float]]:
    return {a: [float(a == b) for b in letters] for a in letters}


def dummies(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """``vector`` with a 0/1 for each of ``values`` at its end; anything else, null too, is all zeros."""
    flags = F.array(*[F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values])
    return df.withColumn("vector", F.concat("vector", flags))


def max_min(df: DataFrame, row_id: str, vector: str, n: int, seeds: list) -> DataFrame:
    """Up to ``n`` rows: the seeds, then each time the row farthest from all chosen (ties: least
    id), until none is apart.  Each step is one pass that keeps a running minimum."""
    dist = lambda v: F.sqrt(F.aggregate(F.zip_with(F.col(vector), v, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, x: a + x))
    chosen = [(i, 0.0) for i in seeds[:n]]
    state = df.select(F.col(row_id).alias("id"), vector, F.lit(None).cast("double").alias("d"))
    new = df.where(F.col(row_id).isin(seeds)).select(F.col(vector).alias("v")).collect()
    while True:
        gaps = [dist(F.array(*[F.lit(float(x)) for x in r["v"]])) for r in new]
        state = staged(state.withColumn("d", F.least(F.col("d"), *gaps) if len(gaps) > 1 or chosen[len(seeds) :] else F.least(*gaps, *gaps)))
        if len(chosen) >= n:
            break
        best = state.where(~F.col("id").isin([c for c, _ in chosen])).agg(F.max_by(F.struct("id", vector, "d"), F.struct(F.round("d", 9), -F.col("id"))).alias("b")).first()["b"]
        if best is None or round(best["d"], 9) <= 0:
            break
        chosen.append((best["id"], float(best["d"])))
        new = [{"v": best[vector]}]
    return df.sparkSession.createDataFrame([(k, *c) for k, c in enumerate(chosen)], "step int, id long, distance double")


def first_in_cluster(df: DataFrame, cluster: str, order: str) -> DataFrame:
    """The row of each cluster that comes first by ``order`` (unique); one aggregate, so a large cluster is no heavy group."""
    return df.groupBy(cluster).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def average_linkage(distances: np.ndarray, names: list[str]) -> pd.DataFrame:
    from .tree import upgma

    return upgma(distances, names)
