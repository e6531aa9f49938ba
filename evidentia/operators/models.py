"""Regression on entity tables: maximum likelihood through pyspark.ml, penalised and
phylogenetic fits in numpy on tables of tips."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import normal_sf, student_t_two_sided


def usable(df: DataFrame, response: str, covariates: list[str], min_each: int = 5) -> tuple[DataFrame, list[str]]:
    """Complete cases and the covariates that vary; raises where either class is too small."""
    full = df.dropna(subset=[response, *covariates])
    r = full.agg(F.count("*").alias("_n"), F.sum(response).alias("_y"), *[F.count_distinct(c).alias(c) for c in covariates]).first()
    if (r["_y"] or 0) < min_each or r["_n"] - (r["_y"] or 0) < min_each:
        raise ValueError(f"{r['_y']} positives of {r['_n']}: too few of one class")
    return full, [c for c in covariates if r[c] > 1]


def logit_glm(df: DataFrame, response: str, covariates: list[str]) -> DataFrame:
    """(term, estimate, se, z, p, odds_ratio) of a binomial model."""
    full, kept = usable(df, response, covariates)
    x = VectorAssembler(inputCols=kept, outputCol="features").transform(full.withColumn("label", F.col(response).cast("double")))
    m = GeneralizedLinearRegression(family="binomial", link="logit").fit(x)
    est = [*m.coefficients.toArray().tolist(), float(m.intercept)]
    se = list(m.summary.coefficientStandardErrors)
    rows = [(t, float(b), float(s), float(b / s), float(2 * normal_sf(abs(b / s))), float(np.exp(b))) for t, b, s in zip([*kept, "(Intercept)"], est, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, z double, p double, odds_ratio double")


def separated(df: DataFrame, group: str, response: str) -> DataFrame:
    """Groups whose responses are all 0 or all 1."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.sum(response).cast("long").alias("n_positive")).where("n_positive = 0 or n_positive = n")


def stratified(df: DataFrame, stratum: str, row_id: str, n: int, seed: int = 1) -> DataFrame:
    """The first ``n`` rows of each stratum in a seeded hash order (the sampling is the feature)."""
    order = F.row_number().over(W.partitionBy(stratum).orderBy(F.xxhash64(F.lit(seed), F.col(row_id).cast("string")), row_id))
    return df.withColumn("_k", order).where(F.col("_k") <= n).drop("_k")


def rubin_pool(fits: DataFrame) -> DataFrame:
    """``fits``: replicate, term, estimate, se.  Per term: pooled estimate, se, df, fraction of
    missing information; p is added by ``with_t``."""
    g = fits.groupBy("term").agg(F.count("*").alias("m"), F.avg("estimate").alias("estimate"), F.avg(F.col("se") * F.col("se")).alias("_w"), F.coalesce(F.var_samp("estimate"), F.lit(0.0)).alias("_b"))
    extra = (1 + 1 / F.col("m")) * F.col("_b")
    total = F.col("_w") + extra
    df = F.when(extra > 0, (F.col("m") - 1) * F.pow(1 + F.col("_w") / extra, F.lit(2.0)))
    return g.select("term", "m", "estimate", F.sqrt(total).alias("se"), df.alias("df"), (extra / total).alias("fmi"))


def with_t(pooled: DataFrame) -> DataFrame:
    """Two-sided p of estimate / se with the pooled degrees of freedom."""

    def run(batches):
        for b in batches:
            t = (b.estimate / b.se).to_numpy()
            p = [student_t_two_sided(x, d) if np.isfinite(d) else float(2 * normal_sf(abs(x))) for x, d in zip(t, b.df.fillna(np.inf), strict=True)]
            yield b.assign(t=t, p=p)

    return pooled.mapInPandas(run, "term string, m long, estimate double, se double, df double, fmi double, t double, p double")


def firth(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance of a logistic model with Jeffreys' penalty."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        w = p * (1 - p)
        info = (x * w[:, None]).T @ x
        inv = np.linalg.inv(info)
        h = np.einsum("ij,jk,ik->i", x, inv, x) * w
        step = inv @ (x.T @ (y - p + h * (0.5 - p)))
        b = b + step * min(1, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return b, inv


def adjusted_prevalence(tips: pd.DataFrame, response: str, group: str, covariates: list[str]) -> pd.DataFrame:
    """Per group: prevalence predicted at the covariates' means, with a Wald interval on the logit."""
    d = tips.dropna(subset=[response, group, *covariates])
    groups = sorted(d[group].unique())
    c = d[covariates].to_numpy(float) - d[covariates].to_numpy(float).mean(0)
    x = np.column_stack([(d[group] == g).to_numpy(float) for g in groups] + [c])
    b, cov = firth(x, d[response].to_numpy(float))
    k = len(groups)
    se = np.sqrt(np.diag(cov)[:k])
    inv = lambda z: 1 / (1 + np.exp(-z))
    n = d.groupby(group)[response].agg(["size", "sum"]).loc[groups]
    return pd.DataFrame({group: groups, "n_tips": n["size"].to_numpy(), "n_positive": n["sum"].to_numpy(), "prevalence": inv(b[:k]), "lower": inv(b[:k] - 1.959964 * se), "upper": inv(b[:k] + 1.959964 * se)})


def binary_d(tree: pd.DataFrame, state: dict, replicates: int = 200, seed: int = 1) -> dict:
    """Signal of a binary trait: sum of sister-clade differences, scaled between the means
    under drift with a threshold (0) and under shuffling (1)."""
    from .tree import _levels

    tips, levels, parent = _levels(tree)
    y = np.array([state[x] for x in tree["node"].to_numpy()[tips]], float)
    n = len(tree)
    length = tree["branch_length"].fillna(0).to_numpy(float)
    order = np.argsort(tree["depth"].to_numpy(), kind="stable")
    rng = np.random.default_rng(seed)

    def contrast(v: np.ndarray) -> float:
        value, weight, total = np.zeros(n), np.zeros(n), 0.0
        value[tips], weight[tips] = v, 1
        for child, up in levels:
            ok = weight[child] > 0
            child, up = child[ok], up[ok]
            s, k = np.zeros(n), np.zeros(n)
            np.add.at(s, up, value[child])
            np.add.at(k, up, 1)
            at = np.unique(up)
            value[at], weight[at] = s[at] / k[at], 1
            total += float(np.abs(value[child] - value[up]).sum())
        return total

    def drift() -> np.ndarray:
        v = np.zeros(n)
        noise = rng.normal(size=n) * np.sqrt(np.maximum(length, 0))
        for k in order:
            v[k] = (v[parent[k]] if parent[k] >= 0 else 0) + noise[k]
        return (v[tips] > np.quantile(v[tips], 1 - y.mean())).astype(float)

    observed = contrast(y)
    shuffled = np.array([contrast(rng.permutation(y)) for _ in range(replicates)])
    drifted = np.array([contrast(drift()) for _ in range(replicates)])
    wide = shuffled.mean() - drifted.mean()
    return {"d": (observed - drifted.mean()) / wide if wide else float("nan"), "p_random": float((shuffled <= observed).mean()), "p_brownian": float((drifted >= observed).mean())}
