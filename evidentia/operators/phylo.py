"""Phylogenetic logistic regression by maximum penalised likelihood, in replicates.

A binary trait moves along the tree at rate alpha around the mean of the tips' expectations, and each tip
then takes its own expectation, logistic in its covariates.  The likelihood is pruned from the tips up, and the
information matrix (Firth's penalty and the standard errors) comes from the tree's three-point structure, so a
fit is linear in the tips; nothing of n x n is made.

A replicate is a sample of tips, both outcomes apart, with the part of the tree above them; replicates are rows of
the tables that go in and tasks of the fit.  What a task holds is bounded by ``max_tips``.  A replicate whose
search does not end, whose standard errors are not finite, or whose alpha lies at its bound is discarded and counted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import firth, rubin_pool, with_t
from .staging import numbered, staged
from .tree import summed

SHORTEST = 1e-8
BOUND = 4.0  # of |log(alpha * height)|


def subsamples(tips: DataFrame, tip: str, response: str, max_tips: int, replicates: int, seed: int = 1) -> DataFrame:
    """``tips`` (complete cases) with ``r``: one replicate of all where they are ``max_tips`` at most, else
    ``replicates`` samples of positives, half at most, and of negatives for the rest, in the order of a digest of
    seed, replicate and tip."""
    n, positive = tips.agg(F.count("*"), F.coalesce(F.sum(F.col(response).cast("long")), F.lit(0))).first()
    if n <= max_tips:
        return tips.withColumn("r", F.lit(0))
    take_1 = min(positive, max_tips // 2)
    take_0 = min(n - positive, max_tips - take_1)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col("_t").cast("string")))
    drawn = tips.select(F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r"), F.col(tip).alias("_t"), F.col(response).cast("int").alias("_y")).withColumn("_h", digest)
    placed = numbered(drawn, [F.col("r"), F.col("_y").desc(), F.col("_h"), F.col("_t")], "_at")
    place = F.col("_at") - F.col("r") * n
    some = placed.where(F.when(F.col("_y") == 1, place < take_1).otherwise(place < positive + take_0)).select("r", "_t")
    return tips.join(some, F.col(tip) == F.col("_t")).drop("_t")


class Shape:
    """A tree as arrays: edges by depth from the deepest, and tips in a given order."""

    def __init__(self, nodes: pd.DataFrame, tips: list):
        place = {x: i for i, x in enumerate(nodes["node"])}
        self.n = len(nodes)
        self.tips = np.array([place[t] for t in tips])
        depth = nodes["depth"].to_numpy()
        up = np.array([place.get(p, -1) if p is not None else -1 for p in nodes["parent"]])
        length = np.maximum(nodes["branch_length"].fillna(0).to_numpy(float), SHORTEST)
        self.length = np.where(up >= 0, length, 0.0)
        self.levels = [(np.flatnonzero((depth == d) & (up >= 0)), up[(depth == d) & (up >= 0)]) for d in range(int(depth.max()), 0, -1)]
        self.root = int(np.flatnonzero(up < 0)[0])
        self.height = np.zeros(self.n)
        for child, parent in reversed(self.levels):
            self.height[child] = self.height[parent] + self.length[child]
        self.top = self.height[self.tips].max()


def log_likelihood(shape: Shape, y: np.ndarray, mu: np.ndarray, alpha: float) -> float:
    mean = mu.mean()
    one, zero = np.minimum(1, mu / mean), np.maximum(0, 1 - (1 - mu) / (1 - mean))
    with np.errstate(divide="ignore"):
        at = np.zeros((shape.n, 2))
        at[shape.tips, 1] = np.log(np.where(y > 0, one, 1 - one))
        at[shape.tips, 0] = np.log(np.where(y > 0, zero, 1 - zero))
        stay = np.exp(-alpha * shape.length)
        for child, parent in shape.levels:
            top = at[child].max(1)
            p0, p1, e = np.exp(at[child, 0] - top), np.exp(at[child, 1] - top), stay[child]
            np.add.at(at[:, 0], parent, top + np.log((1 - mean * (1 - e)) * p0 + mean * (1 - e) * p1))
            np.add.at(at[:, 1], parent, top + np.log((1 - mean) * (1 - e) * p0 + (mean + (1 - mean) * e) * p1))
        top = at[shape.root].max()
        return float(top + np.log((1 - mean) * np.exp(at[shape.root, 0] - top) + mean * np.exp(at[shape.root, 1] - top)))


def information(shape: Shape, x: np.ndarray, mu: np.ndarray, alpha: float) -> np.ndarray:
    """X' W V^-1 W X with W the tips' standard deviations and V = exp(-alpha * path length).

    V is, but for a factor for each tip, a covariance by shared depth, exp(-2 alpha (top - depth)): sums over
    the tips below a node go up its branch by a rank one correction.
    """
    value = np.exp(-2 * alpha * (shape.top - shape.height))
    k = x.shape[1]
    rows = x * (np.sqrt(mu * (1 - mu)) * np.exp(-alpha * (shape.top - shape.height[shape.tips])))[:, None]
    weight, mean, total = np.zeros(shape.n), np.zeros((shape.n, k)), np.zeros((k, k))
    is_tip = np.zeros(shape.n, bool)
    is_tip[shape.tips] = True
    mean[shape.tips] = rows
    for child, parent in [*shape.levels, (np.array([shape.root]), np.array([-1]))]:
        branch = np.where(parent >= 0, value[child] - value[parent], value[child])
        tip = is_tip[child]
        p = weight[child]
        u = np.where(tip[:, None], mean[child], mean[child] / np.where(p > 0, p, 1)[:, None])
        t, own = u[tip], 1 / np.maximum(branch[tip], 1e-300)
        total += (t * own[:, None]).T @ t
        q = u[~tip]
        lost = branch[~tip] * p[~tip] ** 2 / (1 + branch[~tip] * p[~tip])
        total -= (q * lost[:, None]).T @ q
        up = np.where(tip, 1 / np.maximum(branch, 1e-300), p / (1 + branch * p))
        if parent[0] >= 0:
            np.add.at(weight, parent, up)
            np.add.at(mean, parent, up[:, None] * u)
    return total


def simplex(f, start: np.ndarray, step: float = 0.3, rounds: int = 600, tol: float = 1e-7) -> tuple[np.ndarray, float, bool]:
    """Nelder and Mead's search for a minimum: the point, its value, and whether it ended by itself."""
    points = [start, *[start + step * e for e in np.eye(len(start))]]
    held = sorted(((f(p), tuple(p)) for p in points), key=lambda v: v[0])
    for _ in range(rounds):
        best, worst = held[0], held[-1]
        if abs(worst[0] - best[0]) < tol * (1 + abs(best[0])) and max(abs(np.array(worst[1]) - best[1])) < 1e-4:
            return np.array(best[1]), best[0], True
        middle = np.mean([p for _, p in held[:-1]], axis=0)
        at = lambda c, middle=middle, worst=worst: (lambda p: (f(p), tuple(p)))(middle + c * (middle - np.array(worst[1])))
        new = at(1.0)
        if new[0] < best[0]:
            far = at(2.0)
            new = far if far[0] < new[0] else new
        elif new[0] >= held[-2][0]:
            near = at(0.5 if new[0] < worst[0] else -0.5)
            if near[0] >= min(new[0], worst[0]):
                held = sorted([best, *[(lambda p: (f(p), tuple(p)))(np.array(best[1]) + 0.5 * (np.array(p) - best[1])) for _, p in held[1:]]], key=lambda v: v[0])
                continue
            new = near
        held = sorted([*held[:-1], new], key=lambda v: v[0])
    return np.array(held[0][1]), held[0][0], False


def fit(shape: Shape, x: np.ndarray, y: np.ndarray) -> dict:
    """Coefficients, standard errors, alpha, the penalised log likelihood and why the fit is not to be used, if so."""
    k = x.shape[1]

    def cost(v: np.ndarray) -> float:
        mu = 1 / (1 + np.exp(-np.clip(x @ v[:k], -30, 30)))
        scale = np.clip(v[k], -BOUND, BOUND)
        alpha = np.exp(scale) / shape.top
        sign, size = np.linalg.slogdet(information(shape, x, mu, alpha))
        like = log_likelihood(shape, y, mu, alpha)
        return -(like + 0.5 * size) + (v[k] - scale) ** 2 if sign > 0 and np.isfinite(like) else 1e300

    start, _ = firth(x, y)
    best, value, ended = simplex(cost, np.append(start, 0.0))
    alpha = float(np.exp(np.clip(best[k], -BOUND, BOUND)) / shape.top)
    info = information(shape, x, 1 / (1 + np.exp(-np.clip(x @ best[:k], -30, 30))), alpha)
    with np.errstate(invalid="ignore"):
        se = np.sqrt(np.diag(np.linalg.pinv(info)))
    why = [w for bad, w in ((not ended, "search did not end"), (not np.isfinite(se).all() or (se <= 0).any(), "standard errors not finite"), (abs(best[k]) >= BOUND - 1e-3, "alpha at its bound")) if bad]
    return {"coefficients": best[:k], "se": se, "alpha": alpha, "loglik": -value, "discarded": "; ".join(why)}


FITS = "r int, term string, estimate double, se double, alpha double, loglik double, n_tips long, n_positive long, discarded string"


def replicate_fits(tree: DataFrame, samples: DataFrame, tip: str, response: str, covariates: list[str]) -> DataFrame:
    """A row per replicate and term of ``samples`` (r, tip, response, covariates)."""
    rows = staged(samples.select("r", F.col(tip).alias("node"), F.col(response).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in covariates]))
    above = summed(tree, rows.select("r", "node", F.lit(1).cast("long").alias("n")), ["r"], n=F.sum).select("r", "node")
    shape = above.join(tree.select("node", "parent", "depth", "branch_length"), "node").select("r", "node", "parent", "depth", F.col("branch_length").cast("double").alias("branch_length"))

    def one(key: tuple, nodes: pd.DataFrame, tips: pd.DataFrame) -> pd.DataFrame:
        nodes, tips = nodes.sort_values("node"), tips.sort_values("node")
        kept = [c for c in covariates if tips[c].nunique() > 1]
        x, y = np.column_stack([np.ones(len(tips)), *[tips[c] for c in kept]]), tips["y"].to_numpy()
        got = fit(Shape(nodes.reset_index(drop=True), tips["node"].tolist()), x, y)
        out = pd.DataFrame({"term": ["(Intercept)", *kept], "estimate": got["coefficients"], "se": got["se"]})
        return out.assign(r=int(key[0]), alpha=got["alpha"], loglik=got["loglik"], n_tips=len(tips), n_positive=int(y.sum()), discarded=got["discarded"])[[c.split()[0] for c in FITS.split(", ")]]

    return shape.groupBy("r").cogroup(rows.groupBy("r")).applyInPandas(one, FITS)


def phylogenetic_logit(tree: DataFrame, tips: DataFrame, tip: str, response: str, covariates: list[str], max_tips: int = 8000, replicates: int = 20, min_each: int = 10, seed: int = 1) -> DataFrame:
    """(term, estimate, se, z, p, df, odds_ratio, fmi, n_replicates, n_discarded, alpha): fits of the replicates that
    are to be used, pooled by Rubin's rules.  One row without a term tells that none was, or that one outcome has
    fewer than ``min_each`` complete cases (``n_discarded`` is null then)."""
    full = staged(tips.dropna(subset=[tip, response, *covariates]).join(tree.where("is_tip").select(F.col("node").alias(tip)), tip, "left_semi"))
    n, positive = full.agg(F.count("*"), F.coalesce(F.sum(F.col(response).cast("long")), F.lit(0))).first()
    shape = "term string, estimate double, se double, z double, p double, df double, odds_ratio double, fmi double, n_replicates long, n_discarded long, alpha double"
    if min(positive, n - positive) < min_each:
        return tree.sparkSession.createDataFrame([(None,) * 11], shape)
    fits = staged(replicate_fits(tree, subsamples(full, tip, response, max_tips, replicates, seed), tip, response, covariates))
    bad = fits.where("discarded != ''").select("r").distinct().count()
    good = fits.where("discarded = ''")
    if good.isEmpty():
        return tree.sparkSession.createDataFrame([(None,) * 9 + (bad, None)], shape)
    pooled = with_t(rubin_pool(good.withColumnRenamed("r", "replicate")))
    alpha = good.select("r", "alpha").distinct().agg(F.avg("alpha").alias("alpha"))
    out = pooled.crossJoin(F.broadcast(alpha))
    return out.select("term", "estimate", "se", F.col("t").alias("z"), "p", "df", F.exp("estimate").alias("odds_ratio"), "fmi", F.col("m").alias("n_replicates"), F.lit(bad).cast("long").alias("n_discarded"), "alpha")
