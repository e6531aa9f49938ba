"""Density clusters: mutual reachability, its minimum spanning tree by Boruvka rounds, the condensed tree.

Core distances come from the exact nearest neighbours of each row (``vectors.neighbours``).  A Boruvka round
takes for each component its least edge outwards.  Neighbour lists settle most of them: what is not in a row's list
lies beyond its radius, so a row can be skipped where its component has an edge within that.  The rows that
are left are searched against all rows in blocks.  Edges are ordered by (reachability, ids), so the
tree is one and the same whatever the partitions.

The tree has a row per point less one; its merging order is a chain, so the condensed tree is built from it in one
place, after its rows are counted and found within TREE_ROWS.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .graph import hook
from .joins import CheckFailed
from .staging import staged

TREE_ROWS = 5_000_000
LIST = 10


def core_distances(near: DataFrame, min_size: int) -> DataFrame:
    """(id, core, radius): the distance within which ``min_size`` rows lie, itself included, or all
    there are, and how far the list reaches."""
    core = F.coalesce(F.max(F.when(F.col("rank") <= min_size - 1, F.col("d"))), F.lit(0.0))
    return near.groupBy(F.col("u").alias("id")).agg(core.alias("core"), F.max("d").alias("radius"))


class Outwards:
    """The least edge (w, a, b) out of each component that a task finds.  ``bar`` of a row is the edge its component
    has already: only what is no longer than that is looked at."""

    def __init__(self):
        self.best = {}

    def __call__(self, q: V.Rows, b: V.Rows) -> None:
        comp, core = q.numbers["comp"].astype(np.int64), q.numbers["core"]
        some, at = np.unique(comp, return_inverse=True)
        bar = np.minimum(q.numbers["bar"], np.array([self.best.get(c, (np.inf,))[0] for c in some.tolist()])[at])
        other = b.numbers["comp"]
        far = q.squared(b)
        open_ = np.flatnonzero(core <= bar)
        limit = bar[open_] ** 2 + V.NEAR
        inf = np.isinf(limit)
        if inf.any():  # the nearest that leads out, or one that is as near by its core
            w = np.maximum(far[open_[inf]], np.maximum(core[open_[inf], None], b.numbers["core"][None]) ** 2)
            w[comp[open_[inf], None] == other[None]] = np.inf
            least = w.min(1)
            limit[inf] = np.where(np.isfinite(least), least + V.NEAR, -1.0)
        x, y = np.nonzero(far[open_] <= limit[:, None])
        x = open_[x]
        out = comp[x] != other[y]
        x, y = x[out], y[out]
        w = np.maximum(np.maximum(np.sqrt(np.maximum(np.round(far[x, y], 10), 0)), core[x]), b.numbers["core"][y])
        low, high = np.minimum(q.ids[x], b.ids[y]), np.maximum(q.ids[x], b.ids[y])
        order = np.lexsort((high, low, w, comp[x]))
        first = order[np.concatenate(([True], comp[x[order[1:]]] != comp[x[order[:-1]]]))] if len(x) else order
        for c, *e in zip(comp[x[first]].tolist(), w[first].tolist(), low[first].tolist(), high[first].tolist(), strict=True):
            if c not in self.best or tuple(e) < self.best[c]:
                self.best[c] = tuple(e)

    def rest(self):
        c, e = list(self.best), list(self.best.values())
        yield {"comp": np.array(c, np.int64), **{n: np.array([x[i] for x in e], t) for i, (n, t) in enumerate((("w", float), ("a", np.int64), ("b", np.int64)))}}


def spanning_tree(df: DataFrame, row_id: str, vector: str, min_size: int) -> DataFrame:
    """(a, b, w) with a < b: the minimum spanning tree of mutual reachability over rows with unique ids."""
    near = staged(V.neighbours(df, row_id, vector, max(LIST, min_size)))
    core = staged(core_distances(near, min_size))
    of = lambda c, *more: core.select(F.col("id").alias(c), F.col("core").alias(f"core_{c}"), *more)
    reach = near.select("u", "v", "d").join(of("u"), "u").join(of("v"), "v")
    reach = staged(reach.select("u", "v", F.greatest("d", "core_u", "core_v").alias("w")))
    label = staged(core.select("id", F.col("id").alias("comp")))
    tree = None

    while label.select("comp").distinct().limit(2).count() > 1:
        side = lambda c: label.select(F.col("id").alias(c), F.col("comp").alias(f"comp_{c}"))  # noqa: E731, B023
        listed = reach.join(side("u"), "u").join(side("v"), "v").where("comp_u != comp_v")
        listed = staged(listed.groupBy(F.col("comp_u").alias("comp")).agg(F.min(F.struct("w", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).alias("e")))
        bound = F.greatest("core", "radius")
        open_ = label.join(core, "id").join(listed, "comp", "left").where(F.col("e").isNull() | (bound <= F.col("e.w")))
        open_ = open_.select("id", F.coalesce("e.w", F.lit(float("inf"))).alias("bar"))
        best = listed.select("comp", "e.*")
        open_ = staged(open_)
        if not open_.isEmpty():
            rows = df.select(F.col(row_id).cast("long").alias("id"), vector).join(core.join(label, "id"), "id")
            blocks = V.packed(rows, "id", vector, ["core", "comp"])
            asked = V.packed(rows.join(open_, "id"), "id", vector, ["core", "comp", "bar"])
            best = best.unionByName(V.meet(asked, blocks, Outwards, "comp long, w double, a long, b long", held=True))
        chosen = staged(best.groupBy("comp").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*").distinct())
        tree = chosen if tree is None else tree.unionByName(chosen)
        ends = lambda c: label.select(F.col("id").alias(c), F.col("comp").alias(f"_{c}"))  # noqa: E731, B023
        links = chosen.join(ends("a"), "a").join(ends("b"), "b").select(F.col("_a").alias("u"), F.col("_b").alias("v"))
        moved = hook(links, []).select(F.col("node").alias("comp"), F.col("component").alias("_to"))
        label = staged(label.join(moved, "comp", "left").select("id", F.coalesce("_to", "comp").alias("comp")))
    return df.sparkSession.createDataFrame([], "w double, a long, b long") if tree is None else tree


def condensed(edges: np.ndarray, ids: np.ndarray, min_size: int) -> np.ndarray:
    """Labels (-1: noise) of ``ids`` from the tree's edges (w, a, b): of the splits into two sides of ``min_size`` or
    more, the clusters of the greatest stability, the whole itself excepted."""
    n = len(ids)
    order = np.lexsort((edges["b"], edges["a"], edges["w"]))
    a, b, w = np.searchsorted(ids, edges["a"][order]), np.searchsorted(ids, edges["b"][order]), edges["w"][order]
    up, size = np.arange(2 * n - 1), np.ones(2 * n - 1, np.int64)
    left, right = np.full(2 * n - 1, -1), np.full(2 * n - 1, -1)

    def top(i: int) -> int:
        root = i
        while up[root] != root:
            root = up[root]
        while up[i] != root:
            up[i], i = root, up[i]
        return root

    for k in range(n - 1):
        x, y, new = top(a[k]), top(b[k]), n + k
        up[x] = up[y] = new
        left[new], right[new], size[new] = x, y, size[x] + size[y]
    # clusters from the root down: each keeps its own stability and its parts
    births, parts, roots, stability = [0.0], [[]], [2 * n - 2], [0.0]
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        while node >= n:
            lam = 1 / max(w[node - n], 1e-12)
            big = [s for s in (left[node], right[node]) if size[s] >= min_size]
            if len(big) == 2:
                stability[c] += size[node] * (lam - births[c])
                for s in big:
                    parts[c].append(len(births))
                    todo.append((s, len(births)))
                    births.append(lam)
                    parts.append([])
                    roots.append(s)
                    stability.append(0.0)
                break
            stability[c] += sum(size[s] for s in (left[node], right[node]) if s not in big) * (lam - births[c])
            if not big:
                break
            node = big[0]
    total, chosen = list(stability), [True] * len(births)
    for c in range(len(births) - 1, -1, -1):
        below = sum(total[p] for p in parts[c])
        if c == 0 or (parts[c] and below > stability[c]):
            chosen[c], total[c] = False, below
    label, taken = np.full(n, -1), 0
    todo = [0]
    while todo:
        c = todo.pop()
        if not chosen[c]:
            todo += parts[c][::-1]
            continue
        nodes = [roots[c]]
        while nodes:
            x = nodes.pop()
            if x < n:
                label[x] = taken
            else:
                nodes += [left[x], right[x]]
        taken += 1
    return label


def density_clusters(df: DataFrame, row_id: str, vector: str, min_size: int) -> DataFrame:
    """(id, cluster) of each row with a vector: clusters numbered from 0, -1 for noise.  Ids are unique; fewer than
    ``min_size`` rows are all noise, and so is a table that never splits into two clusters."""
    spark = df.sparkSession
    rows = df.where(F.col(row_id).isNotNull() & F.col(vector).isNotNull())
    n = rows.count()
    if n < max(2, min_size):
        return rows.select(F.col(row_id).cast("long").alias("id"), F.lit(-1).alias("cluster"))
    if n > TREE_ROWS:
        raise CheckFailed(f"a tree of {n} points; the limit is {TREE_ROWS}")
    tree = spanning_tree(rows, row_id, vector, min_size).toPandas()
    ids = np.unique(np.concatenate((tree["a"], tree["b"])))
    found = condensed({c: tree[c].to_numpy() for c in ("a", "b", "w")}, ids, min_size)
    return spark.createDataFrame(zip(ids.tolist(), found.tolist(), strict=True), "id long, cluster int")
