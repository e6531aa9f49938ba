"""Dense vectors in packed blocks, and products of blocks.

A table of vectors is packed once, BLOCK rows to a row; a task reads blocks where they lie and meets them with
a chunk of query blocks (CHUNK of them, so of a known size, broadcast).  Rows are neither copied
for each partner nor shuffled; what a product gives is reduced in its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged

BLOCK, CHUNK = 1024, 64
#: By how much a square may pass a bar and still be within it once it is rounded.
NEAR = 1e-8


def packed(df: DataFrame, row_id: str, vector: str, numbers: list[str] | None = None) -> DataFrame:
    """``df`` in blocks: block, ids, x (the matrix by rows, doubles), wide, and each of ``numbers`` (doubles)."""
    numbers = numbers or []
    parts = max(1, -(-df.count() // BLOCK))
    schema = "block long, ids array<long>, wide int, x binary" + "".join(f", {c} array<double>" for c in numbers)

    def pack(batches):
        from pyspark import TaskContext

        held, n, k = [], 0, 0

        def block(part: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(part).combine_chunks()
            ids = t.column("id").to_numpy()
            x = t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64)
            row = [TaskContext.get().partitionId() + parts * k, ids, len(x) // max(1, len(ids)), x.tobytes(), *[t.column(c).to_numpy() for c in numbers]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary(), *[pa.list_(pa.float64())] * len(numbers)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["block", "ids", "wide", "x", *numbers])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(BLOCK - n, batch.num_rows - at)
                held.append(batch.slice(at, take))
                n, at = n + take, at + take
                if n == BLOCK:
                    yield block(held, k)
                    held, n, k = [], 0, k + 1
        if n:
            yield block(held, k)

    thin = df.select(F.col(row_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *[F.col(c).cast("double").alias(c) for c in numbers])
    return staged(thin.repartition(parts).mapInArrow(pack, schema))


class Rows:
    def __init__(self, row: dict):
        self.block, self.ids = row["block"], np.array(row["ids"], np.int64)
        self.x = np.frombuffer(row["x"], np.float64).reshape(len(self.ids), row["wide"])
        self.numbers = {c: np.array(v, float) for c, v in row.items() if c not in ("block", "ids", "wide", "x")}
        self.squares = (self.x**2).sum(1)

    def squared(self, other: Rows) -> np.ndarray:
        """Squares of distances.  Those that count are rounded to ten places, so that each way round gives the same."""
        out = self.x @ other.x.T
        out *= -2
        out += self.squares[:, None]
        out += other.squares[None]
        return out


def meet(queries: DataFrame, blocks: DataFrame, run, schema: str, half: bool = False, held: bool = False) -> DataFrame:
    """``run(query Rows, block Rows)`` gives arrays by the names of ``schema`` for each pair of a query block
    and a block; with ``half`` (of one table with itself) a pair of blocks once, and each block with itself.
    With ``held``, ``run()`` makes for each task one that remembers: it may give None for a pair, and its ``rest()``
    gives arrays at the end of the task.  What it holds is of the size of CHUNK blocks and the task's own."""
    names = [c.split()[0] for c in schema.split(", ")]
    made = run

    def task(batches):
        run = made() if held else made
        here, asked = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if here is None or here.block != row["block"]:
                    here = Rows({c: v for c, v in row.items() if not c.startswith("q_")})
                if row["q_block"] not in asked:
                    asked[row["q_block"]] = Rows({c[2:]: v for c, v in row.items() if c.startswith("q_")})
                out = run(asked[row["q_block"]], here)
                if out is not None and len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)
        if held:
            for out in run.rest():
                yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names=names)

    last = queries.agg(F.max("block")).first()[0]
    found = None
    for at in range(0, (-1 if last is None else last) + 1, CHUNK):
        some = queries.where(F.col("block").between(at, at + CHUNK - 1))
        some = some.select(F.lit(0).alias("_on"), *[F.col(c).alias(f"q_{c}") for c in some.columns])
        pairs = blocks.withColumn("_on", F.lit(0)).join(F.broadcast(some), "_on").drop("_on")
        one = (pairs.where("q_block <= block") if half else pairs).mapInArrow(task, schema)
        found = one if found is None else found.unionByName(one)
    return queries.sparkSession.createDataFrame([], schema) if found is None else found


class Nearest:
    """The ``k`` nearest rows of each query row among the blocks of a task, by (d, v)."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def __call__(self, q: Rows, b: Rows) -> None:
        n = len(q.ids)
        if q.block not in self.held:
            self.held[q.block] = (q.ids, np.full((n, self.k), np.inf), np.full((n, self.k), np.iinfo(np.int64).max))
        _, d, v = self.held[q.block]
        far = q.squared(b)
        bar = d[:, -1] ** 2
        if not np.isfinite(bar).all():
            far[q.ids[:, None] == b.ids[None]] = np.inf
            take = min(self.k, far.shape[1])
            bar = np.minimum(bar, np.partition(far, take - 1, axis=1)[:, take - 1]) if take == self.k else bar
        x, y = np.nonzero(far <= bar[:, None] + NEAR)
        gap = np.sqrt(np.maximum(np.round(far[x, y], 10), 0))
        keep = np.isfinite(gap) & (q.ids[x] != b.ids[y]) & (gap <= d[x, -1])
        x, y, gap = x[keep], y[keep], gap[keep]
        if not len(x):
            return
        rows, at = np.unique(x, return_inverse=True)
        row = np.concatenate((np.repeat(np.arange(len(rows)), self.k), at))
        gaps, ids = np.concatenate((d[rows].ravel(), gap)), np.concatenate((v[rows].ravel(), b.ids[y]))
        order = np.lexsort((ids, gaps, row))
        row, gaps, ids = row[order], gaps[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        best = rank < self.k
        d[rows], v[rows] = gaps[best].reshape(-1, self.k), ids[best].reshape(-1, self.k)

    def rest(self):
        for ids, d, v in self.held.values():
            x, y = np.nonzero(np.isfinite(d))
            yield {"u": ids[x], "v": v[x, y], "d": d[x, y]}


def neighbours(df: DataFrame, row_id: str, vector: str, k: int) -> DataFrame:
    """(u, v, d, rank): the ``k`` nearest other rows of each row (ties: least id), exactly.  A task gives ``k`` for each
    row of a chunk, whatever the number of its blocks."""
    blocks = packed(df, row_id, vector)
    found = meet(blocks, blocks, lambda: Nearest(k), "u long, v long, d double", held=True)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("u").orderBy("d", "v"))).where(F.col("rank") <= k)


def unit_blocks(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """Rows at length 1 in blocks; a row without a vector, or with one of zeros, has no cosine."""
    length = F.sqrt(F.aggregate(F.transform(F.col(vector), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    rows = df.select(row_id, vector, length.alias("_length")).where(F.col(row_id).isNotNull() & (F.col("_length") > 0))
    return packed(rows.select(row_id, F.transform(F.col(vector), lambda x: x.cast("double") / F.col("_length")).alias(vector)), row_id, vector)


def _pairs(q: Rows, b: Rows, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in both blocks and cosines (six places) of the pairs from ``least`` on, each pair of rows once."""
    c = q.x @ b.x.T
    x, y = np.nonzero(c >= least - 1e-6)
    c = np.round(c[x, y], 6)
    keep = (c >= least) & (q.ids[x] != b.ids[y]) & ((q.block != b.block) | (x < y))
    return x[keep], y[keep], c[keep]


def edges_above(df: DataFrame, row_id: str, vector: str, least: float) -> DataFrame:
    """(u, v, cosine) with u < v of all pairs from ``least`` on, rounded to six places."""
    blocks = unit_blocks(df, row_id, vector)

    def near(q: Rows, b: Rows) -> dict:
        x, y, c = _pairs(q, b, least)
        u, v = q.ids[x], b.ids[y]
        return {"u": np.minimum(u, v), "v": np.maximum(u, v), "cosine": c}

    return meet(blocks, blocks, near, "u long, v long, cosine double", half=True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of edges between labels: those of a spanning forest (their places), the labels, and what each becomes."""
    labels, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    to, at, taken = np.arange(len(labels)), np.arange(len(a)), []
    while True:
        low, high = np.minimum(to[x], to[y]), np.maximum(to[x], to[y])
        open_ = low != high
        if not open_.any():
            return np.concatenate(taken) if taken else at[:0], labels, labels[to]
        x, y, at, low, high = x[open_], y[open_], at[open_], low[open_], high[open_]
        # each greater label goes to one lesser, so there is no circle
        who, first = np.unique(high, return_index=True)
        taken.append(at[first])
        up = np.arange(len(labels))
        up[who] = low[first]
        while (up[up] != up).any():
            up = up[up]
        to = up[to]


class Links:
    """Numbers of pairs by threshold, and of the pairs those that join what the task has not seen joined at their
    own threshold or above: at each threshold they have the components of all pairs."""

    def __init__(self, thresholds: list[float]):
        self.bars, self.place, self.size = np.array(thresholds), {}, 0
        self.label = [np.zeros(0, np.int32) for _ in thresholds]
        self.n = np.zeros(len(thresholds), np.int64)

    def at(self, rows: Rows) -> int:
        if rows.block not in self.place:
            self.place[rows.block] = self.size
            new = np.arange(self.size, self.size + len(rows.ids), dtype=np.int32)
            self.label, self.size = [np.concatenate((x, new)) for x in self.label], self.size + len(rows.ids)
        return self.place[rows.block]

    def joined(self, t: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Takes edges into threshold ``t``; the places of those that join something."""
        open_ = np.flatnonzero(self.label[t][u] != self.label[t][v])
        if not len(open_):
            return open_
        taken, old, new = forest(self.label[t][u[open_]], self.label[t][v[open_]])
        to = np.arange(self.size, dtype=np.int32)
        to[old] = new
        self.label[t] = to[self.label[t]]
        return open_[taken]

    def __call__(self, q: Rows, b: Rows) -> dict:
        x, y, c = _pairs(q, b, self.bars[0])
        u, v, level = self.at(q) + x, self.at(b) + y, np.searchsorted(self.bars, c, "right") - 1
        self.n += np.bincount(level, minlength=len(self.bars))
        out = [np.zeros(0, np.int64)]
        for t in range(len(self.bars) - 1, -1, -1):
            mine = np.flatnonzero(level == t)
            new = mine[self.joined(t, u[mine], v[mine])]
            for lower in range(t - 1 if len(new) else -1, -1, -1):
                self.joined(lower, u[new], v[new])
            out.append(new)
        new = np.concatenate(out)
        return {"u": q.ids[x[new]], "v": b.ids[y[new]], "level": level[new].astype(np.int32), "n": np.zeros(len(new), np.int64)}

    def rest(self):
        level = np.flatnonzero(self.n)
        none = np.zeros(len(level), np.int64)
        yield {"u": none, "v": none, "level": level.astype(np.int32), "n": self.n[level]}


def links_above(df: DataFrame, row_id: str, vector: str, thresholds: list[float]) -> tuple[DataFrame, DataFrame]:
    """What the components of the graphs of pairs from each threshold on (ascending) need: (u, v, score), edges enough to
    have the components of all pairs, each with the highest threshold it reaches; and (threshold, n_edges), numbers of
    all pairs.  A task drops an edge whose ends it knows as joined at that threshold, so there are some edges for
    each row and task, not some for each pair of rows."""
    blocks = unit_blocks(df, row_id, vector)
    bars = F.array(*[F.lit(float(t)) for t in thresholds])
    found = staged(meet(blocks, blocks, lambda: Links(thresholds), "u long, v long, level int, n long", half=True, held=True))
    edges = found.where("n = 0").select("u", "v", F.get(bars, F.col("level")).alias("score"))
    reached = found.where("n > 0").select(F.explode(F.slice(bars, F.lit(1), F.col("level") + 1)).alias("threshold"), "n")
    return edges, reached.groupBy("threshold").agg(F.sum("n").alias("n_edges"))


def parallel_analysis(df: DataFrame, row_id: str, vector: str, permutations: int = 25, quantile: float = 0.95, seed: int = 1) -> tuple[int, np.ndarray, np.ndarray]:
    """Leading components whose variance passes that of column-wise permuted data (two at least, as many as
    there are dimensions at most), the variances, and the bars.

    Rows lie in blocks at random.  A task permutes each column of each of its blocks, less the block's means, and sums
    products; so a replicate needs no sort of the table, has no trace of the columns' relations, and one degree of
    freedom less for each block, which is put right.  The driver gets dimensions squared numbers for each replicate.
    """
    blocks = packed(df, row_id, vector)

    def products(batches):
        sums, k = {}, 0
        for batch in batches:
            for row in batch.to_pylist():
                x = Rows(row).x
                k += 1
                own = x - x.mean(0)
                rng = np.random.default_rng((seed, row["block"]))
                parts = [x.T @ x, *[(p := rng.permuted(own, axis=0)).T @ p for _ in range(permutations)], np.tile(x.sum(0), (len(x.T), 1)), np.full((len(x.T),) * 2, len(x)), np.ones((len(x.T),) * 2)]
                for r, g in enumerate(parts):
                    sums[r] = sums.get(r, 0) + g
        for r, g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(g.size, r, np.int32)), pa.array(np.arange(g.size, dtype=np.int32)), pa.array(g.ravel().astype(float))], names=["r", "k", "s"])

    got = blocks.mapInArrow(products, "r int, k int, s double").groupBy("r", "k").agg(F.sum("s").alias("s")).toPandas()
    wide = int(round(np.sqrt(got["k"].max() + 1)))
    table = np.zeros((permutations + 4, wide * wide))
    table[got["r"], got["k"]] = got["s"]
    table = table.reshape(-1, wide, wide)
    n, n_blocks, mean = table[-2, 0, 0], table[-1, 0, 0], table[-3, 0] / table[-2, 0, 0]
    values = lambda c: np.sort(np.linalg.eigvalsh(c))[::-1]
    seen = values((table[0] - n * np.outer(mean, mean)) / (n - 1))
    bars = np.quantile([values(g / max(1, n - n_blocks)) for g in table[1 : permutations + 1]], quantile, axis=0)
    failed = np.flatnonzero(seen <= bars)
    most = int(min(wide, n - 1))
    return min(most, max(2, int(failed[0]) if len(failed) else most)), seen, bars
