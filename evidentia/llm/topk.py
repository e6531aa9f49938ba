"""Exact top-k by inner product: a ball tree for each shard of rows, walked by branch and bound.

Vectors are made integer once (``floor(256 * x)``).  Rows are dealt to shards of
SHARD rows; each is stored as one row with its integer matrix and its ball tree (halves along the
dimension that varies most; a node is a range of rows, their centre and radius).  A node's
inner product with a query is at most ``q . centre + |q| * radius``: a shard is searched for a
block of queries at once, nodes in the order of the largest bound that a query of the block has
there, and a query leaves a node whose bound is under its kth score.

The kth scores are shared.  In a task they carry over from one shard to the next.  Between
tasks they carry over by rounds: the first takes one shard, each further one eight times as many; after
a round the best k of each query are kept as a table, and its kth is the bar that any
row of later rounds has to reach.  Shards are random samples of the rows, so a round finds
some 8 * k rows for a query, however many rows it reads.  Queries go to the shards in chunks of
CHUNK blocks (broadcast, CHUNK * BLOCK vectors each), and rows are never shuffled for queries.

Scores are exact: products are summed in floats only where |q| * |x| is under what these hold
exactly, else in Python's integers; a score beyond a long counts as the long's end.

Defined cases: null vectors and those with null, NaN or infinite components take no part, neither as
queries nor as candidates; a shorter vector counts as if it went on with zeros; a row is no
candidate of its own, but another row with the same id is; repeated query ids are ranked each; a null
id is no query, and a candidate that comes after all others of its score; fewer than k candidates give
fewer rows; an empty table gives none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

SHARD, LEAF, BLOCK, CHUNK, GROWTH = 8192, 256, 1024, 64, 8
LAST = np.iinfo(np.int64).max  # a null id, after all others
LEAST = -LAST


def integer_rows(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """_r (a number for the row), vec_id, v: the rows that take part, with integer components."""
    x = F.col(f"`{embedding}`")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return staged(vectors.where(fine).select(F.monotonically_increasing_id().alias("_r"), F.col(f"`{vec_id}`").cast("long").alias("vec_id"), whole.alias("v")))


def _matrix(column: pa.ListArray) -> np.ndarray:
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    wide = int(n.max(initial=0))
    if (n == wide).all():
        return flat.reshape(len(n), wide)
    out = np.zeros((len(n), wide), np.int64)
    out[np.arange(wide) < n[:, None]] = flat
    return out


def _chunks(batches, size: int):
    """Ids, row numbers and matrices of ``size`` rows at most, over all batches."""
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            take = min(size - n, batch.num_rows - at)
            held.append(batch.slice(at, take))
            n, at = n + take, at + take
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _arrays(table: pa.Table):
    ids = table.column("vec_id").fill_null(LAST).to_numpy()
    return table.column("_r").to_numpy(), ids, _matrix(table.column("v").combine_chunks())


def narrow(x: np.ndarray) -> np.ndarray:
    top = np.abs(x.astype(np.float64)).max(initial=0)
    return x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray, np.ndarray]:
    """An order of the rows, and for each node its range in it, centre and radius.  Node i has the
    children 2i + 1 and 2i + 2 if these are there (a range is never empty)."""
    real = x.astype(np.float64)
    order, spans, todo = np.arange(len(x)), {}, [(0, 0, len(x))]
    while todo:
        node, lo, hi = todo.pop()
        spans[node] = (lo, hi)
        if hi - lo > LEAF:
            own = order[lo:hi]
            widest = int(real[own].var(axis=0).argmax()) if x.shape[1] else 0
            half = (hi - lo) // 2
            if x.shape[1]:
                order[lo:hi] = own[np.argpartition(real[own, widest], half)]
            todo += [(2 * node + 1, lo, lo + half), (2 * node + 2, lo + half, hi)]
    count = max(spans) + 1
    ranges = [spans.get(i, (0, 0)) for i in range(count)]
    centres, radii = np.zeros((count, x.shape[1])), np.zeros(count)
    for i, (lo, hi) in enumerate(ranges):
        if hi > lo:
            own = real[order[lo:hi]]
            centres[i] = own.mean(axis=0)
            radii[i] = np.sqrt(((own - centres[i]) ** 2).sum(axis=1).max()) * (1 + 1e-9)
    return order, ranges, centres, radii


_SHARDS = "shard long, _r binary, ids binary, wide int, bytes int, x binary, ranges binary, centres binary, radii binary"


def shards(rows: DataFrame) -> DataFrame:
    """One row per shard: row numbers and ids, the integer matrix in the order of the tree, the tree."""
    parts = max(1, -(-rows.count() // SHARD))

    def build(batches):
        for k, table in enumerate(_chunks(batches, SHARD)):
            r, ids, x = _arrays(table)
            order, ranges, centres, radii = ball_tree(x)
            x = narrow(x[order])
            row = [TaskContext.get().partitionId() + parts * k, r[order].tobytes(), ids[order].tobytes(), x.shape[1], x.itemsize, x.tobytes(), np.array(ranges, np.int64).tobytes(), centres.tobytes(), radii.tobytes()]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _SHARDS.split(", ")])

    return staged(rows.repartition(parts).mapInArrow(build, _SHARDS))


_BLOCKS = "block long, _qr array<long>, q_ids array<long>, q_wide int, q binary"


def query_blocks(rows: DataFrame) -> DataFrame:
    """Queries in blocks of BLOCK rows."""
    parts = max(1, -(-rows.count() // BLOCK))

    def build(batches):
        for k, table in enumerate(_chunks(batches, BLOCK)):
            r, ids, x = _arrays(table)
            row = [TaskContext.get().partitionId() + parts * k, r, ids, x.shape[1], x.astype(np.int64).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()], strict=True)], names=[c.split()[0] for c in _BLOCKS.split(", ")])

    return staged(rows.repartition(parts).mapInArrow(build, _BLOCKS))


class Shard:
    def __init__(self, row: dict):
        self.number = row["shard"]
        self.rows, self.ids = np.frombuffer(row["_r"], np.int64), np.frombuffer(row["ids"], np.int64)
        self.x = np.frombuffer(row["x"], f"i{row['bytes']}").reshape(len(self.ids), row["wide"])
        self.ranges = np.frombuffer(row["ranges"], np.int64).reshape(-1, 2)
        self.centres, self.radii = np.frombuffer(row["centres"], np.float64).reshape(len(self.ranges), row["wide"]), np.frombuffer(row["radii"], np.float64)
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        self.by_row = np.argsort(self.rows)
        self.as_type = {}

    def typed(self, kind) -> np.ndarray:
        if kind not in self.as_type:
            self.as_type = {kind: self.x.astype(kind)}
        return self.as_type[kind]

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The places of row numbers in the shard, -1 for others."""
        at = self.by_row[np.minimum(np.searchsorted(self.rows, rows, sorter=self.by_row), len(self.rows) - 1)]
        return np.where(self.rows[at] == rows, at, -1)


class Block:
    """Queries with the best rows of each that their task has found, and the bar of the rounds before."""

    def __init__(self, row: dict, k: int):
        self.rows, self.ids = np.array(row["_qr"], np.int64), np.array(row["q_ids"], np.int64)
        self.x = np.frombuffer(row["q"], np.int64).reshape(len(self.ids), row["q_wide"])
        self.norm = np.sqrt((self.x.astype(np.float64) ** 2).sum(axis=1))
        self.k, n = k, len(self.ids)
        bars = {r: (s, i) for r, s, i in zip(row["bar_rows"] or (), row["bar_scores"] or (), row["bar_ids"] or (), strict=True)}
        self.bar = np.array([bars.get(r, (LEAST, LAST)) for r in self.rows.tolist()], np.int64).reshape(n, 2)
        self.query, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))
        self.kth = self.bar[:, 0].copy()

    def widened(self, wide: int) -> np.ndarray:
        return np.pad(self.x, ((0, 0), (0, max(0, wide - self.x.shape[1]))))[:, :wide]

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        bar = self.bar[query]
        good = (score > bar[:, 0]) | ((score == bar[:, 0]) & (ids < bar[:, 1])) | (bar[:, 0] == LEAST)
        query, score, ids = (np.concatenate((a, b[good])) for a, b in ((self.query, query), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, query)
        nth = np.arange(len(query)) - first
        keep = nth < self.k
        full = nth == self.k - 1
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        self.kth[query[full]] = np.maximum(self.kth[query[full]], score[full])

    def search(self, shard: Shard) -> None:
        wide = shard.x.shape[1]
        q = self.widened(wide)
        most = self.norm.max(initial=0) * shard.norm
        kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
        x, typed = shard.typed(kind), q.astype(kind)
        bound = shard.centres @ q.astype(np.float64).T + shard.radii[:, None] * self.norm
        bound += 1e-9 * (np.abs(bound) + self.norm * shard.norm) + 1e-6
        own = shard.place(self.rows)
        # of two nodes with one bound the one with the smaller number goes first: the queries are never compared
        heap = [(-bound[0].max(), 0, np.arange(len(q)))]
        while heap:
            _, node, active = heapq.heappop(heap)
            active = active[bound[node, active] >= self.kth[active]]
            if not len(active):
                continue
            lo, hi = shard.ranges[node]
            children = [c for c in (2 * node + 1, 2 * node + 2) if hi - lo > LEAF and c < len(shard.ranges)]
            for c in children:
                heapq.heappush(heap, (-bound[c, active].max(), c, active))
            if not children:
                self.leaf(typed[active] @ x[lo:hi].T, active, own[active] - lo, shard.ids[lo:hi])

    def leaf(self, scores: np.ndarray, active: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
        if scores.dtype == object:
            scores = np.clip(scores, LEAST, LAST).astype(np.int64)
        mine = np.flatnonzero((own >= 0) & (own < len(ids)))
        bar = self.kth[active].astype(scores.dtype)
        hit = scores >= bar[:, None]
        if scores.shape[1] > self.k and hit.sum() > 4 * self.k * len(active):
            at = scores.shape[1] - self.k - 1  # one more than k, as the query itself may be there
            hit = scores >= np.maximum(bar, np.partition(scores, at, axis=1)[:, at])[:, None]
        hit[mine, own[mine]] = False
        a, b = np.nonzero(hit)
        if len(a):
            self.add(active[a], scores[a, b].astype(np.int64), ids[b])


_FOUND = "_q long, query_id long, score long, vec_id long"


def _searcher(k: int):
    def run(batches):
        shard, blocks = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}
                if shard is None or shard.number != row["shard"].as_py():
                    shard = Shard({c.split()[0]: row[c.split()[0]].as_py() for c in _SHARDS.split(", ")})
                number = row["block"].as_py()
                if number not in blocks:
                    blocks[number] = Block({c: row[c].as_py() for c in ("_qr", "q_ids", "q_wide", "q", "bar_rows", "bar_scores", "bar_ids")}, k)
                blocks[number].search(shard)
        for b in blocks.values():
            ids = pa.array(b.id, mask=b.id == LAST)
            yield pa.RecordBatch.from_arrays([pa.array(b.rows[b.query]), pa.array(b.ids[b.query]), pa.array(b.score), ids], names=["_q", "query_id", "score", "vec_id"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for each row for which ``queries`` (over
    ``vec_id``) holds."""
    rows = integer_rows(vectors, vec_id, embedding)
    index, blocks = shards(rows), query_blocks(rows.where(queries))
    last, n_blocks = index.agg(F.max("shard")).first()[0], blocks.agg(F.max("block")).first()[0]
    best, homes = None, blocks.select("block", F.explode("_qr").alias("_q"))
    begin, size = 0, 1
    while last is not None and n_blocks is not None and begin <= last:
        bars = "bar_rows array<long>, bar_scores array<long>, bar_ids array<long>"
        if best is None:
            barred = blocks.select("*", *[F.lit(None).cast("array<long>").alias(c.split()[0]) for c in bars.split(", ")])
        else:
            kth = best.where(F.col("rank") == k).join(homes, "_q").groupBy("block")
            one = F.collect_list(F.struct("_q", "score", F.coalesce("vec_id", F.lit(int(LAST))).alias("vec_id")))
            kth = kth.agg(one.alias("_x")).select("block", F.col("_x._q").alias("bar_rows"), F.col("_x.score").alias("bar_scores"), F.col("_x.vec_id").alias("bar_ids"))
            barred = staged(blocks.join(kth, "block", "left"))
        found = []
        for at in range(0, n_blocks + 1, CHUNK):
            some = barred.where(F.col("block").between(at, at + CHUNK - 1)).withColumn("_on", F.lit(0))
            pairs = index.where(F.col("shard").between(begin, begin + size - 1)).withColumn("_on", F.lit(0)).join(F.broadcast(some), "_on").drop("_on")
            found.append(staged(pairs.mapInArrow(_searcher(k), _FOUND)))
        for f in found[1:]:
            found[0] = found[0].unionByName(f)
        best = staged(_best(found[0] if best is None else found[0].unionByName(best.drop("rank")), k))
        begin, size = begin + size, size * GROWTH
    if best is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
