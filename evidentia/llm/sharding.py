"""K-d tree sharding: recursive splits at distributed weighted medians.

A node that must yield ``k`` leaves is cut along its widest metadata dimension (its range
against the whole table's) at the weighted quantile ``(k // 2) / k`` of bytes; a node whose
bytes are within ``target_bytes`` is a leaf.  Ties along a dimension are cut by a second
key, a hash of the row's id, so one value that holds a third of the rows still splits.

A quantile is found by histogram refinement: every pass sums bytes into BINS equal bins per
node and descends into the bin that holds the quantile, for all nodes of a level at once.
Each pass returns one row per node to the driver, whatever the input.  Passes read a staged
table of a few numbers per row, never the texts.

Defined cases: a null or empty text has the bytes of its overhead only; null dimensions are
least; repeated rows are rows of their own; an empty table gives no rows; input columns other
than those named are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slots, staged

BINS = 4096
TIES = "_t"


@dataclass
class Node:
    id: int
    leaves: int
    children: "tuple[Node, Node] | None" = None
    rows: int = -1


def _number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    col = F.col(f"`{name}`")
    if kind == "string":
        col = F.xxhash64(col).bitwiseAND(0x3FFFFF)
    elif kind in ("float", "double") or kind.startswith("decimal"):
        col = F.floor(F.coalesce(col.cast("double"), F.lit(0.0)) * 1000).cast("long")
    return F.coalesce(col.cast("long"), F.lit(-1))


def _with(rows: DataFrame, schema: str, params: list[tuple], how: str = "inner") -> DataFrame:
    """Join ``_node`` with a row per node: as many rows as shards at most."""
    names, kinds = zip(*(x.split() for x in ["_node int", *schema.split(", ")]), strict=True)
    values = ", ".join("(" + ", ".join(f"cast({v} as {k})" for v, k in zip(row, kinds, strict=True)) + ")" for row in params)
    table = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    return rows.join(F.broadcast(table), "_node", how)


def _quantiles(rows: DataFrame, spans: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int]]:
    """``rows``: _node, _v, _bytes; ``spans``: node -> (least value, greatest value, bytes wanted).
    For each node, the value at which the running bytes first exceed those wanted, and the
    bytes below that value."""
    found, open_ = {}, {k: (lo, hi, want, 0) for k, (lo, hi, want) in spans.items()}
    while open_:
        params = [(k, lo, hi, -(-(hi - lo + 1) // BINS), want - below) for k, (lo, hi, want, below) in open_.items()]
        sums = (
            _with(rows, "_lo long, _hi long, _step long, _want long", params)
            .where("_v between _lo and _hi")
            .groupBy("_node", "_want", F.expr("(_v - _lo) div _step").alias("_bin"))
            .agg(F.sum("_bytes").alias("_b"))
        )
        run = sums.withColumn("_run", F.sum("_b").over(W.partitionBy("_node").orderBy("_bin"))).where("_run > _want")
        hit = run.groupBy("_node").agg(F.min_by(F.struct("_bin", "_run", "_b"), "_bin").alias("x"))
        steps = {k: step for k, _, _, step, _ in params}
        for r in hit.collect():
            k, (b, upto, own) = r["_node"], r["x"]
            lo, hi, want, below = open_.pop(k)
            below += upto - own
            lo, hi = lo + b * steps[k], min(hi, lo + (b + 1) * steps[k] - 1)
            if lo == hi:
                found[k] = (lo, below)
            else:
                open_[k] = (lo, hi, want, below)
    return found


def kd_tree(base: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``base`` (``dims``, TIES, ``_bytes``) with a last column ``shard``.  Stops at ``shards``
    leaves, or where a node's bytes are within ``target_bytes`` (or it can't be cut)."""
    whole = base.agg(F.sum("_bytes"), F.count("*"), *[F.min(d) for d in dims], *[F.max(d) for d in dims]).first()
    k = shards or max(1, -(-(whole[0] or 0) // target_bytes))
    root, ids = Node(0, k), 1
    width = {d: max(1, (whole[2 + len(dims) + i] or 0) - (whole[2 + i] or 0)) for i, d in enumerate(dims)}
    rows = base.withColumn("_node", F.lit(0))
    level = [root] if k > 1 and whole[1] else []
    while level:
        stats = _with(rows, "_open int", [(x.id, 1) for x in level]).groupBy("_node")
        got = {r["_node"]: r for r in stats.agg(F.sum("_bytes").alias("b"), F.count("*").alias("c"), *[f(d).alias(n + d) for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).collect()}
        for x in level:
            x.leaves = x.leaves if x.id in got or not target_bytes else 0  # an empty side of a cut is no shard
        level = [x for x in level if x.id in got]
        if target_bytes:  # each node by its own bytes; one that its parent's cut left whole can't be cut
            for x in level:
                x.leaves = 1 if x.rows == got[x.id]["c"] else -(-got[x.id]["b"] // target_bytes)
            level = [x for x in level if x.leaves > 1]
            if not level:
                break
        widest = {x.id: max(dims, key=lambda d, r=got[x.id]: ((r["hi" + d] - r["lo" + d]) / width[d], -dims.index(d))) for x in level}
        valued = _with(rows, "_dim int", [(i, dims.index(d) + 1) for i, d in widest.items()]).withColumn("_v", F.element_at(F.array(*dims), F.col("_dim")))
        want = {x.id: got[x.id]["b"] * (x.leaves // 2) // x.leaves for x in level}
        cuts = _quantiles(valued.select("_node", "_v", "_bytes"), {i: (got[i]["lo" + d], got[i]["hi" + d], want[i]) for i, d in widest.items()})
        tied = _with(valued, "_cut long", [(i, c) for i, (c, _) in cuts.items()]).where("_v = _cut")
        ties = _quantiles(tied.select("_node", F.col(TIES).alias("_v"), "_bytes"), {i: (0, 2**24 - 1, want[i] - b) for i, (_, b) in cuts.items()})
        params, below = [], []
        for x in level:
            x.children = tuple(Node(ids + i, n, rows=got[x.id]["c"]) for i, n in enumerate((x.leaves // 2, x.leaves - x.leaves // 2)))
            ids += 2
            params.append((x.id, dims.index(widest[x.id]) + 1, cuts[x.id][0], ties[x.id][0], x.children[0].id))
            below += [y for y in x.children if y.leaves > 1 or target_bytes]
        split = _with(rows, "_dim int, _cut long, _tie long, _left int", params, "left")
        value = F.element_at(F.array(*dims), F.col("_dim"))
        right = (value > F.col("_cut")) | ((value == F.col("_cut")) & (F.col(TIES) >= F.col("_tie")))
        rows = staged(split.select(*base.columns, F.when(F.col("_dim").isNull(), F.col("_node")).otherwise(F.col("_left") + right.cast("int")).alias("_node")))
        level = below
    numbers, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.children:
            stack += x.children[::-1]
        elif x.leaves:
            numbers.append((x.id, len(numbers)))
    return _with(rows, "shard int", numbers).drop("_node")


def shard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", dims: tuple[str, ...] = ("n_chars", "source", "lang", "doc_id"), shards: int | None = 24, target_bytes: int | None = None, overhead: int = 8) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = [f"_d{i}" for i in range(len(dims))]
    base = staged(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            (F.octet_length(body) + overhead).cast("long").alias("_bytes"),
            F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
            *[_number(docs, d).alias(c) for c, d in zip(own, dims, strict=True)],
        ).withColumn(TIES, F.xxhash64("doc_id", "text_crc32", "_bytes").bitwiseAND(2**24 - 1))
    )
    put = kd_tree(base, own, shards, target_bytes).select("doc_id", F.col("_bytes").alias("size"), "text_crc32", "shard")
    return slots(put, "shard", ["doc_id", "text_crc32", "size"])
