"""Merkle manifest of a table: a tree of digests for each source, and one over the sources.

Leaves are hashed and numbered by DataFrame functions (ranges of source, id and digest, so a
source of any size spreads over many tasks).  The trees are walked by Pregel-style
supersteps on RDDs of (tree, index): going up, every node messages its digest to its parent, and
a parent that has heard from all its children hashes them and is a node of the next step; going
down, each parent hands its path (its own siblings and those above) to its children, with the
siblings that they have in its run.  A run has FAN nodes at most, so no message group
grows with the table, and a leaf's path travels once for each run of leaves.  The driver counts the rows
and trees; no digest passes through it.  Lineage is as short as the trees are high, and starts from
a staged table.

A leaf is H of the fields one after another, each ``-`` if null, else its number of UTF-8 bytes,
``:`` and itself; H is sha256, and digests go into others as hex text.  In each source leaves
ascend by id, and runs of FAN nodes become their H until one is left; the sources' subroots,
null first, then by bytes, give the root likewise.

Defined cases: a null id comes first in its source and is never tampered with; rows that
repeat an id stand in the order of their digests; null and empty sources are two sources; a
source of one row has the leaf itself as its subroot; a run of one node is hashed alone; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, slots, staged

FAN = 16
ROWS_PER_TASK = 50_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1


def leaf_digest(*values: Column) -> Column:
    def one(v: Column) -> Column:
        text = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(one, values)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, forged (the leaf of the tampered row where it is one, else null), tree and slot
    (its source's place among the sources, its own among the source's leaves), width (leaves there)."""
    own = {c: F.col(f"`{c}`") for c in FIELDS}
    hit = F.crc32(own["doc_id"].cast("string").cast("binary")) % 5 == 0
    forged = F.when(hit, leaf_digest(*[ascii_lower(own[c]) if c == "text" else own[c] for c in FIELDS]))
    key = F.coalesce(F.concat(F.lit("1"), own["source"].cast("string")), F.lit("0"))  # bytewise, null before all
    rows = staged(docs.select(own["doc_id"].alias("doc_id"), key.alias("key"), leaf_digest(*own.values()).alias("leaf"), forged.alias("forged"), F.monotonically_increasing_id().alias("row")))
    sources = rows.groupBy("key").agg(F.count("*").alias("width")).withColumn("_all", F.lit(0))
    trees = slots(sources, "_all", ["key"]).select("key", "width", F.col("slot").alias("tree"))
    return slots(rows, "key", ["doc_id", "leaf", "row"]).join(trees, "key").select("tree", "slot", "width", "doc_id", "leaf", "forged")


def height(width: int) -> int:
    h = 0
    while width > 1:
        width, h = -(-width // FAN), h + 1
    return h


def digest_of(hexes: str) -> bytes:
    return hashlib.sha256(hexes.encode()).digest()


def _complete(group):
    key, children = group
    children = sorted(children, key=lambda c: c[0])
    if len(children) != min(FAN, children[0][1] - FAN * key[1]):
        raise ValueError(f"node {key} heard from {len(children)} of its children")
    return key, children


def ascend(nodes: RDD, parts: int) -> tuple[RDD, RDD]:
    """Nodes ((tree, index), (width of the level, digest, what else they carry)) message their parents.  Back
    come the parents with their children, and the parents as nodes of the next level."""
    sent = nodes.map(lambda x: ((x[0][0], x[0][1] // FAN), (x[0][1] % FAN, *x[1])))
    runs = sent.groupByKey(parts).map(_complete, preservesPartitioning=True)
    return runs, runs.map(lambda x: (x[0], (-(-x[1][0][1] // FAN), digest_of("".join(c[2].hex() for c in x[1])), None)))


def _hand_down(found):
    (tree, parent), (children, (roots, path)) = found
    whole = b"".join(c[2] for c in children)
    for place, (k, _, digest, carried) in enumerate(children):
        yield (tree, parent * FAN + k), (digest, carried, roots, ((place, whole[: 32 * place] + whole[32 * place + 32 :]), *path))


def descend(runs: RDD, paths: RDD, parts: int) -> RDD:
    """``paths``: parent -> (roots, path).  Each child gets its siblings and its parent's path."""
    return runs.join(paths.partitionBy(parts), parts).flatMap(_hand_down)


def _verified(row):
    leaf, (doc_id, forged), (subroot, root), path = row
    siblings = [(k, rest.hex()) for k, rest in path]
    now = (forged or leaf).hex()
    for k, rest in siblings:
        now = digest_of(rest[: 64 * k] + now + rest[64 * k :]).hex()
    proof = digest_of("".join(rest for _, rest in siblings)).hex()
    return doc_id, leaf.hex(), subroot.hex(), root.hex(), proof, now, now == root.hex()


SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: its leaf, subroot and root, the digest of its proof, and the root that the
    proof gives for the row as it is now (tampered with for a fifth of the ids)."""
    spark = docs.sparkSession
    rows = staged(leaves(docs))
    n, widest, trees = rows.agg(F.count("*"), F.max("width"), F.max("tree")).first()
    if not n:
        return spark.createDataFrame([], SCHEMA)
    cores = spark.sparkContext.defaultParallelism
    parts = lambda level, n=n: max(1, min(cores, n // 1000), n // (ROWS_PER_TASK * FAN**level))
    nodes = rows.select("tree", "slot", "width", "leaf", "doc_id", "forged").rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), (r[4], r[5] and bytes(r[5])))))
    single = lambda x: x[1][0] == 1
    several = lambda x: x[1][0] > 1

    runs, roots = [], [nodes.filter(single)]
    nodes = nodes.filter(several)
    for level in range(height(widest)):
        run, above = ascend(nodes, parts(level))
        runs.append(run)
        roots.append(above.filter(single))
        nodes = above.filter(several)

    count = trees + 1
    tops = [r.map(lambda x, h=h: ((TOP, x[0][0]), (count, x[1][1], (h, x[1][2])))) for h, r in enumerate(roots)]
    nodes, top_runs = spark.sparkContext.union(tops), []
    few = max(1, min(cores, count // 1000))
    for _ in range(height(count)):
        run, nodes = ascend(nodes, few)
        top_runs.append(run)
    paths = nodes.map(lambda x: (x[0], (x[1][1], x[1][2], x[1][1], ())))
    for run in reversed(top_runs):
        paths = descend(run, paths.mapValues(lambda x: x[2:]), few)
    # from here on a tree's root: (tree, 0) -> (its height, what it carries, its digest, the root, its path)
    starts = paths.map(lambda x: ((x[0][1], 0), (x[1][1], x[1][0], x[1][2], x[1][3])))
    at = lambda h: starts.filter(lambda x: x[1][0][0] == h)
    below = None
    for h in range(height(widest), 0, -1):
        here = at(h).mapValues(lambda x: ((x[1], x[2]), x[3]))
        here = here.union(below.mapValues(lambda x: x[2:])) if below else here
        below = descend(runs[h - 1], here, parts(h - 1))
    alone = at(0).map(lambda x: _verified((x[1][1], x[1][0][1], (x[1][1], x[1][2]), x[1][3])))
    out = alone.union(below.map(lambda x: _verified(x[1]))) if below else alone
    return spark.createDataFrame(out, SCHEMA, verifySchema=False)
