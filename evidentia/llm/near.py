"""MinHash near-dedup by an inverted join on signature coordinates.

1. A document's set is its distinct shingles of ``width`` lower-cased words; texts with equal
   sets are one class from here on, so exact copies are never paired with each other.
2. Each class is posted under each of its K (coordinate, value) pairs.  Pairs that one class
   alone has are skipped.  The rest are ordered by frequency, and only the prefix is kept
   that two classes with MATCH or more equal coordinates must share: K - MATCH + 1 of the
   rarest.  MATCH is the largest count that a pair at the threshold falls below with a
   probability under MISS.
3. Round one pairs each posting with two hubs of its list (the member with the most popular
   coordinates, and one by hash): linear in the postings, however long a list is.  Collisions
   of a pair are counted over the whole signatures; pairs of MATCH or more are confirmed on
   the full shingle sets of both texts.
4. Round two takes the lists whose members are still in two or more components and tries all
   pairs across components that round one has not tried: those of short lists by a self join,
   those of long lists inside tasks, block by block, each pair once.  There a pair is counted
   and confirmed in place and only links that merge components leave the task, so neither
   links nor failed pairs of a large group become rows.

Defined cases: null or empty text and texts without words have empty sets, link with nothing
and are their own component; fewer than ``width`` words are one shingle; rows that share a
doc_id pool their links; repeated rows get equal results; rows with a null doc_id keep a null
component unless their text equals another's; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, BLANKS, encode, hashed_words, mapped, maybe_in, mix, ordered_parts, shingles, small, staged, text_groups
from .graph import components

K = 64
MISS = 1e-6
SHORT = 40
BLOCK_ROWS = 768
BLOCK_ITEMS = 500_000
PAIRS_PER_COPY = 256

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, K, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, K, dtype=np.uint64)


def match_threshold(similarity: float, k: int = K, miss: float = MISS) -> int:
    """The largest m with P(Binomial(k, similarity) < m) <= miss."""
    tail, m = 0.0, 0
    while True:
        tail += math.comb(k, m) * similarity**m * (1 - similarity) ** (k - m)
        if tail > miss:
            return max(1, m)
        m += 1


def shingle_sets(texts: list, width: int):
    """The sorted distinct shingle hashes of each text."""
    raw = [x.translate(ASCII_LOWER) for x in encode(texts)]
    for a, b in text_groups([len(x) for x in raw]):
        words, cut = hashed_words(raw[a:b], BLANKS)
        if b - a == 1:
            yield np.unique(shingles(words, width))
            continue
        many = np.maximum(np.diff(cut) - (width - 1), 0)
        of = np.repeat(np.arange(b - a), many)
        s = shingles(words, width)[np.arange(len(of)) + np.repeat(cut[:-1] - np.cumsum(many) + many, many)] if len(of) else words[:0]
        s = s[ordered_parts(of, s, b - a)]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
        s, bound = s[new], np.searchsorted(of[new], np.arange(b - a + 1))
        for i in range(b - a):
            yield s[bound[i] : bound[i + 1]] if many[i] else np.unique(shingles(words[cut[i] : cut[i + 1]], width))


def signature(s: np.ndarray, rows: int = 4096) -> np.ndarray:
    out = np.full(K, np.uint64(2**64 - 1))
    for at in range(0, len(s), rows):
        np.minimum(out, (s[at : at + rows, None] * _A + _B).min(axis=0), out=out)
    return (mix(out) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """Rows (doc_id, n, cls, sig): size of the set, a 128-bit hash of it, its signature."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.binary()), ("sig", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            n, cls, sig = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                n.append(len(s))
                if len(s):
                    cls.append(np.array([mix(s).sum(), mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum()], np.uint64).tobytes())
                    sig.append(signature(s))
                else:
                    cls.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], schema=out)

    return mapped(docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")), run, "doc_id long, n long, cls binary, sig array<int>")


def _prefixes(classes: DataFrame, match: int) -> DataFrame:
    """Postings (key, slot, node, n, popular) of each class's prefix."""
    from pyspark.sql import Window as W

    posted = classes.select("node", "n", F.posexplode("sig").alias("i", "x"))
    posted = posted.select("node", "n", F.expr("shiftleft(cast(i as bigint), 32) | (cast(x as bigint) & 4294967295L)").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("f")).where("f > 1")
    multi = posted.join(shared, "key")
    mine = W.partitionBy("node", "n")
    multi = multi.withColumn("_many", F.count("*").over(mine)).where(F.col("_many") >= match)
    multi = multi.withColumn("popular", F.sum("f").over(mine)).withColumn("_k", F.row_number().over(mine.orderBy("f", "key")))
    return multi.where(F.col("_k") <= F.col("_many") - (match - 1)).select("key", F.expr("cast(shiftright(key, 32) as int)").alias("slot"), "node", "n", "popular")


def _near_size(similarity: float):
    return F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m") - 1e-9


def _colliding(pairs: DataFrame, classes: DataFrame, match: int) -> DataFrame:
    """Pairs whose signatures agree in ``match`` coordinates or more."""
    a = classes.select(F.col("node").alias("u"), F.col("sig").alias("_a"))
    b = classes.select(F.col("node").alias("v"), F.col("sig").alias("_b"))
    both = pairs.join(a, "u").join(b, "v")
    same = F.expr(" + ".join(f"int(_a[{i}] = _b[{i}])" for i in range(K)))  # compiled, as functions of arrays are not
    return both.where(same >= match).select("u", "v").distinct()


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, pair by pair, by one sort of them all."""
    both = [np.concatenate(x) for x in zip(left, right, strict=True)]
    pair, s = np.repeat(np.arange(len(both)), [len(x) for x in both]), np.concatenate(both)
    order = ordered_parts(pair, s, len(both))
    pair, s = pair[order], s[order]
    twice = (s[1:] == s[:-1]) & (pair[1:] == pair[:-1])
    return np.bincount(pair[1:][twice], minlength=len(both))


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Pairs that reach ``similarity`` on the full sets of their texts.  Only texts that the
    pairs may need are shuffled."""
    percent = round(100 * similarity)
    ids = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id")))
    known = maybe_in(docs, F.col("id"), ids)
    # a hub of very many pairs is dealt over tasks, each with a copy of its text
    heavy = pairs.groupBy("u").agg(F.ceil(F.count("*") / PAIRS_PER_COPY).cast("int").alias("copies")).where("copies > 1").withColumnRenamed("u", "_u")
    heavy = small(staged(heavy))
    dealt = pairs.join(heavy, F.col("u") == F.col("_u"), "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("copies", F.lit(1))).cast("int").alias("copy"))
    copied = known.join(heavy, F.col("id") == F.col("_u"), "left")
    copied = copied.select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"), F.col("text").alias("a"))
    both = dealt.join(known.select(F.col("id").alias("v"), F.col("text").alias("b")), "v").join(copied, ["u", "copy"])
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        for batch in batches:
            u, v, a, b = (batch.column(i).to_pylist() for i in range(4))
            new = [k for k in range(len(u)) if not k or (u[k], a[k]) != (u[k - 1], a[k - 1])]  # rows of one u come together
            left = list(shingle_sets([a[k] for k in new], width))
            of = np.searchsorted(new, np.arange(len(u)), "right") - 1
            right = list(shingle_sets(b, width))
            inter = np.concatenate([_intersections([left[i] for i in of[k : k + 64]], right[k : k + 64]) for k in range(0, len(u), 64)])
            n, m = np.array([len(left[i]) for i in of]), np.array([len(x) for x in right])
            mask = pa.array((n > 0) & (100 * inter >= percent * (n + m - inter)), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], schema=out)

    return mapped(both.select("u", "v", "a", "b"), run, "u long, v long").distinct()


def _forest(u: np.ndarray, v: np.ndarray, comp: np.ndarray) -> list[int]:
    """Which of the links u-v (indices) still join two components, taken in order."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    out = []
    for k, (a, b) in enumerate(zip(comp[u].tolist(), comp[v].tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(k)
    return out


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every left set with every right one, by products of 0/1
    matrices over the elements that two sets or more hold, ``wide`` of them at a time."""
    flat = np.concatenate([*left, *right])
    values, index, n = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[index]
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    row, number = row[number >= 0], number[number >= 0]
    order = np.argsort(number, kind="stable")
    row, number = row[order], number[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int((n > 1).sum()), wide):
        a, b = np.searchsorted(number, (at, at + wide))
        m = np.zeros((len(left) + len(right), wide), np.float32)
        m[row[a:b], number[a:b] - at] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _blocks(rows: DataFrame, sizes: DataFrame, classes: DataFrame, docs: DataFrame, match: int, width: int, similarity: float, per_slot: int) -> DataFrame:
    """Confirmed links of long lists across components.

    A list is dealt to blocks of BLOCK_ROWS sets and BLOCK_ITEMS shingles at most, and pairs
    of blocks are tasks of their own.  A task tries each pair at the first long list that it
    shares only, counts its collisions, and confirms it on the full sets in place; what
    leaves a task is a forest: one link for each merge of components at most.
    """
    percent = round(100 * similarity)
    listed = rows.join(sizes, "key")
    masks = listed.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, slot)")).alias("mask")).withColumnRenamed("node", "_m")
    many = F.greatest(F.ceil(F.col("_size") / BLOCK_ROWS), F.ceil(F.col("_items") / BLOCK_ITEMS)).cast("int")
    dealt = listed.withColumn("_n", many).withColumn("_at", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    dealt = dealt.join(masks, F.col("node") == F.col("_m")).join(classes.select("node", "sig"), "node")
    known = maybe_in(docs, F.col("id"), listed.select(F.col("node").alias("id")))
    dealt = dealt.join(known, F.col("node") == F.col("id"))
    dealt = dealt.withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("key", "slot", F.least("_at", "_to").alias("_i"), F.greatest("_at", "_to").alias("_j"), "_at", "node", "comp", "mask", "sig", "text")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        at, node, comp, mask = (t[c].to_numpy() for c in ("_at", "node", "comp", "mask"))
        slot = t["slot"][0].as_py()
        sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(len(at), K)
        sets = list(shingle_sets(t["text"].to_pylist(), width))
        n = np.array([len(x) for x in sets])
        a, b = np.flatnonzero(at == i), np.flatnonzero(at == j)
        us, vs = [], []
        before = np.int64((1 << slot) - 1) if slot < 63 else np.int64(2**63 - 1)
        for x in a:
            other = b[(comp[b] != comp[x]) & ((i != j) | (b > x))]
            other = other[percent * np.maximum(n[other], n[x]) <= 100 * np.minimum(n[other], n[x])]
            same = sig[other] == sig[x]
            full = same.sum(axis=1) >= match
            other, same = other[full], same[full]
            held = same if per_slot == 1 else same[:, : K // per_slot * per_slot].reshape(len(other), K // per_slot, per_slot).all(axis=2)
            earlier = (held[:, :slot] & (((mask[other, None] & mask[x] & before) >> np.arange(slot)) & 1).astype(bool)).any(axis=1)
            other = other[~earlier]
            us.append(np.full(len(other), x))
            vs.append(other)
        us, vs = np.concatenate(us or [at[:0]]).astype(np.int64), np.concatenate(vs or [at[:0]]).astype(np.int64)
        if len(us):
            ua, ub = np.unique(us), np.unique(vs)
            if len(us) * 20 > len(ua) * len(ub):
                both = shared_counts([sets[x] for x in ua], [sets[x] for x in ub])[np.searchsorted(ua, us), np.searchsorted(ub, vs)]
            else:
                both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(us, vs, strict=True)])
            ok = (both > 0) & (100 * both >= percent * (n[us] + n[vs] - both))
            us, vs = us[ok], vs[ok]
            keep = _forest(us, vs, comp)
            us, vs = us[keep], vs[keep]
        return pa.table({"u": pa.array(node[us], pa.int64()), "v": pa.array(node[vs], pa.int64())})

    found = dealt.groupBy("key", "_i", "_j").applyInArrow(compare, "u long, v long")
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def links(post: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: float, per_slot: int = 1) -> DataFrame:
    """Pairs (u, v) that connect what all confirmed links between classes that share a posting
    would connect.  ``post``: key, slot, node, n, popular, where slot s says that the key stands
    for signature coordinates from s * per_slot on; ``classes``: node, n, sig; ``docs``: id,
    text of each node."""
    match = match_threshold(similarity)
    post = staged(post)
    ordered = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    # hubs by ranks that are longs, as maxima of structs would be sorted for; any choice of hubs gives the same components
    popular = F.expr("shiftleft(cast(least(popular, 2147483647) as bigint), 32) | (xxhash64(node) & 4294967295L)")
    hub = lambda rank, name: [F.max_by(c, rank).alias(f"{name}{c}") for c in ("node", "n")]
    hubs = post.groupBy("key").agg(*hub(popular, "_1"), *hub(F.xxhash64("node", "key"), "_2"), F.count("*").alias("_size")).where("_size > 1")
    spread = hubs.select("key", F.explode(F.expr("array_distinct(array(struct(_1node as node, _1n as n), struct(_2node as node, _2n as n)))")).alias("_h"))
    tried = ordered(post.join(spread, "key").select(F.col("node").alias("u"), "n", F.col("_h.node").alias("v"), F.col("_h.n").alias("m")).where(F.col("u") != F.col("v")).where(_near_size(similarity)))
    tried = staged(tried)
    first = staged(_confirmed(staged(_colliding(tried, classes, match)), docs, width, similarity))

    label = components(first, "u", "v")
    rest = post.join(label.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rest = staged(rest.select("key", "slot", "node", "n", "comp"))
    sizes = rest.groupBy("key").agg(F.count("*").alias("_size"), F.sum("n").alias("_items"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
    sizes = staged(sizes.where("_lo != _hi").select("key", "_size", "_items"))
    short = rest.join(sizes.where(F.col("_size") <= SHORT), "key")
    other = short.select("key", F.col("node").alias("v"), F.col("n").alias("m"), F.col("comp").alias("_c"))
    pairs = short.select("key", F.col("node").alias("u"), "n", "comp").join(other, "key").where("u < v and comp != _c").where(_near_size(similarity)).select("u", "v").distinct()
    pairs = pairs.join(tried, ["u", "v"], "left_anti")
    second = _confirmed(staged(_colliding(pairs, classes, match)), docs, width, similarity)
    third = _blocks(rest, sizes.where(F.col("_size") > SHORT), classes, docs, match, width, similarity, per_slot)
    # the components of round one, as stars, connect what its links do
    star = label.where("node != component").select(F.col("component").alias("u"), F.col("node").alias("v"))
    return staged(star.unionByName(second).unionByName(third))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    signed = staged(signatures(docs, doc_id, text, width))
    classes = staged(signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("node"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig")))
    nodes = classes.where("node is not null").select("node", "n", "sig")
    linked = links(_prefixes(nodes, match_threshold(similarity)), nodes, texts, width, similarity)
    label = components(linked, "u", "v")
    named = classes.select("cls", "node").join(label, "node", "left").select("cls", F.coalesce("component", "node").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(named, "cls", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
