"""Similarity graphs: canonical edges, components at one or many thresholds, the knee."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import numbered, staged


def canonical_edges(edges: DataFrame, nodes: DataFrame, a: str = "a", b: str = "b", cost: str = "evalue") -> DataFrame:
    """Undirected edges (u < v) between known nodes, the least cost of repeats; no self loops."""
    known = nodes.select(F.col(nodes.columns[0]).alias("_n"))
    e = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), cost)
    e = e.groupBy("u", "v").agg(F.min(cost).alias(cost))
    return e.join(known, F.col("u") == F.col("_n"), "left_semi").join(known, F.col("v") == F.col("_n"), "left_semi")


def hook(edges: DataFrame, by: list[str]) -> DataFrame:
    """Least reachable node of each linked node, per group of ``by``: (by…, node, component).

    Labels go down by the least of the neighbours' labels and then jump to the label of their
    label, so long paths shorten fast; a round is one grouped minimum and one join, written to
    the shared folder.
    """
    both = edges.select(*by, F.col("u").alias("node"), F.col("v").alias("other")).unionByName(edges.select(*by, F.col("v").alias("node"), F.col("u").alias("other"))).distinct()
    both = staged(both)
    label = staged(both.groupBy(*by, "node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        heard = both.join(label.withColumnRenamed("node", "other"), [*by, "other"]).groupBy(*by, "node").agg(F.min("component").alias("_c"))
        near = label.join(heard, [*by, "node"]).select(*by, "node", F.col("component").alias("_was"), F.least("component", "_c").alias("component"))
        up = label.select(*by, F.col("node").alias("component"), F.col("component").alias("_up"))
        new = staged(near.join(up, [*by, "component"], "left").select(*by, "node", "_was", F.least("component", "_up").alias("component")))
        changed = new.where("component != _was").limit(1).count()
        label = new.drop("_was")
        if not changed:
            return label


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, size, rank): components numbered by size from 0, ties by least node."""
    found = hook(edges.select("u", "v"), [])
    node = nodes.select(F.col(nodes.columns[0]).alias("node"))
    full = node.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = full.groupBy("component").agg(F.count("*").alias("size"))
    sizes = numbered(sizes, [F.col("size").desc(), F.col("component")])
    return full.join(sizes, "component").select("node", "component", "size", "rank")


def threshold_sweep(nodes: DataFrame, edges: DataFrame, score: str, thresholds: list[float], counts: DataFrame | None = None) -> DataFrame:
    """(threshold, n_edges, n_components, largest_component, n_singletons) of the graphs of edges
    with at least that score.  All thresholds are labelled together, by one loop.  ``counts`` (threshold,
    n_edges) where ``edges`` are only what the components need."""
    grid = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= F.col(score))
    e = edges.select("u", "v", F.explode(grid).alias("threshold"))
    n = nodes.count()
    labels = hook(e, ["threshold"])
    sizes = labels.groupBy("threshold", "component").agg(F.count("*").alias("size"))
    per = sizes.groupBy("threshold").agg(F.count("*").alias("_k"), F.sum("size").alias("_linked"), F.max("size").alias("_largest"))
    counts = e.groupBy("threshold").agg(F.count("*").alias("n_edges")) if counts is None else counts
    one = edges.sparkSession.range(1).select(F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    out = one.join(counts, "threshold", "left").join(per, "threshold", "left").na.fill(0)
    alone = F.lit(n) - F.col("_linked")
    return out.select("threshold", "n_edges", (F.col("_k") + alone).alias("n_components"), F.greatest(F.col("_largest"), F.lit(min(n, 1))).alias("largest_component"), alone.alias("n_singletons"))


def knee(curve: DataFrame, x: str, y: str) -> DataFrame:
    """The row farthest from the chord of the normalised curve, the first of equals."""
    w = W.partitionBy()
    lo, hi = (lambda c: F.min(c).over(w)), (lambda c: F.max(c).over(w))
    norm = lambda c: (F.col(c) - lo(c)) / F.when(hi(c) > lo(c), hi(c) - lo(c)).otherwise(1.0)
    c = curve.withColumn("_x", norm(x)).withColumn("_y", norm(y))
    first = lambda v: F.min_by(v, x).over(w)
    last = lambda v: F.max_by(v, x).over(w)
    dx, dy = last("_x") - first("_x"), last("_y") - first("_y")
    far = F.abs(dy * (F.col("_x") - first("_x")) - dx * (F.col("_y") - first("_y"))) / F.sqrt(dx * dx + dy * dy)
    c = c.withColumn("distance", F.round(far, 9))
    return c.orderBy(F.col("distance").desc(), x).limit(1).drop("_x", "_y")


def kmer_similarity(seqs: DataFrame, seq_id: str, seq: str, k: int = 4, min_share: float = 0.5) -> DataFrame:
    """(u, v, shared, jaccard) of sequences by shared k-mers; a stand-in for an aligner.

    Sequences of one k-mer set are one class first.  A pair at the threshold must share one
    of the rarest (1 - share) part of either's k-mers, so only those are joined, and sizes
    are compared before sets.
    """
    s = seqs.where(F.length(seq) >= k).select(F.col(seq_id).alias("id"), F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda i: F.substring(F.col(seq), i, F.lit(k))))).alias("g"))
    s = s.groupBy("g").agg(F.min("id").alias("id")).withColumn("n", F.size("g"))
    long = s.select("id", "n", F.explode("g").alias("t"))
    freq = long.groupBy("t").agg(F.count("*").alias("f"))
    ranked = long.join(freq, "t").withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy("f", "t")))
    prefix = ranked.where((F.col("f") > 1) & (F.col("_k") <= F.col("n") - F.ceil(F.col("n") * min_share) + 1)).select("t", "id", "n")
    other = prefix.select("t", F.col("id").alias("v"), F.col("n").alias("m"))
    pairs = prefix.withColumnRenamed("id", "u").join(other, "t").where("u < v").where(F.least("n", "m") >= F.greatest("n", "m") * min_share).select("u", "v").distinct()
    a, b = s.select(F.col("id").alias("u"), F.col("g").alias("ga")), s.select(F.col("id").alias("v"), F.col("g").alias("gb"))
    full = pairs.join(a, "u").join(b, "v").withColumn("shared", F.size(F.array_intersect("ga", "gb")))
    return full.withColumn("jaccard", F.col("shared") / (F.size("ga") + F.size("gb") - F.col("shared"))).where(F.col("jaccard") >= min_share).select("u", "v", "shared", "jaccard")


def greedy_clusters(seqs: DataFrame, seq_id: str, length: str, pairs: DataFrame) -> DataFrame:
    """member -> representative, greedy from the longest (ties: least id): a sequence joins the
    first representative that it is similar to, else becomes one.

    A sequence is decided once all better neighbours are; each round decides every sequence
    whose better neighbours are all members, and then their neighbours.
    """
    rank = seqs.select(F.col(seq_id).alias("id"), F.col(length).alias("len"))
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = both.join(rank.select(F.col("id").alias("u"), F.col("len").alias("lu")), "u").join(rank.select(F.col("id").alias("v"), F.col("len").alias("lv")), "v")
    better = staged(both.where("lv > lu or (lv = lu and v < u)").select("u", "v", "lv"))  # v goes before u
    state = staged(rank.select("id", F.lit(None).cast("boolean").alias("rep")))
    while True:
        known = state.select(F.col("id").alias("v"), F.col("rep").alias("rv"))
        seen = better.join(known, "v").groupBy("u").agg(F.bool_or(F.coalesce("rv", F.lit(False))).alias("hit"), F.bool_or(F.col("rv").isNull()).alias("wait"))
        new = state.join(seen.withColumnRenamed("u", "id"), "id", "left")
        rep = F.coalesce("rep", F.when(F.col("hit"), False).when(F.col("wait"), None).otherwise(True))
        state = staged(new.select("id", rep.alias("rep")))
        if not state.where("rep is null").limit(1).count():
            break
    reps = state.where("rep").select(F.col("id").alias("v"))
    mine = better.join(reps, "v").groupBy("u").agg(F.min_by("v", F.struct(-F.col("lv"), F.col("v"))).alias("representative"))
    return state.join(mine.withColumnRenamed("u", "id"), "id", "left").select(F.col("id").alias("member"), F.when(F.col("rep"), F.col("id")).otherwise(F.col("representative")).alias("representative"))
