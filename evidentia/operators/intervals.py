"""Intervals on an item: greedy non-overlap selection, architecture strings and classes."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import staged

HOT_ROWS = 200_000


def overlap_clusters(hits: DataFrame, item: str, start: str, end: str, out: str = "_cluster") -> DataFrame:
    """Adds the start of the overlap cluster that each interval belongs to: a cluster ends where the next
    start lies beyond every end so far.

    Rows are dealt to ranges of (item, start), so an item of any size spreads over tasks; the largest
    end and the last cluster's start of the ranges before come from a row per range and item.
    """
    place = [F.col(item), F.col(start), F.col(end)]
    ranged = staged(hits.repartitionByRange(*place).withColumn("_p", F.spark_partition_id()))
    here = W.partitionBy("_p", item)
    before = W.partitionBy("_i").orderBy("_q").rowsBetween(W.unboundedPreceding, -1)

    def carried(rows: DataFrame, value: Column, name: str) -> DataFrame:
        one = rows.groupBy(F.col("_p").alias("_q"), F.col(item).alias("_i")).agg(F.max(value).alias("_m"))
        upto = one.select("_q", "_i", F.max("_m").over(before).alias(name))
        return rows.join(upto, (F.col("_p") == F.col("_q")) & F.col(item).eqNullSafe(F.col("_i")), "left").drop("_q", "_i")

    rows = carried(ranged, F.col(end), "_top")
    earlier = F.max(end).over(here.orderBy(start, end).rowsBetween(W.unboundedPreceding, -1))
    top = F.greatest(earlier, "_top")  # the greater of those that are there
    opened = staged(rows.withColumn("_s", F.when(top.isNull() | (F.col(start) > top), F.col(start))).drop("_top"))
    rows = carried(opened, F.col("_s"), "_last")
    own = F.max("_s").over(here.orderBy(start, end, F.col("_s").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(out, F.coalesce(own, "_last")).drop("_p", "_s", "_last")


def kept_of(order: list[int], starts: list, ends: list, max_overlap: float) -> list[int]:
    """Of intervals in the order given, those that clash with none kept before.

    Kept intervals never contain each other, so in the order of their starts their ends ascend as
    well: what a new one meets lies next to its place, and one that holds a kept one clashes at once.
    """
    out, s, e = [], [], []
    for i in order:
        a, b = starts[i], ends[i]
        at = bisect_left(s, a)
        clash, j = False, at - 1
        while j >= 0 and e[j] >= a and not clash:
            clash = (min(b, e[j]) - a + 1) / (min(b - a, e[j] - s[j]) + 1) > max_overlap
            j -= 1
        j = at
        while not clash and j < len(s) and s[j] <= b:
            clash = (min(b, e[j]) - s[j] + 1) / (min(b - a, e[j] - s[j]) + 1) > max_overlap
            j += 1
        if not clash:
            out.append(i)
            s.insert(at, a)
            e.insert(at, b)
    return out


def _key(v):
    return (0, 0) if v is None else (2, 0) if v != v else (1, v)


def _swept(max_overlap: float, n_rank: int, names: list[str]):
    """Sorted batches (item, start, end, rank columns, others) to the kept rows, cluster by cluster."""

    def resolve(table: pa.Table, bounds: list[int]) -> pa.Table:
        keep = np.ones(table.num_rows, bool)
        wide = [(lo, hi) for lo, hi in zip(bounds, bounds[1:], strict=False) if hi - lo > 1]
        if wide:
            starts, ends = table.column("_start").to_pylist(), table.column("_end").to_pylist()
            ranks = [table.column(f"_k{i}").to_pylist() for i in range(n_rank)]
            for lo, hi in wide:
                order = sorted(range(lo, hi), key=lambda i: [_key(r[i]) for r in ranks])
                keep[lo:hi] = False
                keep[kept_of(order, starts, ends, max_overlap)] = True
        return table.filter(pa.array(keep)).select(names)

    def run(batches):
        held, item, top = [], None, None
        for batch in batches:
            items, starts, ends = (batch.column(c).to_pylist() for c in ("_item", "_start", "_end"))
            cuts = []
            for k, (x, a, b) in enumerate(zip(items, starts, ends, strict=True)):
                if top is None or x != item or a > top:  # without a start: first of its item, by itself
                    cuts.append(k)
                    item, top = x, b
                elif b > top:
                    top = b
            if not cuts:
                held.append(batch)
                continue
            before = sum(h.num_rows for h in held)
            table = pa.Table.from_batches([*held, batch.slice(0, cuts[-1])], schema=batch.schema)
            if table.num_rows:
                yield from resolve(table, [0, *(before + c for c in cuts if before + c)]).to_batches()
            held = [batch.slice(cuts[-1])]
        if held:
            table = pa.Table.from_batches(held)
            yield from resolve(table, [0, table.num_rows]).to_batches()

    return run


def resolve_overlaps(hits: DataFrame, item: str, start: str, end: str, rank: list[Column], max_overlap: float = 0.4) -> DataFrame:
    """Per item, intervals taken best first and dropped where they overlap a kept one by more
    than ``max_overlap`` of the shorter; all other columns go along.

    Only intervals of one overlap cluster can clash, so rows are swept by start and each cluster is resolved
    by itself: what a task holds is one cluster.  Items of more than HOT_ROWS rows (counted; there are at most
    rows / HOT_ROWS of them) are dealt to tasks by cluster, all others by item.

    ``rank`` must be a total order, nulls first.  A null item is an item; intervals without a start
    or an end, or that end before they start, clash with nothing and stay.
    """
    if max_overlap >= 1:
        return hits
    names = hits.columns
    sound = F.col(end) >= F.col(start)
    inside = hits.select(F.col(item).alias("_item"), F.when(sound, F.col(start)).alias("_start"), F.when(sound, F.col(end)).alias("_end"), *[r.alias(f"_k{i}") for i, r in enumerate(rank)], *names)
    sweep, schema = _swept(max_overlap, len(rank), names), hits.schema
    swept = lambda df, *by: df.repartition(*by).sortWithinPartitions("_item", "_start", "_end").mapInArrow(sweep, schema)
    hot = staged(hits.groupBy(F.col(item).alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS))
    if hot.isEmpty():
        return swept(inside, "_item")
    few, same = F.broadcast(hot), F.col("_item").eqNullSafe(F.col("_h"))
    clusters = overlap_clusters(inside.join(few, same, "left_semi"), "_item", "_start", "_end")
    return swept(inside.join(few, same, "left_anti"), "_item").unionByName(swept(clusters, "_item", "_cluster"))


def run_lengths(labels: Column) -> Column:
    """Equal neighbours of an array of strings written once with their number: ``A-Bx3-A``."""
    n = F.size(labels)
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(labels, i) != F.get(labels, i - 1)))
    one = lambda x, times: F.when(times > 1, F.concat(x, F.lit("x"), times.cast("string"))).otherwise(x)
    return F.when(n > 0, F.array_join(F.transform(at, lambda i, k: one(F.get(labels, i), F.coalesce(F.get(at, k + 1), n) - i)), "-")).otherwise("")


def architecture(kept: DataFrame, item: str, start: str, label: str, ties: list[str] | None = None) -> DataFrame:
    """(item, architecture): labels by start, runs of equal ones written once with their number."""
    order = [start, *(ties or []), label]
    row = kept.groupBy(item).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[label]).alias("_l"))
    return row.select(item, run_lengths(F.col("_l")).alias("architecture"))


#: Repeats that a construct needs to bind the intact wall, and its fragments.
REPEATS_FOR_WALL = 3
REPEATS_FOR_FRAGMENTS = 2


def binding_call(n: Column) -> Column:
    """Struct (call, binds_wall, reason) for a number of binding repeats."""
    text = n.cast("string")
    say = lambda call, ok, *why: F.struct(F.lit(call).alias("call"), F.lit(ok).alias("binds_wall"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in why]).alias("reason"))
    return (
        F.when(n.isNull(), say("unknown", False, "no repeat count"))
        .when(n >= REPEATS_FOR_WALL, say("pseudomurein_sacculus", True, text, f" repeats, at least the {REPEATS_FOR_WALL} that bind intact cells"))
        .when(n >= REPEATS_FOR_FRAGMENTS, say("murein_fragments_only", False, text, " repeats bind exposed fragments only"))
        .when(n == 1, say("none", False, "one repeat binds nothing"))
        .otherwise(say("no_pmbr_module", False, "no repeat, so the rule on repeats does not apply"))
    )


def rule_applies(n: Column) -> Column:
    return F.coalesce(n > 0, F.lit(False))


def architecture_table(items: DataFrame, strict: DataFrame, permissive: DataFrame, item: str, start: str, end: str, label: str, binding: str, catalytic: str, accessory: list[str], ties: list[str] | None = None) -> DataFrame:
    """One row per item, with or without intervals: counts under both bars, whether the bar
    decides the binding call, class, strings and spans.  ``strict`` and ``permissive`` are
    resolved separately and summed up by one aggregate."""
    both = [item, start, end, label, *[t for t in ties or [] if t not in (start, end, label)]]
    kept = strict.select(*both, F.lit(True).alias("_strict")).unionByName(permissive.select(*both, F.lit(False).alias("_strict")))
    own, is_ = F.col("_strict"), lambda x: F.col(label) == x
    order = F.struct(start, *(ties or []), label)
    span = lambda x: F.array_sort(F.collect_list(F.when(own & is_(x), F.struct(start, end))))
    a = kept.groupBy(item).agg(
        F.count_if(own & is_(binding)).alias("n_binding"), F.count_if(own & is_(catalytic)).alias("n_catalytic"), F.count_if(own).alias("n_domains"),
        F.array_join(F.array_sort(F.collect_set(F.when(own & F.col(label).isin(accessory), F.col(label)))), ",").alias("accessory_domains"),
        (F.max_by(F.when(own, F.col(label)), F.when(own, order)) == catalytic).cast("int").alias("catalytic_is_last"), F.count_if(~own & is_(binding)).alias("n_binding_permissive"),
        F.transform(F.array_sort(F.collect_list(F.when(own, order))), lambda x: x[label]).alias("_l"), span(binding).alias("_b"), span(catalytic).alias("_c"),
    )
    spelled = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws("-", x[start].cast("string"), x[end].cast("string"))), ";")
    a = a.withColumns({"architecture": run_lengths(F.col("_l")), "binding_span": spelled("_b"), "catalytic_span": spelled("_c")}).drop("_l", "_b", "_c")
    out = items.select(item).join(a, item, "left")
    out = out.na.fill(0, ["n_binding", "n_catalytic", "n_domains", "n_binding_permissive", "catalytic_is_last"]).na.fill("", ["accessory_domains", "architecture", "binding_span", "catalytic_span"])
    call, loose = binding_call(F.col("n_binding")), binding_call(F.col("n_binding_permissive"))
    fragile = call["binds_wall"] != loose["binds_wall"]
    kind = F.when(fragile, "count_ambiguous").when((F.col("n_binding") == 0) & (F.col("accessory_domains") != ""), "accessory_binding").when(F.col("n_binding") == 0, "catalytic_only").when(F.col("n_binding") >= REPEATS_FOR_WALL, "canonical").otherwise("reduced")
    return out.withColumns({"count_fragile": fragile.cast("int"), "binding_competent": call["binds_wall"].cast("int"), "rule_applies": rule_applies(F.col("n_binding")).cast("int"), "predicted_binding": call["call"], "architecture_class": kind})
