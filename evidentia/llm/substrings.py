"""Paragraph-level substring dedup: MinHash banding, exact confirmation, components.

Paragraphs of a text are

- lines of ``min_words`` words or more, and blocks (lines up to the next blank one) of as many;
- stretches: runs of words that stand word for word in another text too, wherever line breaks
  fall in either (see ``stretches``); each stretch stands as a whole in the text it is credited
  to, its source, and is a paragraph there also;
- the whole text, where two documents or more have it.

Equal shingle sets are one class.  Each class is posted under its bands (``bands`` picks rows
and bands for the wanted recall at the similarity threshold).  Colliding classes are paired
through hubs first and exhaustively across components after that (see ``near.links``), confirmed
by exact Jaccard on their full shingle sets, and joined to components.  In a component that
spans two documents or more the least document keeps its paragraphs, once in a text; the
others are removals.

What is found: every passage of ``min_words`` words or more that two texts share word for word,
to its ends and at all its places; passages with edits only where they are lines or blocks
of that length with a Jaccard similarity of ``similarity`` or more.

Defined cases: null or empty text has no paragraphs; a document that repeats its own
paragraph, alone in that, is not reported; rows that repeat (doc_id and text) are one
document; null doc_ids are one document, least of all; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, BLANKS, _powers, discard, encode, hashed_words, mapped, maybe_in, mix, ordered_parts, shingles, staged, text_groups
from .graph import components
from .near import _A, _B, K, links

MIN_WORDS = 50
RECALL = 0.9999
SEED = 30
_Q = 0xD6E8FEB86659FD93
_QINV = pow(_Q, -1, 2**64)


def bands(similarity: float, recall: float = RECALL, k: int = K) -> tuple[int, int]:
    """(rows, bands): the most selective banding of ``k`` coordinates with that recall."""
    best = (1, k)
    for r in range(1, k + 1):
        b = next((b for b in range(1, k // r + 1) if 1 - (1 - similarity**r) ** b >= recall), None)
        if b:
            best = (r, b)
    return best


# --- kernels on arrays of word hashes ------------------------------------------------------------

_STEPS = np.random.default_rng(11).integers(1, 2**63, K, dtype=np.uint64) | np.uint64(1)
_CHUNK = 1 << 17


def signed(words: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, signature, size of the shingle set) of the parts [start, end) of ``words``, each of
    ``width`` words or more, all at once.  ``node`` is a hash of a part's shingle set; a signature
    is a column of ``k`` coordinates, those of ``near.signature``."""
    n = end - start - (width - 1)
    node, size = np.zeros(len(n), np.uint64), np.zeros(len(n), np.int64)
    sig = np.full((k, len(n)), np.uint64(2**64 - 1))
    every = shingles(words, width) if len(words) >= width else words[:0]
    first, upto = 0, np.cumsum(n)
    while first < len(n):  # parts of about _CHUNK shingles together
        last = max(first + 1, int(np.searchsorted(upto, upto[first] - n[first] + _CHUNK)))
        many = n[first:last]
        at = np.concatenate(([0], np.cumsum(many)[:-1]))
        part = np.repeat(np.arange(len(many)), many)
        s = every[np.arange(int(many.sum())) - at[part] + start[first:last][part]]
        for i in range(k):
            sig[i, first:last] = np.minimum.reduceat(s * _A[i] + _B[i], at)
        order = ordered_parts(part, s, len(many))
        s, part = s[order], part[order]
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (part[1:] != part[:-1])))
        node[first:last] = np.add.reduceat(np.where(new, mix(s), np.uint64(0)), at)
        size[first:last] = np.add.reduceat(new, at, dtype=np.int64)
        first = last
    return node.view(np.int64), (mix(sig) >> np.uint64(32)).astype(np.uint32).view(np.int32), size


def sign(words: np.ndarray, start: np.ndarray, end: np.ndarray, width: int, rb: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(node, band keys) of parts of ``words``; a band's number is in the lowest six bits of its key."""
    r, b = rb
    node, sig, _ = signed(words, start, end, width, r * b)
    parts = sig.view(np.uint32).astype(np.uint64).reshape(b, r, len(node))
    keys = mix((parts * _STEPS[:r, None]).sum(axis=1, dtype=np.uint64) + np.uint64(1))
    keys = (keys & ~np.uint64(63)) | np.arange(b, dtype=np.uint64)[:, None]
    return node, np.ascontiguousarray(keys.T).view(np.int64)


def _slide(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Minimum (maximum) of each n consecutive values, by doubling."""
    f, have = np.minimum if least else np.maximum, 1
    while have < n:
        step = min(have, n - have)
        x = f(x[: len(x) - step], x[step:])
        have += step
    return x


def _hash(words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each ``start`` on, wherever they stand."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * _powers(_Q, len(words) + 1)[: len(words)], dtype=np.uint64)))
    return mix((total[start + n] - total[start]) * _powers(_QINV, len(total))[start])


def picked(words: np.ndarray, cut: np.ndarray, window: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, offset, hash) of windows of ``window`` words inside the parts that ``cut`` bounds, one
    at least among any ``every`` consecutive ones; which ones depends on their own words only."""
    n = len(words)
    if n < window:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    top = np.uint64(2**64 - 1)
    line = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    starts = np.arange(n - window + 1)
    inside = line[starts] == line[starts + window - 1]
    key = np.where(inside, shingles(words, 5)[: len(starts)], top)
    edge = np.full(every - 1, top)
    least = _slide(np.concatenate([edge, key, edge]), every, True)  # windows that end at and after each start
    pick = starts[inside & (_slide(least, every, False) == key)]
    return line[pick], pick - cut[line[pick]], _hash(words, pick, window)


def _seed_size(min_words: int) -> tuple[int, int]:
    """(words of a seed, starts in a row of which one is picked) so that every run of
    ``min_words`` words holds a seed, the same one wherever the run stands."""
    window = min(SEED, min_words)
    return window, min_words - window + 1


def spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 byte of each word."""
    edge = np.diff((~BLANKS[np.frombuffer(raw, np.uint8)]).view(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def cut_texts(raw: list[bytes], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of all texts, bounds of the texts in them; text, start and end in them of each
    line and block of ``min_words`` words or more)."""
    lines = [x.split(b"\n") for x in raw]
    words, cut = hashed_words(list(chain.from_iterable(lines)), BLANKS)
    per = np.array([len(x) for x in lines], np.int64)
    of = np.repeat(np.arange(len(raw)), per)
    full = np.diff(cut) > 0
    joined = full[1:] & full[:-1] & (of[1:] == of[:-1])  # a line goes on with the next one
    first = np.flatnonzero(full & ~np.concatenate(([False], joined)))
    last = np.flatnonzero(full & ~np.concatenate((joined, [False])))
    many = first < last
    each = np.flatnonzero(full)
    a, b = np.concatenate((each, first[many])), np.concatenate((each, last[many]))
    a, b = (x[(cut[b + 1] - cut[a]) >= min_words] for x in (a, b))
    order = np.argsort(of[a], kind="stable")
    return words, cut[np.concatenate(([0], np.cumsum(per)))], of[a][order], cut[a][order], cut[b + 1][order]


# --- tables --------------------------------------------------------------------------------------


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(body).alias("th"), body.alias("body"))


_PART = pa.struct([("start", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])
_PARTS_DDL = "array<struct<start:long,n:long,node:long,bands:array<long>>>"


def _lists(values: pa.Array, of: np.ndarray, n: int) -> pa.ListArray:
    """``values`` as ``n`` lists; ``of`` (in order) is the list of each."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


def _parts(start: np.ndarray, n: np.ndarray, node: np.ndarray, keys: np.ndarray) -> pa.StructArray:
    held = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel()))
    return pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(node, pa.int64()), held], fields=list(_PART))


def read(texts: DataFrame, width: int, min_words: int, rb: tuple[int, int]) -> DataFrame:
    """Rows (doc_id, th, n_words, seeds, parts), one for each of ``texts``: hashes of its seeds,
    and its lines and blocks of ``min_words`` words or more."""
    window, every = _seed_size(min_words)
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("seeds", pa.list_(pa.int64())), ("parts", pa.list_(_PART))])

    def run(batches):
        for batch in batches:
            raw = [x.translate(ASCII_LOWER) for x in encode(batch.column(2).to_pylist())]
            for a, b in text_groups([len(x) for x in raw]):
                words, bound, of, start, end = cut_texts(raw[a:b], min_words)
                text, _, h = picked(words, bound, window, every)
                parts = _parts(start - bound[of], end - start, *sign(words, start, end, width, rb))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(np.diff(bound), pa.int64()), _lists(pa.array(h.view(np.int64)), text, b - a), _lists(parts, of, b - a)],
                    schema=out,
                )

    return mapped(texts, run, f"doc_id long, th long, n_words long, seeds array<long>, parts {_PARTS_DDL}")


def _bodies(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (th, doc_id and more, each th once) with the ``body`` of that document; only texts
    that may be wanted are shuffled."""
    key = F.xxhash64("th", "doc_id")
    held = maybe_in(texts, key, wanted.select(key.alias("id")))
    held = held.select(F.col("th").alias("_t"), F.col("doc_id").alias("_d"), "body")
    both = wanted.join(held, F.col("th") == F.col("_t")).where(F.col("doc_id").eqNullSafe(F.col("_d")))
    return both.drop("_t", "_d").dropDuplicates(["th"])  # of repeated rows


def _shared(posts: DataFrame, *more: Column) -> DataFrame:
    """The hashes ``h`` that two texts or more hold, with the least of these texts.  A table of its
    own: a join with it may split a hash that fills many tasks."""
    return staged(posts.groupBy("h").agg(F.min("th").alias("lo"), F.max("th").alias("hi"), *more).where("lo != hi").drop("hi"))


def window_posts(marked: DataFrame, min_words: int) -> DataFrame:
    """Rows (th, h, pos, first) for the windows of ``min_words`` words of rows (th, body, marks)
    that hold a seed in ``marks``; ``first`` at the first place of a hash in its text."""
    window, every = _seed_size(min_words)
    out = pa.schema([("th", pa.int64()), ("h", pa.int64()), ("pos", pa.int64()), ("first", pa.bool_())])

    def run(batches):
        for batch in batches:
            raw = [x.translate(ASCII_LOWER) for x in encode(batch.column(1).to_pylist())]
            ths, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            for a, b in text_groups([len(x) for x in raw]):
                words, bound = hashed_words(raw[a:b], BLANKS)
                text, at, h = picked(words, bound, window, every)
                last = np.diff(bound) - min_words
                # a seed that another of these texts has in its marks is shared, so the text's own marks have it too
                mine = np.isin(h.view(np.int64), marks[a:b].flatten().to_numpy(zero_copy_only=False)) & (last[text] >= 0)
                text, at = text[mine], at[mine]
                held = np.zeros(len(words) + 1, np.int32)  # ranges that hold a start, by differences
                np.add.at(held, bound[text] + np.maximum(at - (every - 1), 0), 1)
                np.add.at(held, bound[text] + np.minimum(at, last[text]) + 1, -1)
                pos = np.flatnonzero(np.cumsum(held)[:-1] > 0)
                if not len(pos):
                    continue
                hashes, of = _hash(words, pos, min_words), np.searchsorted(bound, pos, "right") - 1
                order = ordered_parts(of, hashes, b - a)
                new = np.concatenate(([True], (np.diff(of[order]) > 0) | (hashes[order][1:] != hashes[order][:-1])))
                first = np.zeros(len(pos), bool)
                first[np.minimum.reduceat(order, np.flatnonzero(new))] = True
                yield pa.RecordBatch.from_arrays([pa.array(ths[a:b][of]), pa.array(hashes.view(np.int64)), pa.array(pos - bound[of], pa.int64()), pa.array(first)], schema=out)

    return mapped(marked.select("th", "body", "marks"), run, "th long, h long, pos long, first boolean")


def stretches(texts: DataFrame, per: DataFrame, reps: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Rows (th, start, n, src, at) of places and (src, at, n, src2, at2, n2) of links.

    A stretch is a longest run of windows of ``min_words`` words that are credited to one text:
    the least that holds them.  Equal places have the same (src, at, n), which names a place
    where their words stand.  Runs that meet the text they are credited to at other places than
    in a row (a stuttered word, a passage that it repeats itself) name their own place, and a
    link tells where they are credited.
    """
    seeds = per.select("th", F.explode("seeds").alias("h"))
    shared = _shared(seeds)
    marks = maybe_in(seeds, F.col("h"), shared.select(F.col("h").alias("id"))).distinct().join(shared, "h")
    marks = staged(marks.groupBy("th").agg(F.collect_list("h").alias("marks")).join(reps.select("th", "doc_id"), "th"))
    posts = staged(window_posts(_bodies(texts, marks), min_words))
    # one first place in each text, so the place in the least text is one
    known = _shared(posts.where("first"), F.min_by("pos", "th").alias("at"))
    held = posts.select("th", "h", "pos").join(known.hint("shuffle_hash"), "h")
    by = W.partitionBy("th").orderBy("pos")
    beside = lambda f, step: (f("pos").over(by) == F.col("pos") + step) & (f("lo").over(by) == F.col("lo"))
    ends = held.withColumn("first", ~F.coalesce(beside(F.lag, -1), F.lit(False))).withColumn("last", ~F.coalesce(beside(F.lead, 1), F.lit(False))).where("first or last")
    to = lambda c: F.when(F.col("last"), F.col(c)).otherwise(F.lead(c).over(by))
    runs = ends.withColumn("to", to("pos")).withColumn("end", to("at")).where("first")
    runs = runs.select("th", F.col("pos").alias("start"), (F.col("to") - F.col("pos") + min_words).alias("n"), "lo", "at", "end")
    runs = staged(runs.withColumn("own", (F.col("lo") == F.col("th")) & (F.col("at") == F.col("start"))).withColumn("row", F.col("end") - F.col("at") == F.col("n") - min_words).drop("end"))
    discard(shared, marks, posts, known)
    copy = runs.where("not own")
    named = copy.select("th", "start", "n", F.when(F.col("row"), F.col("lo")).otherwise(F.col("th")).alias("src"), F.when(F.col("row"), F.col("at")).otherwise(F.col("start")).alias("at"))
    source = copy.where("row").select(F.col("lo").alias("th"), F.col("at").alias("start"), "n", F.col("lo").alias("src"), "at").distinct()
    mine = runs.where("own").select(F.col("th").alias("lo"), F.col("start").alias("at2"), F.col("n").alias("n2"))
    odd = copy.where("not row").join(mine, "lo").where(f"at between at2 and at2 + n2 - {min_words}")
    link = staged(odd.select(F.col("th").alias("src"), F.col("start").alias("at"), "n", F.col("lo").alias("src2"), "at2", "n2"))
    credited = link.select(F.col("src2").alias("th"), F.col("at2").alias("start"), F.col("n2").alias("n"), F.col("src2").alias("src"), F.col("at2").alias("at")).distinct()
    return named.unionByName(source).unionByName(credited), link


def signed_places(held: DataFrame, width: int, rb: tuple[int, int]) -> DataFrame:
    """Rows (src, at, n, node, bands) of rows (th, body, places)."""
    out = pa.schema([("src", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ths, places = batch.column(0), batch.column(2)
            raw = [x.translate(ASCII_LOWER) for x in encode(batch.column(1).to_pylist())]
            for a, b in text_groups([len(x) for x in raw]):
                words, bound = hashed_words(raw[a:b], BLANKS)
                mine = [places[i].values for i in range(a, b)]
                of = np.repeat(np.arange(b - a), [len(x) for x in mine])
                start, n = (np.concatenate([x.field(c).to_numpy(zero_copy_only=False) for x in mine]) for c in ("at", "n"))
                from_ = start + bound[of]
                parts = _parts(start, n, *sign(words, from_, from_ + n, width, rb)).flatten()
                yield pa.RecordBatch.from_arrays([ths.take(pa.array(of + a)), *parts], schema=out)

    return mapped(held.select("th", "body", "places"), run, "src long, at long, n long, node long, bands array<long>")


def paragraph_texts(held: DataFrame, width: int) -> DataFrame:
    """Rows (node, text, n, sig) of rows (body, places) with places (id, start, n in words)."""
    out = pa.schema([("node", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("sig", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            bodies, places = encode(batch.column(0).to_pylist()), batch.column(1)
            for a, b in text_groups([len(x) for x in bodies]):
                words, bound = hashed_words([x.translate(ASCII_LOWER) for x in bodies[a:b]], BLANKS)
                mine = [places[i].values for i in range(a, b)]
                of = np.repeat(np.arange(b - a), [len(x) for x in mine])
                node, start, n = (np.concatenate([x.field(c).to_numpy(zero_copy_only=False) for x in mine]) for c in ("id", "start", "n"))
                _, sig, size = signed(words, start + bound[of], start + n + bound[of], width, K)
                texts = []
                for i, x in enumerate(mine):
                    first, last = spans(bodies[a + i])
                    at = slice(*np.searchsorted(of, (i, i + 1)))
                    texts += [bodies[a + i][p:q].decode("utf-8", "surrogatepass") for p, q in zip(first[start[at]].tolist(), last[start[at] + n[at] - 1].tolist(), strict=True)]
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * K, pa.int32()), pa.array(np.ascontiguousarray(sig.T).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(texts, pa.string()), pa.array(size, pa.int64()), held], schema=out)

    return mapped(held.select("body", "places"), run, "node long, text string, n long, sig array<int>")


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.75, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (doc_id, th, start, n_words, cluster, cluster_id, n_docs, removed): the paragraphs
    whose component spans two documents or more.  ``start`` is the paragraph's first word in
    the text, from 0; ``th`` the hash of the text; ``cluster`` the component's least node,
    ``cluster_id`` the doc_id that keeps its paragraphs."""
    if min_words < width:
        raise ValueError("min_words must reach width")
    r, b = bands(similarity)
    texts = _texts(docs, doc_id, text)
    per = staged(read(texts, width, min_words, (r, b)))
    docs_of = per.select("doc_id", "th").distinct()
    reps = staged(docs_of.groupBy("th").agg(F.min("doc_id").alias("doc_id"), (F.count("*") > 1).alias("many")))

    found, link = stretches(texts, per, reps, min_words)
    whole = per.where(F.col("n_words") >= min_words).select("th", F.col("n_words").alias("n")).distinct().join(reps.where("many"), "th", "left_semi")
    found = staged(found.unionByName(whole.select("th", F.lit(0).cast("long").alias("start"), "n", F.col("th").alias("src"), F.lit(0).cast("long").alias("at"))).distinct())
    places = found.select("src", "at", "n").distinct().groupBy("src").agg(F.collect_list(F.struct("at", "n")).alias("places"))
    known = staged(signed_places(_bodies(texts, staged(places.withColumnRenamed("src", "th").join(reps, "th").drop("many"))), width, (r, b)))
    node = known.select("src", "at", "n", "node")
    found = staged(found.join(node, ["src", "at", "n"]).select("th", "start", "n", "node"))

    parts = per.select("doc_id", "th", F.explode("parts").alias("p")).select("doc_id", "th", "p.start", "p.n", "p.node", "p.bands")
    held = parts.select("node", "bands").unionByName(known.select("node", "bands")).select("node", F.explode("bands").alias("key"))
    shared = held.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo != hi").select("key")
    shared = staged(shared)
    post = staged(maybe_in(held, F.col("key"), shared.select(F.col("key").alias("id"))).distinct().join(shared, "key"))

    # from here on only classes that share a band with another matter
    ids = post.select(F.col("node").alias("id")).distinct()
    seen = staged(parts.select("th", "start", "n", "node").unionByName(found).distinct())
    some = maybe_in(seen, F.col("node"), ids).join(ids, F.col("node") == F.col("id"), "left_semi")
    # start and n in one long, as minima of structs would be sorted for; a text has fewer than 2^31 bytes
    one = some.groupBy("node").agg(F.min("th").alias("th"), F.min_by(F.expr("shiftleft(start, 32) | n"), "th").alias("p"))
    one = one.groupBy("th").agg(F.collect_list(F.expr("struct(node as id, shiftright(p, 32) as start, p & 4294967295L as n)")).alias("places"))
    classes = staged(paragraph_texts(_bodies(texts, staged(one.join(reps, "th").drop("many"))), width))
    post = post.join(classes.select("node", "n"), "node").withColumn("popular", F.count("*").over(W.partitionBy("node")))
    post = post.select("key", F.col("key").bitwiseAND(63).cast("int").alias("slot"), "node", "n", "popular")
    near = links(post, classes.select("node", "n", "sig"), classes.select(F.col("node").alias("id"), "text"), width, similarity, r).select("u", "v")
    other = node.select(F.col("src").alias("src2"), F.col("at").alias("at2"), F.col("n").alias("n2"), F.col("node").alias("v"))
    exact = link.join(node, ["src", "at", "n"]).join(other, ["src2", "at2", "n2"]).select(F.col("node").alias("u"), "v")
    label = components(near.unionByName(exact), "u", "v")

    again = F.row_number().over(W.partitionBy("th", "node").orderBy("start", "n")) > 1
    named = seen.withColumn("again", again).join(label, "node", "left").select("th", "start", "n", "again", F.coalesce("component", "node").alias("cluster"))
    named = staged(named.join(docs_of, "th"))
    count = named.groupBy("cluster", "doc_id").agg(F.lit(1)).groupBy("cluster").agg(F.count("*").alias("n_docs"), F.count("doc_id").alias("_ids"), F.min("doc_id").alias("_least")).where("n_docs > 1")
    keeps = staged(count.select("cluster", "n_docs", F.when(F.col("_ids") == F.col("n_docs"), F.col("_least")).alias("cluster_id")))
    out = named.join(keeps, "cluster")
    return out.select("doc_id", "th", "start", F.col("n").alias("n_words"), "cluster", "cluster_id", "n_docs", (~F.col("doc_id").eqNullSafe(F.col("cluster_id")) | F.col("again")).alias("removed"))
