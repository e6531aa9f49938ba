"""Filter interaction audit over a packed bitmap index.

One pass over the texts gives each document four failure bits and the digest of its text; the
fifth filter (a copy of a text with a smaller id) comes from the least id of each digest, two thin
joins bring it and the labels in.  ``bitmap_index`` then packs every partition: rows are
sorted by part, each part starts at a byte, and filters and labels are NumPy bitsets over them.
``prefix_counts`` takes AND-NOT and popcount for each of the 32 subsets of filters that can be a
prefix of an order, summed by part; ``audit`` reads every order and step off those sums, so no
order costs a pass over the documents.

Filters (a set bit means that the document fails it), over words between the six ASCII blanks:

- A: under 100 words
- B: 100 * distinct words < 80 * words
- C: 100 * capitals A-Z > 10 * code points
- D: holds one of ``#$%&*|``
- E: identical to the text of a smaller doc_id, whatever became of that one

Defined cases: a null text is empty (fails A only, and E if a smaller id has none either); a null
language is the part ``''``; rows that repeat a doc_id are documents of their own and no
smaller than each other; a null doc_id neither fails E nor has labels; several label rows of
one id count as good or toxic if one of them says so; an empty table gives no rows; other
columns are ignored, whatever their names.  Words are counted as distinct by 52 bits or more of
their hashes (all 64 in a text of 1 MB or more).
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, encode, hashed_words, separators, staged, text_groups

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
SYMBOLS = separators(b"#$%&*|")
ROWS = 4096
HEAVY = 1000
_JUDGED = "doc_id long, part string, fails int, digest binary"
_INDEX = "parts array<string>, starts array<int>, n_rows array<int>, fails array<binary>, good binary, toxic binary"
_COUNTS = "part string, subset int, alive long, good long, toxic long"


def text_fails(texts: list[bytes]) -> np.ndarray:
    """Bits 0 to 3 (A to D) for each text."""
    hashes, cut = hashed_words(texts, BLANKS)
    n = np.diff(cut)
    bits = max(0, (len(texts) - 1).bit_length())
    key = hashes >> np.uint64(bits) if bits else hashes
    if bits:
        key = key | (np.repeat(np.arange(len(texts), dtype=np.uint64), n) << np.uint64(64 - bits))
        key.sort()
        fresh = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        distinct = np.bincount((key[fresh] >> np.uint64(64 - bits)).astype(np.int64), minlength=len(texts))
    else:
        distinct = np.array([len(np.unique(key))])
    at = np.cumsum([0, *map(len, texts)])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    per_text = lambda x: np.diff(np.concatenate(([0], np.cumsum(x, dtype=np.int64)))[at])
    capitals, points, symbols = per_text((buf >= 65) & (buf <= 90)), per_text((buf & 0xC0) != 0x80), per_text(SYMBOLS[buf])
    return (n < 100) * 1 + (100 * distinct < 80 * n) * 2 + (100 * capitals > 10 * points) * 4 + (symbols > 0) * 8


def _judge(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("fails", pa.int32()), ("digest", pa.binary())])
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            texts = encode(batch.column(1).to_pylist())
            for lo, hi in text_groups([len(t) for t in texts], 1 << 20):
                some = texts[lo:hi]
                digests = pa.array([hashlib.sha256(t).digest() for t in some], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(text_fails(some).astype(np.int32)), digests], schema=schema)


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """A row per document: doc_id, part, fails (five bits, A the lowest), good, toxic."""
    thin = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    own = staged(thin.mapInArrow(_judge, _JUDGED))
    copied = own.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1 and least is not null")
    said = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`quality`").eqNullSafe(1).alias("good"), F.col("`toxic`").eqNullSafe(1).alias("toxic"))
    said = said.where("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    # digests of more than a HEAVYth of the rows are fewer than HEAVY: their rows meet them by broadcast, in their tasks
    copied = staged(copied)
    heavy = F.broadcast(copied.where(F.col("n") * HEAVY > own.count()).select("digest", "least"))
    light = own.join(heavy, "digest", "left_anti").join(copied.select("digest", "least"), "digest", "left")
    rows = light.unionByName(own.join(heavy, "digest")).join(said, "doc_id", "left")
    copy = F.coalesce((F.col("doc_id") > F.col("least")).cast("int"), F.lit(0)) * 16
    no = F.lit(False)
    return rows.select("doc_id", "part", (F.col("fails") + copy).alias("fails"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def _pack(batches):
    kinds = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
    names = ["parts", "starts", "n_rows", "fails", "good", "toxic"]
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        sizes = np.bincount(code, minlength=len(coded.dictionary))
        starts = np.concatenate(([0], np.cumsum(-(-sizes // 8))))  # in bytes
        place = np.empty(len(code), np.int64)  # a row's bit
        place[order] = np.repeat(starts[:-1] * 8 - np.cumsum(sizes) + sizes, sizes) + np.arange(len(code))

        def bitset(flags: np.ndarray, place=place, size=int(starts[-1])) -> bytes:
            bits = np.zeros(size * 8, bool)
            bits[place[flags]] = True
            return np.packbits(bits).tobytes()

        fails, good, toxic = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        held = [bitset((fails >> i & 1).astype(bool)) for i in range(len(FILTERS))]
        row = [coded.dictionary.to_pylist(), starts[:-1].tolist(), sizes.tolist(), held, bitset(good.astype(bool)), bitset(toxic.astype(bool))]
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)


def bitmap_index(rows: DataFrame) -> DataFrame:
    """``rows`` (part, fails, good, toxic) as packed bitsets: a row per Arrow batch of a partition, with
    its parts, the byte and number of rows of each, a bitset per filter and the two of the labels."""
    return rows.select("part", "fails", "good", "toxic").mapInArrow(_pack, _INDEX)


def _count(batches):
    schema = pa.schema([("part", pa.string()), ("subset", pa.int32()), ("alive", pa.int64()), ("good", pa.int64()), ("toxic", pa.int64())])
    for batch in batches:
        for row in batch.to_pylist():
            fails, good, toxic = [np.frombuffer(x, np.uint8) for x in row["fails"]], np.frombuffer(row["good"], np.uint8), np.frombuffer(row["toxic"], np.uint8)
            starts, n = np.array(row["starts"]), np.array(row["n_rows"])
            real = np.full(len(good), 255, np.uint8)  # a part's last byte may have bits of no row
            real[np.append(starts[1:], len(good)) - 1] = (0xFF00 >> ((n - 1) % 8 + 1)) & 0xFF
            alive, sums = [real], []
            for s in range(1, SUBSETS):
                low = (s & -s).bit_length() - 1
                alive.append(alive[s & (s - 1)] & ~fails[low])
            for x in alive:
                sums.append([np.add.reduceat(np.bitwise_count(y).astype(np.int64), starts) for y in (x, x & good, x & toxic)])
            held = np.array(sums).transpose(1, 2, 0).reshape(3, -1)  # by part, then subset
            parts = pa.array(row["parts"], pa.string()).take(pa.array(np.repeat(np.arange(len(starts)), SUBSETS)))
            subsets = np.tile(np.arange(SUBSETS, dtype=np.int32), len(starts))
            yield pa.RecordBatch.from_arrays([parts, pa.array(subsets), *map(pa.array, held)], schema=schema)


def prefix_counts(index: DataFrame) -> DataFrame:
    """part, subset (bits of filters), alive, good, toxic: documents that fail no filter of the subset."""
    counted = index.mapInArrow(_count, _COUNTS)
    return counted.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("alive", "good", "toxic")])


def audit(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from 32 sums a part."""
    held = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "alive", "good", "toxic"))).alias("_c"))
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(FILTERS)])
    rows = held.select("part", "_c", F.explode(orders).alias("filter_order")).select("*", F.explode(F.expr(f"sequence(1, {len(FILTERS)})")).alias("step"))

    def bits(letters):
        return sum((F.when(F.instr(letters, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    prefix = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    rows = rows.withColumn("_s", bits(prefix)).withColumn("_f", bits(F.substring("filter_order", F.col("step"), F.lit(1)))).withColumn("_t", F.col("_s") + F.col("_f"))
    at = lambda s, what="alive": F.col("_c")[s][what]
    everything = SUBSETS - 1
    weight = F.array(*[F.lit(math.factorial(s.bit_count()) * math.factorial(max(0, len(FILTERS) - 1 - s.bit_count()))).cast("long") for s in range(SUBSETS)])
    others = F.filter(F.expr(f"sequence(0, {everything})"), lambda s: s.bitwiseAND(F.col("_f")) == 0)
    share = F.aggregate(others, F.lit(0).cast("long"), lambda acc, s: acc + weight[s] * (at(s) - at(s + F.col("_f"))))
    removed, failing = at(F.col("_s")) - at(F.col("_t")), at(F.lit(0)) - at(F.col("_f"))
    return rows.select(
        "part", "filter_order", "step",
        at(F.col("_t")).alias("kept"), removed.alias("removed"), (failing - removed).alias("redundant"),
        (at(F.lit(everything) - F.col("_f")) - at(F.lit(everything))).alias("unique_fails"),
        (at(F.col("_s"), "good") - at(F.col("_t"), "good")).alias("good_lost"), (at(F.col("_s"), "toxic") - at(F.col("_t"), "toxic")).alias("toxic_lost"),
        share.alias("shapley"),
    )


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(prefix_counts(bitmap_index(judged(docs, labels))))
