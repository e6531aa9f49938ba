"""Shared pieces: reading tables, durable stages, and byte-level word kernels.

Word kernels work on UTF-8 bytes.  Words are maximal runs of bytes that are not
separators; every separator used here is ASCII, so no multi-byte character is cut.
Words are compared by 64-bit hashes of their whole bytes.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SPACES = " \t\n\x0b\x0c\r"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is named and
    all of Spark is this one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="evidentia-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, and
    a lost executor costs nothing but the tasks that it ran.  Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = jpath
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``staged`` wrote, once all that was made from them is staged too."""
    for df in tables:
        df._staged.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(df._staged, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores put before it until ``df`` has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


ROWS_PER_BATCH = 256


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of ROWS_PER_BATCH rows at most from here on in
    this session, as Python holds several objects for each row.  Spark bounds batches in bytes as
    well (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB, one row at least)."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= ROWS_PER_BATCH:
        conf.set(key, str(ROWS_PER_BATCH))
    return df.mapInArrow(run, schema)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else.  ``lower`` has a fast path for ASCII strings and would
    change other letters too, so it serves only strings without any."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
FILTER_BITS = (2**25, 2**29)


def fits(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows and ``most`` bytes of strings and word arrays."""
    sizes = [F.octet_length(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"]
    sizes += [F.octet_length(F.array_join(F.col(f"`{c}`"), "")) + 8 * F.size(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "array<string>"]
    held = [F.coalesce(x.cast("long"), F.lit(0)) for x in sizes]
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(held, F.lit(0).cast("long"))), F.lit(0))).first()
    return rows <= limit and size <= most


def small(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is measured and ``fits``; beyond it the join that it is
    for shuffles."""
    return F.broadcast(df) if fits(df, limit, most) else df


def maybe_in(rows: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in ``ids`` (column ``id``), and few others: a filter before a
    shuffle.  What is broadcast is a bitmap of 32 bits or more for each of ``ids``, within the
    bounds of FILTER_BITS (4 to 64 MB); beyond some 16 million ids more than 3 % of the others pass."""
    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (32 * ids.count()).bit_length()))
    spot = lambda x: F.pmod(F.xxhash64(x), F.lit(size))
    bits = ids.select(spot(F.col("id")).alias("s")).groupBy(F.expr("s div 32768").alias("_w")).agg(F.expr("bitmap_construct_agg(s % 32768)").alias("_b"))
    # longs can be read in place, where a binary value would be copied for each row
    bits = bits.select("_w", F.expr("transform(sequence(1, 4089, 8), i -> cast(conv(hex(substring(_b, i, 8)), 16, -10) as bigint))").alias("_bits"))
    names = rows.columns
    found = rows.withColumn("_s", spot(key)).withColumn("_w", F.expr("_s div 32768")).join(F.broadcast(bits), "_w")
    word = F.expr("get(_bits, cast((_s % 32768) div 64 as int))")
    return found.where(F.call_function("shiftright", word, F.expr("cast((_s % 64) ^ 56 as int)")).bitwiseAND(F.lit(1)) == 1).select(*names)  # bytes stand in a long from its highest down


# --- hashed words -----------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
SEGMENT = 1 << 17  # what is made for its bytes stays in a core's cache
_POWERS: dict[str, np.ndarray] = {}


def separators(pattern_bytes: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(pattern_bytes, np.uint8)] = True
    return out


BLANKS = separators(SPACES.encode())
NON_WORD = np.array([x < 0x30 or 0x3A <= x <= 0x60 or 0x7B <= x <= 0x7F for x in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _POWERS or len(_POWERS[key]) < n:
        seq = np.full(max(n, 1 << 20), base, np.uint64)
        seq[0] = 1
        _POWERS[key] = np.cumprod(seq, dtype=np.uint64)
    return _POWERS[key]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _hash_segment(buf: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of one buffer and the places where they start."""
    inside = np.zeros(len(buf) + 2, bool)
    np.logical_not(sep[buf], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(_P, len(buf))[: len(buf)], out=total[1:])
    return mix((total[end] - total[start]) * _powers(_PINV, len(buf))[start] + (end - start).astype(np.uint64)), start


def hashed_words(texts: list[bytes], sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after another, and n + 1 offsets of the texts in them.

    Short texts are hashed together; a text beyond SEGMENT bytes is cut at separators, so
    memory for the byte-wide arrays stays bounded whatever the length of a text.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            buf = np.frombuffer(b"\n".join(texts[i] for i in group), np.uint8)
            h, start = _hash_segment(buf, sep)
            lens = np.array([len(texts[i]) + 1 for i in group], np.int64)
            cut = np.searchsorted(start, np.cumsum(lens))
            counts[group] = np.diff(cut, prepend=0)
            hashes.append(h)
        group, size = [], 0

    for i, text in enumerate(texts):
        if len(text) > SEGMENT:
            flush()
            buf = np.frombuffer(text, np.uint8)
            at = 0
            while at < len(buf):
                to = min(len(buf), at + SEGMENT)
                while to < len(buf) and not sep[buf[to]]:
                    to += 1
                h, _ = _hash_segment(buf[at:to], sep)
                hashes.append(h)
                counts[i] += len(h)
                at = to
        else:
            if size + len(text) > SEGMENT:
                flush()
            group.append(i)
            size += len(text) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(counts)))


_STEP = [np.uint64(x) for x in _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)]


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of each window of ``width`` consecutive words; with fewer words, of all of them."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix(np.array([sum(int(w) * int(_STEP[k]) for k, w in enumerate(words)) + 77 * n & (2**64 - 1)], np.uint64))
    total = words[: n - width + 1] * _STEP[0]
    for k in range(1, width):
        total = total + words[k : n - width + 1 + k] * _STEP[k]
    return mix(total)


def ordered_parts(part: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
    """``np.lexsort((s, part))`` for parts below ``n``, but for the order of equal values: by one sort of
    keys that hold the part and the highest bits of ``s``, which is an order of magnitude faster."""
    bits = np.uint64(max(1, (n - 1).bit_length()))
    key = (part.astype(np.uint64) << (np.uint64(64) - bits)) | (s >> bits)
    order = np.argsort(key)
    key, held = key[order], s[order]
    if ((key[1:] == key[:-1]) & (held[1:] < held[:-1])).any():  # values that differ in their lowest bits only
        return np.lexsort((s, part))
    return order


def encode(values: list) -> list[bytes]:
    return [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in values]


def text_groups(sizes: list[int], limit: int = 4 << 20):
    """Ranges of rows of about ``limit`` bytes of text together, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def slots(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``slot``: a gapless number from 0 within each ``group``, without one task per group.

    Rows are dealt to ranges of (group, order) and sorted in them, so a group of any size
    spreads over many tasks; a row's number in its range and the sizes of the ranges before
    give its place in all, and a group's least place is its slot 0.  Groups must be few (shards,
    token lengths): their least places go to every task.
    """
    by = [F.col(c) for c in (group, *order)]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    kept = staged(ranged.withColumn("_p", F.shiftright("_id", 33)).withColumn("_k", F.col("_id").bitwiseAND(2**33 - 1)).drop("_id"))
    sizes = kept.groupBy("_p", group).agg(F.count("*").alias("_n"), F.min("_k").alias("_from"))
    upto = W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select(F.col("_p").alias("_q"), F.col(group).alias("_g"), (F.coalesce(F.sum("_n").over(upto), F.lit(0)) - F.col("_from")).alias("_shift"))
    return kept.join(first, (F.col("_p") == F.col("_q")) & (F.col(group) == F.col("_g"))).withColumn("slot", (F.col("_k") + F.col("_shift")).cast("long")).drop("_p", "_k", "_q", "_g", "_shift")
