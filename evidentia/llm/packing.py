"""Best-fit decreasing over token pieces.

Pieces of one length are interchangeable, so the whole plan follows from the histogram of
lengths, which has at most ``window`` rows whatever the corpus.  The driver runs best-fit
decreasing on it: lengths come longest first, and a segment tree indexed by remaining
capacity finds the tightest window that a piece fits in.  Windows are kept as runs with the
same remaining capacity; while a piece still fits in what is left, the same window remains
the tightest, so a window takes ``capacity // length`` pieces at once and a run is placed
in one step.  The result is the packing that placing pieces one by one would give.

Placements say: pieces of this length, from this rank on, go to windows from this number
on, so many in each, at this offset.  Ranks are gapless per length and are found without
one task per length (``slots``).

Defined cases: a null or empty text is one piece of the end id; a document of over
``window`` tokens is first cut into full windows; equal pieces are ranked by document, start
and CRC; repeated rows are pieces of their own; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, slots, staged
from .tokens import pieces


class TightestFit:
    """Segment tree over capacities 0..n with a count of runs in each leaf."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.full = [0] * (2 * self.size)

    def add(self, capacity: int, k: int) -> None:
        at = capacity + self.size
        while at:
            self.full[at] += k
            at >>= 1

    def at_least(self, need: int) -> int | None:
        """The least capacity of ``need`` or more that some run has."""
        at = need + self.size
        if self.full[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.full[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.full[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, first window number, pieces per window, offset)."""
    tree = TightestFit(window)
    runs: dict[int, list[tuple[int, int]]] = {}  # capacity -> (first window, how many)

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.at_least(length)
            if capacity is None:
                capacity, first, n = window, opened, -(-left // (window // length))
                opened += n
            else:
                first, n = runs[capacity].pop()
                tree.add(capacity, -1)
            each = capacity // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            out.append((length, rank, first, each, window - capacity))
            rank += full * each + rest
            left -= full * each + rest
            put(capacity - each * length, first, full)
            if rest:
                put(capacity - rest * length, first + full, 1)
            put(capacity, first + full + bool(rest), n - full - bool(rest))
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = staged(pieces(docs, doc_id, text, path, window, end_id))
    lengths = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    placed: dict[int, tuple[list[int], list[tuple[int, int, int]]]] = {}
    for length, rank, first, each, offset in plan(lengths, window):
        ranks, rows = placed.setdefault(length, ([], []))
        ranks.append(rank)
        rows.append((first, each, offset))
    ranked = slots(cut, "length", ["doc_id", "start", "ids_crc32", "doc_tokens"])
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = pa.schema([(c, pa.int64()) for c in names])

    def run(batches):
        for batch in batches:
            sequence, offsets = [], []
            for length, rank in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                ranks, rows = placed[length]
                i = bisect.bisect_right(ranks, rank) - 1
                first, each, offset = rows[i]
                k = rank - ranks[i]
                sequence.append(first + k // each)
                offsets.append(offset + k % each * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offsets, pa.int64())], schema=out)

    return mapped(ranked.select(*names[:5], "slot"), run, ", ".join(f"{c} long" for c in names))
