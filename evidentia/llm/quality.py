"""Quality rules as a short-circuit cascade.

Each rule has a cost and a rejection rate, both estimated on a bounded sample (the first SAMPLE
rows of SAMPLE_TEXT bytes or fewer, some 25 MB at most); rules then run in order of rejection per
cost, each one only on documents that no earlier rule rejected.  A document's verdict is the
conjunction of all rules, so it does not depend on the order that was estimated, which is a
measurement; the time does, and so does which of several rules is named in ``rejected_by``.  Give
``order`` to have the same name in every run.

Words are maximal runs of non-blank characters (blank: space, tab to carriage return).
Defined cases: a null or empty text has no words and is rejected by the length rule; very
long texts are hashed in bounded segments; repeated rows are judged alike; an empty table
gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, SPACES, encode, hashed_words, mapped, shingles, text_groups

SAMPLE = 1500
SAMPLE_TEXT = 16384
SYMBOLS = b"#*$%&|<>"
DROP_BLANKS = SPACES.encode()
NOT_SYMBOL = bytes(x for x in range(256) if x not in SYMBOLS)
NOT_UPPER = bytes(x for x in range(256) if not 65 <= x <= 90)
NOT_LETTER = bytes(x for x in range(256) if not (65 <= x <= 90 or 97 <= x <= 122))


@dataclass
class Doc:
    """A text with the features that have been asked for so far."""

    text: bytes
    words: np.ndarray
    known: dict[str, int] = field(default_factory=dict)

    def get(self, name: str) -> int:
        if name not in self.known:
            self.known[name] = FEATURES[name](self)
        return self.known[name]


def word_chars(d: Doc) -> int:
    rest = d.text.translate(None, DROP_BLANKS)
    return len(rest) if rest.isascii() else len(rest.decode("utf-8", "surrogatepass"))


def dup_lines(d: Doc) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in d.text.split(b"\n") if x.strip(DROP_BLANKS)]
    return len(lines) - len(set(lines))


def repeat_words(d: Doc, width: int = 5) -> int:
    """Words inside windows of ``width`` words that are found twice or more."""
    n = len(d.words)
    if n <= width:
        return 0
    s = shingles(d.words, width)
    order = np.sort(s)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
    at = np.minimum(np.searchsorted(twice, s), len(twice) - 1)
    edge = np.zeros(n + 1, np.int64)
    hit = np.flatnonzero(twice[at] == s)
    edge[: n - width + 1][hit] += 1
    edge[width:][hit] -= 1
    return int((np.cumsum(edge[:n]) > 0).sum())


FEATURES: dict[str, Callable[[Doc], int]] = {
    "n_words": lambda d: len(d.words),
    "word_chars": word_chars,
    "n_symbols": lambda d: len(d.text.translate(None, NOT_SYMBOL)),
    "n_dup_lines": dup_lines,
    "n_repeat_words": repeat_words,
    "n_stutter": lambda d: int((d.words[1:] == d.words[:-1]).sum()),
    "n_lines": lambda d: sum(1 for x in d.text.split(b"\n") if x.strip(DROP_BLANKS)),
    "n_upper": lambda d: len(d.text.translate(None, NOT_UPPER)),
    "n_letters": lambda d: len(d.text.translate(None, NOT_LETTER)),
}


#: True rejects.
RULES: dict[str, Callable[[Doc], bool]] = {
    "few_words": lambda d: d.get("n_words") < 10,
    "repeated_words": lambda d: 100 * d.get("n_repeat_words") > 20 * d.get("n_words"),
    "symbols": lambda d: 10 * d.get("n_symbols") > 3 * d.get("n_words"),
    "shouting": lambda d: 2 * d.get("n_upper") > d.get("n_letters") and d.get("n_letters") >= 20,
    "duplicate_lines": lambda d: 2 * d.get("n_dup_lines") > d.get("n_lines"),
    "stutter": lambda d: 10 * d.get("n_stutter") > 3 * d.get("n_words"),
    "word_length": lambda d: not 2 * d.get("n_words") <= d.get("word_chars") <= 15 * d.get("n_words"),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _docs(texts: list) -> Iterator[Doc]:
    raw = encode(texts)
    for a, b in text_groups([len(x) for x in raw]):
        words, cut = hashed_words(raw[a:b], BLANKS)
        for i in range(a, b):
            yield Doc(raw[i], words[cut[i - a] : cut[i - a + 1]])


def rule_order(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[str]:
    """Rules by rejection per cost on a sample of at most ``sample`` rows, none beyond
    SAMPLE_TEXT bytes."""
    body = F.col(f"`{text}`")
    rows = docs.where(body.isNull() | (F.octet_length(body) <= SAMPLE_TEXT)).select(body.alias("t")).limit(sample).toPandas()["t"].tolist()
    got = list(_docs([x if isinstance(x, str) else None for x in rows]))
    score = {}
    for name, rule in RULES.items():
        began = time.perf_counter()
        rejected = sum(rule(Doc(d.text, d.words)) for d in got)
        cost = (time.perf_counter() - began) / max(1, len(got)) + 1e-9
        score[name] = (rejected + 0.5) / (len(got) + 1) / cost
    return sorted(RULES, key=lambda r: (-score[r], r))


def verdict(d: Doc, order: list[str]) -> str | None:
    """The first rule in ``order`` that rejects."""
    return next((r for r in order if RULES[r](d)), None)


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, the base features, base_failed, kept, rejected_by (null if kept; the first
    rule in ``order`` that rejects)."""
    order = order or rule_order(docs, text)
    out = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in BASE], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for i, d in zip(batch.column(0).to_pylist(), _docs(batch.column(1).to_pylist()), strict=True):
                by = verdict(d, order)
                base = [d.get(c) for c in BASE]
                failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
                rows.append((i, *base, failed, by is None and not failed, by))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out) if rows else pa.RecordBatch.from_arrays([pa.array([], t) for t in out.types], schema=out)

    return mapped(docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")), run, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, rejected_by string")


def filtered(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    order = order or rule_order(docs, text)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            keep = [verdict(d, order) is None for d in _docs(batch.column(at).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)
