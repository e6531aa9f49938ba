"""Licence scan: one Aho-Corasick pass over normalised words, and licence expressions.

A text is lower-cased (A-Z), its words joined by single spaces; an automaton of notice
phrases and identifier tags, each with a space on both sides, finds every place where they
stand as whole words.  What follows ``SPDX-License-Identifier:`` in its line of the
raw text, however long, is parsed by a shunting-yard parser with ``with`` over ``and`` over ``or`` and brackets; the labels of an
expression are its identifiers, and its score tells whether the permissive branch of each
``or`` suffices.

Labels: four base labels of fixed phrases, and the method's own (further phrases, tags and
identifiers), prefixed ``spdx:`` where they come from an expression.  Score: 1 for a parsed
expression or two different notices, 0.75 for one notice, 0.5 for the method's phrases
alone, 0 without any.

Defined cases: null text is empty; no words gives zeros and nulls; a malformed expression
gives no label; repeated rows are scanned each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, mapped

#: Fixed by contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The method's own notices and tags, as normalised words.
OWN = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "licensed under the apache license": "apache",
    "apache 2 0": "apache",
    "gpl 2 0": "gpl",
    "gpl 3 0": "gpl",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
}
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "unlicense", "cc0-1.0", "zlib"}
SEPARATE = ASCII_LOWER.translate(bytes(32 if x < 0x30 or 0x3A <= x <= 0x40 or 0x5B <= x <= 0x60 or 0x7B <= x <= 0x7F else x for x in range(256)))
TAG = "spdx-license-identifier:"
LINE_END = re.compile(r"[\n\r]|\Z")
#: An identifier may name the document that defines it.
TOKEN = re.compile(r"\s*(\(|\)|(?:DocumentRef-[A-Za-z0-9.\-]+:)?[A-Za-z0-9][A-Za-z0-9.+\-]*)(:?)")
RANK = {"or": 1, "and": 2, "with": 3}
#: A text without these words in a row has no tag.
WORDS_OF_TAG = ("spdx license identifier",)


def parse_expression(text: str, at: int = 0, end: int | None = None):
    """Nested tuples (operator, left, right) or an identifier; None where it doesn't parse.
    Reading goes from ``at`` to ``end`` and stops at the first character that can't belong to an
    expression, or before a word with a colon, which is the next tag; an operator left open by it goes."""
    values: list = []
    stack: list[str] = []

    def reduce() -> bool:
        if len(values) < 2:
            return False
        right, left = values.pop(), values.pop()
        values.append((stack.pop(), left, right))
        return True

    value_next, end = True, len(text) if end is None else end
    while m := TOKEN.match(text, at, end):
        token, low = m[1], m[1].lower()
        if m[2] and token not in ("(", ")"):
            if value_next and stack and stack[-1] in RANK:
                stack.pop()
                value_next = False
            break
        if token == "(":
            if not value_next:
                break
            stack.append(token)
        elif token == ")":
            if value_next:
                return None
            while stack and stack[-1] != "(":
                if not reduce():
                    return None
            if not stack:
                break
            stack.pop()
        elif low in RANK:
            if value_next:
                return None
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[low]:
                if not reduce():
                    return None
            stack.append(low)
            value_next = True
            at = m.end()
            continue
        else:
            if not value_next:
                break
            values.append(low.rstrip("."))
            value_next = False
        at = m.end()
    while stack:
        if stack[-1] == "(" or not reduce():
            return None
    return values[0] if len(values) == 1 and not value_next else None


def identifiers(tree) -> list[str]:
    out, todo = [], [tree]
    while todo:  # no recursion: a list of thousands is a tree as deep
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            op, left, right = x
            todo += [left] if op == "with" else [right, left]
    return out


def permissive(tree) -> bool:
    """Whether the expression can be met by permissive licences alone."""
    values, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            values.append(x in PERMISSIVE)
        elif len(x) == 1:
            right, left = values.pop(), values.pop()
            values.append(left or right if x[0] == "or" else left and right)
        else:
            op, left, right = x
            todo += [left] if op == "with" else [(op,), right, left]
    return values[0]


@lru_cache
def automaton(of: str = "notices"):
    """Of notice phrases, over normalised words; or of tags, over text as it stands."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, name in [(TAG, TAG)] if of == "tags" else [(f" {x} ", x) for x in (*OWN, *BASE, *WORDS_OF_TAG)]:
        out.add_word(word, name)
    out.make_automaton()
    return out


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, permissive)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(SEPARATE).split()
    flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} " if words else ""
    starts, base, labels = [], set(), set()
    at = nth = 0
    tagged = False
    for end, phrase in automaton().iter(flat):
        if phrase in WORDS_OF_TAG:
            tagged = True
            continue
        if phrase in BASE:
            begin = end - len(phrase) - 1
            nth += flat.count(" ", at, begin) if begin >= at else -flat.count(" ", begin, at)
            at = begin
            starts.append(nth)
            base.add(BASE[phrase])
        labels.add(BASE.get(phrase) or OWN[phrase])
    free = None
    if tagged:
        end = -1
        raw = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).decode("utf-8", "surrogatepass")
        for last, _ in automaton("tags").iter(raw):
            if end <= last:
                end = LINE_END.search(text, last + 1).start()
            if (tree := parse_expression(text, last + 1, end)) is not None:
                labels.update(f"spdx:{x}" for x in identifiers(tree))
                free = permissive(tree) if free is None else free and permissive(tree)
    score = 1.0 if free is not None or len(base) > 1 else 0.75 if base else 0.5 if labels else 0.0
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, free


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_())]
    out = pa.schema(kinds)

    def run(batches):
        for batch in batches:
            rows = [(i, *scan(x)) for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for _, t in kinds], schema=out)

    return mapped(docs.select(F.col(f"`{doc_id}`").cast("long"), F.col(f"`{text}`")), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean")
