"""Main text of raw HTML by a recurrent block labeller.

A page is read into leaf blocks: runs of text between block-level tags, each with its tag
path (tag and the first eight words of each class, id and role of its eight nearest
ancestors: features of the classifier only, no text is cut).  A bidirectional LSTM in numpy reads
the blocks of a page in order, as a path vector (mean of hashed tag-path embeddings), a word
vector (mean of hashed word embeddings, all words of the block) and a few figures, and labels
every block as article or not with the whole page as context.  Blocks labelled article are
joined by one space.  Weights are in ``blocks.npz``; ``train_blocks`` makes them from
generated pages of many layouts.

Scripts, styles, comments in markup and other elements without readable text never become
blocks.  White space (as Unicode has it, character references decoded) becomes one space.

Defined cases: null or empty html, and pages without article blocks, give an empty text;
unclosed or stray tags are tolerated; an unterminated comment or script runs to the end of
the page; repeated rows are read each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, hashed_words, mapped, text_groups

BUCKETS = 512
PATH, WORD, HIDDEN = 16, 8, 16
NEAREST = 8
FIGURES = 8
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video head title select textarea".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
CLOSES = {k: frozenset(v.split()) for k, v in CLOSES.items()}
SCOPE = frozenset("ul ol dl table body".split())
TAG = re.compile(r"<!--|<([/!?]?)([a-zA-Z][^\s/>]*)?((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Za-z]+")


@lru_cache(maxsize=65536)
def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS


@lru_cache(maxsize=65536)
def element_tokens(tag: str, attrs: str) -> tuple[int, ...]:
    """Hashes of a tag and of the words of its class, id and role."""
    out = [bucket("<" + tag)]
    for m in ATTR.finditer(attrs):
        out += [bucket("." + x.lower()) for x in PART.findall(m[1] or m[2] or m[3] or "")[:8]]
    return tuple(dict.fromkeys(out))


def leaf_blocks(page: str) -> list[tuple[str, tuple[tuple[int, ...], ...], int]]:
    """(text, hashed path, characters inside links) of each block, in page order."""
    out: list = []
    stack: list[tuple[str, tuple[int, ...]]] = []
    text: list[str] = []
    linked = in_link = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal text, linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append((joined, tuple(x[1] for x in stack[-NEAREST:]), linked))
            text, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            shown = html.unescape(raw) if "&" in raw else raw
            text.append(shown)
            if in_link:
                linked += len(shown)

    while at < n:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        if m[0] == "<!--":
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        at = m.end()
        if m[1] in ("!", "?") or not m[2]:
            continue
        tag = m[2].lower()
        if m[1] == "/":
            if tag == "a":
                in_link = 0
            if tag in INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in INLINE:
            in_link = 1 if tag == "a" else in_link
            continue
        if tag in SILENT and not m[3].endswith("/"):
            if tag in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "select", "svg", "math", "canvas", "object", "audio", "video"):
                flush()
                close = _closer(tag).search(page, at)
                at = n if not close else close.end()
                continue
            if tag == "head":
                continue
        flush()
        if tag in VOID:
            continue
        if tag in ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPE:
                    break
        in_link = 0
        stack.append((tag, element_tokens(tag, m[3])))
    flush()
    return out


@lru_cache
def _closer(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def features(pages: list[list]) -> dict:
    """Flat arrays for the blocks of several pages."""
    blocks = [b for p in pages for b in p]
    path, path_at = [], [0]
    weight = []
    for _, ancestors, _ in blocks:
        for depth, tokens in enumerate(reversed(ancestors)):
            path += tokens
            weight += [1.0 / (1 + 0.25 * depth)] * len(tokens)
        if not ancestors:
            path.append(0)
            weight.append(0.0)
        path_at.append(len(path))
    raw = [b[0].lower().encode("utf-8", "surrogatepass") for b in blocks]
    words, cut = hashed_words(raw, BLANKS)
    fig = np.zeros((len(blocks), FIGURES), np.float32)
    i = 0
    for p in pages:
        for k, (t, _, linked) in enumerate(p):
            m = len(t)
            fig[i] = (np.log1p(m) / 8, min(1.0, linked / m), (cut[i + 1] - cut[i]) / 100 if cut[i + 1] - cut[i] < 200 else 2, sum(map(t.count, ".!?")) / m * 20, sum(map(t.count, "|©»·")) / m * 20, k / len(p), 1.0 / (1 + k), 1.0 / (len(p) - k))
            i += 1
    return {"path": np.array(path, np.int64), "weight": np.array(weight, np.float32), "path_at": np.array(path_at), "word": (words % np.uint64(BUCKETS)).astype(np.int64), "word_at": cut, "fig": fig, "sizes": np.array([len(p) for p in pages])}


def _means(table: np.ndarray, index: np.ndarray, at: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Mean row of ``table`` for each group of indices, and the weight of each index in it."""
    n = np.diff(at)
    w = np.ones(len(index), np.float32) if weight is None else weight
    group = np.repeat(np.arange(len(n)), n)
    total = np.bincount(group, w, len(n)).astype(np.float32)
    share = w / np.maximum(total, 1e-6)[group]
    out = np.zeros((len(n), table.shape[1]), np.float32)
    rows = table[index] * share[:, None]
    full = n > 0
    if full.any():
        out[full] = np.add.reduceat(rows, at[:-1][full], axis=0)
    return out, share


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x: np.ndarray, W: np.ndarray, U: np.ndarray, b: np.ndarray, keep: bool = False):
    """x (time, page, d) -> h (time, page, HIDDEN), and what a backward pass needs."""
    T, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    z0 = x @ W + b
    hs = np.empty((T, n, HIDDEN), np.float32)
    saved = []
    for t in range(T):
        z = z0[t] + h @ U
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before = (h, c)
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[t] = h
        if keep:
            saved.append((i, f, o, g, tc, *before))
    return hs, saved


def vectors(f: dict, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p, ps = _means(m["path"], f["path"], f["path_at"], f["weight"])
    w, ws = _means(m["word"], f["word"], f["word_at"])
    return np.concatenate([p, w, f["fig"]], axis=1), ps, ws


def layout(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, page) places of the flat blocks, padded with -1; forwards and backwards."""
    T, first = int(sizes.max()), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    t = np.arange(T)[:, None]
    inside = t < sizes
    return np.where(inside, first + t, -1), np.where(inside, first + sizes - 1 - t, -1)


def scores(f: dict, m: dict) -> np.ndarray:
    """Logit of each block of being article text."""
    x, _, _ = vectors(f, m)
    out = np.zeros(len(x), np.float32)
    sizes = f["sizes"]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * sizes[order[stop]] <= 40_000:
            stop += 1
        some = order[start:stop]
        ahead, back = layout(sizes[some])
        shift = first[some] - np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        parts = {}
        for name, place in (("f", ahead), ("b", back)):
            flat = np.where(place < 0, 0, place + shift)
            hs, _ = lstm(x[flat] * (place >= 0)[:, :, None], m["W" + name], m["U" + name], m["b" + name])
            parts[name] = (flat[place >= 0], hs[place >= 0])
        for name, (flat, hs) in parts.items():
            out[flat] += hs @ m["v" + name]
        start = stop
    return out + x @ m["skip"] + m["bias"]


@lru_cache
def model() -> dict:
    with np.load(os.path.join(os.path.dirname(__file__), "blocks.npz")) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def main_texts(pages: list[str | None], m: dict) -> list[str]:
    read = [leaf_blocks(p) if p else [] for p in pages]
    f = features(read)
    if not len(f["fig"]):
        return [""] * len(pages)
    keep = scores(f, m) > 0
    out, i = [], 0
    for p in read:
        out.append(" ".join(b[0] for k, b in enumerate(p) if keep[i + k]))
        i += len(p)
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    weights = model()
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            texts = []
            for a, b in text_groups([len(x or "") for x in raw], 1 << 20):
                texts += main_texts(raw[a:b], weights)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=out)

    return mapped(pages.select(F.col(f"`{page_id}`").cast("long"), F.col(f"`{url}`"), F.col(f"`{source}`")), run, "page_id long, url string, text string, n_chars long")
