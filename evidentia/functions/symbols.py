"""Symbols of Arrow columns of strings, laid one after another, for work on whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in one array, and the length of each row; a null has none."""
    rows = texts.fill_null("").to_pylist()
    length = np.fromiter(map(len, rows), np.int64, len(rows))
    text = "".join(rows)
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8), length
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), length


def among(code: np.ndarray, letters: str) -> np.ndarray:
    """Whether each code point is one of a few letters."""
    if code.dtype != np.uint8:
        return np.isin(code, [ord(x) for x in letters])
    known = np.zeros(256, bool)
    known[[ord(x) for x in letters]] = True
    return known[code]


def places(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row starts, and for each symbol its row and its place in it."""
    start = np.cumsum(length) - length
    row = np.repeat(np.arange(len(length)), length)
    return start, row, np.arange(len(row)) - start[row]


def strings(code: np.ndarray, length: np.ndarray, null: np.ndarray) -> pa.Array:
    """The column of strings whose symbols are ``code``."""
    ends = np.concatenate(([0], np.cumsum(length)))
    if code.dtype == np.uint8 and (code < 128).all():
        out = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(code))])
        return pc.if_else(pa.array(~null), out, None)
    text = code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([None if no else text[a:b] for a, b, no in zip(ends[:-1].tolist(), ends[1:].tolist(), null.tolist(), strict=True)], pa.string())
