"""Word boundaries and 64-bit word hashes of many texts at once, by whole-buffer array operations.

A text's words are the maximal runs of bytes other than 0x20 and 0x09-0x0D. The hash of a word is a sum of table
entries, one for each (place in the word, byte), mixed with its length; the table follows from a fixed rule, so
hashes agree on all workers and in all runs.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes handled by one array pass.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def kept(name: str, make):
    """A value that a worker process makes once.

    A worker forgets the modules it has imported when a task ends, and with them all that they hold; what is to outlast a
    task is kept by the interpreter's own module.
    """
    store = sys.__dict__.setdefault("_lontar_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


def _tables():
    table = mix((np.arange(1, 64 * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15)))
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return table, space, lower


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column, end to end, and n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    big = pa.types.is_large_string(texts.type)
    n = len(texts)
    offs = np.frombuffer(texts.buffers()[1], np.int64 if big else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(texts, most: int = CHUNK):
    """(lo, hi, bytes, offsets) of runs of whole texts of about `most` bytes; a longer text is alone."""
    raw, offs = buffers(texts)
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(raw: np.ndarray, offs: np.ndarray, lower: bool = False):
    """(hash, start, end, first): hash and byte range of each word; text i has words first[i]:first[i + 1]."""
    table, space, low = kept("word tables", _tables)
    if lower:
        raw = low[raw]
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, np.zeros(len(offs), np.int64)
    ink = ~space[raw]
    st, en = ink.copy(), ink.copy()
    st[1:] &= ~ink[:-1]
    en[:-1] &= ~ink[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    st[edge] = ink[edge]
    en[edge - 1] = ink[edge - 1]
    start, end = np.flatnonzero(st), np.flatnonzero(en) + 1
    first = np.searchsorted(start, offs)
    if not len(start):
        return np.zeros(0, U), start, end, first
    lens = end - start
    at = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=at[1:])
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    part = table[((place & 63) << 8) | raw[ink]]
    far = np.flatnonzero(place >= 64)
    if len(far):
        part[far] = mix(part[far] + (place[far] >> 6).astype(U) * U(0xD1342543DE82EF95))
    h = np.add.reduceat(part, at)
    return mix(h ^ (lens.astype(U) * U(0xA24BAED4963EE407))), start, end, first


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by place of the first; runs over texts' ends (mask with `inside`)."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, U)
    g = np.zeros(m, U)
    odd = 0x9E3779B97F4A7C15
    for j in range(k):
        g = g * U(0xF1357AEA2E62A9C5) + h[j : j + m]
    return mix(g + U(odd))


def left(first: np.ndarray) -> np.ndarray:
    """For each word, the number of words from it to its text's end, itself included."""
    n = np.diff(first)
    return np.repeat(first[1:], n) - np.arange(first[-1])


def slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w consecutive entries (np.minimum or np.maximum), by place of the first."""
    if len(a) < w:
        return a[:0]
    size, out = 1, a
    while size * 2 <= w:
        out = op(out[:-size], out[size:])
        size *= 2
    if size < w:
        out = op(out[: len(a) - w + 1], out[w - size : w - size + len(a) - w + 1])
    return out


def anchors(g: np.ndarray, starts_ok: np.ndarray, w: int) -> np.ndarray:
    """Places of g that are a least entry of some window of w entries; starts_ok marks the windows that count."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    low = np.where(starts_ok[: len(g) - w + 1], slide(g, w, np.minimum), U(0))
    pad = np.zeros(w - 1, U)
    top = slide(np.concatenate([pad, low, pad]), w, np.maximum)
    return np.flatnonzero((g == top) & (g > 0))
