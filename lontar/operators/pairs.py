"""Pairs of words within a window, counted and scored over a whole corpus.

Words are numbered by frequency, the numbers with their counts are broadcast (16 bytes a word; the words themselves stay
where they are), and texts are stored as numbers. A task counts the pairs of a million words at a time; what it has of each bucket of pairs goes as one row of packed
columns to the task that sums the bucket. Buckets are as many as the pairs need, and are worked off in SLICES passes over
the numbered texts, so that disk holds the shuffle of one pass only.

Beyond MOST different words the callers keep to joins on the words themselves.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

#: Words that may be broadcast; passes over the texts; pairs of a bucket, at least so many buckets a pass; words counted at once.
MOST, SLICES, BUCKET, LEAST, BLOCK = 24_000_000, 4, 4_000_000, 32, 1_000_000
#: Up to so many words a pair's key and a text's place are sorted as one number of 64 bits.
NARROW = 1 << 22
#: Pairs of the TOP most frequent words are counted in each task and never shuffled by document.
TOP = 1024
U = np.uint64


class Numbered(NamedTuple):
    #: (id, key..., words: packed numbers), and (t, n, c): word, number from 0, occurrences
    texts: DataFrame
    words: DataFrame
    total: int
    #: broadcast: hashes of the words, sorted, and their numbers; counts by number
    told: object


def _hashes(words: pa.Array) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), U, len(words))


def _encoded(lists: pa.ListArray):
    """(ends of the lists, distinct words, each word's place among them)."""
    d = lists.flatten().dictionary_encode()
    return np.asarray(lists.value_lengths().fill_null(0)).cumsum(), d.dictionary, np.asarray(d.indices)


def numbered(df: DataFrame, words: str = "ids", key: tuple = ()) -> Numbered | None:
    """The texts of df (key..., words: array<string> without nulls) in numbers; None where there are more than MOST words."""
    def counted(batches):
        for b in batches:
            _, w, at = _encoded(b.column(0))
            yield pa.RecordBatch.from_arrays([w, pa.array(np.bincount(at, minlength=len(w)).astype(np.int64))], ["t", "c"])

    counts = stored(df.select(words).mapInArrow(counted, "t string, c long").groupBy("t").agg(F.sum("c").alias("c")))
    if counts.count() > MOST:
        return None

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(b.column("t")).view(np.int64)), b.column("c")], ["h", "c"])

    t = counts.mapInArrow(hashed, "h long, c long").toArrow()  # 16 bytes a word, MOST words at most
    h, c = t.column("h").to_numpy().view(U), t.column("c").to_numpy()
    total = int(c.sum())
    if not len(c) or c.max() < 1 << 32:
        c = c.astype(np.uint32)
    order = np.argsort(h)
    order = order[np.argsort(-c[order].astype(np.int64), kind="stable")]
    h = h[order]
    by_hash = np.argsort(h)
    spark = df.sparkSession
    told = spark.sparkContext.broadcast((h[by_hash], by_hash.astype(np.int32), c[order]))
    fields = [f for f in df.select(*key).schema.fields] if key else []

    def run(batches):
        hashes, number, _ = told.value
        for b in batches:
            ends, w, at = _encoded(b.column("_w"))
            n = number[np.searchsorted(hashes, _hashes(w))][at] if len(w) else np.zeros(0, np.int32)
            packed = pa.array([x.tobytes() for x in np.split(n, ends[:-1])] if len(ends) else [], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(k) for k in ("id", *key)] + [packed], ["id", *key, "words"])

    schema = ", ".join(["id long", *[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "words binary"])
    texts = stored(df.select(F.monotonically_increasing_id().alias("id"), *key, F.col(words).alias("_w")).mapInArrow(run, schema))

    def rows(batches):
        hashes, number, _ = told.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("t"), pa.array(number[np.searchsorted(hashes, _hashes(b.column("t")))], pa.int32()), b.column("c")], ["t", "n", "c"])

    return Numbered(texts, counts.mapInArrow(rows, "t string, n int, c long"), total, told)


def _blocks(batches, window: int, base: int, block: int):
    """(ids, rows, keys, distances) of the pairs of different words within the window, some `block` words' at a time: ids of
    the texts, and each pair's place among them, its key and how far apart its words are."""
    for b in batches:
        lists = [np.frombuffer(x, np.int32) for x in b.column("words").to_pylist()]
        some = np.array([len(x) for x in lists], np.int64)
        ids = b.column("id").to_numpy()[some > 0]
        row = np.repeat(np.arange(len(ids)), some[some > 0])
        w = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
        for low in range(0, len(w), block):
            high, found = min(low + block, len(w)), []
            for k in range(1, window + 1):
                i = slice(low, max(low, min(high, len(w) - k)))
                x, y, r = w[i], w[i.start + k : i.stop + k], row[i]
                ok = (r == row[i.start + k : i.stop + k]) & (x != y)
                x, y, r = x[ok], y[ok], r[ok]
                found.append((r - row[low], np.minimum(x, y) * base + np.maximum(x, y), np.full(len(r), k, np.int8)))
            yield ids[row[low] : row[high - 1] + 1], *(np.concatenate(c) for c in zip(*found))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(U) * U(0x9E3779B97F4A7C15)
        h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return ((h >> U(20)) % U(buckets)).astype(np.int64)


def _packed(a: np.ndarray) -> bytes:
    """Numbers as bytes, plane by plane: shuffles pack the planes that are zero."""
    return np.ascontiguousarray(a.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(parts: list[bytes]) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view("<i8").ravel() for p in parts]


def _runs(*sorted_columns):
    """Where runs of equal rows begin."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


PACK = "bucket int, first long, keys binary, n binary, m binary, docs binary"


def _dealt(num: Numbered, window: int, near: int, ignored: int, part: int, buckets: int, by_text: bool) -> DataFrame:
    """Rows of PACK of a pass: by bucket the keys (as steps), how often within the window (n) and within `near` (m), and, by_text, whose."""
    base = len(num.told.value[2])

    def run(batches):
        per = buckets // SLICES
        for ids, row, keys, far in _blocks(batches, window, base, BLOCK):
            at = _bucket(keys, buckets)
            ok = (at >= part * per) & (at < (part + 1) * per)
            row, keys, far, at = row[ok], keys[ok], far[ok], at[ok] - part * per
            if by_text:
                ok = (keys >= TOP * base) | (keys % base >= TOP)
                row, keys, far, at = row[ok], keys[ok], far[ok], at[ok]
            if not len(keys):
                continue
            if by_text and base > NARROW:
                order = np.lexsort((row, keys))
            else:  # two words' numbers have 44 bits, a text's place 20
                order = np.argsort((keys.astype(U) << U(20)) | row.astype(U) if by_text else keys)
            order = order[np.argsort(at[order].astype(np.uint16) if per < 1 << 16 else at[order], kind="stable")]
            row, keys, far, at = row[order], keys[order], far[order], at[order]
            begin = _runs(keys, row) if by_text else _runs(keys)
            n = np.diff(np.r_[begin, len(keys)])
            close = far <= near
            if ignored >= 0:
                close &= (keys // base != ignored) & (keys % base != ignored)
            m = np.add.reduceat(close.astype(np.int64), begin)
            keys, at, docs, first = keys[begin], at[begin], ids[row[begin]], int(ids.min())
            cuts = np.r_[_runs(at), len(at)]
            out = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                out.append((int(at[lo]) + part * per, first, _packed(np.diff(keys[lo:hi], prepend=0)), _packed(n[lo:hi]), _packed(m[lo:hi]), _packed(docs[lo:hi] - first) if by_text else b""))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 4))], ["bucket", "first", "keys", "n", "m", "docs"])

    rows = num.texts.select("id", "words").mapInArrow(run, PACK)
    return rows.repartition(buckets // SLICES, "bucket").sortWithinPartitions("bucket")


def _each(batches):
    """Columns of each bucket; the rows come sorted by it."""
    held, now = [], None
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != now and held:
                yield held
                held = []
            now = r["bucket"]
            held.append(r)
    if held:
        yield held


def _scored(keys, n, told, total: int, least: int):
    """PMI of sorted keys with their counts; 0 where a pair is too rare or has none above 0."""
    c, t, base = told[2], float(total), len(told[2])
    v = np.log(n / t / (c[keys // base] / t * (c[keys % base] / t) + 1e-9) + 1e-9)
    return np.where((n >= least) & (v > 0), v, 0.0)


def _summed(keys, *counts):
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = _runs(keys)
    return keys[begin], [np.add.reduceat(c[order], begin) for c in counts]


def _buckets(num: Numbered, window: int) -> int:
    return SLICES * max(LEAST, -(-num.total * window // (SLICES * BUCKET)))


def scored(num: Numbered, window: int = 4, least: int = 2, near: int = 3, ignored: str | None = None) -> DataFrame:
    """(x, y, n, m, pmi): numbers of the pairs with positive PMI, occurrences within the window, and within `near` without pairs of the word ignored."""
    told, total, buckets = num.told, num.total, _buckets(num, window)
    skip = _number(num, ignored)

    def run(batches):
        base = len(told.value[2])
        for rows in _each(batches):
            keys = np.concatenate([x.cumsum() for x in _unpacked([r["keys"] for r in rows])])
            keys, (n, m) = _summed(keys, *[np.concatenate(_unpacked([r[k] for r in rows])) for k in ("n", "m")])
            v = _scored(keys, n, told.value, total, least)
            ok = v > 0
            keys = keys[ok]
            yield pa.RecordBatch.from_arrays([pa.array((keys // base).astype(np.int32)), pa.array((keys % base).astype(np.int32)), pa.array(n[ok]), pa.array(m[ok]), pa.array(v[ok])], ["x", "y", "n", "m", "pmi"])

    out = None
    for part in range(SLICES):
        s = stored(_dealt(num, window, near, skip, part, buckets, False).mapInArrow(run, "x int, y int, n long, m long, pmi double"))
        out = s if out is None else out.unionByName(s)
    return out


def _number(num: Numbered, word: str | None) -> int:
    if word is None:
        return -1
    hashes, number, _ = num.told.value
    h = _hashes(pa.array([word]))[0]
    i = int(np.searchsorted(hashes, h))
    return int(number[i]) if i < len(hashes) and hashes[i] == h else -1


def by_text(num: Numbered, window: int = 4, least: int = 2, near: int = 3) -> DataFrame:
    """(id, s, n): of each text with known pairs within `near` the sum of their PMI and how many they are; PMI is of the same texts."""
    told, total, buckets = num.told, num.total, _buckets(num, window)
    spark = num.texts.sparkSession
    base = len(told.value[2])
    top = min(TOP, base)

    def often(batches):
        n = np.zeros(top * top, np.int64)
        for _, _, keys, _ in _blocks(batches, window, base, BLOCK):
            keys = keys[keys < top * base]
            x, y = keys // base, keys % base
            ok = y < top
            n += np.bincount(x[ok] * top + y[ok], minlength=top * top)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["k", "n"])

    texts = num.texts.select("id", "words")
    t = texts.mapInArrow(often, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # TOP * TOP / 2 rows at most
    k, n = t.column("k").to_numpy(), t.column("n").to_numpy()
    value = np.zeros(top * top)
    value[k] = _scored(k // max(top, 1) * base + k % max(top, 1), n, told.value, total, least)
    value = spark.sparkContext.broadcast(value)

    def sums(ids, v, m):
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        begin = _runs(ids)
        both = [np.add.reduceat(c[order], begin) if len(begin) else c for c in (v * m, m)]
        return pa.RecordBatch.from_arrays([pa.array(ids[begin], pa.int64()), pa.array(both[0], pa.float64()), pa.array(both[1], pa.int64())], ["id", "s", "n"])

    def known_often(batches):
        for ids, row, keys, _ in _blocks(batches, near, base, BLOCK):
            row, keys = row[keys < top * base], keys[keys < top * base]
            x, y = keys // base, keys % base
            v = np.where(y < top, value.value[x * top + np.minimum(y, top - 1)], 0.0)
            yield sums(ids[row[v > 0]], v[v > 0], np.ones(np.count_nonzero(v > 0), np.int64))

    def run(batches):
        for rows in _each(batches):
            keys = np.concatenate([x.cumsum() for x in _unpacked([r["keys"] for r in rows])])
            n, m = (np.concatenate(_unpacked([r[c] for r in rows])) for c in ("n", "m"))
            ids = np.concatenate([x + r["first"] for x, r in zip(_unpacked([r["docs"] for r in rows]), rows)])
            order = np.argsort(keys, kind="stable")
            keys, n, m, ids = keys[order], n[order], m[order], ids[order]
            begin = _runs(keys)
            v = _scored(keys[begin], np.add.reduceat(n, begin), told.value, total, least)
            v = np.repeat(v, np.diff(np.r_[begin, len(keys)]))
            ok = (v > 0) & (m > 0)
            yield sums(ids[ok], v[ok], m[ok])

    kind = "id long, s double, n long"
    out = stored(texts.mapInArrow(known_often, kind))
    add = lambda df: df.groupBy("id").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    for part in range(SLICES):
        out = out.unionByName(stored(add(_dealt(num, window, near, -1, part, buckets, True).mapInArrow(run, kind))))
    return add(out)
