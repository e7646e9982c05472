"""Substring deduplication with FM-indexes.

A window is 20 consecutive words; every word is removed that a window covers whose words also start earlier (smaller
doc_id, or same document and earlier start). Words are runs of bytes other than 0x20 and 0x09-0x0D, unchanged.

1. Anchors: of each window of 13 consecutive 8-word grams the one with the least hash is kept, so each window of 20
   words holds an anchor, at the same place wherever the window stands. Anchors that occur once in the corpus cannot
   be part of a repeat; they are dropped by an exact count.
2. Segments: around each other anchor the 12 words before it and the 19 after its start hold all its windows. Equal
   segments are one, with its first place; only that one is cut from its text, and what the index finds for it goes to
   all its copies. Shards take all segments of an anchor, so a shard holds all texts of its windows, and shards grow in
   number, not in size, with the corpus.
3. Each shard gets a compressed FM-index: a suffix array of its segments by prefix doubling, its Burrows-Wheeler
   transform in a wavelet matrix of packed bits with rank blocks. Backward search runs all windows at once; the
   matching statistic of a window that reaches 20 words is an interval of the suffix array with all its occurrences,
   whose least place says which windows start earlier elsewhere. A window alone in its interval leaves the search.
4. Each segment's intervals return to the documents; a document drops the words that they cover.
5. An anchor with more distinct segments than one index holds, or with more than a thousandth of all anchor rows, does
   not enter an index: its segments are dealt in pieces, and the earliest place of each of their windows is a minimum
   over the window's hash, summed up before it is shuffled. So no index and no task grows with a frequent passage.

Null text has no words. Where rows share a doc_id they are ordered by their text's hash; fully equal rows are one
document and get one outcome. Null doc_ids come first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import HOT, integral, release, row_keys, split_join, stored, unique_ids

WINDOW, GRAM = 20, 8
SPAN = WINDOW - GRAM + 1  # grams in a window
BEFORE, WIDE = SPAN - 1, SPAN - 1 + WINDOW  # a segment's words before its anchor, and all
#: Segments of one index; a shard with more gets several, each with whole anchors, and a wider anchor gets none.
INDEXED = 4_096
U = np.uint64


class Wavelet:
    """A wavelet matrix of packed bits over numbers 0..top, with counts at each 64 bits."""

    def __init__(self, a: np.ndarray, top: int):
        self.n, self.levels = len(a), []
        for bit in reversed(range(max(1, int(top).bit_length()))):
            b = (a >> bit & 1).astype(bool)
            packed = np.packbits(np.concatenate([b, np.zeros(-len(b) % 64 + 64, bool)]), bitorder="little").view(U)
            ones = np.zeros(len(packed) + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=ones[1:], dtype=np.int32)
            self.levels.append((bit, packed, ones, int(len(b) - b.sum())))
            a = np.concatenate([a[~b], a[b]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c in the first i entries, and the place of c's first entry, as one number: their sum."""
        for bit, packed, ones, zeros in self.levels:
            w = i >> 6
            below = packed[w] & ((U(1) << (i & 63).astype(U)) - U(1))
            r = ones[w] + np.bitwise_count(below).astype(np.int64)
            i = np.where(c >> bit & 1, zeros + r, i - r)
        return i


class FMIndex:
    """Of texts of equal width over numbers from 1; 0 stands for no word and ends a match."""

    def __init__(self, rows: np.ndarray):
        n, w = rows.shape
        self.symbols, flat = np.unique(rows, return_inverse=True)
        text = np.concatenate([np.column_stack([flat.reshape(n, w).astype(np.int64) + 1, np.zeros(n, np.int64)]).ravel()])
        rank, size = text.copy(), 1
        while size < w:  # prefix doubling: rank orders suffixes by their first `size` words
            key = rank * (len(text) + 1)
            key[:-size] += rank[size:] + 1
            self.sa = np.argsort(key)
            k = key[self.sa]
            new = np.zeros(len(k), np.int64)
            new[1:] = k[1:] != k[:-1]
            rank[self.sa] = np.cumsum(new)
            size *= 2
        bwt = text[self.sa - 1]
        self.tree = Wavelet(bwt, int(text.max(initial=1)))
        self.flat, self.width = text, w + 1
        top = int(text.max(initial=1)) + 1
        count = np.bincount(text, minlength=top + 1)
        upto = np.concatenate([[0], np.cumsum(count)])
        self.less, self.upto = upto[: top + 1], upto[1 : top + 2]  # suffixes that begin with a smaller symbol, or one no larger
        self.zero = self.tree.rank(np.arange(top), np.zeros(top, np.int64))

    def intervals(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, lo, hi): suffix array intervals of the `length` symbols from places `at`, by backward search.

        Only those with two occurrences or more: an interval of one is the place itself.
        """
        c = self.flat[at + length - 1]
        live = np.flatnonzero(self.upto[c] - self.less[c] > 1)
        at, lo, hi = at[live], self.less[c[live]], self.upto[c[live]]
        for j in reversed(range(length - 1)):
            if not len(live):
                break
            c = self.flat[at + j]
            less = self.less[c] - self.zero[c]
            lo, hi = less + self.tree.rank(c, lo), less + self.tree.rank(c, hi)
            more = np.flatnonzero(hi - lo > 1)
            if len(more) < len(live):
                live, at, lo, hi = live[more], at[more], lo[more], hi[more]
        return live, lo, hi


def earliest(rows: np.ndarray, key: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct segments with first places (key, pos): (segment, window, key, start) of the earliest occurrence of
    each window that some other segment or place has too, where it differs from the segment's own."""
    n, w = rows.shape
    span = w - WINDOW + 1
    full = np.ones((n, span), bool)
    gaps = np.flatnonzero((rows == 0).any(1))
    if len(gaps):
        full[gaps] = np.lib.stride_tricks.sliding_window_view(rows[gaps] != 0, WINDOW, axis=1).all(2)
    seg, off = np.nonzero(full)
    none = np.zeros(0, np.int64)
    if not len(seg):
        return none, none, none, none
    index = FMIndex(rows)
    which, lo, hi = index.intervals(seg * index.width + off, WINDOW)
    if not len(which):
        return none, none, none, none
    seg, off = seg[which], off[which]
    # order of places: by key, then by start
    uk, ki = np.unique(key, return_inverse=True)
    s, o = index.sa // index.width, index.sa % index.width
    place = ki[s] * (1 << 33) + (pos[s] + o)
    cut, inv = np.unique(lo, return_inverse=True)  # intervals of one length are equal or disjoint
    end = np.zeros(len(cut), np.int64)
    end[inv] = hi
    low = np.minimum.reduceat(np.append(place, np.iinfo(np.int64).max), np.column_stack([cut, end]).ravel())[::2][inv]
    k, p = uk[low >> 33], low & ((1 << 33) - 1)
    new = (k != key[seg]) | (p != pos[seg] + off)
    return seg[new], off[new], k[new], p[new]


def _places(raw, offs):
    h, start, end, first = K.words(raw, offs)
    g = K.grams(h, GRAM)
    room = K.left(first)
    ok = room >= WINDOW
    return h, start, end, first, g, K.anchors(g, ok, SPAN)


def anchor_rows(keyed: DataFrame) -> DataFrame:
    """(h, sh, key, pos): each document's anchors: hashes of the anchor and of its segment, place of the segment."""
    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy()
            for lo, hi, raw, offs in K.chunks(b.column(1)):
                h, _, _, first, g, at = _places(raw, offs)
                doc = np.searchsorted(first, at, "right") - 1
                seg = _segments(h, first[doc], first[doc + 1], at)
                sh = np.zeros(len(at), U)
                for j in range(WIDE):
                    sh = sh * U(0xF1357AEA2E62A9C5) + seg[:, j]
                yield pa.RecordBatch.from_arrays([pa.array(g[at].view(np.int64)), pa.array(K.mix(sh).view(np.int64)), pa.array(keys[lo:hi][doc]), pa.array((at - first[doc] - BEFORE).astype(np.int32))], ["h", "sh", "key", "pos"])

    return keyed.mapInArrow(run, "h long, sh long, key long, pos int")


def _segments(h, first, last, at):
    """A row of word hashes for each anchor at `at` of a text with words first:last; 0 beyond its ends."""
    idx = at[:, None] + np.arange(-BEFORE, WINDOW)
    inside = (idx >= first[:, None]) & (idx < last[:, None])
    return np.where(inside, h[np.clip(idx, 0, max(0, len(h) - 1))] | U(1), U(0)) if len(h) else np.zeros((0, WIDE), U)


def _cover(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the windows from `starts` cover."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + WINDOW, n), -1)
    return np.cumsum(d[:-1]) > 0


def repeats(keyed: DataFrame) -> DataFrame:
    """(key, marks) of documents with windows whose words also start earlier. keyed: _key, text.

    A mark is pos << 16 | bits: bit o stands for the window from pos + o, if the document has that window.
    """
    spark = keyed.sparkSession
    a = stored(anchor_rows(keyed))
    several = stored(a.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    m = stored(split_join(a, several, "h", "n", ("key", "pos")))
    release(spark, a)
    classes = m.groupBy("h", "sh").agg(F.min("key").alias("ckey"), F.min_by("pos", F.struct("key", "pos")).alias("cpos"), F.count(F.lit(1)).alias("n"))
    share = max((several.agg(F.sum("n")).first()[0] or 0) / HOT, INDEXED)  # not more than HOT anchors are above it
    spread = several.where(F.col("n") > share).select("h", F.ceil(F.col("n") / share).alias("pieces"))

    def cut(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys, marks = b.column(0).to_numpy(), b.column(2).to_pylist()
            for lo, hi, raw, offs in K.chunks(b.column(1)):
                h, _, _, first = K.words(raw, offs)
                doc = np.repeat(np.arange(lo, hi), [len(marks[i]) for i in range(lo, hi)])
                rows = [x for i in range(lo, hi) for x in marks[i]]
                p = np.array([x["cpos"] for x in rows], np.int64)
                f, e = first[doc - lo], first[doc - lo + 1]
                seg = _segments(h, f, e, f + p + BEFORE)
                small = (seg >> U(32)).astype(np.uint32) | (seg > 0).astype(np.uint32)
                ends = pa.py_buffer(np.arange(0, small.nbytes + 1, 4 * WIDE, dtype=np.int32).tobytes())
                cells = pa.Array.from_buffers(pa.binary(), len(small), [None, ends, pa.py_buffer(small.tobytes())])
                named = [pa.array([x[c] for x in rows], pa.int64()) for c in ("h", "sh", "n")]
                yield pa.RecordBatch.from_arrays([*named, pa.array(keys[doc]), pa.array(p.astype(np.int32)), cells], ["h", "sh", "n", "ckey", "cpos", "seg"])

    at = classes.groupBy("ckey").agg(F.collect_list(F.struct("h", "sh", "cpos", "n")).alias("at"))
    seg = keyed.join(at.withColumnRenamed("ckey", "_key"), "_key").select("_key", "text", "at").mapInArrow(cut, "h long, sh long, n long, ckey long, cpos int, seg binary")
    seg = seg.join(F.broadcast(spread), "h", "left").withColumn("piece", F.coalesce(F.pmod("sh", "pieces"), F.lit(-1))).drop("pieces")
    seg = seg.repartition("h", "piece").sortWithinPartitions("h", "piece")
    same = ["sh", "n", "ckey", "cpos"]

    def found_rows(t, over, wins):
        return pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks() for c in same], over, wins], [*same, "over", "wins"])

    def segments(t):
        return np.frombuffer(b"".join(t.column("seg").to_pylist()), np.uint32).reshape(-1, WIDE)

    def flush(t):
        """Rows of an index: the windows whose earliest place is not the segment's own."""
        rows = segments(t)
        ck, cp = t.column("ckey").to_numpy(), t.column("cpos").to_numpy().astype(np.int64)
        s, o, k, p = earliest(rows, ck, cp)
        order = np.argsort(s, kind="stable")
        cells = pa.array(np.column_stack([o, k, p])[order].reshape(-1), pa.int64())
        ends = np.zeros(len(rows) + 1, np.int32)
        np.cumsum(3 * np.bincount(s, minlength=len(rows)), out=ends[1:])
        return found_rows(t, pa.ListArray.from_arrays(pa.array(ends), cells), pa.nulls(len(rows), pa.list_(pa.int64())))

    def by_windows(t):
        """Rows that enter no index: the hash of each window, 0 where the text ends inside it."""
        rows = segments(t)
        h = K.grams(rows.ravel().astype(U), WINDOW) if len(rows) else np.zeros(0, U)
        at = np.arange(len(rows))[:, None] * WIDE + np.arange(WIDE - WINDOW + 1)
        full = np.lib.stride_tricks.sliding_window_view(rows != 0, WINDOW, axis=1).all(2)
        w = np.where(full, h[at] | U(1), U(0)).view(np.int64)
        ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * w.shape[1])
        return found_rows(t, pa.nulls(len(rows), pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, pa.array(w.ravel())))

    def search(batches):
        """Whole anchors are gathered until an index is full."""
        held, n, wide = [], 0, None
        for b in batches:
            t = pa.Table.from_batches([b])
            apart = t.column("piece").to_numpy() >= 0
            if wide is not None:
                apart |= t.column("h").to_numpy() == wide
            if apart.any():
                yield by_windows(t.filter(pa.array(apart)))
                t = t.filter(pa.array(~apart))
            if not t.num_rows:
                continue
            held.append(t)
            n += t.num_rows
            if n >= INDEXED:
                t = pa.concat_tables(held)
                h = t.column("h").to_numpy()
                whole = int(np.searchsorted(h, h[-1]))
                if whole:
                    yield flush(t.slice(0, whole))
                held, n = [t.slice(whole)], len(h) - whole
                if n >= INDEXED:
                    wide = h[-1]
                    yield by_windows(held[0])
                    held, n = [], 0
        if n:
            yield flush(pa.concat_tables(held))

    found = stored(seg.mapInArrow(search, "sh long, n long, ckey long, cpos int, over array<long>, wins array<long>"))
    apart = found.where("wins IS NOT NULL")
    if not apart.isEmpty():
        w = apart.select("sh", "ckey", "cpos", F.posexplode("wins").alias("o", "w")).where("w <> 0").select("sh", "o", "w", "ckey", (F.col("cpos") + F.col("o")).cast("long").alias("p"))
        first = stored(w.groupBy("w").agg(F.min(F.struct("ckey", "p")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        w = split_join(w, first, "w", "n", ("sh", "o")).where("first.ckey <> ckey OR first.p <> p")
        w = w.groupBy("sh").agg(F.flatten(F.collect_list(F.array(F.col("o").cast("long"), F.col("first.ckey"), F.col("first.p")))).alias("then"))  # 13 windows at most
        none = F.array().cast("array<bigint>")
        found = found.where("wins IS NULL").drop("wins").unionByName(apart.join(w, "sh", "left").select(*same, F.coalesce("then", none).alias("over")))
        found = stored(found)

    def judge(batches):
        for b in batches:
            if not b.num_rows:
                continue
            key, pos, ck, cp = (b.column(c).to_numpy().astype(np.int64) for c in ("key", "pos", "ckey", "cpos"))
            late = (ck < key) | ((ck == key) & (cp < pos))
            bits = np.where(late, (1 << (WIDE - WINDOW + 1)) - 1, 0)
            lists = b.column("over")
            v = lists.flatten().to_numpy().reshape(-1, 3)
            n = np.diff(lists.offsets.to_numpy()) // 3
            i = np.repeat(np.arange(len(key)), n)
            o, k, p = v[:, 0], v[:, 1], v[:, 2]
            then = (k < key[i]) | ((k == key[i]) & (p < pos[i] + o))
            np.bitwise_and.at(bits, i[~then], ~(1 << o[~then]))
            np.bitwise_or.at(bits, i[then], 1 << o[then])
            some = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array((pos[some] << 16) | bits[some])], ["key", "mark"])

    late = split_join(m.select("sh", "key", "pos"), found.select(*same, "over"), "sh", "n", ("key", "pos"))
    late = late.select("key", "pos", "ckey", "cpos", "over").mapInArrow(judge, "key long, mark long")
    return late.groupBy("key").agg(F.collect_list("mark").alias("marks"))


def starts_of(marks, n: int) -> np.ndarray:
    """Starts of the windows that marks name in a text of n words."""
    m = np.asarray(marks, np.int64)
    i, o = np.nonzero(m[:, None] >> np.arange(WIDE - WINDOW + 1) & 1)
    s = (m >> 16)[i] + o
    return s[(s >= 0) & (s + WINDOW <= n)]


def kept_words(raw, offs, marks: list):
    """For each text: (words, words removed, bytes of the kept words joined by one space)."""
    _, start, end, first = K.words(raw, offs)
    data = raw.tobytes()
    for i in range(len(offs) - 1):
        f, e = int(first[i]), int(first[i + 1])
        n = e - f
        if marks[i] is None or not len(gone := starts_of(marks[i], n)):
            yield n, 0, b" ".join(data[offs[i] : offs[i + 1]].split())
            continue
        keep = np.flatnonzero(~_cover(gone, n)) + f
        yield n, n - len(keep), b" ".join([data[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist())])


def _with_marks(whole: DataFrame, several: bool) -> DataFrame:
    keyed = whole.select("_key", "text")
    r = repeats(keyed.distinct() if several else keyed)
    return whole.join(r.withColumnRenamed("key", "_key"), "_key", "left")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    if integral(docs) and unique_ids(docs):
        d = _with_marks(docs.select(F.col("doc_id").cast("long").alias("_key"), "text"), False).withColumn("doc_id", F.col("_key").cast(kind))
    else:
        d = _with_marks(row_keys(docs.select("doc_id", "text"), "doc_id", "text"), True)

    def run(batches):
        for b in batches:
            marks = b.column("marks").to_pylist()
            for lo, hi, raw, offs in K.chunks(b.column("text")):
                r = list(kept_words(raw, offs, marks[lo:hi]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array([x[0] for x in r], pa.int64()), pa.array([x[1] for x in r], pa.int64()),
                                                  pa.array([hashlib.sha256(x[2]).hexdigest() for x in r])], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return d.select("doc_id", "text", "marks").mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame) -> DataFrame:
    """docs with repeated words removed from text: a changed text is its kept words joined by one space.

    Rows whose words are all removed go; n_chars, where there is one, follows the text. Other rows stay as they are.
    """
    several = not unique_ids(docs)
    others = [c for c in docs.columns if c != "text"]
    whole = row_keys(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("_row")), "text", "_row")
    texts = whole.select("_key", "text")
    d = _with_marks(texts.dropDuplicates(["_key"]) if several else texts, False)

    @F.pandas_udf("string")
    def shorter(text: pd.Series, marks: pd.Series) -> pd.Series:
        """The kept words, or null where none is removed."""
        out = []
        for lo, hi, raw, offs in K.chunks(pa.array(text, pa.string())):
            out += [x[2].decode() if x[1] else None for x in kept_words(raw, offs, list(marks[lo:hi]))]
        return pd.Series(out, dtype=object)

    d = d.withColumn("_t", F.when(F.col("marks").isNotNull(), shorter(F.col("text"), F.coalesce("marks", F.array().cast("array<bigint>")))))
    d = d.where("_t IS NULL OR _t <> ''").select("_key", F.coalesce("_t", "text").alias("_text"), F.col("_t").isNotNull().alias("_cut"))
    d = d.join(whole.select("_key", "_row"), "_key")  # texts stay where the last join put them
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_cut"), F.char_length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return d.select(*[(new[c] if c in new else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


#: DuckDB SQL of the rule; quadratic in nothing, but windows are lists of 20 words.
SQL_PARTS = """
sw AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
swin AS (SELECT rid, i, list_slice(w, i, i + 19) AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 18)) AS i FROM sw WHERE len(w) >= 20)),
slate AS (SELECT rid, i FROM (SELECT rid, i, row_number() OVER (PARTITION BY md5(array_to_string(win, ' ')) ORDER BY rid, i) AS o FROM swin) WHERE o > 1),
sgone AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS p FROM slate),
sword AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM sw),
skeep AS (SELECT s.rid, string_agg(word, ' ' ORDER BY s.p) AS kept, count(*) AS n_kept FROM sword s ANTI JOIN sgone g ON s.rid = g.rid AND s.p = g.p GROUP BY s.rid)
"""
SQL = f"""WITH {SQL_PARTS.format(docs='documents')}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM sw LEFT JOIN skeep USING (rid)"""
