"""Scoring by a language model kept in a log-frequency Bloom filter.

Tokens are the words of a text (A-Z lower-cased), then one end token. Training rows give counts of words, word pairs
and triples (ends stand before the first word). A count c is quantised to level q = 1 + floor(log2(c) * fine): the filter holds
(item, level) for each level 1..q, and a look-up probes level after level until one is missing; the last one found
stands for the middle of its range. The smoothed word probability (c(w) + 1) / (N + V + 1) is what the pair falls back
on, and the pair's is what the triple falls back on: with p known without it, a context seen n times, k of them before
the token, gives (k + PRIOR * p) / (n + PRIOR). So the more often a context was seen, the more it counts.

Counting: each task hashes words to 64 bits and, in batches of BATCH tokens, sends the distinct items in one
packed message for each block of the hash space. A block's owner sums its messages, builds its slice of the filter, and
answers each message with the levels of its items and, for the exact base score, the words' counts. A batch's
answers meet its tokens, which are read from the table again in the same batches. So a word of any frequency is one
entry of a message, and messages, answers and the filter grow with the input: a slice is as large as its items need,
no count is left out of it, and no task or driver holds more than one slice.

The second reading gives the same batches, as the table is then a plain scan of files or is stored before; each batch's
digest is held against that of the first reading all the same. Null and empty texts have the end token alone. Rows that repeat a doc_id each count and score for themselves. With no
training rows N = V = 0. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernel as K
from .common import in_training, same_scan, spread, stored

PROBES, BITS_PER_ITEM = 4, 8
PRIOR = {2: 500.0, 3: 10.0}  # how often a context must be seen to count as much as what is known without it
BATCH = 1 << 20
#: Bits that tell pairs and triples of one block apart. A block holds about a million of them, however many blocks there are.
NARROW = 40
FINE = {1: 2, 2: 1, 3: 1}  # levels for each doubling of a count: words, pairs, triples
U = np.uint64
END = U(0x5851F42D4C957F2D)
_PAIR = U(0xC2B2AE3D27D4EB4F)


def tokens(raw, offs):
    """(hash, doc, new): tokens with each text's end token behind its words; new marks a text's first token."""
    h, _, _, first = K.words(raw, offs, lower=True)
    n = len(offs) - 1
    h = np.insert(h, first[1:], END)
    size = np.diff(first) + 1
    new = np.zeros(len(h), bool)
    new[np.cumsum(size) - size] = True
    return h, np.repeat(np.arange(n), size), new


def pairs(h, new):
    """Hash of each token with the one before it; a text's first token follows an end token."""
    v = np.empty_like(h)
    v[1:] = h[:-1]
    v[new] = END
    return K.mix(v * U(0x9FB21C651E98DF25) + h + _PAIR)


def items(h, new):
    """(kind, hashes): words, pairs and triples that end at each token; ends stand before a text's first token."""
    yield 1, h
    two = pairs(h, new)
    yield 2, two
    before = np.empty_like(two)
    before[1:] = two[:-1]
    before[new] = END
    yield 3, K.mix(before * U(0xA0761D6478BD642F) + h + _PAIR)


def summed(h, counts):
    """(distinct, sums, place of each entry among the distinct), ascending."""
    if not len(h):
        return h, np.zeros(0, np.int64), np.zeros(0, np.int64)
    o = np.argsort(h, kind="stable")
    a = h[o]
    new = np.r_[True, a[1:] != a[:-1]]
    at = np.empty(len(h), np.int64)
    at[o] = np.cumsum(new) - 1
    cut = np.flatnonzero(new)
    return a[cut], np.add.reduceat(counts[o].astype(np.int64), cut), at


def turns(batches):
    """(msg, ids, held out, hash, doc, new) of runs of BATCH tokens. A scan of the same table gives the same ones."""
    from pyspark import TaskContext

    part, turn = TaskContext.get().partitionId(), 0
    ids, held, hs, ds, news, n = [], [], [], [], [], 0

    def whole():
        return (part << 24) + turn, ids, np.array(held, bool), np.concatenate(hs), np.concatenate(ds), np.concatenate(news)

    for b in batches:
        keys, out = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi, raw, offs in K.chunks(b.column(2)):
            h, d, new = tokens(raw, offs)
            hs.append(h), ds.append(d + len(ids)), news.append(new)
            ids += keys[lo:hi]
            held += out[lo:hi]
            n += len(h)
            if n >= BATCH:
                yield whole()
                ids, held, hs, ds, news, n = [], [], [], [], [], 0
                turn += 1
    if ids:
        yield whole()


def packed(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)


def runs(x):
    """(value, start, stop) of each run of equal values of a sorted array."""
    cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return zip(x[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(x)])


def digest(ids, size, u) -> bytes:
    """Stands for a batch's documents: doc_ids, numbers of tokens, distinct words."""
    return hashlib.blake2b(repr(ids).encode() + size.astype("<i8").tobytes() + u.tobytes(), digest_size=16).digest()


def narrow(u, shift):
    """Ascending hashes of one block, the block's bits left out and cut to NARROW bits, as five bytes each."""
    low = (u << (U(64) - shift)) >> U(64 - NARROW)
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : NARROW // 8]).tobytes()


def wide(b):
    out = np.zeros((len(b) // (NARROW // 8), 8), np.uint8)
    out[:, : NARROW // 8] = np.frombuffer(b, np.uint8).reshape(-1, NARROW // 8)
    return out.view("<u8").ravel()


def messages(docs: DataFrame, blocks: int) -> DataFrame:
    """(kind, block, msg, a, b): packed messages; kinds 1, 2, 3: words, pairs, triples of a block; kind 5: the batch's digest.

    a = hashes, ascending, distinct but for narrowed ones that meet, b = how often each is in training documents. Blocks without an entry get no message, so there
    are no more messages than entries, however many blocks there are.
    """
    shift = U(64 - int(math.log2(blocks)))
    names = ["kind", "block", "msg", "a", "b"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        for msg, ids, held, h, d, new in turns(batches):
            train = ~held[d]
            for kind, x in items(h, new):
                u, c, _ = summed(x, train)
                rows = [(5, msg % blocks, msg, digest(ids, np.bincount(d, minlength=len(ids)), u), None)] if kind == 1 else []
                for k, lo, hi in runs(u >> shift):
                    c8 = c[lo:hi]
                    a = u[lo:hi].tobytes() if kind == 1 else narrow(u[lo:hi], shift)
                    rows.append((kind, k, msg, a, (c8.astype(np.uint8) if c8.max() < 256 else c8.astype(np.uint32)).tobytes()))
                yield packed(rows, names, types)

    return docs.mapInArrow(run, "kind int, block int, msg long, a binary, b binary")


def slots(h, level: int, size: int):
    """PROBES places of (h, level) in a slice of `size` bits."""
    x = K.mix(h + U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    step = (x >> U(32)) | U(1)
    x &= U(0xFFFFFFFF)
    for _ in range(PROBES):
        yield (x * U(size)) >> U(32)
        x = (x + step) & U(0xFFFFFFFF)


def levels(c, fine: int):
    return 1 + np.floor(np.log2(np.maximum(c, 1)) * fine + 1e-9).astype(np.int64)


def values(q, fine: int):
    """The count that a level stands for."""
    lo = 2.0 ** ((q - 1) / fine)
    return np.where(q > 0, np.where(q <= fine, lo, lo * 2 ** (0.5 / fine)), 0.0)


def fill(groups):
    """(slice, bits): a slice of the filter for [(hashes, counts, fine)]; it is as large as its items need."""
    items = sum(int(levels(c, f).sum()) for _, c, f in groups)
    bits = max(64, -(-items * BITS_PER_ITEM // 64) * 64)
    a = np.zeros(bits, bool)
    for h, c, f in groups:
        q = levels(c, f)
        level = 1
        while len(h):
            for s in slots(h, level, bits):
                a[s.astype(np.int64)] = True
            h, q, level = h[q > level], q[q > level], level + 1
    return np.packbits(a, bitorder="little").tobytes(), bits


def owners(sent: DataFrame, blocks: int) -> DataFrame:
    """(kind, msg, block, a, b, n, m): kinds 1, 2, 3 answer messages: a = levels, b = the words' exact counts;
    kind 4: n = N, m = V of the block; kind 5 is as it came."""
    names = ["kind", "msg", "block", "a", "b", "n", "m"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def settle(block, held):
        groups, asked = [], []
        if told := [x for x in held if x[0] == 5]:
            yield packed([(5, msg, block, a.to_pybytes(), None, 0, 0) for _, msg, a, _ in told], names, types)
        for kind in (1, 2, 3):
            made = [x for x in held if x[0] == kind]
            if not made:
                continue
            hs = [np.frombuffer(x[2], U) if kind == 1 else wide(x[2]) for x in made]
            cs = [np.frombuffer(x[3], np.uint8 if x[3].size == len(h) else np.uint32).astype(np.int64) for x, h in zip(made, hs)]
            u, c, at = summed(np.concatenate(hs), np.concatenate(cs))
            groups.append((u[c > 0], c[c > 0], FINE[kind]))
            asked.append((kind, [x[1] for x in made], [len(x) for x in hs], u, c, at))
            if kind == 1:
                yield packed([(4, -1, block, None, None, int(c.sum()), int((c > 0).sum()))], names, types)
        f = Filter(*fill(groups))
        for kind, msgs, sizes, u, c, at in asked:
            q, lo = f.levels(u).astype(np.uint8), 0
            for msg, n in zip(msgs, sizes):
                x = at[lo : lo + n]
                yield packed([(kind, msg, block, q[x].tobytes(), c[x].tobytes() if kind == 1 else None, 0, 0)], names, types)
                lo += n

    def run(batches):
        block, held = None, []
        for b in batches:
            whole = [c.to_pylist() for c in b.columns[:3]] + [[x.as_buffer() if x.is_valid else None for x in c] for c in b.columns[3:]]  # binaries are not copied
            for kind, k, msg, x, y in zip(*whole):
                if k != block and held:
                    yield from settle(block, held)
                    held = []
                block = k
                held.append((kind, msg, x, y))
        if held:
            yield from settle(block, held)

    rows = sent.repartition("block").sortWithinPartitions("block", "kind")
    return rows.mapInArrow(run, "kind int, msg long, block int, a binary, b binary, n long, m long")


class Filter:
    """A slice of the filter, for look-ups."""

    def __init__(self, data: bytes, bits: int):
        self.data, self.bits = np.frombuffer(data, np.uint8), bits

    def levels(self, h):
        """The last level held of each item (0: not held)."""
        q = np.zeros(len(h), np.int64)
        live, level = np.arange(len(h)), 1
        while len(live):
            ok = np.arange(len(live))
            for s in slots(h[live], level, self.bits):  # all probes' places; those that a probe misses leave
                s = s[ok].astype(np.int64)
                ok = ok[(self.data[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)]
            live = live[ok]
            q[live] = level
            level += 1
        return q

    def count(self, h, fine: int):
        """Quantised counts (0: not held)."""
        return values(self.levels(h), fine)


def planes(x) -> bytes:
    """Numbers of 32 bits byte by byte: the upper ones are mostly zero and compress."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(b: bytes):
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def report(docs: DataFrame, prior: dict[int, float] = PRIOR, blocks: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = blocks or 1 << max(4, math.ceil(math.log2(4 * spread(docs))))  # four for each task: messages are small rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids_type = pa.list_(to_arrow_type(docs.schema["doc_id"].dataType))
    base = same_scan(docs.select("doc_id", (~in_training(7, 2)).alias("held_out"), "text"))
    got = stored(owners(messages(base, blocks), blocks))
    n = got.where("kind = 4").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("m"), F.lit(0)).alias("v")).first()
    total, train = float(n.n + n.v + 1), int(n.n)
    names = ["msg", "kind", "block", "a", "b", "c", "d", "e", "ids"]
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5, ids_type]

    def again(batches):
        """A batch's tokens: a = its digest, b = numbers of tokens, c = held out, d = distinct words, e = place of each token among them."""
        for msg, ids, held, h, d, _ in turns(batches):
            u, _, at = summed(h, np.ones(len(h), np.int64))
            size = np.bincount(d, minlength=len(ids))
            yield packed([(msg, 0, -1, digest(ids, size, u), planes(size), held.astype(np.uint8).tobytes(), u.tobytes(), planes(at), ids)], names, types)

    def settle(held):
        """Scores of a batch from its tokens and answers; the answers, in order of blocks, are those of its distinct words and pairs."""
        if not held[0] or held[0][0] != held[5]:
            raise RuntimeError("lm: the table's second scan differs from the first")
        _, size, flags, u, at, ids = held[0]
        size, flags, u, at = unplaned(size).astype(np.int64), np.frombuffer(flags, np.uint8), np.frombuffer(u, U), unplaned(at)
        h, d, new = u[at], np.repeat(np.arange(len(ids)), size), np.zeros(len(at), bool)
        new[np.cumsum(size) - size] = True
        c = np.frombuffer(b"".join(held[4]), np.int64)
        prob, context = None, None
        for kind, x in items(h, new):
            q = np.frombuffer(b"".join(held[kind]), np.uint8).astype(np.int64)
            x, _, place = summed(x, np.ones(len(x), np.int64)) if kind > 1 else (u, None, at)
            if len(q) != len(x) or len(c) != len(u):
                raise RuntimeError("lm: answers are missing")
            held_counts = values(q, FINE[kind])
            n = held_counts[place]
            if kind == 1:
                prob = (n + 1) / total
                first = held_counts[np.searchsorted(u, END)]  # ends, which stand before a text's first token
            else:
                prob = (np.minimum(n, context) + prior[kind] * prob) / (context + prior[kind])
                first = 0.0
            context = np.r_[0.0, n[:-1]]  # the count of what stands before each token
            context[new] = first
        exact = np.bincount(d, np.log10(c + 1.0)[at]) - size * math.log10(total)
        known = np.bincount(d, (c > 0)[at]).astype(np.int64)
        cells = [pa.array(ids, ids_type.value_type), pa.array(flags > 0), pa.array(size), pa.array(known), pa.array(exact), pa.array(np.bincount(d, np.log10(prob)))]
        return pa.RecordBatch.from_arrays(cells, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    def join(batches):
        msg, held = None, None
        for b in batches:
            for m, k, _, *x in zip(*[c.to_pylist() for c in b.columns]):
                if m != msg:
                    if held:
                        yield settle(held)
                    msg, held = m, {0: None, 1: [], 2: [], 3: [], 4: [], 5: None}
                if k == 0:
                    held[0] = x
                elif k == 5:
                    held[5] = x[0]
                else:
                    held[k].append(x[0])
                    if k == 1:
                        held[4].append(x[1])
        if held:
            yield settle(held)

    answers = got.where("kind <> 4").select("msg", "kind", "block", "a", "b")
    # the table comes first in the union: its tasks then have the numbers they had in messages()
    scan = base.mapInArrow(again, f"msg long, kind int, block int, a binary, b binary, c binary, d binary, e binary, ids array<{kind}>")
    rows = scan.unionByName(answers, allowMissingColumns=True)
    out = rows.repartition("msg").sortWithinPartitions("msg", "kind", "block").mapInArrow(join, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
