"""Document fingerprints from closed syncmers.

A k-mer (k consecutive code points) is a closed syncmer if the least hash among its s-mers stands at its first or
last place. The choice depends on the k-mer alone, so an edit elsewhere in the text never changes it: the anchors
serve positional matching: anchors that two texts share vote for the shift between their places, and the share of a
text's anchors that agree on the best shift says how much of it stands in the other, in order (aligned_*, shift_*).

The fingerprint keeps the distinct 32-bit hashes of a text's syncmers below 2^32 / SCALE, but at least the SKETCH least
ones (all of them, where fewer), in ascending order, as hex digits: it grows with the text, so that a passage shared
by long texts shows. Likeness is the Jaccard estimate from two fingerprints, over the range that both cover.

Null counts as the empty text, whose fingerprint is empty; a text shorter than k, or without a syncmer, has the
hash of the whole text as its one entry. Equal texts have equal fingerprints, and two empty ones a likeness of 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernel as K
from .common import integral, row_keys, unique_ids

KMER, SMER, SKETCH, SCALE = 12, 5, 128, 16
BELOW = (1 << 32) // SCALE
U = np.uint64


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def syncmers(c: np.ndarray, k: int = KMER, s: int = SMER) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the closed syncmers of a text given as code points."""
    m = len(c) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    c = c.astype(U) + U(1)
    n = len(c) - s + 1
    h = c[:n].copy()
    for j in range(1, s):
        h *= U(0xF1357AEA2E62A9C5)
        h += c[j : j + n]
    h = K.mix(h)
    low = K.slide(h, k - s + 1, np.minimum)
    at = np.flatnonzero((h[:m] == low) | (h[k - s : k - s + m] == low))
    g = np.zeros(len(at), U)
    for j in (*range(0, k - s, s), k - s):  # s-mers that cover the k-mer
        g = g * U(0xD1342543DE82EF95) + h[at + j]
    return at, K.mix(g)


def marks(c: np.ndarray, k: int = KMER, s: int = SMER) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text's anchors: its syncmers, or where there are none the whole text as one."""
    at, g = syncmers(c, k, s)
    if len(c) and not len(g):
        return np.zeros(1, np.int64), np.frombuffer(hashlib.blake2b(c.tobytes(), digest_size=8).digest(), U)
    return at, g


def sketch(g: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """The fingerprint's hashes, ascending, from those of all anchors."""
    g = (g >> U(32)).astype(np.uint32)
    least = np.unique(g[g < BELOW])
    return least if len(least) >= size else np.unique(g)[:size]


def hexed(a: np.ndarray) -> str:
    return a.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, size: int = SKETCH) -> float:
    """Jaccard estimate: the share of both among all hashes in the range that both fingerprints cover."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    # a fingerprint covers all hashes, those up to its last one, or those below the fixed limit
    up_to = min(1 << 32 if len(x) < size else int(x[-1]) if len(x) == size and x[-1] >= BELOW else BELOW - 1 for x in (a, b))
    a, b = a[: np.searchsorted(a, up_to, "right")], b[: np.searchsorted(b, up_to, "right")]
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def aligned(a: tuple, b: tuple) -> tuple[float, int]:
    """(share of a's distinct anchors that b has at the shift most of them agree on, that shift); the first place of an anchor counts.

    Of equally good shifts the least one; (0, 0) where no anchor is shared, (1, 0) for two texts without any."""
    if not len(a[1]) or not len(b[1]):
        return float(len(a[1]) == len(b[1])), 0
    ga, ia = np.unique(a[1], return_index=True)
    gb, ib = np.unique(b[1], return_index=True)
    _, x, y = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
    if not len(x):
        return 0.0, 0
    shift, n = np.unique(b[0][ib[y]] - a[0][ia[x]], return_counts=True)
    top = int(n.argmax())
    return float(n[top] / len(ga)), int(shift[top])


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column fingerprint added (replaced, where there is one)."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def of(s):
        return s.map(lambda x: hexed(sketch(marks(codes(x or ""))[1])))

    return docs.withColumn("fingerprint", of(F.col(text)))


def anchors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, hash): a row for each anchor, for positional matching."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, g = marks(codes(x or ""))
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), b.column(0).type), pa.array(at.astype(np.int64)), pa.array(g.view(np.int64))], ["key", "place", "hash"])

    return docs.select(key, text).mapInArrow(run, f"key {kind}, place long, hash long")


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def numbers(values: list[int]):
    """An array of whole numbers, written in the plan as one text."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def rank(values: list[int], k):
    """How many of ascending values are not above k, by halving."""
    a, steps = numbers(values), F.array(*[F.lit(1 << i) for i in reversed(range(max(1, len(values).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.get(a, lo + s - 1) <= k, lo + s).otherwise(lo))


def neighbours(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, tail, doc_id, text): doc_id's ranges, each followed by a row with tail set: the first of the next.

    A range is one partition, in order, so each row's successor is the row after it. The ranges' limits come from a scan
    of doc_id alone; only a range's first row travels twice. The driver and the plan hold two numbers for each range.
    """
    plain = integral(docs) and unique_ids(docs)
    base = docs.select("doc_id", "text", F.col("doc_id").cast("long").alias("_key")) if plain else row_keys(docs.select("doc_id", "text"), "doc_id", "text")
    base = base.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("_key").alias("k"))
    cuts = sorted({int(x) for x in base.select("k").approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)}) if parts > 1 else []

    bucket = rank(cuts, F.col("k"))
    heads = sorted((r.k, r.bucket) for r in base.select(bucket.alias("bucket"), "k").groupBy("bucket").agg(F.min("k").alias("k")).collect())
    first, before = [k for k, _ in heads], [heads[i - 1][1] for i in range(len(heads))]
    at = rank(first, F.col("k")) - 1
    # the range that ends where this row begins the next one; null for other rows
    follows = F.when(F.get(numbers(first), at) == F.col("k"), F.get(numbers(before), at).cast("int"))
    rows = base.withColumn("own", bucket).withColumn("to", follows)
    place = lambda b, tail: F.struct(b.alias("bucket"), F.lit(tail).alias("tail"))
    rows = rows.withColumn("at", F.explode(F.when(F.col("to").isNotNull(), F.array(place(F.col("own"), 0), place(F.col("to"), 1))).otherwise(F.array(place(F.col("own"), 0)))))
    rows = rows.select("at.bucket", "at.tail", "k", "doc_id", "text")
    return rows.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "tail", "k", "text")


def edit_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and likenesses, as op1's contract names them; then, for the
    edited text and the next document, the share of the text's anchors found in order there, and their shift.

    Null doc_ids come first; rows with one doc_id are ordered by their text's hash. doc_id may be of any type that has an
    order. Extra columns are ignored. An empty table gives an empty result.
    """
    from .common import spread

    spark = docs.sparkSession
    parts = parts or max(spread(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = neighbours(docs, parts).select("bucket", "tail", "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
              "aligned_edited double, shift_edited long, aligned_next double, shift_next long")
    names = [x.split()[0] for x in schema.split(", ")]
    types = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.int64()]

    def run(batches):
        last = None  # (bucket, doc_id, text, anchors, fingerprint) that waits for its successor
        done = None  # a bucket whose tail has come
        for b in batches:
            out = []
            for bucket, tail, i, x in zip(*[c.to_pylist() for c in b.columns]):
                if tail and done == bucket:
                    continue
                own = marks(codes(x))
                mark = sketch(own[1])
                if last and last[0] == bucket:
                    _, j, y, m, fp = last
                    e = edited(y, x)
                    me = m if e == y else marks(codes(e))
                    fe = fp if e == y else sketch(me[1])
                    out.append((j, len(y), hashlib.sha256(e.encode()).hexdigest(), hexed(fp), hexed(fe), likeness(fp, fe), likeness(fp, mark), *aligned(m, me), *aligned(m, own)))
                last = None if tail else (bucket, i, x, own, mark)
                done = bucket if tail else done
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.mapInArrow(run, schema)
