"""SimHash near-duplicates by multi-index hashing.

A text's words (A-Z lower-cased) give 3-word shingles, repeats included; a bit of its 64-bit fingerprint is 1 if it is
set in over half of the shingles' XXH64 values. Two fingerprints that differ in at most 3 bits differ in at most 1 bit
in one of their two 32-bit segments. So each distinct fingerprint enters a table by both segments, and every value
within one bit of a segment (33 of them) is looked up; what meets there is verified on all 64 bits. Within a table
entry only the links of a spanning forest leave the task: as many as members, never all pairs.

Links join connected components. Work after the fingerprints is by distinct fingerprint, so copies cost nothing; a
fingerprint with over a thousandth of the rows is dealt in pieces when rows meet their component. Very long texts are read
whole; extra columns, whatever their names, are ignored.
Null or empty text has no words: fingerprint zero, linked as any other. Rows that repeat a doc_id get each their own
fingerprint; component_id is the least doc_id reachable (null ids are never that, unless all are null).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components

SHINGLE, SEED, BITS = 3, 42, 3
U = np.uint64


def fingerprint(text: str | None) -> int:
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    t = b" ".join(w)
    if len(w) <= SHINGLE:
        return xxhash.xxh64_intdigest(t, SEED)
    end = np.cumsum([len(x) + 1 for x in w])
    start = [0, *end[: -SHINGLE].tolist()]
    end = (end[SHINGLE - 1 :] - 1).tolist()
    dig = xxhash.xxh64_intdigest
    h = np.array([dig(t[a:b], SEED) for a, b in zip(start, end)], U)
    n = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        n += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(n * 2 > len(h), bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(x) for x in b.column("text").to_pylist()], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(f)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _forest(fp: np.ndarray, center: np.ndarray, bits: int, out: list) -> None:
    """Adds (a, b) of a spanning forest of the links of one table entry between table members and all members."""
    n = len(fp)
    root = np.arange(n)

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in np.flatnonzero(center):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= bits)
        for j in near[root[near] != root[i]] if len(near) > 1 else ():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((fp[i], fp[j]))


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints within `bits` (3 at most)."""
    assert bits <= 3
    low, high = F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)
    masks = F.array(*[F.lit(1 << i) for i in range(32)]).cast("array<bigint>")
    flips = lambda v: F.concat(F.array(v), F.transform(masks, lambda m: v.bitwiseXOR(m)))
    # segment and value in one long: 2^32 tells the segments apart
    keys = F.concat(flips(low), F.transform(flips(high), lambda v: v + F.lit(1 << 32)))
    rows = fps.select("fp", F.posexplode(keys).alias("i", "key")).select("key", "fp", (F.col("i") % 33 == 0).alias("center"))
    rows = rows.repartition("key").sortWithinPartitions("key")

    def run(batches):
        hold = None

        def done(key, fp, center):
            """Links of whole table entries; entries without a pair of member and table member are passed over."""
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[cut, len(key)])
            some = np.add.reduceat(center.astype(np.int64), cut)
            out = []
            for i in np.flatnonzero((size > 1) & (some > 0)):
                s = slice(cut[i], cut[i] + size[i])
                _forest(fp[s], center[s], bits, out)
            a = np.array(out, U).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, 0])), pa.array(np.ascontiguousarray(a[:, 1]))], ["a", "b"])

        for b in batches:
            key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy().view(U)
            center = b.column("center").to_numpy(zero_copy_only=False)
            if hold:
                key, fp, center = (np.concatenate(x) for x in zip(hold, (key, fp, center)))
            keep = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if keep:
                yield done(key[:keep], fp[:keep], center[:keep])
            hold = (key[keep:], fp[keep:], center[keep:])
        if hold and len(hold[0]):
            yield done(*hold)

    return rows.mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fp, component_id of each row."""
    from .common import split_join, stored

    f = stored(fingerprints(docs))
    each = stored(f.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(each.select("fp"), bits))
    each = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = each.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    ids = split_join(each.select("fp", "root", "n"), least, "root", "m", ("fp",)).select("fp", "n", "component_id")
    return split_join(f, ids, "fp", "n", ("doc_id",)).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def unique(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one whose doc_id is component_id (of equal rows, one)."""
    from .common import row_keys

    whole = row_keys(docs.select("doc_id", "text", F.struct("*").alias("_row")), "text", "_row")
    g = groups(whole.select(F.col("_key").alias("doc_id"), "text")).where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    kept = whole.join(g, "_key")
    several = not whole.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return (kept.dropDuplicates(["_key"]) if several else kept).select("_row.*")
