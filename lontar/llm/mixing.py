"""Mixing sources to target weights by capped water-filling.

Sources in code point order, null last, weigh WEIGHTS in turn. Targets share `share` of all sizes by weight; a
target stops at `epochs` times its source's size and the excess goes to the others by weight until none is above.
That limit has a closed form: with sources in order of cap / weight, a level t holds target = min(cap, t * weight).
Each document is then taken floor(target / size) whole times, and a seeded fraction once more: documents stand in
the order of a seeded digest of doc_id and text, and the first ones are taken until the source's remaining words are used up;
the one at the end gives only the words still missing. So each source's words meet its target, rounded down.

Null text has size 0; null source is a source of its own; sources of size 0 have target 0. Rows that repeat a doc_id
count each for itself. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import split_join, stored

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS, SEED = 1.5, 2, "mix-17"
#: Above so many sources their table is joined by a shuffle, in which sources with many rows are dealt in pieces.
SMALL = 50_000


def size_of(text):
    """Number of words [^\\x20\\x09-\\x0D]+."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+"), "")).cast("long")


def order_of(seed: str = SEED):
    """A seeded digest of doc_id and text: its first four hex digits are the bucket. Rows without doc_id spread as others do."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))


def targets(sizes: DataFrame, share: float = SHARE, epochs: float = EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size) -> also weight and target; a row for each source, so the windows are small."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    t = t.withColumn("total", F.sum("source_size").over(everything) * float(share)).withColumn("level", (F.col("total") - before) / rest)
    # the first source whose cap the level does not pass; levels behind it mean nothing
    t = t.withColumn("rn", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("rn", "level"))).over(everything)
    t = t.withColumn("level", first["level"])
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return t.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, share: float = SHARE, epochs: float = EPOCHS, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """docs' columns with _size, _source_size, _target and _taken added: the words of each that the mix takes.

    Columns of docs that begin with _mix_, or have one of these four names, are replaced.

    One pass sums sizes by source and bucket (65,536 buckets of the digest) with partial sums before its shuffle;
    a second pass decides each row by its source's entry. Only the rows of one bucket of each source are ordered.
    """
    docs = docs.drop("_size", "_source_size", "_target", "_taken", *[c for c in docs.columns if c.startswith("_mix_")])
    bucket = lambda dg: F.conv(F.substring(dg, 1, 4), 16, 10).cast("int")
    sums = docs.select("source", bucket(order_of(seed)).alias("b"), size_of(F.col("text")).alias("n"))
    sums = stored(sums.groupBy("source", "b").agg(F.sum("n").alias("n")))
    per = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), share, epochs, weights)
    per = per.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    per = per.withColumn("left", F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    run = Window.partitionBy("source").orderBy("b")  # 65,536 rows a source at most
    cut = sums.withColumn("before", F.sum("n").over(run) - F.col("n"))
    cut = cut.alias("c").join(per.alias("p"), F.col("c.source").eqNullSafe(F.col("p.source"))).select(
        F.col("p.source").alias("_mix_source"), F.col("p.source_size").alias("_source_size"), F.col("p.target").alias("_target"), F.col("whole").alias("_mix_whole"), F.col("left").alias("_mix_left"), "b", "before", "n")
    last = F.when(F.col("before") < F.col("_mix_left"), F.struct("b", "before"))  # the bucket in which the words run out
    same = ["_mix_source", "_source_size", "_target", "_mix_whole", "_mix_left"]
    cut = cut.groupBy(*same).agg(F.max(last).alias("e"))
    cut = stored(cut.select(*same, F.coalesce("e.b", F.lit(-1)).alias("_mix_edge"), F.coalesce("e.before", F.lit(0)).alias("_mix_before")))
    small = cut.limit(SMALL + 1).count() <= SMALL
    # the size is worked out after the edge's filter, so that the edge's branch reads few texts' words
    j = docs.withColumn("_mix_dg", order_of(seed)).withColumn("_mix_b", bucket(F.col("_mix_dg")))
    if small:
        j = j.join(F.broadcast(cut), F.col("source").eqNullSafe(F.col("_mix_source")))
    else:
        name = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
        rows = docs.groupBy(name(F.col("source")).alias("_mix_k")).agg(F.count(F.lit(1)).alias("_mix_n"))
        j = split_join(j.withColumn("_mix_k", name(F.col("source"))), cut.withColumn("_mix_k", name(F.col("_mix_source"))).join(rows, "_mix_k"), "_mix_k", "_mix_n", ("_mix_dg",)).drop("_mix_k")
    sized = lambda d: d.withColumn("_size", size_of(F.col("text")))
    far = sized(j.where("_mix_b <> _mix_edge")).withColumn("_mix_once", F.when(F.col("_mix_b") < F.col("_mix_edge"), F.col("_size")).otherwise(0))
    w = Window.partitionBy("_mix_source").orderBy("_mix_dg", "_size").rowsBetween(Window.unboundedPreceding, 0)
    edge = sized(j.where("_mix_b = _mix_edge"))
    cum = F.sum("_size").over(w)
    edge = edge.withColumn("_mix_once", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_mix_left") - F.col("_mix_before") - (cum - F.col("_size")))))
    out = far.unionByName(edge).withColumn("_taken", (F.col("_mix_whole") * F.col("_size") + F.col("_mix_once")).cast("long"))
    return out.drop(*[c for c in out.columns if c.startswith("_mix_")])


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs.select("doc_id", "source", "text"), **how).select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


#: The same in SQL.
SQL_PARTS = """
sized AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix-17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS dg FROM {docs}),
per0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
per1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM per0),
per2 AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per1),
per3 AS (SELECT *, (SELECT level FROM per2 WHERE level <= cap / weight ORDER BY cap / weight, source ASC NULLS LAST LIMIT 1) AS lv FROM per2),
per AS (SELECT source, source_size, coalesce(least(cap, lv * weight), cap) AS target FROM per3),
mixed0 AS (
  SELECT s.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN CAST(floor(p.target / p.source_size) AS BIGINT) ELSE 0 END AS whole,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.dg, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS before
  FROM sized s JOIN per p ON s.source IS NOT DISTINCT FROM p.source),
mixed AS (
  SELECT *, CAST(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size) AS BIGINT) - before)) AS BIGINT) AS taken FROM mixed0)
"""
SQL = f"WITH {SQL_PARTS.format(docs='documents')} SELECT doc_id, size, source_size, target, taken FROM mixed"
