"""Ordered sequences by key, scanned on two levels, so that one key may hold all rows.

laid_out() sorts a table by key and step into ranges of about equal size and numbers the part that each range has of a key:
a segment. Windows work inside segments, so no task sees more of a key than one range. What a segment owes to those before
it comes from a small table of segments: sums and carries of the keys that span several ranges (there are no more such
segments than ranges), or the last rows before its first (a halo).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

#: Steps whose weights are summed in one go; weights stay far inside a double's range.
BLOCK = 64


def _on(left: str, right: str, keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return on


def laid_out(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, segments). rows: df with _p (range), _i (place in the segment, from 0) and _n (place in the key, from 0).

    segments: keys, _p, _k (rows) and _b (the key's rows before), of the keys that span several ranges alone. Null keys are a
    key; rows of equal order are in no particular one.
    """
    rows = stored(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    sizes = rows.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_k"))
    every = Window.partitionBy(*keys)
    before = F.sum("_k").over(every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    segments = sizes.withColumn("_b", F.coalesce(before, F.lit(0))).withColumn("_s", F.count(F.lit(1)).over(every))
    segments = stored(segments.where("_s > 1").drop("_s"))
    # as many rows as ranges at most
    later = F.broadcast(segments.where("_b > 0").select(*keys, "_p", "_b"))
    rows = rows.withColumn("_i", (F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(*order)) - 1).cast("long"))
    rows = rows.alias("l").join(later.alias("r"), _on("l", "r", [*keys, "_p"]), "left")
    return rows.select("l.*", (F.col("l._i") + F.coalesce("r._b", F.lit(0))).alias("_n")), segments


def with_halo(rows: DataFrame, segments: DataFrame, keys: list[str], width: int) -> DataFrame:
    """rows with _halo (false), and before each segment copies (true) of the `width` rows of its key before its first."""
    ends = segments.withColumn("_e", F.col("_b") + F.col("_k"))
    # the last rows of each segment, for each later segment that begins near enough
    own = F.broadcast(ends.select(*keys, "_p", "_e"))
    tail = rows.alias("l").join(own.alias("r"), _on("l", "r", [*keys, "_p"])).where(F.col("l._n") >= F.col("r._e") - width).select("l.*")
    to = F.broadcast(ends.where("_b > 0").select(*keys, F.col("_p").alias("_to"), F.col("_b").alias("_tb")))
    halo = tail.alias("l").join(to.alias("r"), _on("l", "r", keys)).where((F.col("l._n") < F.col("r._tb")) & (F.col("l._n") >= F.col("r._tb") - width))
    halo = halo.select(*[F.col("r._to").alias("_p") if c == "_p" else F.col(f"l.{c}") for c in rows.columns], F.lit(True).alias("_halo"))
    return rows.withColumn("_halo", F.lit(False)).unionByName(halo)


def _decayed(df: DataFrame, parts: list[str], place: str, value: str, alpha: float, depth: int = 0) -> DataFrame:
    """df with _r: alpha * _r of the row before in the part + value. place counts a part's rows from 0.

    Inside blocks of BLOCK rows it is a running sum of weighted values; blocks follow one another by the same rule with
    alpha^BLOCK, on one row a block.
    """
    w = Window.partitionBy(*parts).orderBy(place)
    if alpha < 1e-4:  # what is five rows older is below 1e-20
        past = [F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) * alpha**k for k in range(1, 5)]
        return df.withColumn("_r", F.col(value) + sum(past, F.lit(0.0)))
    if alpha == 1 or depth == 5:  # 64^5 rows: one block is left
        run = F.sum(F.col(value) * F.pow(F.lit(alpha), -F.col(place))).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("_r", run * F.pow(F.lit(alpha), F.col(place)))
    b, i = f"_block{depth}", f"_in{depth}"
    d = df.withColumn(b, F.floor(F.col(place) / BLOCK)).withColumn(i, F.col(place) % BLOCK)
    inside = Window.partitionBy(*parts, b).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_s", F.pow(F.lit(alpha), F.col(i)) * F.sum(F.col(value) * F.pow(F.lit(alpha), -F.col(i))).over(inside))
    ends = d.groupBy(*parts, b).agg(F.max_by("_s", i).alias("_end"))
    ends = _decayed(ends, parts, b, "_end", alpha**BLOCK, depth + 1)
    ends = ends.select(*parts, (F.col(b) + 1).alias(b), F.col("_r").alias("_before"))
    j = d.alias("l").join(ends.alias("r"), _on("l", "r", [*parts, b]), "left")
    r = F.col("l._s") + F.pow(F.lit(alpha), F.col(f"l.{i}") + 1) * F.coalesce("r._before", F.lit(0.0))
    return j.select(*[f"l.{c}" for c in df.columns], r.alias("_r"))


def ema(df: DataFrame, key: str, step: str, value: str, alpha: float = 0.9) -> DataFrame:
    """Adds ema: alpha * before + (1 - alpha) * value, from the first value of the key on; for any alpha from 0 to 1."""
    if not 0 <= alpha <= 1:
        raise ValueError(alpha)
    rows, segments = laid_out(df, [key], [step])
    share = F.when(F.col("_n") == 0, 1.0).otherwise(1.0 - alpha)  # the first value counts whole
    r = stored(_decayed(rows.withColumn("_v", share * F.col(value)), [key, "_p"], "_i", "_v", alpha))
    # segments in order: a number for each range that a key has a part of
    ends = r.alias("l").join(F.broadcast(segments).alias("r"), _on("l", "r", [key, "_p"])).where(F.col("l._i") == F.col("r._k") - 1).select(F.col(f"l.{key}").alias(key), "l._p", "r._k", "l._r")
    start = F.struct(F.lit(0.0).alias("a"), F.array().cast("array<double>").alias("out"))
    fold = lambda acc, x: F.struct((acc["a"] * F.pow(F.lit(alpha), x["_k"]) + x["_r"]).alias("a"), F.concat(acc["out"], F.array(acc["a"])).alias("out"))
    ends = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", "_k", "_r"))).alias("e"))
    carry = ends.select(key, F.explode(F.arrays_zip(F.col("e._p").alias("p"), F.aggregate("e", start, fold, lambda acc: acc["out"]).alias("before"))).alias("x")).select(key, F.col("x.p").alias("_p"), F.col("x.before").alias("_before"))
    j = r.alias("l").join(F.broadcast(carry).alias("r"), _on("l", "r", [key, "_p"]), "left")
    out = F.col("l._r") + F.pow(F.lit(alpha), F.col("l._i") + 1) * F.coalesce("r._before", F.lit(0.0))
    return j.select(*[f"l.{c}" for c in df.columns], out.alias("ema"))


def curve(df: DataFrame, key: str, step: str, value: str, history: int = 50, recent: int = 10) -> DataFrame:
    """Adds trend (slope over the last `history` steps, 0 for under five), stagnant and recent (mean of the last `recent`)."""
    rows, segments = laid_out(df, [key], [step])
    d = with_halo(rows, segments, [key], max(history, recent) - 1)
    w = Window.partitionBy(key, "_p").orderBy("_n")
    h, r = w.rowsBetween(-(history - 1), 0), w.rowsBetween(-(recent - 1), 0)
    x = (F.col("_n") - F.min("_n").over(Window.partitionBy(key, "_p"))).cast("double")
    d = d.withColumn("_x", x)
    slope = F.when(F.count(value).over(h) >= 5, F.coalesce(F.regr_slope(F.col(value), F.col("_x")).over(h), F.lit(0.0))).otherwise(0.0)
    d = d.withColumn("trend", slope).withColumn("stagnant", F.abs(F.col("trend")) < 1e-4).withColumn("recent", F.avg(value).over(r))
    return d.where("NOT _halo").select(*df.columns, "trend", "stagnant", "recent")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, strictly: bool = False) -> DataFrame:
    """left with the columns of right's last row of the same key whose time is not after left's (before it, if strictly); null where there is none.

    left's and right's columns have no name in common but keys. Of right's rows of equal key and time the greatest by its
    other columns counts. Rows without a time, or without one of the keys, meet nothing. Both tables are laid out together,
    left's rows behind right's of the same time; the last row of right is carried forward inside each range, and from range
    to range by one row a range. A key may hold all rows of either side.
    """
    other = [c for c in right.columns if c not in keys]
    usable = F.col(at).isNotNull()
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    put = F.struct(*[F.col(c) for c in left.columns])
    take = F.struct(*[F.col(c) for c in other])
    r = right.where(F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.lit(1 if strictly else 0).alias("_side"), take.alias("_take"))
    l = left.where(usable).select(*keys, F.col(at).alias("_at"), F.lit(0 if strictly else 1).alias("_side"), put.alias("_put"))
    both = r.withColumn("_put", F.lit(None).cast(l.schema["_put"].dataType)).unionByName(l.withColumn("_take", F.lit(None).cast(r.schema["_take"].dataType)))
    for k in keys:
        both = both.where(F.col(k).isNotNull())
    rows, segments = laid_out(both, keys, ["_at", "_side", "_take"])
    inside = Window.partitionBy(*keys, "_p").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.withColumn("_last", F.last("_take", True).over(inside))
    ends = d.alias("l").join(F.broadcast(segments).alias("r"), _on("l", "r", [*keys, "_p"])).where(F.col("l._i") == F.col("r._k") - 1).select(*[F.col(f"l.{k}").alias(k) for k in keys], "l._p", "l._last")
    before = F.last("_last", True).over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    carry = F.broadcast(stored(ends.select(*keys, "_p", before.alias("_before"))))
    j = d.where("_put IS NOT NULL").alias("l").join(carry.alias("r"), _on("l", "r", [*keys, "_p"]), "left")
    met = j.select("l._put.*", F.coalesce("l._last", "r._before").alias("_t")).select(*left.columns, *[F.col(f"_t.{c}").alias(c) for c in other])
    alone = left.where(~usable).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in other])
    return met.unionByName(alone)
