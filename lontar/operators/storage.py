"""Tables written in the shared checkpoint folder, to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark) -> str:
    """A new folder name below spark.checkpoint.dir (below a temporary folder only where that is unset on one machine)."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lontar-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lontar-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in a scratch() folder and read again.

    The shuffles of the write are dropped as it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch(spark) + ".parquet"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads again."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def held(df: DataFrame, name: str, value) -> DataFrame:
    """df with a column, as a generator's output: the optimizer then keeps it as a value and does not repeat its
    expression at each use. One row stays one row."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """df with its rows' numbers from 1 in the given order, which must be total. No task sees more than one range of it."""
    parts = stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    sizes = sizes.select("_p", before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.withColumn(name, inside).join(F.broadcast(sizes), "_p").withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_p", "_before")


#: Up to so many rows of a look-up table are broadcast; a key with more than one HOT-th of the rows is dealt in PIECES.
FEW, HOT, PIECES = 200_000, 1000, 64


def looked_up(left: DataFrame, key: str, right: DataFrame) -> DataFrame:
    """left with the other columns of right, which has one row a key; null where right has no such key.

    right is broadcast where a count shows that it is small, or that few of its keys occur in left. Else left is stored, as
    it is read several times; rows without a key are kept out of the shuffle, and a key with more than a thousandth of
    left's rows is dealt in pieces by a hash of the row: there can be no more than a thousand.
    """
    if right.limit(FEW + 1).count() <= FEW:
        return left.join(F.broadcast(right), key, "left")
    right = stored(right.join(left.select(key).distinct(), key, "left_semi"))
    if right.count() <= FEW:
        return left.join(F.broadcast(right), key, "left")
    left = stored(left)
    more = [c for c in right.columns if c != key]
    n = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    often = stored(n.where(F.col("n") > max(total / HOT, 1)).select(key, F.lit(PIECES).alias("_pieces")))
    by = [c for c, t in left.dtypes if not t.startswith("map")]
    dealt = left.where(F.col(key).isNotNull()).join(F.broadcast(often), key, "left").withColumn("_piece", F.pmod(F.xxhash64(*by), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    copies = right.join(F.broadcast(often), key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    met = dealt.join(copies, [key, "_piece"], "left").drop("_piece").select(*left.columns, *more)
    return met.unionByName(left.where(F.col(key).isNull()).select(*left.columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in more]))
