"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch; texts may be long, so batches hold few rows.
ARROW_ROWS = 512
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with more than one HOT-th of the rows is split.
HOT = 1000


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: a batch of long texts stays within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder.

    The folder is what the session names in spark.checkpoint.dir; only where that is unset (tests on one
    machine) a temporary one is made.
    """
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lontar-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/lontar-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage ends there.

    The shuffles of the write are dropped as it ends: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}.parquet"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads again."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            delete(spark, path)


def split_join(left: DataFrame, right: DataFrame, key: str, n: str, by: tuple[str, ...], how: str = "inner", total: int | None = None) -> DataFrame:
    """left joined with right on key, whatever share of left's rows a key has.

    right has one row a key; its column n, which is dropped, counts left's rows of that key. A key with more than one
    HOT-th of all rows is dealt in pieces by a hash of left's columns `by`, and its row of right goes to each piece.
    There can be no more than HOT such keys, whatever the table's size; only their pieces are broadcast. total: left's rows,
    where they are known (about).
    """
    total = (right.agg(F.sum(n)).first()[0] or 0) if total is None else total
    share = max(total / HOT, 100.0)
    hot = right.where(F.col(n) > share).select(F.col(key).alias("_hot"), F.ceil(F.col(n) / share).cast("int").alias("_pieces"))
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_piece", F.pmod(F.xxhash64(*by), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_hot", "_pieces")
    pieces = F.when(F.col(n) > share, F.ceil(F.col(n) / share)).otherwise(1).cast("int")
    copies = right.withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop(n)
    return dealt.join(copies, [key, "_piece"], how).drop("_piece")


def same_scan(df: DataFrame) -> DataFrame:
    """df, if it is no more than a scan of files with filters and projections, which gives the same partitions again; else its stored copy."""
    def plain(node) -> bool:
        if node.nodeName() not in ("Project", "Filter", "LogicalRelation", "Relation"):
            return node.nodeName().startswith(("Relation", "LogicalRelation"))
        kids = node.children()
        return all(plain(kids.apply(i)) for i in range(kids.size()))

    return df if plain(df._jdf.queryExecution().optimizedPlan()) else stored(df)


def unique_ids(docs: DataFrame) -> bool:
    """Whether doc_id is neither null nor repeated."""
    return docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()


def integral(docs: DataFrame) -> bool:
    """Whether doc_id is of a whole-number type."""
    return docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def row_keys(docs: DataFrame, *carry: str) -> DataFrame:
    """(_key long, carry...): _key orders rows by doc_id, null first.

    Where doc_ids are whole numbers, unique and not null, _key is doc_id. Else rows are ordered by (doc_id, hash of the text)
    and fully equal rows share a key: they are one document and get the same outcome.
    """
    if integral(docs) and unique_ids(docs):
        return docs.select(F.col("doc_id").cast("long").alias("_key"), *carry)
    th = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keys = docs.select("doc_id", th.alias("_th")).distinct().orderBy(F.col("doc_id").asc_nulls_first(), "_th")
    keys = stored(keys.select("doc_id", "_th", F.monotonically_increasing_id().alias("_key")))
    left = docs.select("doc_id", th.alias("_th"), *[c for c in carry if c != "doc_id"]).alias("l")
    on = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l._th") == F.col("r._th"))
    return left.join(keys.alias("r"), on).select("_key", *[f"l.{c}" for c in carry])


def in_training(folds: int, held: int):
    """Rows whose crc32(doc_id as text) mod folds is not the held-out remainder (null ids train)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held, F.lit(True))


def spread(docs: DataFrame, least: int = 1) -> int:
    """Tasks of a scan: grows with the input's size."""
    return max(least, docs.rdd.getNumPartitions())
