"""Versions of a lexicon and of what was analysed with it: a change re-analyses only the sentences that it can touch.

A store is a folder with tables:

    lexicon/v=N   the whole lexicon of each version
    needs/        (bucket, kata, teks, lanjut): which entries, there or not, each word's analysis depends on
    places/       (bucket, teks, lanjut, key...): which sentences hold a word
    parsed/v=N    the sentences analysed in version N: all of them in the first, in later ones those that a change touches

needs and places are partitioned by a hash of the word that is looked up, so a change reads the buckets of its words alone.
A version's sentences are the latest of each key. Tables are only added to: a reader of an old version is never disturbed,
and a version that was not finished (no _SUCCESS in parsed) is not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexicon as L
from . import morphology
from .storage import stored

BUCKETS = 256


def _bucket(word):
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last whole version; 0 where there is none."""
    n = 0
    while _exists(spark, f"{path}/parsed/v={n + 1}/_SUCCESS"):
        n += 1
    return n


def lexicon_at(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/lexicon/v={version}")


def _bucketed(df: DataFrame, path: str) -> None:
    df.repartition("bucket").write.partitionBy("bucket").parquet(path)


def create(sentences: DataFrame, lexicon: DataFrame, path: str, key: tuple = ("doc_id", "sent_idx")) -> None:
    """Version 1 of a store: all sentences (key..., text) analysed. key tells sentences apart."""
    lexicon.write.parquet(f"{path}/lexicon/v=1")
    lexicon = sentences.sparkSession.read.parquet(f"{path}/lexicon/v=1")
    words = morphology.words_of(sentences, list(key)).select("teks", (F.col("idx") > 0).alias("lanjut"), *key)
    _bucketed(words.distinct().withColumn("bucket", _bucket(F.col("teks"))), f"{path}/places")
    _bucketed(morphology.needs(words).withColumn("bucket", _bucket(F.col("kata"))), f"{path}/needs")
    morphology.parse(sentences, lexicon, key).write.parquet(f"{path}/parsed/v=1")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kata): entries that are in one lexicon alone or differ in class or domain."""
    a, b = (x.select("kata", F.struct("kelas", "domain").alias(n)) for x, n in ((old, "a"), (new, "b")))
    return a.join(b, "kata", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("kata")


def _of_bucket(table: DataFrame, words: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a bucketed table that words (on...) meet; buckets without any are not read."""
    buckets = [r[0] for r in words.select(_bucket(F.col(on[0]))).distinct().collect()]  # BUCKETS at most
    return table.where(F.col("bucket").isin(*buckets)).join(L.small(words.select(*on).distinct()), on, "left_semi")


def touched(spark: SparkSession, path: str, words: DataFrame, key: tuple = ("doc_id", "sent_idx")) -> DataFrame:
    """(key...): the sentences that hold a word whose analysis depends on an entry of words (kata)."""
    held = stored(_of_bucket(spark.read.parquet(f"{path}/needs"), words, ["kata"]).select("teks", "lanjut").distinct())
    return _of_bucket(spark.read.parquet(f"{path}/places"), held, ["teks", "lanjut"]).select(*key).distinct()


def renew(spark: SparkSession, path: str, entries: DataFrame, key: tuple = ("doc_id", "sent_idx")) -> int:
    """The next version: entries (kata, kelas, domain) added or in place of what they were, without a class (null) removed.

    Only the sentences that hold an affected word are analysed again, with the new lexicon. Returns the version's number;
    entries that change nothing make none.
    """
    n = latest(spark, path)
    old = lexicon_at(spark, path, n)
    entries = entries.withColumn("kata", F.lower("kata"))
    new = L.add(old.join(entries.where("kelas IS NULL").select("kata"), "kata", "left_anti"), entries.where("kelas IS NOT NULL"))
    new.write.mode("overwrite").parquet(f"{path}/lexicon/v={n + 1}")
    new = lexicon_at(spark, path, n + 1)
    words = stored(changed(old, new))
    if words.isEmpty():
        return n
    sentences = read(spark, path, n, key).select(*key, "text").join(touched(spark, path, words, key), list(key), "left_semi")
    morphology.parse(stored(sentences), new, key).write.mode("overwrite").parquet(f"{path}/parsed/v={n + 1}")
    return n + 1


def read(spark: SparkSession, path: str, version: int | None = None, key: tuple = ("doc_id", "sent_idx")) -> DataFrame:
    """The analysed sentences as of a version (the last). Later versions are small, so the first is joined with what they hold."""
    n = version or latest(spark, path)
    out = spark.read.parquet(f"{path}/parsed/v=1")
    if n == 1:
        return out
    more = [spark.read.parquet(f"{path}/parsed/v={v}").withColumn("_v", F.lit(v)) for v in range(2, n + 1)]
    renewed = more[0]
    for m in more[1:]:
        renewed = renewed.unionByName(m)
    last = renewed.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_v")))).where("_n = 1").drop("_n", "_v")
    return out.join(last.select(*key), list(key), "left_anti").unionByName(last)
