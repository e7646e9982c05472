"""Streams give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from lontar.operators import morphology, semantics, training
from lontar.operators.storage import stored
from lontar.sources import seeds
from lontar.streaming import references as streams


def drained(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        return stream.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_references(spark, tmp_path):
    u = stored(semantics.understand(morphology.parse(seeds.sentences(spark), seeds.lexicon(spark))))
    for i in range(4):  # four files, a micro-batch each, in the order of sentences
        u.where(F.col("sent_idx") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    u.where("sent_idx > 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {tuple(r) for r in drained(streams.references(s), "refs")}
    assert got == {tuple(r) for r in semantics.references(u).collect()}


def test_controller(spark, tmp_path):
    d = spark.createDataFrame([("a", i, float(i % 7)) for i in range(40)] + [("b", i, 2.0) for i in range(3)], "k string, s int, v double")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = {(r.k, r.s): (r.ema, r.recent) for r in drained(streams.controller(s, "k", "s", "v"), "ctl")}
    for r in training.ema(training.curve(d, "k", "s", "v"), "k", "s", "v").collect():
        assert got[r.k, r.s] == pytest.approx((r.ema, r.recent))
