"""Work that follows from rows: tasks of a parse, readings of a look-up."""

from pyspark.sql import functions as F

from lontar.operators import morphology, storage


def test_tasks_grow_with_rows(spark):
    few = morphology._tasks(spark, 0, 100)
    assert few == 1 and morphology._tasks(spark, 10**6, 100) == 10**4
    assert morphology._tasks(spark, 100, 100) <= spark.sparkContext.defaultParallelism


def test_look_ups_beyond_a_broadcast_read_left_once(spark, monkeypatch):
    left = spark.range(40).select("id", F.when(F.col("id") % 4 > 0, F.concat(F.lit("k"), F.col("id") % 7)).alias("key"))
    right = spark.createDataFrame([(f"k{i}", i) for i in range(5)] + [(f"z{i}", i) for i in range(50)], "key string, v int")
    want = sorted(map(tuple, left.join(right, "key", "left").select("id", "key", "v").collect()), key=str)
    for few in (100, 10, 1):  # broadcast whole, as what occurs, and not at all
        monkeypatch.setattr(storage, "FEW", few)
        got = storage.looked_up(left, "key", right)
        assert sorted(map(tuple, got.select("id", "key", "v").collect()), key=str) == want
        assert few > 1 or "Range (" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_lemma_has_its_first_source_without_a_sort(spark, tmp_path):
    from lontar.plans import queries as Q

    rows = [(5, "Rumah rumah besar", "en", "s7"), (2, "besar api", "en", "s3"), (9, "api rumah", "fr", None), (1, "api", "de", "tanpa"), (4, None, "es", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    d = Q.dictionary_rows(spark, str(tmp_path))
    domain = lambda i: Q.R.DOMAINS[i % len(Q.R.DOMAINS)]
    want = {("rumah", "n", domain(7), 1005), ("besar", "n", domain(3), 1002), ("api", "n", domain(3), 1002), ("api", "v", domain(0), 1009), ("rumah", "v", domain(0), 1009), ("api", "adj", domain(0), 1001)}
    assert {(r.lemma, r.pos, r.domain, r.seq) for r in d.where("definition IS NULL AND seq > 1000").collect()} == want
    assert "SortAggregate" not in d._jdf.queryExecution().toString()


def test_tokens_beyond_a_broadcast_are_dealt_by_their_number(spark, monkeypatch):
    t = spark.range(600).select(F.col("id").alias("doc_id"), F.lit(0).alias("idx"), F.concat(F.lit("w"), F.col("id") % 90).alias("teks"), F.lit(False).alias("lanjut"))
    words = t.select("teks", "lanjut", F.upper("teks").alias("root")).distinct()
    want = sorted(map(tuple, t.join(words, ["teks", "lanjut"]).collect()))
    monkeypatch.setattr(morphology, "FEW", 10)
    monkeypatch.setattr(morphology, "TOKENS", 20)
    got = morphology.with_analyses(t, words, ["doc_id"]).select("teks", "lanjut", "doc_id", "idx", "root")
    assert sorted(map(tuple, got.collect())) == want
    sizes = got.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < 600 / 4
    monkeypatch.setattr(morphology, "TOKENS", 10**6)  # few tokens: as many tasks as shuffles have
    got = morphology.with_analyses(t, words, ["doc_id"]).select("teks", "lanjut", "doc_id", "idx", "root")
    assert sorted(map(tuple, got.collect())) == want
