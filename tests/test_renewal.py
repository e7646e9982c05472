"""A renewed store equals a full run, and reads and analyses little."""

import pytest
from pyspark.sql import functions as F

from lontar.operators import morphology, renewal
from lontar.operators.storage import scratch
from lontar.sources import seeds


def tokens(df):
    return {(x.doc_id, x.sent_idx): [t.asDict(recursive=True) for t in x.tokens] for x in df.collect()}


@pytest.fixture(scope="module")
def sentences(spark):
    more = [(100 + i, j, f"Kalimat{i} tentang {w} dan hal lain nomor {j}.") for i in range(60) for j, w in enumerate(["kucing", "pohon", "laut", "angin"])]
    more += [(900, 0, "Mereka membukukan catatan, buku-buku, lelaki berbelanja!"), (900, 1, None), (900, 2, "")]
    return seeds.sentences(spark).select("doc_id", "sent_idx", "text").unionByName(spark.createDataFrame(more, "doc_id long, sent_idx int, text string"))


def test_renewal_equals_a_full_run(spark, sentences):
    lex, path = seeds.lexicon(spark), scratch(spark)
    renewal.create(sentences, lex, path)
    assert tokens(renewal.read(spark, path)) == tokens(morphology.parse(sentences, lex))
    changes = [[("beli", "n", "hukum"), ("Lelaki", "n", "seni"), ("belanja", "v", "ekonomi")], [("buku", None, None), ("kucing", "n", "alam")], [("buku", "n", "seni"), ("tidak_ada", "n", None)]]
    for n, change in enumerate(changes, 2):
        entries = spark.createDataFrame(change, "kata string, kelas string, domain string")
        assert renewal.renew(spark, path, entries) == n == renewal.latest(spark, path)
        whole = tokens(morphology.parse(sentences, renewal.lexicon_at(spark, path, n)))
        assert tokens(renewal.read(spark, path)) == whole
        # few sentences were analysed again
        assert 0 < spark.read.parquet(f"{path}/parsed/v={n}").count() < 0.4 * len(whole)
    # old versions stay as they were
    assert tokens(renewal.read(spark, path, 1)) == tokens(morphology.parse(sentences, lex))
    assert renewal.renew(spark, path, spark.createDataFrame([("buku", "n", "seni")], "kata string, kelas string, domain string")) == 4  # no change, no version


def test_a_change_reads_its_buckets_alone(spark, sentences):
    path = scratch(spark)
    renewal.create(sentences, seeds.lexicon(spark), path)
    words = spark.createDataFrame([("beli",)], "kata string")
    needs = renewal._of_bucket(spark.read.parquet(f"{path}/needs"), words, ["kata"])
    plan = needs._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and needs.select(F.spark_partition_id()).count() > 0
    assert {x.teks for x in needs.collect()} == {"membeli", "dibeli", "Dibeli", "beli"} & {x.teks for x in needs.collect()} and renewal.touched(spark, path, words).count() >= 5


def test_unfinished_versions_are_not_there(spark, sentences):
    path = scratch(spark)
    assert renewal.latest(spark, path) == 0
    renewal.create(sentences, seeds.lexicon(spark), path)
    seeds.lexicon(spark).write.parquet(f"{path}/lexicon/v=2")  # a renewal that was lost on its way
    assert renewal.latest(spark, path) == 1
    assert renewal.renew(spark, path, spark.createDataFrame([("beli", "n", "hukum")], "kata string, kelas string, domain string")) == 2
