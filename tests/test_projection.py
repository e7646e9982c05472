"""Projections against numpy, observed runs against counts of what they wrote."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lontar.operators import corpus, observed, projection
from lontar.operators.storage import scratch


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 7)) * [5, 1, 1, 1, 3, 1, 0.2] + 2
    w, b = r.normal(size=(7, 3)), np.array([1.0, -2.0, 0.5])
    y = x @ w + b
    rows = [(i, [float(v) for v in x[i]], [float(v) for v in y[i]]) for i in range(400)]
    rows += [(900, None, [0.0] * 3), (901, [1.0, 2.0], [0.0] * 3), (902, [None] * 7, [0.0] * 3), (903, [], None)]
    return spark.createDataFrame(rows, "id int, x array<float>, y array<double>").repartition(5), x, w, b


def test_product(vectors):
    df, x, w, b = vectors
    got = {r.id: r.proyeksi for r in projection.projected(df.withColumn("proyeksi", F.lit("clash")), "x", w, b).collect()}
    assert len(got) == 404 and all(got[i] is None for i in (900, 901, 902, 903))
    assert np.allclose([got[i] for i in range(400)], x.astype(np.float32) @ w + b, atol=1e-4)
    with pytest.raises(ValueError):
        projection.projected(df, "x", np.zeros((1 << 14, 1 << 13)))


def test_fits(vectors):
    df, x, w, b = vectors
    m, c = projection.fitted(df, "x", 7, "y", 3)
    assert np.allclose(m, w, atol=1e-4) and np.allclose(c, b, atol=1e-4)
    m, c = projection.principal(df, "x", 7, 2)
    z = x - x.mean(0)
    _, v = np.linalg.eigh(z.T @ z)
    v = v[:, ::-1][:, :2]
    assert np.allclose(np.abs(m.T @ v), np.eye(2), atol=1e-4) and np.allclose(x @ m + c, z @ m, atol=1e-4)
    empty = df.limit(0)
    assert not projection.fitted(empty, "x", 7, "y", 3)[0].any() and projection.principal(empty, "x", 7, 2)[0].shape == (7, 2)


def test_observed_robustness(spark):
    rows = [("a", True, 0.5), ("a", False, 0.25), ("b", True, 1.0), ("c", True, 0.0), (None, False, 0.25)]
    path = scratch(spark)
    got = {r.kategori: r for r in observed.robustness(spark.createDataFrame(rows, "kategori string, valid boolean, skor double").repartition(3), path, ["a", "b", "none"]).collect()}
    assert spark.read.parquet(path).count() == 5
    assert (got[None].run_size, got[None].valid_count, got[None].average_score) == (5, 3, 0.4)
    assert (got["a"].run_size, got["a"].valid_rate, got["b"].average_score, got["none"].run_size, got["none"].valid_rate) == (2, 0.5, 1.0, 0, 0.0)
    assert got[None].detik > 0 and got[None].per_detik > 0
    none = spark.createDataFrame([], "kategori string, valid boolean, skor double")
    assert observed.robustness(none, scratch(spark), ["a"]).where("kategori IS NULL").first().run_size == 0


def test_observed_clean_run(spark):
    rows = [(1, "satu dua tiga empat"), (2, "satu dua tiga empat"), (3, "satu dua tiga empat!"), (4, "ya"), (5, None), (6, "lima enam tujuh delapan sembilan")]
    d, path = spark.createDataFrame(rows, "doc_id long, text string"), scratch(spark)
    got = {r.tahap: r for r in observed.clean_run(d, path).collect()}
    assert {k: r.baris for k, r in got.items()} == {"masuk": 6, "bersih": 4, "unik": 3, "akhir": spark.read.parquet(path).count()}
    assert {r.doc_id for r in spark.read.parquet(path).collect()} == {r.doc_id for r in corpus.run(d).collect()} and got["bersih"].bagian == pytest.approx(4 / 6)
