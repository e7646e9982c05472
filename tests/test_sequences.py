"""Two-level scans against folds in order, with one key that spans every range; controller and duplicates, batch and stream."""

import random

import pytest
from pyspark.sql import functions as F

from lontar.operators import corpus, sequences, training
from lontar.streaming import references as streams


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small ranges stay as they are, so that keys span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def runs(n, seed=0):
    """One key holds most rows; others have a few; one is null."""
    r = random.Random(seed)
    rows = [("hot", i, r.uniform(-5, 5)) for i in range(n)]
    for k in ("a", "b", None):
        rows += [(k, i, r.uniform(-5, 5)) for i in range(r.randint(1, 70))]
    r.shuffle(rows)
    return rows


def by_key(rows):
    out = {}
    for k, i, v in sorted(rows, key=lambda x: x[1]):
        out.setdefault(k, []).append((i, v))
    return out


def test_ranges_bound_the_largest_task(spark):
    d = spark.createDataFrame(runs(4000), "k string, i int, v double").repartition(5)
    rows, segments = sequences.laid_out(d, ["k"], ["i"])
    most = rows.groupBy("k", "_p").count().agg(F.max("count")).first()[0]
    assert most < 2500 and segments.where("k = 'hot'").count() > 1
    got = {(x.k, x.i): x._n for x in rows.collect()}
    for k, vs in by_key(runs(4000)).items():
        assert [got[k, i] for i, _ in vs] == list(range(len(vs)))


@pytest.mark.parametrize("alpha", [0.0, 1e-5, 0.5, 0.9, 0.999, 1.0])
def test_ema_over_ranges(spark, alpha):
    rows = runs(5000)
    got = {(x.k, x.i): x.ema for x in sequences.ema(spark.createDataFrame(rows, "k string, i int, v double").repartition(7), "k", "i", "v", alpha).collect()}
    assert len(got) == len(rows)
    for k, vs in by_key(rows).items():
        a = None
        for i, v in vs:
            a = v if a is None else alpha * a + (1 - alpha) * v
            assert got[k, i] == pytest.approx(a, abs=1e-9)


@pytest.mark.parametrize("n", [60, 3000])
def test_curve_over_ranges(spark, n):
    rows = runs(n, 3)
    got = {(x.k, x.i): x for x in sequences.curve(spark.createDataFrame(rows, "k string, i int, v double").repartition(7), "k", "i", "v").collect()}
    assert len(got) == len(rows)
    for k, vs in by_key(rows).items():
        y = [v for _, v in vs]
        for j, (i, _) in enumerate(vs):
            h, r = y[max(0, j - 49) : j + 1], y[max(0, j - 9) : j + 1]
            m, c = sum(h) / len(h), (len(h) - 1) / 2
            slope = sum((x - c) * (v - m) for x, v in enumerate(h)) / sum((x - c) ** 2 for x in range(len(h))) if len(h) >= 5 else 0.0
            assert got[k, i].trend == pytest.approx(slope, abs=1e-9) and got[k, i].recent == pytest.approx(sum(r) / len(r), abs=1e-9)


@pytest.mark.parametrize("strictly", [False, True])
def test_as_of(spark, strictly):
    r = random.Random(1)
    key = lambda: "hot" if r.random() < 0.8 else r.choice(["a", "b", None])
    left = [(i, key(), r.randint(0, 400) if r.random() < 0.95 else None) for i in range(3000)]
    right = [(key(), r.randint(0, 400) if r.random() < 0.95 else None, j) for j in range(500)]
    l = spark.createDataFrame(left, "id int, k string, t int").repartition(5)
    x = spark.createDataFrame(right, "k string, s int, j int").repartition(3)
    got = {y.id: (y.s, y.j) for y in sequences.as_of(l, x, ["k"], "t", "s", strictly).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        fit = [(s, j) for kk, s, j in right if k is not None and kk == k and s is not None and t is not None and (s < t if strictly else s <= t)]
        assert got[i] == (max(fit) if fit else (None, None))
    assert sequences.as_of(l.limit(0), x, ["k"], "t", "s").count() == 0 and sequences.as_of(l, x.limit(0), ["k"], "t", "s").where("j IS NULL").count() == len(left)


NAMES = list(training.LOSS_WEIGHTS)


def losses(n):
    r = random.Random(4)
    return [(k, i, *[None if r.random() < 0.05 else r.uniform(0, 1.2) * (1 if i < n / 2 else 0.2) for _ in NAMES]) for k in ("x", "y") for i in range(n if k == "x" else 37)]


def folded(rows):
    out, state = {}, {}
    for k, i, *v in sorted(rows):
        n, w, last = state.get(k, (0, [x[0] for x in training.LOSS_WEIGHTS.values()], [[] for _ in NAMES]))
        last = [[*a, b][-10:] for a, b in zip(last, v)]
        n += 1
        if n % 10 == 0:
            seen = [[b for b in a if b is not None] for a in last]
            w = training.next_weights(w, [sum(a) / len(a) if a else 0.0 for a in seen])
        state[k] = n, w, last
        out[k, i] = w
    return out


SCHEMA = "k string, i int, " + ", ".join(f"l_{x} double" for x in NAMES)


def test_controller(spark):
    rows = losses(1500)
    got = training.controlled(spark.createDataFrame(rows, SCHEMA).repartition(6), "k", "i").collect()
    want = folded(rows)
    assert len(got) == len(rows)
    for x in got:
        assert [x[f"w_{n}"] for n in NAMES] == pytest.approx(want[x.k, x.i])
    # a loss far above its threshold reaches the bound, and all together stay within 8
    assert max(sum(w) for w in want.values()) <= 8.0 + 1e-9
    assert training.next_weights([1.0, 0.8, 0.6, 1.0, 1.5], [9.0] * 5) == pytest.approx([1.1, 0.88, 0.66, 1.1, 1.65])
    assert training.next_weights([2.0, 1.5, 1.2, 2.0, 3.0], [9.0] * 5) == pytest.approx([x * 8 / 9.7 for x in (2.0, 1.5, 1.2, 2.0, 3.0)])


def streamed(spark, tmp_path, parts, schema, make):
    """Rows of a stream whose micro-batches are the given lists."""
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for j, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
            s = spark.readStream.schema(schema).parquet(str(src))
            q = make(s).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.parquet(str(out)).collect()


def test_controller_stream_equals_batch(spark, tmp_path):
    rows = sorted(losses(130), key=lambda x: x[1])
    parts = [rows[:55], rows[55:60], rows[60:]]
    got = streamed(spark, tmp_path, parts, SCHEMA, lambda s: streams.weights(s, "k", "i"))
    want = folded(rows)
    assert len(got) == len(rows)
    for x in got:
        assert [x[f"w_{n}"] for n in NAMES] == pytest.approx(want[x.k, x.i])


def test_duplicates_stream_equals_near_dedup(spark, tmp_path):
    r = random.Random(2)
    base = ["saya makan nasi goreng di rumah setiap hari bersama keluarga besar kami", "dia membaca buku di perpustakaan kota besar itu setiap minggu pagi", ""]
    rows = []
    for i in range(90):
        w = r.choice(base).split()
        if w and r.random() < 0.7:
            w[-r.randint(1, 4) :] = [f"w{r.randint(0, 3)}" for _ in range(r.randint(0, 3))]
        rows.append((i, " ".join(w), "satu" if i < 60 else "dua"))
    settings = corpus.Settings(key_length=20)
    got = {x.i: x.duplicate for x in streamed(spark, tmp_path, [rows[:20], rows[20:60], rows[60:]], "i int, text string, masa string", lambda s: streams.duplicates(s, "i", settings=settings, generation="masa"))}
    assert len(got) == 90
    for masa in ("satu", "dua"):  # the second generation starts from nothing
        part = spark.createDataFrame([x for x in rows if x[2] == masa], "i int, text string, masa string")
        kept = {x.i for x in corpus.near_dedup(part, settings, order="i").collect()}
        assert kept == {x[0] for x in rows if x[2] == masa and not got[x[0]]}
