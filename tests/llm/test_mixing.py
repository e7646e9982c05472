"""Mixing against step-by-step water-filling, and its bounds."""

import random

import pytest
from pyspark.sql import functions as F

from lontar.llm import mixing


def fill(sizes: dict, weights=mixing.WEIGHTS, share=1.5, epochs=2.0):
    """Clamp and reshare until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, out, open_ = sum(sizes.values()) * share, {}, list(order)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > epochs * sizes[s]]
        if not over:
            return out | {s: level * w[s] for s in open_}
        for s in over:
            out[s] = epochs * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 50, 1000, 100000]) * r.randint(1, 9) for i in range(r.randint(1, 14))} | ({None: 70} if seed % 2 else {})
    t = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = fill(sizes)
    for x in t:
        assert x.target == pytest.approx(want[x.source], rel=1e-9, abs=1e-6)


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "c", None, "é"] + ["a"] * 5), " ".join("w" * r.randint(0, 40))) for i in range(400)]
    rows += [(400, "a", None), (401, "b", ""), (402, "a", "x " * 5000), (5, "a", "same"), (5, "a", "same"), (None, "c", "no id here")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("_size", F.lit("clash"))
    own = ["whole", "left", "before", "b", "n", "weight", "target", "e"]
    d = d.withColumns({c: F.lit(c) for c in own})
    assert set(mixing.mix(d).columns) == {"doc_id", "source", "text", *own, "_size", "_source_size", "_target", "_taken"}
    assert mixing.mix(d).select(*own).distinct().collect() == [tuple(own)]
    got = mixing.mix(d).select("doc_id", "source", "_size", "_source_size", "_target", "_taken").collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = fill(sizes)
    for s in sizes:
        of = [x for x in got if x.source == s]
        assert all(0 <= x._taken <= 2 * x._size and x._source_size == sizes[s] for x in of)
        assert sum(x._taken for x in of) == pytest.approx(want[s], abs=1)
    again = mixing.mix(d.repartition(7)).select("doc_id", "source", "_size", "_taken").collect()
    key = lambda rs: sorted((str(x.doc_id), str(x.source), x._size, x._taken) for x in rs)
    assert key(again) == key(got)
    assert mixing.report(d.limit(0)).count() == 0
