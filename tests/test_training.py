"""Training data, losses and metrics against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lontar.operators import checks, metrics, reports, semantics, training
from lontar.operators.storage import ranked, stored
from lontar.operators import morphology
from lontar.sources import files, seeds


@pytest.mark.parametrize("alpha", [0.0, 1e-6, 0.05, 0.5, 0.9, 0.999, 1.0])
def test_ema_is_exact(spark, alpha):
    r = random.Random(1)
    rows = [(k, i, r.uniform(-5, 5)) for k in ("a", None) for i in range(1000 if k else 70)]
    got = {(x.k, x.i): x.ema for x in training.ema(spark.createDataFrame(rows, "k string, i int, v double").repartition(3), "k", "i", "v", alpha).collect()}
    e = {}
    for k, i, v in rows:
        e[k] = v if k not in e else alpha * e[k] + (1 - alpha) * v
        assert got[k, i] == pytest.approx(e[k], abs=1e-9), (k, i)


def test_filter_actions_keeps_a_share(spark):
    rows = [(i, "anak makan nasi") for i in range(10)] + [(100 + i, f"hari {i} cerah") for i in range(1000)] + [(5000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = training.filter_actions(d).collect()
    assert sum("makan" in (r.text or "") for r in got) == 10 and len(got) == 11  # floor(10 * 0.15 / 0.85) others
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in training.filter_actions(d.repartition(5)).collect())


def test_mixes(spark):
    a = spark.createDataFrame([(f"anak makan {i}",) for i in range(20)], "text string")
    o = spark.createDataFrame([(f"teks {i}",) for i in range(60)], "text string")
    m = training.phase_mix(a, o, 0.4).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in m} == {"action": 40, "other": 60}
    c = {(r.phase, r.part): r["count"] for r in training.curriculum(a, o, n_relations=50, most_others=30).groupBy("phase", "part").count().collect()}
    assert c == {(1, "action"): 20, (2, "relation"): 50, (2, "replay 1"): 6, (3, "other"): 30, (3, "replay 1"): 3, (3, "replay 2"): 16}
    assert all(len(r.text.split()) >= 2 for r in training.relations(spark, 30).collect())


def test_negatives_and_losses(spark):
    d = spark.createDataFrame([(1, [5, 6, 7, 8, 0, 0]), (2, [3, 4, 0, 0])], "doc_id long, ids array<int>")
    n = training.negatives(d, 3).collect()
    assert len(n) == 6 and all(sorted(r.ids[:4]) == [5, 6, 7, 8] and r.ids[4:] == [0, 0] for r in n if r.doc_id == 1) and all(r.ids == [3, 4, 0, 0] for r in n if r.doc_id == 2)
    pmi = spark.createDataFrame([(5, 6, 2.0), (6, 8, 1.0)], "a int, b int, pmi double")
    assert training.cooccurrence_loss(d, pmi).first()[0] == pytest.approx(-1.5)
    assert training.cooccurrence_loss(d.limit(0), pmi).first()[0] == 0.0
    x = spark.createDataFrame([(0.9, 1.0, 0.8, 0.9, 1.0, 0.7), (0.4, 0.0, 0.2, 0.2, 0.2, 0.2), (1.0, 0.0, 0.5, 0.1, 0.3, 0.3)], "score double, label double, morph double, struct double, semantic double, lexical double")
    r = training.correctness_loss(x).first()
    assert r.l_binary == pytest.approx((-math.log(0.9) - math.log(0.6) + 100) / 3) and r.l_margin == 0
    assert r.total == pytest.approx(r.l_binary + 0.1 * r.l_consist)
    assert training.correctness_loss(x.where("label = 1")).first().l_margin == 0
    assert training.averaged(x.withColumn("k", F.lit(1)), ["k"], ["score"]).first().score == pytest.approx(2.3 / 3)


def test_verdicts(spark):
    h = spark.createDataFrame([(1, 2.0, 0.5, 0.5, 0.2, 0.0, 100.0, True), (2, 1.0, 0.6, 0.5, 0.3, 0.1, 50.0, True), (3, 0.9, 0.4, 0.5, 0.0, 0.1, 60.0, False)], "epoch int, loss double, mcs double, svs double, sds double, velocity double, root_ppl double, grad_ok boolean")
    r = metrics.loop_verdict(h).first()
    assert (r.loss_falls, r.mcs_holds, r.svs_holds, r.drift_small, r.no_collapse, r.perplexity_falls, r.gradients_sound, r.passed) == (True, False, True, True, True, True, False, 5)
    t = metrics.transfer(spark.createDataFrame([("a", 1.0), ("b", 4.0), ("z", 0.0)], "n string, v double"), "n", "v", {"a": "b", "b": "z"}).collect()
    assert {(x.name, x.ratio) for x in t} == {("a", 0.25), ("b", 0.0)}


def test_ranked(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 50), i) for i in range(2000)]
    got = ranked(spark.createDataFrame(rows, "a int, b int").repartition(5), "n", F.col("a").desc(), F.col("b")).collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.n)] == sorted(rows, key=lambda x: (-x[0], x[1])) and {x.n for x in got} == set(range(1, 2001))


def test_reports(spark):
    p = stored(morphology.parse(seeds.sentences(spark), seeds.lexicon(spark)))
    a = stored(checks.spans(checks.analyse(p)))
    for d in ("semantik", "topologis"):
        assert {v.dimensi for r in reports.of_dimension(a, d).collect() for v in r.pelanggaran} <= {d}
    e = {r.text: r for r in reports.explained(reports.problem_tokens(reports.metadata(a))).collect()}
    b = e["Batu menangis."]
    assert b.token_bermasalah == ["Batu", "menangis"] and "[animasi] 0.85: batu angis" in b.penjelasan and b.avg_degree == 2.0 * b.n_edge / 2
    assert e[""].avg_degree == 0 and e[""].n_iterasi == 0 and e[""].token_bermasalah == []
    w = reports.weakest(a).where("text = 'Batu menangis.'").first()
    assert w.nilai_terlemah == min(w.kepuasan)
    k = stored(reports.knowledge_json(stored(semantics.understand(p))))
    import json

    j = json.loads(k.where("text = 'Budi membeli beras.'").first().pengetahuan)
    assert j["frame_nama"] == "JUAL_BELI" and j["pemahaman"] == 1.0 and len(j["inferensi"]) == 2
    long = reports.head(a.select("skor", "text"), "pakai", lambda d: F.col("skor") > 0.7)
    long = reports.head(long, "panjang", lambda rows: rows["text"].str.len().astype("int64"), "long")
    assert all(r.panjang == len(r.text) and r.pakai == (r.skor > 0.7) for r in long.collect())
    assert reports.info(seeds.lexicon(spark)).first().nama == "umum"


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "satu", "label": 1, "source": "x"}\nnot json\n\n{"text": "dua"}\n{"text": "tiga", "label": "0"}\n{"label": 1}\n')
    got = files.read_labelled(spark, str(tmp_path / "a.jsonl"))
    assert sorted((r.text, r.label, r.source) for r in got.collect()) == [("satu", 1, "x"), ("tiga", 0, "")]
    assert files.read_labelled(spark, str(tmp_path / "a.jsonl"), 1).count() == 1
    files.write_json(got, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
