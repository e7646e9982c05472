"""Pairs counted by buckets give what joins on the words give."""

import pytest
from pyspark.sql import functions as F

from lontar.operators import metrics, pairs, training

TEXTS = [(1, "a b c a b 0 d a b"), (2, "A b x y 0 a 0 b z"), (2, "b a b c c c a"), (3, None), (4, ""), (5, "é b é b ß"), (None, "a b a b"), (6, " ".join(f"w{i % 7} w{i % 5}" for i in range(300)))]


@pytest.fixture
def texts(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SLICES", 2)
    monkeypatch.setattr(pairs, "LEAST", 3)
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)


def _joined(monkeypatch, f):
    with monkeypatch.context() as m:
        m.setattr(pairs, "MOST", 0)
        return f()


def test_pairs_by_buckets_are_those_of_joins(texts, monkeypatch):
    rows = lambda: sorted((r.a, r.b, r.n, round(r.pmi, 9)) for r in training.pmi(texts).collect())
    old = _joined(monkeypatch, rows)
    assert rows() == old and len(old) > 10
    monkeypatch.setattr(pairs, "BLOCK", 5)  # texts of more words than are counted at once
    assert rows() == old


def test_scores_by_their_own_pairs(texts, monkeypatch):
    ids = texts.select("doc_id", training.words(F.col("text")).alias("ids"))
    p = _joined(monkeypatch, lambda: training.pmi(texts).localCheckpoint())
    loss, coherence = training.cooccurrence_loss(ids, p).first()[0], metrics.coherence(ids, p).first()[0]
    assert loss < 0 < coherence
    for top in (2, 1024):  # with pairs of frequent words alone, and with all
        monkeypatch.setattr(pairs, "TOP", top)
        assert training.own_cooccurrence_loss(texts).first()[0] == pytest.approx(loss, abs=1e-9)
        assert training.own_coherence(texts).first()[0] == pytest.approx(coherence, abs=1e-9)
    none = texts.where("doc_id = 3")
    assert training.own_cooccurrence_loss(none).first()[0] == 0 == training.own_coherence(none).first()[0]


def test_pairs_of_many_words_are_numbered_too(texts, monkeypatch):
    assert pairs.MOST > 20_000_000  # 6 GB of documents have some 17 million words
    by = lambda: sorted((r.id, round(r.s, 9), r.n) for r in pairs.by_text(pairs.numbered(texts.select(training.words(F.col("text")).alias("ids")))).collect())
    old = by()
    monkeypatch.setattr(pairs, "NARROW", 1)  # numbers of so many words that a text's place has no room beside them
    monkeypatch.setattr(pairs, "TOP", 2)
    assert by() == old and old
