"""The knowledge base as tables against the fixed rules, and what is added at run time."""

import pytest

from lontar.operators import knowledge, morphology, relations, semantics, storage
from lontar.operators.storage import stored
from lontar.plans import rules as R
from lontar.sources import seeds


@pytest.fixture(scope="module")
def props(spark):
    return stored(semantics.proposition(morphology.parse(seeds.sentences(spark), seeds.lexicon(spark))))


def said(df):
    return {(x.doc_id, x.sent_idx): (x.tipe_agen, x.tipe_pasien, x.tipe_aksi, [tuple(i) for i in x.inferensi or []]) for x in df.select("doc_id", "sent_idx", "tipe_agen", "tipe_pasien", "tipe_aksi", "inferensi").collect()}


@pytest.mark.parametrize("few", [200_000, 0])
def test_the_fixed_base_concludes_as_before(spark, props, monkeypatch, few):
    monkeypatch.setattr(storage, "FEW", few)  # 0: by joins in which frequent words are dealt in pieces
    assert said(knowledge.inferences(props, knowledge.base(spark))) == said(semantics.inferences(props))


def test_rules_words_and_types_added_at_run_time(spark, props):
    kb = knowledge.base(spark)
    kb = knowledge.add_types(kb, spark.createDataFrame([("MAKANAN", "BENDA"), ("BIJI", "MAKANAN")], "tipe string, induk string"))
    kb = knowledge.add_words(kb, spark.createDataFrame([("Beras", "BIJI"), ("budi", "PEJABAT")], "kata string, tipe string"))
    rule = [("MEMBELI_MAKANAN", "transfer", "PEJABAT", "MAKANAN", ["agen MENYIMPAN pasien"], "kuliner", 9)]
    kb = knowledge.add_rules(kb, spark.createDataFrame(rule, "aturan string, aksi string, agen string, pasien string, kesimpulan array<string>, domain string, prioritas int"))
    got = said(knowledge.inferences(props, kb))
    agent, patient, action, inferred = got[1, 0]
    assert (agent, patient, action) == ("PEJABAT", "BIJI", "transfer")
    assert [i[0] for i in inferred] == ["budi MENYIMPAN beras", "beras MEMILIKI beras", "budi TIDAK_LAGI_MEMILIKI beras"]
    n = knowledge.sizes(kb).first()
    assert n.n_aturan == len(R.WORLD_RULES) + 1 and n.n_entitas == len(R.ENTITY_TYPES) + 2
    assert knowledge.rules_for(kb, "transfer").count() == 2
    fact = {(x.subjek, x.relasi, x.objek): x.n for x in knowledge.facts(knowledge.inferences(props, kb)).collect()}
    assert fact["budi", "MENYIMPAN", "beras"] >= 1


def test_types_in_a_circle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("x", "x"), (None, "a")], "tipe string, induk string")
    got = {tuple(r) for r in knowledge.closure(edges).collect()}
    ring = {(p, q) for p in "abc" for q in "abc"}
    assert got == ring | {("d", q) for q in "abcd"} | {("x", "x")}
    pairs = spark.createDataFrame([("d", "c"), ("a", "d"), ("new", "new")], "tipe string, supertipe string")
    assert {(r.tipe, r.supertipe): r.adalah for r in knowledge.is_subtype(pairs, knowledge.closure(edges)).collect()} == {("d", "c"): True, ("a", "d"): False, ("new", "new"): True}


def test_relations(spark):
    lex = spark.createDataFrame([("beras", "n", "kuliner", 0), ("uang", "n", "ekonomi", 1), ("nasi", "n", "kuliner", 2), ("hakim", "n", "hukum", 3)], "kata string, kelas string, domain string, seq int")
    rel = spark.createDataFrame([("beras", "hiponim", "hakim", 0), ("beras", "sinonim", "uang", 0), ("beras", "antonim", "hakim", 0)] + [("nasi", "sinonim", f"w{i}", i) for i in range(7)], "kata string, jenis string, ke string, urut int")
    rel = relations.add(rel, spark.createDataFrame([("Beras", "sinonim", "nasi"), ("beras", "sinonim", "uang")], "kata string, jenis string, ke string"))
    assert sorted((r.ke, r.urut) for r in relations.of(rel, "beras").where("jenis = 'sinonim'").collect()) == [("nasi", 1), ("uang", 0)]
    words = [("beras", "beras", "N", "n", "kuliner", False, False), ("nasi", "nasi", "N", "n", "kuliner", False, False), ("entah", "entah", "?", None, None, False, False)]
    v = {r.teks: r.vektor for r in relations.vectors(spark.createDataFrame(words, "teks string, root string, kelas string, pos string, domain string, serapan boolean, proper boolean"), lex, rel).collect()}
    at = R.DOMAINS.index
    # uang and nasi come before hakim: synonyms first
    assert [round(v["beras"][at(d)], 6) for d in ("kuliner", "ekonomi", "hukum")] == [round(1 / 1.6, 6), round(0.3 / 1.6, 6), round(0.3 / 1.6, 6)]
    assert v["beras"][-1] == 0.8 and v["nasi"][-1] == 0.6 and v["entah"][-1] == 0.2 and not any(v["entah"][:20]) and len(v["nasi"]) == 31
