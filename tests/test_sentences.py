"""Parses and checks of the seed sentences against values derived by hand from the rules."""

import pytest
from pyspark.sql import functions as F

from lontar.config import Config
from lontar.operators import checks, morphology, semantics
from lontar.operators.storage import stored
from lontar.sources import seeds


@pytest.fixture(scope="module")
def lexicon(spark):
    return stored(seeds.lexicon(spark))


@pytest.fixture(scope="module")
def parsed(spark, lexicon):
    return stored(morphology.parse(seeds.sentences(spark), lexicon))


@pytest.fixture(scope="module")
def analysed(parsed):
    return {r.text: r for r in stored(checks.spans(checks.analyse(parsed))).collect()}


@pytest.fixture(scope="module")
def understood(parsed):
    return stored(semantics.understand(parsed))


def brief(row):
    return [(t.teks, t.root, t.kelas, t.peran) for t in row.tokens]


def test_golden_parse(parsed):
    r = {x.text: x for x in parsed.collect()}
    assert brief(r["Budi membeli beras."]) == [("Budi", "budi", "N", "S"), ("membeli", "beli", "V", "P"), ("beras", "beras", "N", "O")]
    assert [a.bentuk for a in r["Budi membeli beras."].tokens[1].afiks] == ["me-"]
    assert brief(r["Hakim menjatuhkan hukuman kepada terdakwa."])[1:] == [("menjatuhkan", "jatuh", "V", "P"), ("hukuman", "hukuman", "N", "O"), ("kepada", "kepada", "Prep", "?"), ("terdakwa", "terdakwa", "N", "K")]
    # a preposition of the closed list has its role already, so its noun is placed by position
    assert brief(r["Dia membeli sayuran di pasar."])[-1] == ("pasar", "pasar", "N", "Pel")
    assert brief(r["Anak-anak makan nasi."])[0] == ("Anak-anak", "anak", "N", "S")
    assert brief(r["Meeting itu besar."])[0][2] == "N_serapan"
    assert [t.teks for t in r["Café itu menjual naïve beras."].tokens] == ["Caf", "itu", "menjual", "nave", "beras"]
    assert r[""].tokens == [] and r["?!..."].tokens == []


def test_whole_words_and_derivations(parsed):
    r = {t.teks: t for x in parsed.collect() for t in x.tokens}
    assert r["membersihkan"].root == "membersihkan"  # its class differs from its root's
    assert r["pengamanan"].root == "pengamanan"
    assert r["Presiden"].proper is False and r["mengirim"].afiks[0].valid is False


def test_golden_scores(analysed):
    r = analysed["Budi membeli beras."]
    assert len(r.edges) == 5 and {e.rel for e in r.edges} == {"adjacent", "subj-pred", "pred-obj"}
    assert r.e_semantik == pytest.approx(0.058946, abs=1e-6)
    assert r.energi == pytest.approx(0.043229, abs=1e-6)
    assert (r.betti0, r.betti1, r.n_sisi, r.n_segitiga, r.anomali) == (1, 1, 3, 1, False)
    assert r.rata_kepuasan == pytest.approx(0.956842, abs=1e-6) and r.skor == pytest.approx(0.731650, abs=1e-6)
    assert r.ringkasan == "[VALID] skor=0.732 energi=0.043 pelanggaran=1 morfem=3"
    assert r.n_morfisme == 5 and r.n_rusak == 0


@pytest.mark.parametrize("text", ["", "?!..."])
def test_empty_sentences(analysed, text):
    r = analysed[text]
    assert r.ringkasan == "[VALID] skor=0.375 energi=0.000 pelanggaran=0 morfem=0" and r.lengkap == 0 and r.register == "formal"


def test_violations(analysed):
    kinds = lambda t: {(v.tipe, tuple(v.tokens), round(v.severitas, 2)) for v in analysed[t].pelanggaran}
    assert ("animasi", ("batu", "angis"), 0.85) in kinds("Batu menangis.")
    assert ("sintaktis", ("sangat", "makanan"), 0.7) in kinds("Makanan itu sangat lezat.")
    assert ("sintaktis", ("oleh", "Budi"), 0.8) in kinds("Oleh Budi dibeli beras.")
    assert {("topologis", ("di",), 0.8), ("topologis", ("di",), 0.9)} <= kinds("Di beli beras Budi pasar di.")
    assert ("topologis", ("kepada", "dari"), 0.7) in kinds("Surat kepada dari terdakwa.")
    assert ("semantik", ("kepada", "vonis"), 0.75) in kinds("Hakim memberi hukuman kepada vonis.")
    assert ("komposisi", ("antara lain",), 0.9) in kinds("Jenis tarian antara lain saman.")
    assert not {k for k in kinds("Tari itu indah, antara lain tari saman dan tari besar.") if k[0] == "komposisi"}


def test_direction_of_unequal_distances(analysed):
    assert analysed["Uang hukum sekolah."].betti0 == 1 and analysed["Hukum sekolah uang."].betti0 == 2
    assert analysed["Hukum sekolah uang."].terpencil == ["uang"]


def test_spans_point_into_the_text(analysed):
    for text, r in analysed.items():
        for s in r.spans:
            assert text[s.mulai : s.akhir] == s.token
        assert [s.mulai for s in r.spans] == sorted(s.mulai for s in r.spans)


def test_verb_object_clash(spark, lexicon):
    s = spark.createDataFrame([(1, 0, "Dia masak mobil.")], "doc_id long, sent_idx int, text string")
    p = morphology.parse(s, lexicon)
    r = checks.composition(checks.edges(p)).first()
    assert [(list(v.tokens), v.severitas) for v in r.komposisi] == [(["masak", "mobil"], 0.7)]
    r = checks.composition(checks.edges(p), Config.preset("militer")).first()
    assert r.komposisi == []


def test_presets():
    assert Config.preset("medis").name == "kesehatan" and Config.preset("bisnis").threshold == 2.0
    assert "gugat" in Config.preset("hukum").neutral and Config.preset("lain").threshold == 1.5
    assert "alat_musik" in Config(extra_incompatible={"hukum": ["alat_musik"]}).incompatible["hukum"]


def test_golden_understanding(understood):
    r = {x.text: x for x in understood.collect()}
    b = r["Budi membeli beras."]
    assert (b.prop.aksi, b.prop.AGEN.nilai, b.prop.PASIEN.nilai, b.prop.kelengkapan) == ("beli", "Budi", "beras", 0.75)
    assert (b.frames[0].nama, b.frames[0].skor, b.pemahaman) == ("JUAL_BELI", 1.0, 1.0)
    assert [(i.pernyataan, i.keyakinan) for i in b.inferensi] == [("beras MEMILIKI beras", 0.75), ("budi TIDAK_LAGI_MEMILIKI beras", 0.75)]
    assert r["Guru tidak mengajar siswa."].prop.polaritas is False and r["Guru tidak mengajar siswa."].inferensi == []
    v = r["Hakim menjatuhkan hukuman kepada terdakwa."]
    assert v.prop.PENERIMA.root == "terdakwa" and "terdakwa STATUS_MENJADI terpidana" in [i.pernyataan for i in v.inferensi]
    assert r["Beras dibeli oleh Budi di pasar."].prop.PASIEN.root == "beras"
    assert r[""].prop is None and r[""].frames == [] and r[""].pemahaman == 0


def test_references(understood):
    rows = semantics.references(understood).collect()
    assert ("Dia", "budi") in {(r.anafor, r.root) for r in rows if r.doc_id == 1}
    assert all(r.keyakinan in (0.85, 0.70, 0.80) for r in rows)
    again = {tuple(r) for r in semantics.references(understood.repartition(7)).collect()}
    assert again == {tuple(r) for r in rows}


def test_ask(understood):
    assert {(r.subjek, r.objek) for r in semantics.ask(understood, "TIDAK_LAGI_MEMILIKI", "BUDI").collect()} == {("budi", "beras")}


def test_context_forgets_the_sixth_proposition():
    ent = lambda r: {"nilai": r, "root": r, "domain": None, "agen": True}
    context = [[], []]
    ref = [{"teks": "dia", "orang": True, "yakin": 0.85}]
    for r in ["a", "b", "c", "d", "e"]:
        semantics.resolve_step(context, [], [ent(r)], True)
    assert semantics.resolve_step(context, ref, [ent("a")], True)[0][1] == "e"
    assert [e["root"] for e in context[0]] == ["b", "c", "d", "e"]  # evicting by root takes the new "a" too


def test_repartitioning_changes_nothing(spark, lexicon, parsed):
    s = seeds.sentences(spark)
    a = {(r.doc_id, r.sent_idx): brief(r) for r in parsed.collect()}
    b = {(r.doc_id, r.sent_idx): brief(r) for r in morphology.parse(s.repartition(5, F.rand(3)), lexicon).collect()}
    assert a == b


def test_likeness_is_the_cosine_of_vectors(parsed):
    t = parsed.select(F.explode("tokens").alias("t")).distinct()
    pairs = t.crossJoin(t.select(F.col("t").alias("u")))
    r = pairs.agg(F.max(F.abs(checks.cosine(checks.vector(F.col("t")), checks.vector(F.col("u"))) - checks._likeness(checks._features(F.col("t")), checks._features(F.col("u"))))), F.count("*")).first()
    assert r[0] < 1e-12 and r[1] > 1000
    w = parsed.sparkSession.createDataFrame([(x,) for x in ["beli", "membeli", "eli", "", None, "belian", "Membeli"]], "w string")
    assert [x[0] for x in w.select(checks._neutral(F.col("w"), {"beli", "jual"})).collect()] == [True, True, False, False, None, False, True]
