"""Cleaning, deduplication, validation, vocabularies, second morphology, training data, metrics."""

import json

import pytest
from pyspark.sql import functions as F

from lontar.operators import corpus, lexicon, metrics, morphology, training, vocabulary
from lontar.sources import seeds


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first().x


@pytest.mark.parametrize("text, out", [
    ("saya makan nasi di rumah", "saya makan nasi di rumah"), ("kunjungi https://example.com untuk info lebih", "kunjungi untuk info lebih"), ("teks <b>tebal</b> dan biasa ini", "teks tebal dan biasa ini"),
    ("teks ini[1] punya referensi[2] gaya wiki", "teks ini punya referensi gaya wiki"), ("ya oke", None), ("1234 5678 9012 3456", None), ("{{{{{[][][]||||}}}}}", None), ("teks\x00dengan null ini", "teks dengan null ini"), (None, None), ("", None)])
def test_clean(spark, text, out):
    assert one(spark, text, corpus.clean) == out


def test_normalise(spark):
    assert one(spark, "ini\t kalimat!!!! sangat   menarik??? ya......... ", corpus.normalise) == "ini kalimat! sangat menarik? ya..."


def test_settings():
    for bad in ({"min_tokens": 0}, {"min_tokens": 9, "max_tokens": 9}, {"max_digit_ratio": 0}, {"max_garbage_ratio": 1.1}):
        with pytest.raises(ValueError):
            corpus.Settings(**bad)


def brute_near(rows, s):
    kept = {}
    for i, t in sorted(rows):
        words, key = set(t.lower().split()), t.strip().lower()[: s.key_length]
        if all((len(words & w) / len(words | w) if words | w else 1) < s.near_threshold for w in kept.setdefault(key, [])):
            kept[key].append(words)
            yield i


def test_near_dedup(spark):
    base = "satu dua tiga empat lima enam tujuh delapan sembilan sepuluh sebelas dua belas tiga belas"
    rows = [(1, base + " a"), (2, base + " b"), (3, base + " x y z p q r s t"), (4, base + " x y z p q r s u"), (5, "lain"), (6, "lain"), (7, ""), (8, ""), (9, base + " 1 2 3 4 5 6 7 8 9")]
    s = corpus.Settings()
    got = {r.doc_id for r in corpus.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()}
    assert got == set(brute_near(rows, s))


@pytest.mark.parametrize("task_rows", [2000, 40, 1])
def test_near_dedup_of_a_key_with_many_kept_rows(spark, monkeypatch, task_rows):
    monkeypatch.setattr(corpus, "TASK_ROWS", task_rows)
    import random

    r = random.Random(7)
    base = "lisensi " * 8
    texts = [base + " ".join(f"w{r.randrange(60)}" for _ in range(r.randint(0, 25))) for _ in range(260)]
    for t in r.choices(texts, k=140):
        w = t.split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(8, len(w)) if len(w) > 8 else 0] = f"w{r.randrange(60)}"
        texts.append(" ".join(w))
    texts += ["", " "] + [base + f"salinan besar nomor a b c d e f g h {i}" for i in range(60)]
    r.shuffle(texts)
    rows, s = list(enumerate(texts)), corpus.Settings(key_length=40)
    want = set(brute_near(rows, s))
    assert len(want) > 200
    got = corpus.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), s)
    assert {r.doc_id for r in got.collect()} == want


def test_validator(spark, tmp_path):
    lines = ['{"text": "saya makan nasi di rumah", "extra": 1}', '{"content": "tanpa"}', '{"text": 12345}', '{"text": "   "}', "{tidak valid json", "", '{"text": "ya"}', json.dumps({"text": " ".join(["kata"] * 50)}),
             '{"text": "lihat https://a.b sekarang juga"}', '{"text": "ini [[link]] wiki di sini"}', '{"text": "ini <b>x</b> di sini"}', json.dumps({"text": "huruf 😀 di sini"}), json.dumps({"text": "a\x00b c d"})]
    p = tmp_path / "x.jsonl"
    p.write_text("\n".join(lines))
    got = [list(r.codes) for r in corpus.validate_lines(corpus.read_lines(spark, str(p))).collect()]
    assert got == [[], ["MISSING_TEXT"], ["WRONG_TYPE"], ["EMPTY_TEXT"], ["INVALID_JSON"], ["TOO_SHORT"], ["TOO_LONG"], ["CONTAINS_URL"], ["CONTAINS_MARKUP"], ["CONTAINS_MARKUP"], ["OUT_OF_BMP"], ["NULL_BYTE"]]


def test_quality(spark):
    g = spark.createDataFrame([(95.0, "Excellent"), (80.0, "Good"), (65.0, "Fair"), (40.0, "Poor")], "t double, g string").select(corpus.grade(F.col("t")).alias("x"), "g").collect()
    assert all(r.x == r.g for r in g)
    rows = spark.createDataFrame([("saya makan nasi", [])] * 40 + [(f"kalimat berbeda {i}", []) for i in range(10)], "text string, codes array<string>")
    assert corpus.quality(rows).first().diversity < 80 and corpus.dataset_codes(rows).first().codes == ["HIGH_DUPLICATE_RATE", "LOW_DIVERSITY"]
    assert corpus.quality(rows.limit(0)).first().n == 0
    assert corpus.stage_counts(rows.limit(0)).first().rejection_rate == 0


def test_second_morphology(spark):
    w = spark.createDataFrame([(x,) for x in "berjalan makanan jalankan rumah".split()], "word string")
    assert {(r.word, r.root, r.affix) for r in morphology.best(w).collect()} == {("berjalan", "jalan", "ber"), ("makanan", "makan", "an"), ("jalankan", "jalan", "kan"), ("rumah", "rumah", "<NONE>")}
    w = spark.createDataFrame([(x,) for x in "dan yang di dia sedang itu para 123 sekolah membaca".split()], "word string")
    got = {r.word: r.tag for r in morphology.pos_tags(w).collect()}
    assert [got[x] for x in "dan yang di dia sedang itu para 123 membaca".split()] == ["CONJ", "REL", "P", "PRON", "ADV", "DET", "DET", "NUM", "V"]
    known = seeds.lexicon(spark)
    assert {r.word: r.tag for r in morphology.pos_tags(w, known).collect()}["sekolah"] == "N"
    b = {r.word: (r.root, r.affix) for r in morphology.best(spark.createDataFrame([("sekolah",), ("dimakan",)], "word string"), known).collect()}
    assert b == {"sekolah": ("sekolah", "<NONE>"), "dimakan": ("makan", "di")}


def test_vocabulary(spark):
    d = spark.createDataFrame([("makan makan nasi",), ("nasi guru",)], "text string")
    v = morphology.root_vocabulary(d)
    assert [r.token for r in v.orderBy("id").collect()][:4] == ["<PAD>", "<UNK>", "<BOS>", "<EOS>"]
    h = vocabulary.hard_checks(v).first()
    assert (h.empty, h.missing, h.misplaced, h.doubled) == (False, [], [], 0)
    bad = spark.createDataFrame([("<PAD>", 1), ("a", 1)], "token string, id int")
    h = vocabulary.hard_checks(bad).first()
    assert h.misplaced == ["<PAD>"] and h.missing == ["<UNK>", "<BOS>", "<EOS>"] and h.doubled == 1
    t = spark.createDataFrame([(["PASS", "PASS"], "OPTIMAL"), (["WARN", "PASS"], "VALID"), (["FAIL", "WARN"], "DEGRADED"), (["FAIL", "FAIL"], "EXPERIMENTAL")], "s array<string>, t string")
    assert all(r.x == r.t for r in t.select(vocabulary.tier(F.col("s")).alias("x"), "t").collect())
    f = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9), ("d", 20)], "token string, freq long")
    assert vocabulary.median_frequency(f).first().median == 9
    o = vocabulary.oov(spark.createDataFrame([("c",)], "token string"), f).first()
    assert (o.significant, o.missing, o.status) == (2, 1, "FAIL")


def test_dictionary_files(spark, tmp_path):
    shapes = {"a": {"entries": [{"id": 1, "lemma": "Beli", "pos": "v", "clean_definition": "x"}]}, "b": [{"kata": "Beli", "kelas": "v", "domain": ["ekonomi", "y"]}], "c": {"Beli": {"pos": "v", "domain": "ekonomi"}, "nasi": "n"}}
    got = {}
    for k, v in shapes.items():
        (tmp_path / k).write_text(json.dumps(v))
        got[k] = {(r.lemma, r.pos, r.domain) for r in lexicon.read_dictionary(spark, str(tmp_path / k)).collect()}
    assert got == {"a": {("Beli", "v", None)}, "b": {("Beli", "v", "ekonomi")}, "c": {("Beli", "v", "ekonomi"), ("nasi", "n", None)}}


def test_lexicon(spark):
    x = {r.kata: r for r in seeds.lexicon(spark).collect()}
    assert (x["senapan"].domain, x["rumah"].domain, x["toko"].domain, x["musik"].domain) == ("senjata", "bangunan", None, "alat_musik")
    assert (x["pasar"].kelas, x["indah"].kelas, x["kepada"].domain) == ("n", "n", None)
    more = lexicon.add(seeds.lexicon(spark), spark.createDataFrame([("budi", "n", "sosial"), ("baru1", "v", None)], "kata string, kelas string, domain string"))
    y = {r.kata: r.domain for r in more.collect()}
    assert y["budi"] == "sosial" and "baru1" in y and len(y) == len(x) + 1


def test_pmi_against_brute_force(spark):
    import math
    from collections import Counter

    texts = ["a b c a b", "b a d", "c d c d e", "", "a b"]
    tok, pair = Counter(), Counter()
    for t in texts:
        w = t.split()
        tok.update(w)
        for i in range(len(w)):
            pair.update(tuple(sorted((w[i], y))) for y in w[i + 1 : i + 5] if y != w[i])
    n = sum(tok.values())
    want = {k: v for k, c in pair.items() if c >= 2 and (v := math.log(c / n / (tok[k[0]] / n * tok[k[1]] / n + 1e-9) + 1e-9)) > 0}
    got = {(r.a, r.b): r.pmi for r in training.pmi(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == pytest.approx(want)


def test_labels_and_curves(spark):
    assert one(spark, "Dokter memeriksa pasien", training.domain_label) == "memeriksa" and one(spark, "xyz", training.domain_label) == "other"
    assert one(spark, "saya makan", training.has_action) is True and one(spark, "saya", training.has_action) is False
    c = spark.createDataFrame([("k", i, float(i * i)) for i in range(12)], "k string, s int, v double")
    rows = {r.s: r for r in training.ema(training.curve(c, "k", "s", "v"), "k", "s", "v").collect()}
    assert rows[3].trend == 0 and rows[4].trend == pytest.approx(4) and rows[11].recent == pytest.approx(sum(i * i for i in range(2, 12)) / 10)
    e = 0.0
    for i in range(1, 12):
        e = 0.9 * e + 0.1 * i * i
    assert rows[11].ema == pytest.approx(e)


def test_metrics(spark):
    ids = spark.createDataFrame([(1, ["saya", "makan", "nasi"]), (2, ["a", "a", "0"]), (3, [])], "doc_id long, ids array<string>")
    assert metrics.verb_hit_rate(ids, ["makan"]).first()[0] == pytest.approx(1 / 3)
    assert metrics.structure(ids, ["makan"]).first()[0] == pytest.approx(1 / 3)
    assert metrics.diversity(ids).first()[0] == pytest.approx(0.5)
    p = metrics.paired(spark.createDataFrame([(0.9, 1), (0.4, 1), (0.2, 0)], "score double, label int")).first()
    assert (p.accuracy, p.avg_pos, p.separation) == pytest.approx((2 / 3, 0.65, 0.45))
    a = metrics.ablation(spark.createDataFrame([("FULL", 1.0), ("X", 0.9), ("Y", 0.995)], "c string, v double"), "c", "v").collect()
    assert {r.c: r.verdict for r in a} == {"FULL": "reference", "X": "important", "Y": "minor"}
    m = metrics.morphological(spark.createDataFrame([("jalan", "ber"), ("jalan", "ber"), ("jalan", "me"), ("di", "kan")], "root string, affix string"), ["ber", "me", "kan"]).first()
    assert (m.affix_validity, m.root_affix_coherence, m.transform_consistency) == pytest.approx((1.0, 0.75, 2 / 3))
    v = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0]), (1, [0.0, 1.0], [1.0, 0.0]), (2, [1.0, 0.0], [0.0, 0.0])], "e int, vector array<double>, anchor array<double>")
    d = metrics.drift(v, ["e"]).collect()
    assert [(r.e, r.anchor_distance, r.coverage, r.n_tokens) for r in d] == [(1, 0.5, 0.5, 2)]


def test_entry_works_without_the_training_subpackage(spark):
    """The guard of the entry module: with the subpackage missing, the other queries stay."""
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def without(name, *a, **k):
        fromlist = a[2] if len(a) > 2 else k.get("fromlist") or ()
        if name == "corpus_pipeline" or name.startswith("lontar.llm") or (name == "lontar" and "llm" in fromlist):
            raise ImportError(name)
        return real(name, *a, **k)

    kept = {k: sys.modules.pop(k) for k in list(sys.modules) if k in ("__spark_entry__", "corpus_pipeline") or k.startswith("lontar.llm")}
    builtins.__import__ = without
    try:
        e = importlib.import_module("__spark_entry__")
        assert "sentence_scores" in e.queries() and not any(k.startswith("op") for k in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    finally:
        builtins.__import__ = real
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(kept)


def test_dedup_with_null_and_repeated_ids(spark):
    rows = [(None, "only here one two three"), (None, "shared text of four"), (5, "shared text of four"), (5, "another text of four"), (7, "another text of four"),
            (7, "another text of four"), (None, None), (8, None), (None, "only here one two three"), (9, "")]
    for kind, make in (("long", lambda i: i), ("string", lambda i: i if i is None else str(i))):
        d = spark.createDataFrame([(make(i), t) for i, t in rows], f"doc_id {kind}, text string").repartition(3)
        want = sorted([(None, "only here one two three"), (make(5), "shared text of four"), (make(5), "another text of four"), (make(8), None), (make(9), "")], key=str)
        assert sorted(map(tuple, corpus.exact_dedup(d).collect()), key=str) == want
        near = corpus.near_dedup(d.unionByName(spark.createDataFrame([(None, "Only here one two three")], f"doc_id {kind}, text string")))
        # case does not count, nor does a null text match an empty one
        assert sorted(((i, t and t.lower()) for i, t in map(tuple, near.collect()) if i is not None), key=str) == sorted(((i, t) for i, t in want if i is not None), key=str)
        assert [t.lower() for i, t in map(tuple, near.collect()) if i is None] == ["only here one two three"]


def test_composition(spark):
    from lontar.functions.text import composed

    rows = ["Café", "Café", "plain", None, "ﬁsh Ａ b 한", "", "x²"]
    d = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    import unicodedata

    for form in ("NFC", "NFKC"):
        assert {r.i: r.text for r in composed(d, form=form).collect()} == {i: t if t is None else unicodedata.normalize(form, t) for i, t in enumerate(rows)}
    got = corpus.cleaned(spark.createDataFrame([(1, "ＴＨＥ ﬁsh swims fast")], "doc_id int, text string")).first()
    assert got.text == "THE fish swims fast"


def test_run_file(spark, tmp_path):
    import json
    import pathlib

    (tmp_path / "in.txt").write_text("Anak membaca buku di sekolah\nya\nAnak membaca buku di sekolah\nGuru mengajar siswa baru hari ini\n")
    counts = corpus.run_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out")).first()
    rows = [json.loads(x) for p in sorted(pathlib.Path(tmp_path / "out").glob("*.json")) for x in p.read_text().splitlines()]
    assert [r["text"] for r in rows] == ["Anak membaca buku di sekolah", "Guru mengajar siswa baru hari ini"] and rows[0]["meta"] == {"source": "corpus"}
    assert (counts.n_input, counts.n_clean, counts.n_final) == (4, 3, 2)
