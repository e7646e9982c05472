"""Tags, heads, masks and ids against values derived by hand; the dictionary store against plain Python."""

import collections

import pytest
from pyspark.sql import functions as F

from lontar.operators import dependency, dictionary, morphology

KEY = ["s"]


def rows(spark, texts):
    return dependency.token_rows(spark.createDataFrame(list(enumerate(texts)), "s int, text string"), KEY)


def test_tokens_and_tags(spark):
    d = rows(spark, ["Dan yang di dia, sedang itu para 123!", None, "", "  a\u00a0b "])
    got = {s: [r.token for r in sorted(d.where(F.col("s") == s).collect(), key=lambda r: r.idx)] for s in range(4)}
    assert got == {0: ["Dan", "yang", "di", "dia", ",", "sedang", "itu", "para", "123", "!"], 1: [], 2: [], 3: ["a", "b"]}
    t = {r.token: r.tag for r in dependency.tags(d, KEY).collect()}
    assert [t[w] for w in ("Dan", "yang", "di", "dia", "sedang", "itu", "para", "123")] == ["CONJ", "REL", "P", "PRON", "ADV", "DET", "DET", "NUM"]


def by_hand(tokens, tags):
    """Heads, token by token."""
    n = len(tokens)
    find = lambda places, ts: next((j for j in places if tags[j] in ts), None)
    root = next((i for i in range(n) if tags[i] == "V" and tokens[i].lower() not in ("adalah", "merupakan", "ialah", "yakni", "yaitu")), None)
    for ts in (("V",), ("N", "PRON")):
        root = find(range(n), ts) if root is None else root
    root = root or 0
    out = []
    for i in range(n):
        left, right, t = range(i - 1, -1, -1), range(i + 1, n), tags[i]
        if i == root:
            h = -1
        elif t in ("N", "PRON"):
            h = find(range(min(i, root) + 1, max(i, root)), ("P",))
        elif t == "ADJ":
            h = find(left, ("N", "PRON"))
            h = find(right, ("N",)) if h is None else h
        elif t == "ADV":
            near = [j for k in range(1, n) for j in (i - k, i + k) if 0 <= j < n and tags[j] == "V"]
            h = near[0] if near else None
        elif t == "P":
            h = find(left, ("V",))
        elif t == "DET":
            h = find(left, ("N", "PRON", "ADJ")) if tokens[i].lower() in ("ini", "itu", "tersebut") else find(right, ("N", "PRON"))
        elif t == "NUM":
            h = find(right, ("N",))
            h = find(left, ("N",)) if h is None else h
        elif t == "CONJ":
            h = i + 1 if i + 1 < n else None
        elif t == "REL":
            h = find(left, ("N", "PRON"))
        elif t == "V":
            h = root
        else:
            h = i - 1 if i else None
        out.append(root if h is None else h)
    return out


TEXTS = ["anak membaca buku", "para siswa", "Dia pergi ke pasar dan sekolah itu", "buku ini adalah buku yang sangat mahal", "yang", "di atas tiga meja besar dia sedang menulis surat untuk guru tersebut .", "dan", "tiga",
         "cepat sekali para anak itu berlari karena hujan turun di sana , lalu mereka pulang"]


def test_heads(spark):
    d = dependency.heads(dependency.tags(rows(spark, TEXTS), KEY), KEY).collect()
    by = collections.defaultdict(list)
    for r in sorted(d, key=lambda r: (r.s, r.idx)):
        by[r.s].append(r)
    assert [r.head for r in by[0]] == [1, -1, 1]
    for s, xs in by.items():
        assert [r.head for r in xs] == by_hand([r.token for r in xs], [r.tag for r in xs]), TEXTS[s]


def test_mask_is_symmetric_with_self_loops(spark):
    m = collections.defaultdict(set)
    for r in dependency.mask(rows(spark, TEXTS), KEY, 6).collect():
        m[r.s].add((r.i, r.j))
    for s, pairs in m.items():
        n = min(6, len(TEXTS[s].split()))
        assert {(i, i) for i in range(n)} <= pairs == {(j, i) for i, j in pairs} and max(max(p) for p in pairs) < 6


def test_encode(spark):
    vocab = spark.createDataFrame([("<PAD>", 0), ("<UNK>", 1), ("jalan", 7), ("rumah", 8), ("X", 9)], "token string, id int")
    r = dependency.encode(rows(spark, ["berjalan rumah X x"]), KEY, vocab, 6).first()
    assert r.morpheme_ids == [7, 8, 9, 1, 0, 0] and r.affix_ids[:2] == [2 + morphology.R.PREFIXES2.index("ber"), 1] and r.raw_tokens == ["berjalan", "rumah", "X", "x"]
    assert r.affix_confidences[4:] == [0.0, 0.0] and dependency.encode(rows(spark, ["a b c"]), KEY, vocab, 2).first().morpheme_ids == [1, 1]


def test_context_decides_between_classes(spark):
    counts = spark.createDataFrame([("bisa", "n", 2, 1), ("bisa", "v", 2, 2), ("ular", "n", 1, 3), ("cepat", "adv", 1, 4)], "lemma string, pos string, freq long, first long")
    d = dependency.tags(rows(spark, ["bisa bisa", "dan bisa"]), KEY, counts)
    assert {(r.s, r.idx, r.tag) for r in d.collect()} == {(0, 0, "N"), (0, 1, "N"), (1, 0, "CONJ"), (1, 1, "N")}
    low = spark.createDataFrame([("bisa", "v", 2, 1), ("bisa", "n", 2, 2), ("bisa", "p", 3, 3), ("n", "n", 1, 4)], "lemma string, pos string, freq long, first long")
    assert {r.tag for r in dependency.tags(rows(spark, ["bisa"]), KEY, low).collect()} == {"P"}


def test_dictionary(spark):
    e = spark.createDataFrame([(" Makan ", "v", "mengunyah", 0), ("rumah", "n", None, 1), ("makan", "n", "", 2), ("", "n", "x", 3), (None, "n", "x", 4), ("makan", "v", "menelan", 5), ("air", None, "cairan", 6)], "lemma string, pos string, definition string, seq int")
    got = {r.lemma: (r.id, r.pos, r.n_entries, r.definitions) for r in dictionary.load(e).collect()}
    assert got == {"makan": (1, "v", 3, ["mengunyah", "menelan"]), "rumah": (2, "n", 1, []), "air": (3, "unk", 1, ["cairan"])}
    assert {r.lemma for r in dictionary.load(e, 3).collect()} == {"makan", "rumah"}
    assert {r.lemma: r.pos_list for r in dictionary.top_classes(dictionary.classes(e)).collect()}["makan"] == ["v", "n"]
    store = dictionary.load(e)
    words = spark.createDataFrame([("Rumah",), ("mkn",), ("rumahh",), ("zzz",), ("ayer",)], "word string")
    slang = spark.createDataFrame([("mkn", "makan"), ("ayer", "air laut")], "informal string, formal string")
    found = {r.word: (r.lemma, r.id, round(r.confidence, 3)) for r in dictionary.lookup(words, store, slang).collect()}
    assert found == {"Rumah": ("rumah", 2, 1.0), "mkn": ("makan", 1, 1.0), "rumahh": ("rumah", 2, round(10 / 11, 3)), "zzz": (None, 0, 0.0), "ayer": (None, 0, 0.0)}
    assert {r.word for r in dictionary.lookup(words, store, slang, 0.9).where("id > 0").collect()} == {"Rumah", "mkn"}
    assert {r.word: r.known for r in dictionary.contains(words, store).collect()} == {"Rumah": True, "mkn": False, "rumahh": False, "zzz": False, "ayer": False}
    vocab = spark.createDataFrame([("<PAD>", 0), ("makan", 4), ("zzz", 5)], "token string, id int")
    m = dictionary.vocabulary_map(vocab, store)
    c = dictionary.coverage(m, spark.createDataFrame([("makan", 3), ("lain", 1)], "token string, freq long")).first()
    assert (c.vocab_size, c.hits, c.initial_coverage, c.runtime_coverage) == (2, 1, 0.5, 0.75)
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "lemma_id long, vector array<double>")
    t = spark.createDataFrame([(4,), (5,)], "id int")
    for size, want in ((2, [1.0, 2.0]), (3, [1.0, 2.0, 3.0]), (7, [1.0, 2.0, 3.0, 1.0, 2.0, 3.0, 1.0])):
        assert {r.id: r.anchor for r in dictionary.anchors(t, m, v, size).collect()} == {4: want, 5: None}


def test_load_vocabulary(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"meta": {}, "vocab": {"<UNK>": 1, "makan": 9}}')
    (tmp_path / "b.json").write_text('{"makan": 9, "<EOS>": 3}')
    want = {"<PAD>": 0, "<UNK>": 1, "<BOS>": 2, "<EOS>": 3, "makan": 9}
    for name in ("a", "b"):
        assert {r.token: r.id for r in morphology.load_vocabulary(spark, str(tmp_path / f"{name}.json")).collect()} == want


@pytest.mark.parametrize("text, root, affix", [("berjalan", "jalan", "ber"), ("makanan", "makan", "an"), ("rumah", "rumah", "<NONE>")])
def test_best(spark, text, root, affix):
    r = morphology.best(spark.createDataFrame([(text,)], "word string")).first()
    assert (r.root, r.affix) == (root, affix)


def test_heads_and_masks_without_shuffles_are_those_of_windows(spark):
    from lontar.operators import morphology
    from pyspark.sql import functions as F

    words = "kucing saya makan ikan di rumah besar dan adalah itu ini yang sangat cepat tiga 3,5 berlari memakan dari ke anjing, tidak . ! bermain Σας İndi ekologi makanan".split()
    rows = [(i // 9, i % 9, " ".join(words[(i * 7 + k * k * (i % 5 + 1)) % len(words)] for k in range(i % 60))) for i in range(300)] + [(None, 1, " ".join(words)), (77, None, "makan ikan besar")]
    s = spark.createDataFrame([*rows, (99, 0, " ".join(words * 5)), (99, 1, None)], "doc_id long, sent_idx int, text string")
    key = ["doc_id", "sent_idx"]
    old = dependency.tags(dependency.token_rows(s, key), key)
    same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert same(dependency.heads(old, key).select(*key, "idx", "tag", "head"), dependency.sentence_heads(s, key))
    pairs = dependency.mask(dependency.token_rows(s, key), key).groupBy(*key).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("i").cast("long").alias("places"))
    assert same(pairs, dependency.mask_sums(s, key)) and dependency.mask_sums(s, key).where("doc_id = 99").first().n_pairs > 1000
    tags = spark.createDataFrame([(w.lower(),) for w in words], "w string").select("w", morphology.tag_of(F.col("w")).alias("t")).collect()
    assert [morphology.plain_tag(r.w) for r in tags] == [r.t for r in tags]
