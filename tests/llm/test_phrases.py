"""Importance resampling, the Jaccard join and collocations against brute force over hard rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lontar.llm import collocations, resampling, setjoin

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def rows_of(df):
    return sorted((tuple(x) for x in df.collect()), key=str)


# ---- resampling ---------------------------------------------------------------------------------------------------------
def brute_weights(docs, target, orders):
    def feats(t):
        w = WORD.findall(lower(t))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x))
    for _, x in target:
        t.update(feats(x))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    out = []
    for i, x in docs:
        f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(WORD.findall(lower(x))), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    return out


def hard_docs(seed):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(40)] + ["École", "été", "漢字"]
    docs = [(i, " ".join(r.choice(voc).upper() if r.random() < 0.2 else r.choice(voc) for _ in range(r.randint(0, 60)))) for i in range(80)]
    return docs + [(80, None), (81, ""), (82, " \t\n"), (7, docs[7][1]), (7, docs[7][1]), (8, "w1 w2"), (None, docs[9][1]), (None, docs[10][1]), (83, "w1 w3 . " * 30000)]


@pytest.mark.parametrize("orders", [1, 3])
def test_resampling(spark, orders):
    docs, target = hard_docs(orders), [(i, t) for i, t in hard_docs(9)[:10]] + [(0, None), (0, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("pos", F.lit("clash")).withColumn("bucket", F.lit(1)).withColumn("score", F.lit("x")).repartition(3)
    b = spark.createDataFrame(target, "item_id long, text string").withColumn("t", F.lit("clash"))
    want = brute_weights(docs, target, orders)
    got = resampling.draw(resampling.weigh(d, b, orders))
    assert rows_of(got.drop("rank")) == sorted(want, key=str)
    fit = [x for x in want if x[1] >= 20]
    many = len(fit) // 10
    ranked = sorted(got.where("rank IS NOT NULL").collect(), key=lambda x: x.rank)
    assert [x.rank for x in ranked] == list(range(1, many + 1))
    best = sorted(fit, key=lambda x: (-x[4], math.inf if x[0] is None else x[0], x[2]))[:many]
    assert [(x.doc_id, x.score) for x in ranked] == [(x[0], x[4]) for x in best]
    kept = resampling.sample(d, b, orders=orders)
    assert kept.columns == d.columns and kept.count() >= many


def test_resampling_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(resampling.report(d, none).drop("rank", "score"))[0][:2] == (1, 3) and resampling.report(d.limit(0), d).count() == 0


# ---- Jaccard join -------------------------------------------------------------------------------------------------------
def brute_groups(docs):
    sets = []
    for _, t in docs:
        w = lower(t).encode().split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))]


def copies(seed, n=60):
    """Base texts, copies with words changed, chains of copies of copies, short texts, a common passage."""
    r = random.Random(seed)
    voc = [f"v{i}" for i in range(300)]
    line = " ".join(r.choice(voc) for _ in range(30))
    docs = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.3 or not docs:
            t = " ".join(r.choice(voc) for _ in range(r.choice([1, 2, 3, 4, 5, 8, 20, 40, 80])))
        elif kind < 0.4:
            t = line + " " + " ".join(r.choice(voc) for _ in range(r.randint(0, 6)))
        else:
            w = r.choice(docs).split()
            for _ in range(r.choice([0, 1, 1, 1, 2])):
                w[r.choice([0, -1, r.randrange(len(w))])] = r.choice(voc).upper()
            t = " ".join(w[r.randint(0, 1) :]) or "v1"
        docs.append(t)
    return docs


@pytest.mark.parametrize("seed,piece,fetch", [(0, 1000, 10**6), (1, 3, 0), (2, 2, 10**6), (3, 1000, 0)])
def test_join(spark, monkeypatch, seed, piece, fetch):
    monkeypatch.setattr(setjoin, "PIECE", piece)
    monkeypatch.setattr(setjoin, "FETCH", fetch)
    texts = copies(seed, 150)
    ids = random.Random(seed).sample(range(1000), len(texts))
    docs = list(zip(ids, texts)) + [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "one"), (2004, "ONE"), (2005, "é x"), (2006, "É x"), (None, texts[0]), (None, "only null"), (3, texts[5]), (3, texts[5]), (3, texts[9]),
                                    (2007, "long text of words " * 20000), (2008, "text of words long " * 20000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("g", F.lit(0)).repartition(5)
    got = setjoin.report(d)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows_of(got) == sorted(brute_groups(docs), key=str)


def test_join_of_a_hot_group(spark, monkeypatch):
    """A third of all rows are unlike copies of one text; a line is in all of them. Star, chain and ring are joined whole."""
    monkeypatch.setattr(setjoin, "PIECE", 8)
    r = random.Random(5)
    voc = [f"v{i}" for i in range(2000)]
    base = [r.choice(voc) for _ in range(120)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(1, 4)):
            w[r.randrange(len(w))] = r.choice(voc)
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join(base[:30] + [r.choice(voc) for _ in range(r.randint(2, 200))])) for i in range(150)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows_of(setjoin.report(d)) == sorted(brute_groups(docs), key=str)


def test_join_of_nothing_and_string_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert setjoin.report(none).count() == 0
    d = spark.createDataFrame([("b", "a b c d e f g h"), ("a", "A b c d e f g h"), ("c", None)], "doc_id string, text string")
    assert rows_of(setjoin.report(d)) == [("a", 5, "a"), ("b", 5, "a"), ("c", 0, "c")]


# ---- collocations -------------------------------------------------------------------------------------------------------
def brute_phrases(docs, longest, least, top):
    f, n = Counter(), Counter()
    for lang, t in docs:
        lang = "und" if lang is None else lang
        for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(t)):
            w = re.findall(r"[^ \t]+", p)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = {}
    cand = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    for (lang, g), a in cand.items():
        inside = any(b >= a and y[0] == lang and len(y[1]) > len(g) and any(y[1][i : i + len(g)] == g for i in range(len(y[1]) - len(g) + 1)) for y, b in cand.items())
        if not inside:
            s, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out.setdefault(lang, []).append((-s, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for i, (s, a, p, x, y) in enumerate(sorted(v)[:top])]


@pytest.mark.parametrize("seed,longest,flush", [(0, 5, 1 << 21), (1, 5, 50), (2, 2, 50), (3, 3, 1 << 21)])
def test_collocations(spark, monkeypatch, seed, longest, flush):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(12)] + ["École", "été", "漢字", "a\x1cb", "\x00", "z z", " "]
    docs = []
    for i in range(120):
        w = []
        for _ in range(r.randint(0, 30)):
            w += [r.choice(voc).upper() if r.random() < 0.1 else r.choice(voc)] if r.random() < 0.7 else ["of", "the", "fixed", "phrase", "here"][: r.randint(2, 5)]
        docs.append((r.choice(["en", "fr", None, "und", ""]), "".join(x + r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for x in w)))
    docs += [("en", None), (None, None), ("en", ""), ("de", "..!\n"), ("fr", "der der der der der"), ("fr", "der der der der der"), ("en", "very long text, " * 20000)]
    d = spark.createDataFrame(docs, "lang string, text string").withColumn("f", F.lit("clash")).withColumn("phrase", F.lit(0)).withColumn("n", F.lit("x")).repartition(3)
    monkeypatch.setattr(collocations, "LEAST", 5)
    s = collocations.scored(d, longest, 5)
    want = sorted(brute_phrases(docs, longest, 5, 10**9))
    got = sorted((x.lang, x.phrase, x.a, x.l, x.r, x.n, x.score) for x in s.collect())
    assert got == sorted((x[0], x[2], x[3], x[4], x[5], x[6], x[7]) for x in want)


def test_collocations_ranks_and_wide_products(spark):
    docs = [("en", "a b. " * 100 + "c d e, " * 100), ("en", "a b " * 3), (None, "x y! " * 100)] * 3
    d = spark.createDataFrame(docs, "lang string, text string")
    got = sorted(tuple(x) for x in collocations.report(d).collect())
    assert got == sorted(brute_phrases(docs, 5, 100, 2000))
    assert [x[1] for x in got if x[0] == "en"] == [1, 2]
    assert collocations.report(d.limit(0)).count() == 0
    big = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_001, 8_999_999_999_999, 12_345_678_901_234_567)], "a long, l long, r long, n long")
    q = big.selectExpr("(CAST(a * 1000 AS decimal(19,0)) * CAST(n AS decimal(18,0))) div (CAST(l AS decimal(18,0)) * CAST(r AS decimal(18,0))) AS s").first().s
    assert q == 1000 * 9_000_000_000_000 * 12_345_678_901_234_567 // (9_000_000_000_001 * 8_999_999_999_999)
