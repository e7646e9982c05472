"""Syncmers, toxicity, quality, token counts, language model against brute force, on small hard cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lontar.llm import kernel, lm, quality, syncmers, tokens, toxicity

HARD = [None, "", " ", "a", "a b", "é ü ß 漢字 😀 naïve", "x" * 70000, "word " * 30000, "tab\tnew\nline\x0bfeed\x0c cr\r end", "a b", "The The the THE ÉCOLE école", "<|endoftext|> x <|startoftext|>", "\x00nul\x1fus", "don't we'll I'M 12345 ½ x²"]


def frame(spark, texts, extra=True):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return d.withColumn("score", F.lit("clash")).withColumn("h", F.lit(1)) if extra else d


def test_words_and_hashes():
    a = pa.array(HARD, pa.string())
    seen = {}
    for lo, hi, raw, offs in kernel.chunks(a, 100):
        h, s, e, f = kernel.words(raw, offs)
        for i in range(hi - lo):
            want = (HARD[lo + i] or "").encode().split()
            assert [bytes(raw[x:y]) for x, y in zip(s[f[i] : f[i + 1]], e[f[i] : f[i + 1]])] == want
            for w, x in zip(want, h[f[i] : f[i + 1]]):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_anchors_cover_windows():
    r = np.random.default_rng(1)
    g = r.integers(1, 30, 500).astype(np.uint64)
    at = set(kernel.anchors(g, np.ones(500, bool), 13))
    want = {i + j for i in range(488) for j in range(13) if g[i + j] == g[i : i + 13].min()}
    assert at == want


def brute_syncmers(text, k=syncmers.KMER, s=syncmers.SMER):
    c = syncmers.codes(text).astype(np.uint64) + np.uint64(1)
    sh = lambda i: int(kernel.mix(np.array([sum_hash(c[i : i + s])], np.uint64))[0])
    out = []
    for i in range(len(c) - k + 1):
        h = [sh(i + j) for j in range(k - s + 1)]
        if min(h) in (h[0], h[-1]):
            out.append(i)
    return out


def sum_hash(c):
    h = 0
    for x in c:
        h = (h * 0xF1357AEA2E62A9C5 + int(x)) % (1 << 64)
    return h


def test_syncmers_are_context_free():
    r = random.Random(5)
    t = "".join(r.choice("abcdé ") for _ in range(400))
    at, g = syncmers.syncmers(syncmers.codes(t))
    assert list(at) == brute_syncmers(t)
    whole = dict(zip(at.tolist(), g.tolist()))
    at2, g2 = syncmers.syncmers(syncmers.codes("zz" + t[100:300]))
    assert {(p - 2 + 100, x) for p, x in zip(at2.tolist(), g2.tolist()) if p >= 2} <= set(whole.items())


def mixed(x):
    m = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def brute_anchors(text, k=12, s=5):
    """(place, hash) of the closed syncmers, or of the whole text, one by one."""
    c = [ord(x) + 1 for x in text]
    small = [mixed(sum_hash(c[i : i + s])) for i in range(len(c) - s + 1)]
    out = []
    for i in range(len(c) - k + 1):
        h = small[i : i + k - s + 1]
        if min(h) in (h[0], h[-1]):
            g = 0
            for j in (0, 5, 7):  # s-mers that cover the k-mer
                g = (g * 0xD1342543DE82EF95 + h[j]) % (1 << 64)
            out.append((i, mixed(g)))
    return out or [(0, int.from_bytes(hashlib.blake2b(text.encode("utf-32-le"), digest_size=8).digest(), "little"))] * bool(text)


def brute_fingerprint(anchors):
    g = sorted({h >> 32 for _, h in anchors})
    return g[: max(128, sum(x < 1 << 28 for x in g))]


def brute_likeness(a, b):
    if not a or not b:
        return float(a == b)
    top = [float("inf") if len(x) < 128 else x[-1] if len(x) == 128 and x[-1] >= 1 << 28 else (1 << 28) - 1 for x in (a, b)]
    a, b = ({y for y in x if y <= min(top)} for x in (a, b))
    return len(a & b) / len(a | b)


def brute_aligned(a, b):
    if not a or not b:
        return float(a == b), 0
    pa_, pb = ({h: p for p, h in reversed(x)} for x in (a, b))
    votes = collections.Counter(pb[h] - pa_[h] for h in pa_.keys() & pb.keys())
    if not votes:
        return 0.0, 0
    n, shift = max((n, -s) for s, n in votes.items())
    return n / len(pa_), -shift


def brute_op1(rows, spark):
    th = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, th[x[1] or ""]))
    known = {}
    for i, (k, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1] or ""
        t = t or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        m = [known.setdefault(x, None) or known.__setitem__(x, brute_anchors(x)) or known[x] for x in (t, e, n)]
        f = [brute_fingerprint(x) for x in m]
        digits = ["".join(f"{x:08x}" for x in y) for y in f]
        yield k, len(t), hashlib.sha256(e.encode()).hexdigest(), digits[0], digits[1], brute_likeness(f[0], f[1]), brute_likeness(f[0], f[2]), *brute_aligned(m[0], m[1]), *brute_aligned(m[0], m[2])


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_edit_likeness(spark, parts):
    r = random.Random(parts)
    texts = HARD + ["".join(r.choice("abcdefgh ") for _ in range(r.randint(0, 900))) for _ in range(40)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(0)).repartition(4)
    got = [tuple(x) for x in syncmers.edit_likeness(d, parts).collect()]
    assert sorted(got) == sorted(brute_op1(rows, spark))
    assert syncmers.edit_likeness(d.limit(0)).count() == 0


def test_edit_likeness_one_row_and_ties(spark):
    one = syncmers.edit_likeness(spark.createDataFrame([(7, "abcd")], "doc_id long, text string"))
    assert list(map(tuple, one.collect())) == list(brute_op1([(7, "abcd")], spark))
    rows = [(1, "x" * 30), (1, "y" * 30), (1, "y" * 30), (None, "z" * 9), (2, ""), (None, None)]
    got = syncmers.edit_likeness(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_op1(rows, spark), key=str)
    named = [("b", "first text of all"), ("a", "another text here"), ("c", None)]
    got = syncmers.edit_likeness(spark.createDataFrame(named, "doc_id string, text string"), 2).collect()
    assert sorted(map(tuple, got)) == sorted(brute_op1(named, spark))


def test_anchors_stay_in_place(spark):
    """A passage moved into another text keeps its anchors, at one shift."""
    r = random.Random(8)
    words = [f"{r.randrange(10**6)}" for _ in range(400)]
    a, b = " ".join(words[:200]), " ".join(words[300:] + words[50:150])
    d = spark.createDataFrame([(1, a), (2, b)], "key long, text string")
    got = {1: {}, 2: {}}
    for x in syncmers.anchors(d, "key").collect():
        got[x.key].setdefault(x.hash, x.place)
    shifts = collections.Counter(got[2][h] - got[1][h] for h in got[1].keys() & got[2].keys())
    best = b.index(words[50] + " " + words[51]) - a.index(words[50] + " " + words[51])
    assert shifts.most_common(1)[0][0] == best
    share, shift = syncmers.aligned(*(syncmers.marks(syncmers.codes(x)) for x in (a, b)))
    assert shift == best and 0.4 < share < 0.6


def test_equal_texts_have_equal_fingerprints(spark):
    d = frame(spark, HARD + HARD)
    f = {}
    for r in syncmers.fingerprint(d).collect():
        assert f.setdefault(r.text or "", r.fingerprint) == r.fingerprint
    assert f[""] == ""
    made = lambda t: syncmers.sketch(syncmers.marks(syncmers.codes(t))[1])
    long = " ".join(f"w{i}" for i in range(9000))
    a = made(long)
    assert len(a) > 500 and syncmers.likeness(a, made(long + " more")) > 0.9 > 0.1 > syncmers.likeness(a, made("other " + long[::-1]))
    passage = " ".join(f"w{i}" for i in range(500, 580))
    assert syncmers.likeness(a, made(" ".join(f"v{i * 7}" for i in range(9000)) + passage)) > 0


# ---- toxicity ---------------------------------------------------------------------------------------------------------
def test_fold():
    assert toxicity.fold("You 1d10t, IDI0T! $cum l0ser. 2024 idіot trash-can") == " you idiot idiot scum loser idiot trash can "
    assert toxicity.fold("") == "  " == toxicity.fold("!?  12")


@pytest.mark.parametrize("text, out", [
    *[(f"x{c}y", f" x{d}y ") for c, d in zip("01345789@$!", "oieastbgasi", strict=True)], *[(f"x{c}{c}y", f" x{d}{d}y ") for c, d in zip("01345789@$!", "oieastbgasi", strict=True)],
    ("sh!t id!ot pathet!c", " shit idiot pathetic "), ("you 1d10t, id!ot", " you idiot idiot "), ("/1d10t m0r0n,1d10t so-called-1d10t", " idiot moron idiot so called idiot "),
    ("Stop! \"idiot!\" 99 9! $5 $cum a$$hole @ss", " stop idiot scum asshole ass "), ("x" * 70000 + "-1", " " + "x" * 70000 + " ")])
def test_fold_every_sign(text, out):
    assert toxicity.fold(text) == out


def made(n, seed=1):
    r = random.Random(seed)
    common = ["lorem", "ipsum", "dolor", "sit", "amet", "magna", "aliqua", "tempor", "labore", "irure"]
    for i in range(n):
        w = [r.choice(common) + r.choice(["", "an", "or", "um"]) for _ in range(r.randint(5, 60))]
        bad = int(r.random() < 0.2)
        for _ in range(r.randint(1, 3) * bad):
            w.insert(r.randint(0, len(w)), r.choice(["grubbel", "zorkh" + r.choice(["an", "el", "ot"])]))
        if not bad and r.random() < 0.2:
            w.insert(0, "zorkhan garden" if False else "garden")
        yield i, " ".join(w), bad


def test_toxicity_learns_words_and_beginnings(spark):
    rows = list(made(900))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string").withColumn("score", F.lit(0))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.report(d, labels).collect()}
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([a == b for a, b in held]) > 0.97
    clean = toxicity.clean(d, labels)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_without_labels(spark):
    d = frame(spark, ["you idiot", "fine day"])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.report(d, labels).count() == 2 and toxicity.report(d.limit(0), labels).count() == 0


def test_exceptions_take_back():
    a = toxicity.automaton({" trash ": 3.0}, {" trash can ": " trash "})
    assert toxicity.weigh(a, toxicity.fold("the trash can"))[0] == 0 and toxicity.weigh(a, toxicity.fold("you trash"))[0] == 3
    a = toxicity.automaton({" tra": 4.0, " trash ": 5.0, " scum ": 3.0}, {" tram ": " tra", " tram line ": " tra", " trash can ": " trash "})
    for text, want in (("tram line you scum", 3), ("tram tram line scum scum", 6), ("trash can trash", 5), ("travel scum", 7), ("tram", 0)):
        assert toxicity.weigh(a, toxicity.fold(text))[0] == want, text


def test_samples_are_bounded(spark):
    d = spark.createDataFrame([(i % 10, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 10, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.sample(d, labels, 4, "toxic").collect()
    assert len(got) == 4 == len({r.doc_id for r in got}) and {r.text for r in got} <= {f"text {i}" for i in range(500)}


def brute_toxicity(docs, labels):
    """Scores of a list of texts, learned from (doc_id, text, toxic) with distinct ids, by plain counting and matching."""
    folded = {i: toxicity.fold(t or "") for i, t, _ in labels}
    one = {}
    for i, _, y in labels:
        k = (toxicity._signature(folded[i].split()), y)
        one[k] = min(one.get(k, (i, folded[i])), (i, folded[i]))
    one = [(y, f) for (_, y), (_, f) in one.items()]
    n = collections.Counter(y for y, _ in one)
    seen = collections.Counter()
    for y, f in one:
        words = set(f.split())
        seen.update({(y, f" {w} ") for w in words} | {(y, f" {w[:k]}") for w in words for k in range(3, min(9, len(w)) + 1)})
    found = {}
    for t in {t for _, t in seen}:
        p, q = seen[1, t], seen[0, t]
        w = math.log((p + 0.5) / (n[1] + 1)) - math.log((q + 0.5) / (n[0] + 1))
        chance = (p + q) * n[1] / (n[0] + n[1])
        if p >= 4 and p >= 0.6 * (p + q) and w > 0 and (p - chance) / math.sqrt(chance + 1e-9) > 5:
            found[t] = (w, p, q)
    terms = {t: v[0] for t, v in found.items() if not any((u := t[:k]) in found and found[u][2] <= 0.1 * found[u][1] for k in range(4, len(t)))}

    def entries(f):
        """(start, word and its end, phrase with the next word) of each word that an entry begins, with the entries."""
        for at in [j for j, c in enumerate(f) if c == " " and j + 1 < len(f)]:
            own = [t for t in terms if f.startswith(t, at)]
            stop = f.find(" ", at + 1)
            nxt = f.find(" ", stop + 1)
            if own:
                yield at, f[at : stop + 1], f[at : nxt + 1] if nxt > 0 else None, own

    counts = collections.Counter()
    for y, f in one:
        mine = set()
        for _, word, phrase, own in entries(f):
            mine |= {(word, t) for t in own if t != word} | ({(phrase, t) for t in own} if phrase else set())
        counts.update((y, *x) for x in mine)
    gone = {p for (y, p, t), c in counts.items() if y == 0 and c >= 3 and not counts[1, p, t]}
    gone |= {f" {e} " for e in toxicity.DEFAULT_EXCEPTIONS if f" {e.split()[0]} " in terms}

    def measure(f):
        hits = list(entries(f))
        total = sum(terms[max(own, key=len)] for at, _, _, own in hits if not any(f.startswith(e, at) for e in gone))
        return toxicity.features(total, len(hits), f.count(" ") - 1)

    order = sorted(labels)
    curve = toxicity.logistic(np.array([measure(folded[i]) for i, _, _ in order]), np.array([y for _, _, y in order]))
    return [1 / (1 + math.exp(-(sum(c * u for c, u in zip(curve, measure(toxicity.fold(t or "")))) + curve[-1]))) for t in docs]


def test_toxicity_by_brute_force(spark):
    """Nulls in labels, ids without text, empty and long texts and repeated rows among the documents."""
    r = random.Random(12)
    rows = [(i, t if r.random() < 0.7 or y else t + " " + r.choice(["zorkhan fruit", "grubbel tea", "zorkhut"]), y) for i, t, y in made(1100, 7)]
    rows += [(5000 + i, t, 0) for i, t in enumerate(HARD)]
    texts = [t for _, t, _ in rows]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(0, texts[0]), (None, texts[1]), (9999, None)], "doc_id long, text string").withColumn("y", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (8888, 1), (9999, None)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    train = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    want = brute_toxicity(texts + [texts[0], texts[1], None], train)
    got = toxicity.report(d, labels).collect()
    key = lambda x: (str(x[0]), round(x[1], 6))
    assert sorted(key((x.doc_id, x.score)) for x in got) == sorted(map(key, zip([i for i, _, _ in rows] + [0, None, 9999], want)))
    assert all(x.predicted == int(x.score >= 0.5) for x in got) and {x.predicted for x in got} == {0, 1}


# ---- quality ------------------------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    r = random.Random(2)
    rows = []
    for i in range(700):
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(20, 80))]
        y = int(r.random() < 0.7)
        if not y:
            w = r.choice([[x.upper() + "!!" for x in w], [w[0]] * len(w), [x + "$$$" for x in w], [y for x in w for y in (x, "|")]])
        rows.append((i, " ".join(w), y))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string").withColumn("x", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.report(d, labels).collect()}
    assert len(got) == len(rows) + len(HARD) and all(0 <= x.score <= 1 for x in got.values())
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.95
    assert quality.report(d, labels.limit(0)).first().score == 0.5 and quality.report(d.limit(0), labels).count() == 0


def test_statistics_do_not_depend_on_neighbours():
    t = [x or "" for x in HARD]
    whole = quality.statistics(pa.array(t))
    for i, x in enumerate(t):
        assert quality.statistics(pa.array([x]))[0] == pytest.approx(whole[i], abs=1e-12)
    assert np.isfinite(whole).all()


def slow_statistics(text):
    """quality.STATS of one text, a byte, a word and a line at a time."""
    b, w = text.encode(), text.encode().split()
    share = lambda n: n / max(len(b), 1)
    each = lambda n: n / max(len(w), 1)
    two = sum(b[i] == 0xC3 and 0x80 <= b[i + 1] <= 0x9E for i in range(len(b) - 1))
    capital = sum(65 <= c <= 90 for c in b) + 2 * two
    letter = capital + sum(97 <= c <= 122 or c >= 128 for c in b) - 2 * two
    signs = b"#$%&*@~^=+<>{}[]\\`"
    lens = [len(x) for x in w]
    mean = each(sum(lens))
    lines = [x for x in (tuple(line.split()) for line in b.split(b"\n")) if x]
    pairs = list(zip(w, w[1:]))
    return [math.log1p(len(b)), math.log1p(len(w)), share(capital), share(letter), share(sum(48 <= c <= 57 for c in b)), share(sum(c in b" \t\x0b\x0c\r" for c in b)),
            share(sum(c in b"\"'()-/:;?_" for c in b)), each(sum(c in b".," for c in b)), each(b.count(b"|")), each(sum(c in signs for c in b)), each(b.count(b"!")), each(b.count(b"\n")),
            mean, math.sqrt(max(0, each(sum(x * x for x in lens)) - mean**2)), each(len(set(w))), each(sum(x == y for x, y in pairs)), 1 - len(set(pairs)) / max(len(pairs), 1),
            1 - len(set(lines)) / len(lines) if lines and b"\n" in b else 0.0, each(sum(x[-1] in signs for x in w)), each(sum(65 <= x[0] <= 90 for x in w))]


def test_statistics_one_at_a_time():
    texts = [x or "" for x in HARD if len(x or "") < 9000] + ["A b\nA b\nc! d, e.\n\n É é ÀB\n| x$ #y 12", "same same same\nsame", "\n\n"]
    for t in texts:
        assert quality.statistics(pa.array([t]))[0] == pytest.approx(slow_statistics(t), abs=1e-9), t


def test_quality_by_brute_force(spark):
    """The whole model by plain matrices: features one by one, each fold scored by the other folds, isotonic fit of these."""
    r = random.Random(3)
    rows = []
    for i in range(400):
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 60))]
        y = int(r.random() < 0.6)
        rows.append((i, " ".join(w if y or r.random() < 0.3 else [x + "!" for x in w]), y))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, rows[0][1]), (7, rows[7][1]), (9001, None)], "doc_id long, text string").withColumn("x", F.lit("clash"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (9001, None), (9002, 1)], "doc_id long, quality int")
    train = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5]
    ids = spark.createDataFrame([(i,) for i, _, _ in train], "doc_id long")
    fold = {x.doc_id: x.f for x in ids.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(quality.FOLDS)).alias("f")).collect()}
    x, y, f = np.array([slow_statistics(t) for _, t, _ in train]), np.array([v for _, _, v in train], float), np.array([fold[i] for i, _, _ in train])
    m = {"mean": x.mean(0), "sd": x.std(0) + 1e-3, "dims": quality.DIMS, "gamma": quality.GAMMA, "seed": quality.SEED}
    z = quality.fourier(x, m)

    def coef(of):
        return np.linalg.solve(z[of].T @ z[of] + quality.RIDGE * max(1.0, of.sum() / 100) * np.eye(z.shape[1]), z[of].T @ y[of])

    s = np.array([z[i] @ coef(f != f[i]) for i in range(len(z))])
    knots, values = quality.isotonic(s, y)
    whole = coef(f >= 0)
    texts = [t for _, t, _ in rows] + [rows[0][1], rows[7][1], ""]
    v = quality.fourier(np.array([slow_statistics(t) for t in texts]), m) @ whole
    want = np.clip(np.interp(v, knots, values) + 1e-6 * np.tanh(v), 0, 1)
    got = quality.report(d, labels).collect()
    # a score at a step of the fit may differ by rounding
    near = lambda a, b: sum(abs(p - q) < 1e-3 for p, q in zip(a, b)) >= 0.99 * len(b)
    key = lambda i: (i is None, i or 0)
    own = sorted(zip([i for i, _, _ in rows] + [None, 7, 9001], want.tolist()), key=lambda p: (key(p[0]), p[1]))
    mine = sorted(((r.doc_id, r.score) for r in got), key=lambda p: (key(p[0]), p[1]))
    assert [i for i, _ in mine] == [i for i, _ in own] and near([p for _, p in mine], [p for _, p in own])
    assert all(r.predicted == int(r.score >= 0.3) for r in got)


def test_isotonic():
    x, v = quality.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.interp([1, 2, 3, 4, 5], x, v) == pytest.approx([0, 0.5, 0.5, 1, 1])


# ---- tokens ---------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_token_counts(spark, library):
    r = random.Random(4)
    texts = HARD + ["".join(chr(r.choice([*range(32, 127), *range(192, 256), 0x416, 0x3A3, 0x4E2D, 0x1F600, 10])) for _ in range(r.randint(1, 60))) for _ in range(300)]
    got = {x.doc_id: x for x in tokens.count(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048), t[:40]


def test_prefix_counts(library):
    c = tokens.Counter(tokens.default_path())
    for word in ["extraordinarily", "unbelievable", "thereandbackagain", "école", "%%%%&&"]:
        inner, ended = c.prefixes(word)
        s = c.symbols(word)
        for i in range(1, len(s) + 1):
            if word.isascii():
                assert ended[i] == len(library.encode(word[:i], add_special_tokens=False).ids)
        assert ended[-1] == c.whole(word)
    text = "The quick brown fox's 12 dens"
    assert sum(c.each(text)) == len(library.encode(text, add_special_tokens=False).ids) and min(c.each(text)) > 0


def test_prefixes_answer_budgets(spark, library):
    """Each prefix that ends with a piece costs what the library says of it alone; rows may repeat."""
    text = "The quick, extraordinarily brown fox jumps 1234 times over thereandbackagain <|endoftext|> unbelievable dens"
    texts = [text, "", None, "one two three four", text, "x" * 3000]
    for budget in (0, 1, 7, 20, 5000):
        for r in tokens.within(tokens.prefixes(frame(spark, texts, False)), budget).collect():
            t = texts[r.doc_id] or ""
            ends = [m.end() for m in re.finditer(r"<\|endoftext\|>|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+", t)]
            assert r.running == [len(library.encode(t[:e], add_special_tokens=False).ids) for e in ends]
            assert (r.n_fit, r.fit_tokens) == (sum(x <= budget for x in r.running), max([0, *[x for x in r.running if x <= budget]]))


# ---- language model -------------------------------------------------------------------------------------------------------
def test_lm_base_is_exact_and_model_helps(spark):
    r = random.Random(6)
    phrases = [" ".join(r.choice("red green blue fast slow big small cat dog bird".split()) for _ in range(6)) for _ in range(12)]
    texts = HARD + [" ".join(r.choice(phrases) for _ in range(r.randint(1, 30))) for _ in range(200)]
    got = {x.doc_id: x for x in lm.report(frame(spark, texts), blocks=4).collect()}
    tok = lambda t: (t or "").encode().lower().split() + [b" end "]
    c = collections.Counter(x for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for x in tok(t))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (len(tok(t)), sum(w in c for w in tok(t)), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), rel=1e-9)
        assert x.score < 0
    held = [x for x in got.values() if x.held_out and x.doc_id >= len(HARD)]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    again = {x.doc_id: x for x in lm.report(frame(spark, texts).repartition(3), blocks=4).collect()}
    assert again.keys() == got.keys()
    for i, x in again.items():
        assert x.base_score == pytest.approx(got[i].base_score, rel=1e-12) and x.score == pytest.approx(got[i].score, rel=1e-12)


@pytest.mark.parametrize("blocks", [1, 2, 64])
def test_lm_score_by_brute_force(spark, blocks, monkeypatch):
    """Scores of each document against counts quantised one by one; the filter's false positives are shut out by wide slices."""
    monkeypatch.setattr(lm, "BITS_PER_ITEM", 400)
    monkeypatch.setattr(lm, "BATCH", 500)
    r = random.Random(blocks)
    texts = HARD + [" ".join(f"W{int(r.paretovariate(0.6)) % 500}" for _ in range(r.randint(0, 60))) for _ in range(250)]
    tok = [(t or "").encode().lower().split() + [b"\n"] for t in texts]
    n = counted([w for i, w in enumerate(tok) if zlib.crc32(str(i).encode()) % 7 != 2], b"\n")

    def coarse(c, fine):
        if not c:
            return 0.0
        q = int(math.floor(math.log2(c) * fine + 1e-9))
        return 2 ** (q / fine) * (2 ** (0.5 / fine) if q >= fine else 1)

    got = {x.doc_id: x.score for x in lm.report(frame(spark, texts).repartition(3), blocks=blocks).collect()}
    for i, w in enumerate(tok):
        assert got[i] == pytest.approx(log10_of(w, b"\n", n, lambda k, x: coarse(n[k][x], lm.FINE[k])), rel=1e-9), i


def counted(tok, end):
    """Counts of words, pairs, triples; pairs and triples by what stands before."""
    n = {1: collections.Counter(), 2: collections.Counter(), 3: collections.Counter()}
    for w in tok:
        n[1].update((x,) for x in w)
        n[2].update(zip([end, *w], w))
        n[3].update(zip([end, end, *w], [end, *w], w))
    return n


def log10_of(w, end, n, held):
    total = sum(n[1].values()) + len(n[1]) + 1
    out = 0.0
    for i, x in enumerate(w):
        v, u = (w[i - 1] if i else end), (w[i - 2] if i > 1 else end)
        p = (held(1, (x,)) + 1) / total
        for kind, context, item in ((2, held(1, (v,)), (v, x)), (3, held(2, (u, v)) if i else 0.0, (u, v, x))):
            p = (min(held(kind, item), context) + lm.PRIOR[kind] * p) / (context + lm.PRIOR[kind])
        out += math.log10(p)
    return out


def test_lm_ties_nulls_and_nothing(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]
    assert lm.report(spark.createDataFrame(rows, "doc_id long, text string"), blocks=2).count() == 4
    assert lm.report(spark.createDataFrame([], "doc_id long, text string"), blocks=2).count() == 0
    ids = [str(i) if i is not None else None for i, _ in rows]
    named = spark.createDataFrame([(i, t) for i, (_, t) in zip(ids, rows)], "doc_id string, text string")
    assert sorted((str(x.doc_id), x.n_tokens) for x in lm.report(named, blocks=2).collect()) == [("1", 3), ("1", 3), ("2", 1), ("None", 2)]


def test_filter_has_no_false_negatives():
    r = np.random.default_rng(0)
    h = np.unique(r.integers(0, 1 << 63, 20000).astype(np.uint64) << np.uint64(1))
    c = r.integers(1, 5000, len(h))
    f = lm.Filter(*lm.fill([(h, c, 2)]))
    got, q = f.count(h, 2), lm.levels(c, 2)
    assert (got >= 2.0 ** ((q - 1) / 2) - 1e-9).all() and np.median(got / c) == pytest.approx(1, abs=0.25)
    other = np.setdiff1d(r.integers(0, 1 << 63, 20000).astype(np.uint64) << np.uint64(1), h)
    assert (f.levels(other) > 0).mean() < 0.05


def test_lm_keeps_every_count_at_any_size(spark):
    """Scores stay near those of all counts, rare ones too."""
    r = random.Random(3)
    texts = [" ".join(f"w{int(r.paretovariate(0.7)) % 900}" for _ in range(r.randint(0, 40))) for _ in range(300)]
    got = {x.doc_id: x.score for x in lm.report(frame(spark, texts), blocks=4).collect()}
    tok = {i: t.split() + ["\n"] for i, t in enumerate(texts)}
    n = counted([w for i, w in tok.items() if zlib.crc32(str(i).encode()) % 7 != 2], "\n")
    off = [(got[i] - log10_of(w, "\n", n, lambda k, x: n[k][x])) / len(w) for i, w in tok.items()]
    assert abs(np.mean(off)) < 0.05 and np.mean(np.abs(off)) < 0.1
