import itertools
import random

import pytest
from pyspark.sql import functions as F

from lontar.config import Config
from lontar.operators import checks, homology, morphology, noise
from lontar.operators.storage import held
from lontar.plans import rules as R
from lontar.sources import seeds


def gap(a, b):
    """Distance of two words (root, domain, class), the earlier first, spelt out."""
    (ra, da, pa), (rb, db, pb) = a, b
    bonus = 0.0 if pa is None or pb is None else 0.2 if pa == pb != "?" else 0.1 if {pa, pb} == {"adj", "n"} else 0.0
    if ra.lower() == rb.lower():
        return 0.0
    if da and db:
        group = lambda d: R.DOMAIN_GROUPS.get(d)
        base = R.DOMAIN_PAIRS.get((da, db), 0.2 if da == db else 0.8 if group(da) and group(da) == group(db) else 2.5)
        return max(0.0, base - bonus)
    return 1.2 if da or db else 1.0 - bonus * 0.3


DOMAINS = ["ekonomi", "hukum", "pendidikan", "kuliner", "senjata", "alam", None]


def sentence(r, n):
    """Words (root, domain, class); a root has one domain and class, in either case."""
    pool = {f"w{i}": (r.choice(DOMAINS), r.choice(["n", "v", "adj", "?", None])) for i in range(max(2, n // 2))}
    roots = [r.choice([*pool]) for _ in range(n)]
    return [(x.upper() if r.random() < 0.2 else x, *pool[x]) for x in roots]


def by_kind(words):
    kinds = sorted({(d or "", p or "", d is None, p is None) for _, d, p in words})
    plain = [(None if x else d, None if y else p) for d, p, x, y in kinds]
    points = {}
    for i, (root, d, p) in enumerate(words):
        x = points.setdefault(root, {"root": root, "sama": root.lower(), "jenis": plain.index((d, p)), "awal": i, "akhir": i})
        x["akhir"] = i
    gaps = [{"a": i, "b": j, "d": gap(("a", *x), ("b", *y))} for i, x in enumerate(plain) for j, y in enumerate(plain)]
    return list(points.values()), gaps


def adjacent(words):
    """Distance of each pair of different roots: the least of their places'."""
    out = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(words), 2):
        if a[0] != b[0]:
            k = frozenset((a[0], b[0]))
            out[k] = min(out.get(k, 99), gap(a, b))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_kinds_count_what_pairs_would(seed):
    r = random.Random(seed)
    words = sentence(r, r.choice([0, 1, 2, 3, 6, 10, 16, 24]))
    roots, pairs, (points, gaps) = list(dict.fromkeys(w[0] for w in words)), adjacent(words), by_kind(words)
    # bars: components at each distance, by the earliest root
    top = {x: x for x in roots}
    bars = []
    for d in sorted(set(pairs.values())):
        comps = {x: {x} for x in roots}
        for k, v in pairs.items():
            if v <= d:
                a, b = k
                if comps[a] is not comps[b]:
                    comps[a] |= comps[b]
                    for x in comps[b]:
                        comps[x] = comps[a]
        lives = {min(c, key=roots.index) for c in comps.values()}
        bars += [(0.0, d, x) for x in roots if x not in lives and top.get(x)]
        for x in roots:
            if x not in lives:
                top[x] = None
    bars += [(0.0, float("inf"), x) for x in roots if top[x]]
    assert sorted(homology.merges(points, gaps)) == sorted(bars)
    once = {x for x in roots if sum(w[0] == x for w in words) == 1}
    for thr in (0.0, 0.1, 0.2, 0.7, 1.0, 1.2, 1.35, 1.5, 2.3, 2.35, 2.5, 2.8, 3.0, 9.0):
        near = {k for k, v in pairs.items() if v <= thr}
        tri = sum(all(frozenset(x) in near for x in itertools.combinations(t, 2)) for t in itertools.combinations(roots, 3))
        alone = [x for x in roots if x in once and not any(x in k for k in near)]
        parts = sum(b[1] > thr for b in bars)
        assert homology.joined(points, gaps, once, thr) == (len(near), tri, parts, alone)


def test_a_long_sentence_takes_linear_memory():
    import tracemalloc

    points, gaps = by_kind(sentence(random.Random(1), 20_000))
    tracemalloc.start()
    bars = homology.merges(points, gaps)
    homology.joined(points, gaps, set(), 2.4)
    assert len(bars) == len(points) and tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


@pytest.fixture(scope="module")
def parsed(spark):
    from lontar.operators.storage import stored

    r = random.Random(3)
    words = [w for w, *_ in seeds.LEXICON] + ["Budi", "BELI", "entah", "apa"]
    more = [(50 + i, 0, " ".join(r.choice(words) for _ in range(r.randint(2, 25)))) for i in range(60)]
    rows = seeds.sentences(spark).select("doc_id", "sent_idx", "text").unionByName(spark.createDataFrame(more, "doc_id long, sent_idx int, text string"))
    return stored(morphology.parse(rows, seeds.lexicon(spark)))


FOUND = ["doc_id", "sent_idx", "n_sisi", "n_segitiga", "betti0", "betti1", "euler", "terpencil", "anomali", "e_topologis"]


def test_closed_form_agrees(spark, parsed):
    """Expressions inside the range of thresholds, and the count by kinds, which holds at any."""
    e = checks.edges(parsed)
    inside = {(r.doc_id, r.sent_idx): r for r in checks.topology(e, Config(threshold=1.5)).select(*FOUND).collect()}
    outside = {}
    for r in homology.counted(held(checks._roots(e), "_a", F.filter("_k", lambda x: ~x["twice"])), 1.5).select("doc_id", "sent_idx", "hitung", "tokens").collect():
        outside[r.doc_id, r.sent_idx] = r.hitung
    for k, r in inside.items():
        h = outside[k]
        assert h.betti0 == r.betti0 and (sorted(h.terpencil) == sorted(r.terpencil) or r.betti0 == 1)
    assert len(inside) == len(outside) == parsed.count()


@pytest.mark.parametrize("thr", [0.5, 1.0, 2.5])
def test_any_threshold(spark, parsed, thr):
    a = checks.analyse(parsed, Config(threshold=thr)).select("doc_id", "sent_idx", "n_sisi", "n_segitiga", "betti0", "terpencil", "skor", F.transform("tokens", lambda t: F.struct(t["root"].alias("root"), t["domain"].alias("domain"), t["pos"].alias("pos"))).alias("w"))
    for r in a.collect():
        words = [(x.root, x.domain, x.pos) for x in r.w]
        roots, pairs = list(dict.fromkeys(w[0] for w in words)), adjacent(words)
        near = {k for k, v in pairs.items() if v <= thr}
        twice = {x for x in roots if sum(w[0] == x for w in words) > 1}
        sets = {frozenset(w[0] for w in t) for t in itertools.combinations(words, 3) if all(len({x[0] for x in p}) == 1 or frozenset(x[0] for x in p) in near for p in itertools.combinations(t, 2))}
        assert r.n_sisi == len(near) + len(twice) and r.n_segitiga == len(sets)
        assert sorted(r.terpencil) == sorted(x for x in roots if x not in twice and not any(x in k for k in near) and len(words) > 1) and 0 <= r.skor <= 1


def test_fuzzy_compares_with_the_whole_lexicon(spark):
    import difflib
    import random

    r = random.Random(4)
    make = lambda: "".join(r.choice("aknmeé") for _ in range(r.randint(1, 9)))
    known = sorted({make() for _ in range(150)} | {"makan", "abcde"})
    asked = sorted({make() for _ in range(150)} | {"nakan", "akan", "emakan", "abc"})
    want = {}
    for x in set(asked) - set(known):
        q, y = min((-difflib.SequenceMatcher(None, x, y).ratio(), y) for y in known)
        if -q >= 0.75:
            want[x] = (y, -q)
    assert want["abc"] == ("abcde", 0.75)
    got = homology.fuzzy(spark.createDataFrame([(x,) for x in asked], "word string"), spark.createDataFrame([(x,) for x in known], "kata string"))
    assert {x.word: (x.kata, x.ratio) for x in got.collect()} == want
    one = homology.fuzzy(spark.createDataFrame([(x,) for x in ("nakan", "akan", "emakan")], "word string"), spark.createDataFrame([("makan",)], "kata string"))
    assert {x.word: round(x.ratio, 2) for x in one.collect()} == {"nakan": 0.8, "akan": 0.89, "emakan": 0.91}


def test_fuzzy(spark):
    w = spark.createDataFrame([("berass",), ("beras",), ("zzz",)], "word string")
    assert [(r.word, r.kata) for r in homology.fuzzy(w, seeds.lexicon(spark)).collect()] == [("berass", "beras")]


def test_noise(spark):
    text = "satu dua tiga empat lima enam tujuh"
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "a  b")], "doc_id long, text string")
    key = lambda rows: sorted((str(r.doc_id), r.text) for r in rows)
    for kind in noise.KINDS:
        a = key(noise.noise(d, kind, 0.9).collect())
        assert a == key(noise.noise(d.repartition(3), kind, 0.9).collect())
        assert dict(a)["2"] == dict(a)["3"] == "" and dict(a)["1"] != text
    c = noise.noise(spark.createDataFrame([(i, text) for i in range(60)], "doc_id long, text string"), "chaos", 0.5).collect()
    assert all(set(r.text.split()) <= set(text.split()) for r in c) and len({r.text for r in c}) > 30
    still = {r.text for r in noise.noise(d.where("doc_id = 1"), "typo", 0.0).collect()}
    assert still == {text}


def test_topology_counts_what_pairs_give(spark):
    import itertools
    import random

    r = random.Random(7)
    kinds = [("n1", "ekonomi"), ("n2", "ekonomi"), ("N2", "ekonomi"), ("n3", "hukum"), ("n4", "pendidikan"), ("n5", "kuliner"), ("n6", "senjata"), ("n7", "alam"), ("n8", "alam"), ("n9", None), ("m1", None)]
    rows = [(d, 0, "", [dict(idx=i, root=x, domain=g, pos=None) for i, (x, g) in enumerate(r.choices(kinds[: r.choice([7, 9, 11])], k=r.randint(0, 9)))]) for d in range(150)]
    token = "struct<idx:int,root:string,domain:string,pos:string>"
    df = spark.createDataFrame(rows, f"doc_id long, sent_idx int, text string, tokens array<{token}>").withColumn("n", F.size("tokens"))
    got = {x.doc_id: x for x in checks.topology(df).collect()}
    gaps = df.select("doc_id", F.transform(checks._pairs(F.col("n"), None), lambda p: F.struct(p["i"], p["j"], checks._gap(F.get("tokens", p["i"]), F.get("tokens", p["j"])).alias("d"))).alias("g"))
    near = {x.doc_id: {(i, j) for i, j, d in x.g if d <= 1.5} for x in gaps.collect()}
    for d, _, _, tokens in rows:
        roots, n = [t["root"] for t in tokens], len(tokens)
        sides = {frozenset((roots[i], roots[j])) for i, j in near[d]}
        ok = lambda *p: all(frozenset(q) in sides for q in itertools.combinations(p, 2))
        faces = {frozenset(p) for p in itertools.combinations(roots, 3) if ok(*p)}
        part = {x: x for x in roots}
        for e in sides:
            a, b = part[min(e)], part[max(e)]
            part = {x: a if y == b else y for x, y in part.items()}
        lonely = [x for x in dict.fromkeys(roots) if not any(x in e for e in sides)] if n > 1 else []
        x = got[d]
        assert (x.n_sisi, x.n_segitiga, x.betti0, x.euler, x.terpencil) == (len(sides), len(faces), len(set(part.values())), n - len(sides) + len(faces), lonely), tokens
