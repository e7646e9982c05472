"""Decontamination, SimHash groups, components, substring removal, archives and the pipeline against brute force."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lontar.llm import components, decontaminate, simhash, substrings, warc
from lontar.llm.common import scratch, split_join

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---- decontamination ----------------------------------------------------------------------------------------------------
def brute_hits(docs, items):
    wins = []
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(10, len(w))
        wins += [(str(i), tuple(w[j : j + k])) for j in range(len(w) - k + 1)] if w else []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, its = set(), set()
        for i, win in wins:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    its.add(i)
        yield d, len(w), len(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("seed,small", [(0, None), (1, None), (2, None), (1, 0)])
def test_decontamination(spark, monkeypatch, seed, small):
    if small is not None:  # by a shuffle
        monkeypatch.setattr(decontaminate, "SMALL", small)
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(6 + 6 * seed)] + ["École", "été", "漢字"]
    text = lambda n: " ".join(r.choice(voc).upper() if r.random() < 0.2 else r.choice(voc) for _ in range(n))
    items = [(i, text(r.choice([0, 1, 3, 9, 10, 11, 25]))) for i in range(8)] + [(8, None), (9, "same words " * 9), (10, "same words " * 9)]
    docs = []
    for i in range(40):
        t = text(r.randint(0, 60)).split()
        for _ in range(r.randint(0, 2)):
            w = (r.choice(items)[1] or "").split()
            a = r.randint(0, len(w))
            t[r.randint(0, len(t)) : 0] = w[a : a + 14]
        docs.append((i, " ".join(t)))
    docs += [(40, None), (41, ""), (42, "w1 " * 9), (42, "w1 " * 9), (43, items[9][1] * 40), (None, items[9][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("h", F.lit(0)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("p", F.lit("clash"))
    got = sorted((tuple(x) for x in decontaminate.report(d, b).collect()), key=str)
    assert got == sorted(brute_hits(docs, items), key=str)
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(str(x.doc_id) + str(x.text) for x in kept.collect()) == sorted(str(i) + str(t) for (i, t), h in zip(docs, brute_hits(docs, items)) if not h[5])


def test_decontamination_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(d, none).first().contaminated is False and decontaminate.report(d.limit(0), none).count() == 0


# ---- SimHash --------------------------------------------------------------------------------------------------------------
def brute_fp(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_simhash(spark):
    r = random.Random(8)
    base = [" ".join(r.choice(["Alpha", "beta", "gamma", "delta", "eps"]) + str(r.randint(0, 9)) for _ in range(r.randint(1, 120))) for _ in range(30)]
    texts = base + [b + " x" for b in base] + base[:5] + [None, "", " \t", "one", "one two", "One two", "one two three", "é " * 300, "w " * 40000]
    for b in base[:15]:
        w = b.split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {x.doc_id: x for x in simhash.report(d).collect()}
    fp = {i: brute_fp(t) for i, t in rows}
    assert {i: f"{v:016x}" for i, v in fp.items()} == {i: x.fingerprint for i, x in got.items()}
    want = classes(range(len(rows)), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)
    assert {i: x.component_id for i, x in got.items()} == want
    kept = simhash.unique(d)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect()) == sorted(set(want.values()))


def test_links_of_close_fingerprints(spark):
    r = random.Random(9)
    fps = [r.getrandbits(64) for _ in range(40)]
    for f in fps[:30]:
        for _ in range(6):
            fps.append(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    e = [(x.a % (1 << 64), x.b % (1 << 64)) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in e)
    index = {f: i for i, f in enumerate(fps)}
    pairs = {frozenset((index[a], index[b])) for a, b in e}
    assert classes(range(len(fps)), lambda a, b: frozenset((a, b)) in pairs) == classes(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


def test_simhash_of_a_hot_fingerprint(spark):
    """Two thirds of all rows are one text; each row is answered, whatever its columns are called."""
    docs = [(i, "one text that is in most of the rows") for i in range(4000)] + [(4000 + i, f"word{i} other{i} third{i} fourth{i}") for i in range(2000)] + [(9000, "a very long text " * 30000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("root", F.lit(2)).repartition(5)
    got = {x.doc_id: x for x in simhash.report(d).collect()}
    assert len(got) == 6001 and all(got[i].component_id == 0 for i in range(4000))
    assert all(int(got[i].fingerprint, 16) == brute_fp(t) for i, t in docs[3990:4050] + docs[-1:])


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(r.randint(2000, 2200), r.randint(2000, 2200)) for _ in range(150)] + [(5, 5)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges}
    nodes = sorted({n for e in edges for n in e})
    want = classes(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert got == {n: x for n, x in want.items() if n != x}
    # a hub with most edges, a long chain, and both again
    hub = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(7000, i) for i in range(7001, 7900)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(hub, "a long, b long").repartition(6)).collect()}
    assert got == {**{i: 0 for i in range(1, 3000)}, **{5001 + i: 5000 for i in range(40)}, **{i: 7000 for i in range(7001, 7900)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d"), (1, "x y z w"), (None, "a b c d"), (2, "a b c d"), (2, "a b c d")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.report(d).count() == 5 and simhash.unique(d).count() == 2
    assert simhash.report(d.limit(0)).count() == 0


# ---- substrings --------------------------------------------------------------------------------------------------------------
def brute_removed(rows):
    """rows in order: (words, removed places) of each."""
    seen, out = {}, []
    for i, t in enumerate(rows):
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone |= set(range(j, j + 20))
            else:
                seen[k] = (i, j)
        out.append((w, gone))
    return out


@pytest.mark.parametrize("seed, indexed", [(0, 4096), (1, 4096), (2, 4096), (0, 1), (1, 2), (2, 5), (2, 60)])
def test_substrings(spark, seed, indexed, monkeypatch):
    """With small indexes most anchors are wider than one, and the frequent ones are dealt in pieces."""
    monkeypatch.setattr(substrings, "INDEXED", indexed)
    r = random.Random(seed)
    voc = [f"w{i}" for i in range([3, 40, 400][seed])] + ["É", "é"]
    words = lambda n: [r.choice(voc) for _ in range(n)]
    shared = [words(r.randint(15, 70)) for _ in range(6)]
    texts = []
    for _ in range(60):
        w = words(r.randint(0, 50))
        for _ in range(r.randint(0, 2)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            w[r.randint(0, len(w)) : 0] = s[a:]
        texts.append(" ".join(w))
    texts += [None, "", "a " * 19, "a " * 20, "a " * 21, "a " * 3000, texts[0], texts[1], texts[1] + "\t\n end", "x" * 5000]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(5)).withColumn("pos", F.lit("clash")).repartition(3)
    want = brute_removed(texts)
    got = {x.doc_id: x for x in substrings.report(d).collect()}
    for i, (w, gone) in enumerate(want):
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest()), i
    clean = substrings.clean(d)
    assert clean.columns == d.columns
    c = {x.doc_id: x for x in clean.collect()}
    for i, (w, gone) in enumerate(want):
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
        if not gone:
            assert c[i].text == texts[i] and c[i].n_chars == 5
        elif kept:
            assert c[i].text == kept and c[i].n_chars == len(kept)
        else:
            assert i not in c


def test_substrings_repeated_ids(spark):
    long = " ".join(f"v{i}" for i in range(30))
    rows = [(1, long), (1, long), (1, "z " + long), (None, long + " q"), (2, "short")]
    got = substrings.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5
    by = sorted((str(x.doc_id), x.n_words, x.n_removed) for x in got)
    assert ("None", 31, 0) in by and by.count(("1", 30, 30)) == 2 and ("1", 31, 30) in by
    assert substrings.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substrings_string_ids(spark):
    long = " ".join(f"v{i}" for i in range(30))
    rows = [("b", long), ("a", "x " + long), ("c", None), ("B", "short")]
    got = {x.doc_id: (x.n_words, x.n_removed) for x in substrings.report(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": (31, 0), "b": (30, 30), "c": (0, 0), "B": (1, 0)}


def test_fm_index_counts(spark):
    r = np.random.default_rng(3)
    rows = r.integers(1, 4, (60, 32)).astype(np.uint32)
    f = substrings.FMIndex(rows)
    at = np.array([s * f.width + o for s in range(60) for o in range(25)])
    which, lo, hi = f.intervals(at, 8)
    found = dict(zip(which.tolist(), (hi - lo).tolist()))
    wins = [tuple(rows[s, o : o + 8]) for s in range(60) for o in range(25)]
    for i, w in enumerate(wins):
        n = sum(tuple(rows[s, o : o + 8]) == w for s in range(60) for o in range(25))
        assert found.get(i, 1) == n


# ---- archives ------------------------------------------------------------------------------------------------------------------
def test_warc(spark, tmp_path):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (9, "http://c", "same"), (3, None, None), (4, "http://e", ""), (5, "http://f", "é\r\n\r\nWARC/1.1 x" * 3), (6, "u\r\nX: y", "big" * 50000), (7, "http://g", "only"), (7, "http://g", "only"), (None, "n", "same"), (None, "n", "lone")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("strong", F.lit("clash"))
    got = warc.report(d).collect()
    assert len(got) == len(pages)
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        b, t = (h or "").encode(), top[h or ""]
        again = t >= 0 and i != t
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", t if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    path = scratch(spark)
    warc.write(d, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in pages})
    whole = warc.read(spark, path, whole=True)
    assert sorted(bytes(x.payload).decode() for x in whole.collect()) == sorted(h or "" for _, _, h in pages)
    out = str(tmp_path / "warc")
    warc.export(spark, path, out)
    import gzip
    import pathlib

    data = b"".join(gzip.open(p).read() for p in sorted(pathlib.Path(out).glob("*.gz")))
    n = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert rest[size : size + 4] == b"\r\n\r\n"
        data, n = rest[size + 4 :], n + 1
    assert n == len(pages)


def test_warc_headers_with_hostile_urls(spark):
    urls = ["https://reg.example/img@sha256:deadbeef", "x\r\nWARC-Type: response\r\n", "y\u2028WARC-Type: response", "z\u0085WARC-Refers-To: <urn:page:99:1>", "WARC-Type: response", None, "\x00\x1f"]
    pages = [(f"{i}:a>\n%", u, "copy" if i % 2 else f"own {i}") for i, u in enumerate(urls)]
    d = spark.createDataFrame(pages, "page_id string, url string, html string")
    path = scratch(spark)
    warc.write(d, path)
    top = max(i for i, _, h in pages if h == "copy")
    got = warc.read(spark, path, whole=True).collect()
    assert len(got) == len(pages) and len({re.search(r"WARC-Record-ID: (.*)\r\n", x.header)[1] for x in got}) == len(pages)
    html = {i: h for i, _, h in pages}
    for x in got:
        payload = html[x.page_id].encode()
        again = html[x.page_id] == "copy" and x.page_id != top
        assert (x.record_type, x.refers_to) == (("revisit", top) if again else ("response", None))
        assert (bytes(x.payload), x.payload_bytes, x.payload_digest) == (payload, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        record = x.header.encode() + (b"" if again else payload) + b"\r\n\r\n"
        assert (x.record_bytes, x.record_sha256) == (len(record), hashlib.sha256(record).hexdigest())
        assert ("WARC-Profile: " in x.header) == again and "WARC-Date: " in x.header
    assert sorted(map(tuple, warc.report(d).collect())) == sorted((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join(spark, how):
    """A key with most of the rows, keys with one, and keys that only one side has."""
    r = random.Random(4)
    left = [(r.choice([7] * 9 + list(range(40))), i) for i in range(3000)]
    n = {}
    for k, _ in left:
        n[k] = n.get(k, 0) + 1
    right = [(k, f"v{k}", c) for k, c in n.items() if k % 5] + [(1000, "none", 0)]
    got = split_join(spark.createDataFrame(left, "k long, i long"), spark.createDataFrame(right, "k long, v string, n long"), "k", "n", ("i",), how)
    assert got.columns == ["k", "i", "v"]
    want = [(k, i, f"v{k}" if k % 5 else None) for k, i in left if k % 5 or how == "left"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_small_payloads_are_responses(spark):
    d = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    assert {x.page_id: x.record_type for x in warc.report(d, 5).collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert warc.report(d.limit(0)).count() == 0


def test_damage_is_noticed(spark):
    path = scratch(spark)
    warc.write(spark.createDataFrame([(1, "u", "ab")], "page_id long, url string, html string"), path)
    p = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"ax")).collect()
    spark.createDataFrame(p).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read(spark, path).collect()
    spark.createDataFrame(p).limit(0).write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="record and header differ"):
        warc.read(spark, path).collect()


# ---- pipeline --------------------------------------------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    n = [len(left)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch(spark)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        now = {r.doc_id: r.text for r in docs.collect()}
        if name == "simhash":
            fp = {i: brute_fp(t) for i, t in left.items()}
            assert set(now) == set(classes(sorted(left), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3).values())
        if name == "substrings":
            keys = sorted(left)
            for i, (w, gone) in zip(keys, brute_removed([left[k] for k in keys])):
                kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
                assert now.get(i) == (left[i] if not gone else kept or None)
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(now) == {h[0] for h in brute_hits(list(left.items()), items) if not h[5]}
        left = now
        n.append(len(left))
    assert n == sorted(n, reverse=True) and n[0] > n[-1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in last} == set(left) and all(0 <= r.taken <= 2 * r.size for r in last)
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, last))


def keyed(spark, rows):
    """Distinct (doc_id, text) in the order that the stages use: doc_id, null first, then the text's hash."""
    th = {t: h for t, h in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    return sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, th[x[1] or ""]))


def test_pipeline_on_hard_rows(spark, tmp_path):
    """Null ids and texts, ids and rows that repeat, empty and very long texts, clashing names: each stage by brute force."""
    import corpus_pipeline
    from test_mixing import fill
    from test_texts import brute_toxicity, made

    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choice("bcdfgaeiou") for _ in range(r.randint(3, 9))) for _ in range(n))
    items, shared = [(i, words(25)) for i in range(6)] + [(6, None), (7, "")], [words(60) for _ in range(3)]
    base = [(i, t + " " + words(30), y) for i, t, y in made(700, 5)]
    rows = [(i, t) for i, t, _ in base]
    rows += [(1000 + i, words(40) + " " + shared[i % 3] + " " + words(10)) for i in range(12)] + [(1100 + i, words(30) + " " + items[i % 6][1]) for i in range(9)]
    rows += [(2000 + i, rows[i * 5][1]) for i in range(40)] + [(2100 + i, rows[i * 7][1] + " more") for i in range(40)]
    rows += [rows[3], rows[3], (None, words(50)), (None, words(50)), (None, None), (None, None), (3000, None), (3001, ""), (3002, " \n "), (3, words(40)), (3003, words(9000)), (3004, "word " * 9000), (3005, "y" * 50000)]
    source = {x: r.choice(["a", "b", "c", None]) for x in set(rows)}
    docs = spark.createDataFrame([(i, t, source[i, t], len(t or "")) for i, t in rows], "doc_id long, text string, source string, n_chars long")
    clash = ["_key", "_row", "_score", "key", "marks", "h", "fp", "spans", "_t", "size", "left"]
    docs = docs.withColumns({c: F.lit(c) for c in clash}).repartition(3)
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in base] + [(None, 1)], "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    left, docs = [(x.doc_id, x.text) for x in docs.collect()], spark.read.parquet(f"{sf}/documents.parquet")
    tops = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch(spark)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns[:4] == ["doc_id", "text", "source", "n_chars"] and docs.columns[4:] == clash
        now = [(x.doc_id, x.text) for x in docs.collect()]
        if name == "toxicity":
            first = {}
            for i, t in keyed(spark, left):  # of repeated ids the text with the least hash is learned from
                first.setdefault(i, t)
            y = {i: y for i, _, y in base}
            score = dict(zip(left, brute_toxicity([t for _, t in left], [(i, first[i], y[i]) for i in y if zlib.crc32(str(i).encode()) % 5])))
            assert sorted(now, key=str) == sorted((x for x in left if score[x] < 0.5), key=str)
        if name == "simhash":
            order = keyed(spark, left)
            fp = [brute_fp(t) for _, t in order]
            kept = set(classes(range(len(order)), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3).values())
            assert sorted(now, key=str) == sorted((order[k] for k in kept), key=str)
        if name == "substrings":
            order = keyed(spark, left)
            want = []
            for (i, t), (w, gone) in zip(order, brute_removed([t for _, t in order])):
                kept = b" ".join(x for j, x in enumerate(w) if j not in gone).decode()
                if not gone or kept:
                    want.append((i, kept if gone else t))
            assert sorted(now, key=str) == sorted(want, key=str)
        if name == "decontamination":
            assert sorted(now, key=str) == sorted((x for x, h in zip(left, brute_hits(left, items)) if not h[5]), key=str)
        tops.append(len(left) - len(now))
        left = now
    assert min(tops[0], tops[1], tops[3]) > 0
    last = corpus_pipeline.run(spark, sf).collect()
    sizes = {}
    for x in docs.collect():
        sizes[x.source] = sizes.get(x.source, 0) + len((x.text or "").split())
    assert sorted((str(x.doc_id), x.size) for x in last) == sorted((str(i), len((t or "").split())) for i, t in left)
    for s, want in fill(sizes).items():
        assert sum(x.taken for x in last if x.source == s) == pytest.approx(want, abs=1)
    assert all(0 <= x.taken <= 2 * x.size for x in last)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
