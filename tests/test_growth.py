"""Work that must not grow faster than the input: what is worked out once, and what is not shuffled."""

import random
import re
import unicodedata

from lontar.operators import checks, corpus, dependency, morphology
from lontar.plans import queries
from lontar.sources import seeds

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_violations_are_analysed_once_for_all_dimensions(spark):
    assert "tokens" not in plan(queries.violations_by_dimension(spark, SF)).replace("tokens:array<string>", "")


def test_presets_share_edges_order_and_topology(spark):
    p = plan(queries.preset_scores(spark, SF))
    assert "'S'" not in p and "subj-komplemen" not in p and "berita" not in p


def test_edges_and_composition_do_not_grow_with_the_square_of_a_sentence(spark):
    p = morphology.parse(spark.createDataFrame([(1, 0, "anak membaca buku")], "doc_id int, sent_idx int, text string"), seeds.lexicon(spark))
    assert "array_distinct" not in plan(checks.edges(p).select("edges"))


def test_mask_shuffles_tokens_once_and_no_pairs(spark):
    rows = dependency.token_rows(spark.createDataFrame([(1, 0, "anak membaca buku di rumah"), (None, 0, "anak membaca buku")], "doc_id long, sent_idx int, text string"), ["doc_id", "sent_idx"])
    m = dependency.mask(rows, ["doc_id", "sent_idx"], 32)
    p = physical(m)
    assert p.count("Exchange hashpartitioning") == 1 and "Join" not in p
    h = {(r.doc_id, r.idx): r.head for r in dependency.heads(dependency.tags(rows, ["doc_id", "sent_idx"]), ["doc_id", "sent_idx"]).collect()}
    want = set()
    for (d, i), a in h.items():
        want.add((d, i, i))
        if a >= 0:
            want |= {(d, i, a), (d, a, i)} | {(d, i, j) for (e, j), b in h.items() if d is not None and e == d and b == a and i != j}
    got = [(r.doc_id, r.i, r.j) for r in m.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_text_is_stripped_once_however_often_it_is_tested(spark):
    d = spark.createDataFrame([(1, "satu dua tiga")], "doc_id long, text string")
    p = plan(corpus.cleaned(d).where("text IS NOT NULL"))
    assert p.count("https") == 1 and p.count(r"\{\{") == 1 and p.count("{4,}") == 1


def test_cleaning_tries_each_pattern_where_it_can_match(spark):
    def want(t):
        for pattern in (corpus.URL, corpus.HTML, corpus.WIKI, corpus.NOTE, "\x00"):
            t = re.sub(pattern, " ", t)
        t = re.sub(corpus.WORD_GAP, " ", t).strip(" ")
        share = lambda chars: sum(c in chars for c in t) / len(t) if t else 0
        if len(t.split(" ")) < 3 or share("0123456789") > 0.3 or share(r"{}[]|<>\^~*_=#@") > 0.1:
            return None
        for pattern, to in (("!{2,}", "!"), (r"\?{2,}", "?"), (r"\.{4,}", "...")):
            t = re.sub(pattern, to, t)
        return t.strip(" ")

    r, parts = random.Random(5), ["http://a.b", "https:// x", "www.c", "www. ", "<b>", "<", ">", "[[", "]]", "{{a}}", "{{", "[1]", "[x]", "\x00", " ", "  ", "\t", "\r\n", "\n", " ", "!!", "!", "??", "....", "..", "7", "kata satu ", "dua tiga ", "#", ""]
    texts = ["", " ", "a b", "a  b c", " a b c ", "a\tb\nc", *("".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(400))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.text for x in corpus.cleaned(d).collect()}
    assert got == {i: want(unicodedata.normalize("NFKC", t)) for i, t in enumerate(texts)} and sum(x is not None for x in got.values()) > 50
