"""Bars from lean tokens: the same as from whole parses, without roles, and distances of kinds as the expression has them."""

from pyspark.sql import functions as F

from lontar.operators import checks, homology, lexicon, morphology
from lontar.operators.storage import held
from lontar.plans import rules as R
from lontar.sources import seeds


def test_gaps_are_those_of_the_expression(spark):
    kinds = [(d, p) for d in [*R.DOMAINS, None] for p in ("n", "v", "adj", "?", None)]
    k = spark.createDataFrame(kinds, "domain string, pos string")
    a, b = (k.select(F.struct(F.lit(name).alias("root"), "domain", "pos").alias(name)) for name in "ab")
    got = a.crossJoin(b).select("a", "b", checks._gap(F.col("a"), F.col("b")).alias("d")).collect()
    assert len(got) == len(kinds) ** 2
    assert all(lexicon.gap(r.a.domain, r.a.pos, r.b.domain, r.b.pos) == r.d for r in got)


def test_bars_of_lean_tokens(spark):
    s, lex = seeds.sentences(spark), seeds.lexicon(spark)
    lean = morphology.tokens_of(s, lex, fields=homology.BAR_FIELDS)
    plan = lean._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan and lean.schema["tokens"].dataType.elementType.names == [*homology.BAR_FIELDS]
    whole = morphology.parse(s, lex)
    by_expression = held(homology.kinds(whole), "t", F.col("titik")).select("doc_id", "sent_idx", "t", "jarak").collect()
    want = {(r.doc_id, r.sent_idx): sorted(homology.merges(r.t, r.jarak)) for r in by_expression if r.t}
    assert any(len(b) > 2 for b in want.values())
    for parsed in (lean, whole):
        rows = homology.barcode(parsed).collect()
        assert {(r.doc_id, r.sent_idx): sorted(map(tuple, r.bars)) for r in rows if r.bars} == want
