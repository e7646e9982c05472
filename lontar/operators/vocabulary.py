"""Vocabularies: size targets, checks against a corpus, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans import rules as R
from ..plans.rules import FIELD_SEEDS

MIN_VOCAB, MAX_VOCAB, MIN_COVERAGE, MAX_OOV = 5_000, 15_000, 0.75, 0.15
TIERS = ["EXPERIMENTAL", "DEGRADED", "VALID", "OPTIMAL"]


def target(n):
    """Size for n sentences: 50 * sqrt(n) within bounds, to the nearest thousand (halves to even)."""
    raw = F.floor(50 * F.sqrt(n.cast("double")))
    return (F.bround(F.greatest(F.lit(MIN_VOCAB), F.least(F.lit(MAX_VOCAB), raw)) / 1000.0, 0) * 1000).cast("int")


def corpus_slots(t):
    """(corpus, dictionary) slots of a target: three quarters and the rest."""
    c = F.floor(t * 0.75).cast("int")
    return c, (t - c).cast("int")


def frequencies(texts: DataFrame) -> DataFrame:
    from ..functions.text import tokens

    return texts.select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def size_status(n, n_sentences: int):
    goal = target(F.lit(n_sentences))
    low, high = F.greatest(F.lit(MIN_VOCAB), F.floor(goal * 0.85)), F.least(F.lit(MAX_VOCAB), F.floor(goal * 1.15))
    small = F.lit("WARN" if 0 < n_sentences < 20_000 else "FAIL")
    return F.when(n.between(MIN_VOCAB, MAX_VOCAB), F.when(n.between(low, high), "PASS").otherwise("WARN")).when(n < MIN_VOCAB, small).otherwise("WARN")


def hard_checks(vocab: DataFrame) -> DataFrame:
    """One row (token, id): empty, missing, misplaced (specials), doubled (ids)."""
    special = F.array(*[F.lit(s) for s in R.SPECIALS])
    a = vocab.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.map_from_entries(F.collect_list(F.when(F.col("token").isin(R.SPECIALS), F.struct("token", "id")))).alias("m"))
    return a.select((F.col("n") == 0).alias("empty"), F.filter(special, lambda s: F.try_element_at("m", s).isNull()).alias("missing"),
                    F.filter(special, lambda s: F.try_element_at("m", s).isNotNull() & (F.try_element_at("m", s) != F.array_position(special, s) - 1)).alias("misplaced"), (F.col("n") - F.col("ids")).alias("doubled"))


def _graded(v, good, fair, more_is_better: bool):
    return F.when(v >= good, "PASS").when(v >= fair, "WARN").otherwise("FAIL") if more_is_better else F.when(v <= good, "PASS").when(v <= fair, "WARN").otherwise("FAIL")


def coverage(vocab: DataFrame, freq: DataFrame) -> DataFrame:
    """One row: share of the corpus's tokens that the vocabulary has, and status."""
    j = freq.join(vocab.select("token", F.lit(1).alias("has")), "token", "left")
    a = j.agg(F.coalesce(F.sum(F.when(F.col("has") == 1, F.col("freq"))), F.lit(0)).alias("covered"), F.coalesce(F.sum("freq"), F.lit(0)).alias("total"))
    v = F.when(F.col("total") > 0, F.col("covered") / F.col("total")).otherwise(0.0)
    return a.withColumn("value", v).withColumn("status", F.when(F.col("total") == 0, "SKIP").otherwise(_graded(v, MIN_COVERAGE, MIN_COVERAGE * 0.9, True)))


def median_frequency(freq: DataFrame) -> DataFrame:
    """One row: the upper median of the frequencies. Counted by frequency first, so that few rows are ordered."""
    c = freq.groupBy("freq").agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy("freq")
    c = c.withColumn("upto", F.sum("k").over(w)).withColumn("n", F.sum("k").over(Window.partitionBy(F.lit(1))))
    return c.where("upto >= floor(n / 2) + 1").agg(F.min("freq").alias("median"))


def oov(vocab: DataFrame, freq: DataFrame) -> DataFrame:
    """One row: share of the significant tokens (frequency at least the median, from 3 to 10) that it lacks."""
    limit = F.greatest(F.lit(3), F.least(F.col("median"), F.lit(10)))
    sig = freq.crossJoin(F.broadcast(median_frequency(freq))).where(F.col("freq") >= limit)  # one row
    j = sig.join(vocab.select("token", F.lit(1).alias("has")), "token", "left")
    a = j.agg(F.count(F.lit(1)).alias("significant"), F.count_if(F.col("has").isNull()).alias("missing"))
    v = F.when(F.col("significant") > 0, F.col("missing") / F.col("significant")).otherwise(0.0)
    return a.withColumn("value", v).withColumn("status", F.when(F.col("significant") == 0, "SKIP").otherwise(_graded(v, MAX_OOV, MAX_OOV * 1.5, False)))


def fields(vocab: DataFrame) -> DataFrame:
    """(field, seeds, present, share, status) for each field's seed words."""
    rows = [(f, w) for f, ws in FIELD_SEEDS.items() for w in ws.split()]
    seeds = vocab.sparkSession.createDataFrame(rows, "field string, token string")
    j = seeds.join(vocab.select("token", F.lit(1).alias("has")).distinct(), "token", "left")
    g = j.groupBy("field").agg(F.count(F.lit(1)).alias("seeds"), F.count("has").alias("present"))
    return g.withColumn("share", F.col("present") / F.col("seeds")).withColumn("status", F.when(F.col("share") < 0.25, "FAIL").when(F.col("share") < 0.5, "WARN").otherwise("PASS"))


def composition(n_corpus, n_dictionary, total, low=0.70, high=0.80):
    """PASS where corpus tokens are 70 to 80 % of the vocabulary and dictionary ones the complement, else WARN."""
    c, d = n_corpus / total, n_dictionary / total
    return F.when(total == 0, "FAIL").when(c.between(low, high) & d.between(1 - high, 1 - low), "PASS").otherwise("WARN")


def tier(statuses):
    """Two failures EXPERIMENTAL, one DEGRADED, a warning VALID, else OPTIMAL."""
    n = lambda s: F.size(F.filter(statuses, lambda x: x == s))
    return F.when(n("FAIL") >= 2, "EXPERIMENTAL").when(n("FAIL") == 1, "DEGRADED").when(n("WARN") > 0, "VALID").otherwise("OPTIMAL")


def validate(vocab: DataFrame, freq: DataFrame, n_sentences: int) -> DataFrame:
    """One row: the status of each check and the tier."""
    real = vocab.where(~F.col("token").isin(R.SPECIALS))
    size = real.agg(F.count(F.lit(1)).alias("n")).select("n", size_status(F.col("n"), n_sentences).alias("size"))
    f = fields(vocab).agg(F.min(F.when(F.col("status") == "FAIL", 0).when(F.col("status") == "WARN", 1).otherwise(2)).alias("w")).select(F.element_at(F.array(F.lit("FAIL"), F.lit("WARN"), F.lit("PASS")), F.col("w") + 1).alias("fields"))
    out = size.crossJoin(coverage(vocab, freq).select(F.col("status").alias("coverage"))).crossJoin(oov(vocab, freq).select(F.col("status").alias("oov"))).crossJoin(f)  # one row each
    return out.withColumn("tier", tier(F.array("size", "coverage", "oov", "fields")))
