"""The relation graph of the lexicon: synonyms, hyponyms and other relations as edges, and what they say of a word.

Edges are rows (kata, jenis, ke, urut): a word, the kind of relation, the other word, its place among the word's edges.
A word's neighbours give its domain vector a part in their domains, their number its uncertainty. Neighbours meet the
lexicon by joins (broadcast where counted few, else frequent words in pieces), edges are counted before they are shuffled,
and of a word with very many edges each task keeps the first three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chosen
from ..plans import rules as R
from . import morphology
from .storage import held, looked_up

#: Kinds whose words share a part of their meaning, in the order in which they count, and how many of them do.
NEAR_KINDS, NEAR = ("sinonim", "hiponim"), 3
PART = 0.3


def add(relations: DataFrame, more: DataFrame) -> DataFrame:
    """relations with the edges of more (kata, jenis, ke) behind those there are, in the order of their words; equal edges stay once."""
    last = relations.groupBy(F.col("kata").alias("_k"), F.col("jenis").alias("_j")).agg(F.max("urut").alias("_u"))
    new = more.select(F.lower("kata").alias("kata"), "jenis", F.lower("ke").alias("ke")).distinct().join(relations.select("kata", "jenis", "ke"), ["kata", "jenis", "ke"], "left_anti")
    place = F.row_number().over(Window.partitionBy("kata", "jenis").orderBy("ke"))
    new = new.withColumn("_n", place).join(last, (F.col("kata") == F.col("_k")) & (F.col("jenis") == F.col("_j")), "left")
    return relations.unionByName(new.select("kata", "jenis", "ke", (F.coalesce("_u", F.lit(-1)) + F.col("_n")).cast("int").alias("urut")))


def of(relations: DataFrame, word: str) -> DataFrame:
    """(jenis, ke, urut) of a word."""
    return relations.where(F.col("kata") == word.lower()).select("jenis", "ke", "urut")


def degrees(relations: DataFrame) -> DataFrame:
    """(kata, jenis, n): how many edges of each kind."""
    return relations.groupBy("kata", "jenis").agg(F.count(F.lit(1)).alias("n"))


def uncertainty(known, n):
    """0.8 for a word that is in no entry, else more the more near relations it has: 0.2, from 6 on 0.4, from 11 on 0.6."""
    return F.when(~known, 0.8).when(n > 10, 0.6).when(n > 5, 0.4).otherwise(0.2)


def features(lexicon: DataFrame, relations: DataFrame) -> DataFrame:
    """(kata, n_dekat, tetangga): of each word with near relations, how many, and which places of the domain list the first three have."""
    near = relations.where(F.col("jenis").isin(*NEAR_KINDS))
    kind = chosen(F.col("jenis"), {k: i for i, k in enumerate(NEAR_KINDS)})
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy("kata").orderBy(kind, "urut", "ke"))).where(F.col("_n") <= NEAR)
    first = looked_up(first.select("kata", "ke"), "ke", lexicon.select(F.col("kata").alias("ke"), F.lower("domain").alias("domain")))
    places = F.filter(F.transform(F.array(*[F.lit(x) for x in R.DOMAINS]), lambda c, i: F.when(F.contains(F.col("domain"), c), i)), lambda i: i.isNotNull())
    places = first.select("kata", F.explode(F.coalesce(places, F.array().cast("array<int>"))).alias("p")).groupBy("kata").agg(F.array_sort(F.collect_set("p")).alias("tetangga"))
    n = near.groupBy("kata").agg(F.count(F.lit(1)).alias("n_dekat"))
    return n.join(places, "kata", "left").withColumn("tetangga", F.coalesce("tetangga", F.array().cast("array<int>")))


def with_domain_vector(df: DataFrame, domain: str, neighbours: str) -> DataFrame:
    """Adds bidang, 20 shares: 1 for the word's own domain, 0.3 at least for its neighbours', scaled to sum 1; all 0 without a domain."""
    d = F.lower(domain)
    names = F.array(*[F.lit(x) for x in R.DOMAINS])
    own = F.array_position(F.transform(names, lambda c: F.coalesce(F.contains(d, c) | F.contains(c, d), F.lit(False))), True)
    df = held(df, "_own", own)
    near = F.coalesce(neighbours, F.array().cast("array<int>"))
    shares = [F.when(F.col(domain).isNull(), 0.0).when(F.col("_own") == i + 1, 1.0).when(F.array_contains(near, i), PART).otherwise(0.0) for i in range(len(R.DOMAINS))]
    df = held(df, "_raw", F.array(*shares))
    df = held(df, "_total", F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x))
    return df.withColumn("bidang", F.transform("_raw", lambda x: F.when(F.col("_total") > 0, x / F.col("_total")).otherwise(0.0))).drop("_own", "_raw", "_total")


def vectors(tokens: DataFrame, lexicon: DataFrame, relations: DataFrame, informal: bool = False) -> DataFrame:
    """tokens (teks, root, kelas, pos, domain, serapan, proper, ...) with vektor: 20 domains, 9 classes, register, certainty.

    informal: whether words that are part of informal forms have register 0.
    """
    f = features(lexicon, relations).withColumnRenamed("kata", "_akar")
    t = looked_up(tokens.withColumn("_akar", F.lower("root")), "_akar", f)
    parsed, listed = (chosen(F.lower(c), R.CLASS_DIMENSION) for c in ("kelas", "pos"))
    classes = F.array(*[F.when(parsed == k, 1.0).when(parsed.isNull() & (listed == k), 0.8).otherwise(0.0) for k in R.VECTOR_CLASSES])
    known = F.col("pos").isNotNull()
    register = F.when(F.lit(informal) & morphology.informal(F.col("teks")), 0.0).when(F.col("serapan"), 0.5).when(F.col("proper") | known, 1.0).otherwise(0.5)
    sure = 1.0 - uncertainty(known, F.coalesce("n_dekat", F.lit(0)))
    t = with_domain_vector(t, "domain", "tetangga")
    return t.withColumn("vektor", F.concat("bidang", classes, F.array(register, F.round(sure, 6)))).drop("_akar", "n_dekat", "tetangga", "bidang")


def register(parsed: DataFrame) -> DataFrame:
    """parsed with register, informal words counted: informal where they are over 0.3 of a sentence, mixed where loans are, else formal."""
    n = F.greatest(F.size("tokens"), F.lit(1))
    share = lambda test: F.size(F.filter("tokens", test)) / n
    return parsed.withColumn("register", F.when(share(lambda x: morphology.informal(x["teks"])) > 0.3, "informal").when(share(lambda x: x["serapan"]) > 0.3, "mixed").otherwise("formal"))
