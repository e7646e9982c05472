"""The lexicon as a table: loading, domains from definitions, duplicates, look-ups.

Columns: kata, kelas (dictionary word class), domain (or null), seq. One row for each lower-cased lemma.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chosen, in_list
from ..plans import rules as R


def domain_of(definition):
    """The domain that a definition's words say, or null: strong words count 2 each, weak ones 1 if two or more."""
    d = F.lower(F.coalesce(definition, F.lit("")))
    hits = lambda words: F.size(F.filter(F.array(*[F.lit(w) for w in words.split(",")]), lambda w: F.contains(d, w)))
    order = [*R.STRONG_WORDS, *[k for k in R.WEAK_WORDS if k not in R.STRONG_WORDS]]
    counts = F.array(*[F.struct(hits(R.STRONG_WORDS[k]).alias("strong"), hits(R.WEAK_WORDS[k]).alias("weak"), F.lit(k).alias("domain")) for k in order])
    # a domain that only weak words name stands behind all that strong words name
    scored = F.transform(counts, lambda c, i: F.struct((c["strong"] * 2 + F.when(c["weak"] >= 2, c["weak"]).otherwise(0)).alias("score"), F.when(c["strong"] > 0, -i).otherwise(-i - len(order)).alias("order"), c["domain"].alias("domain")))
    best = F.array_max(scored)
    return F.when(best["score"] > 0, best["domain"])


def main_part(definition):
    """A definition up to ';' or '(2)', if that is not empty and under 200 characters."""
    p = F.split_part(F.split_part(F.coalesce(definition, F.lit("")), F.lit(";"), F.lit(1)), F.lit("(2)"), F.lit(1))
    return F.when((p != "") & (F.char_length(p) < 200), p)


def build(entries: DataFrame) -> DataFrame:
    """Lexicon of entries (lemma, pos, domain, definition, seq).

    A lemma's first entry stays unless a later one's class has strictly higher priority; so the first of the highest.
    """
    e = entries.where(F.col("lemma").isNotNull()).select(F.lower("lemma").alias("kata"), F.coalesce("pos", F.lit("?")).alias("kelas"), "domain", "definition", "seq")
    pos = F.lower("kelas")
    domain = F.when(in_list(pos, R.NO_DOMAIN_POS), F.lit(None).cast("string")).otherwise(F.coalesce("domain", domain_of(main_part(F.col("definition")))))
    fixed = F.create_map(*[F.lit(x) for k, v in R.DOMAIN_OVERRIDES.items() for x in (k, v or "")])
    over = F.try_element_at(fixed, F.col("kata"))
    domain = F.when(over.isNotNull(), F.nullif(over, F.lit(""))).otherwise(domain)
    w = Window.partitionBy("kata").orderBy(chosen(pos, R.POS_PRIORITY, 0).desc(), "seq")
    return e.withColumn("domain", domain).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("kata", "kelas", "domain", "seq")


def add(lexicon: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` (kata, kelas, domain) replace or extend the lexicon."""
    w = Window.partitionBy("kata").orderBy(F.desc("_new"), F.desc("seq"))
    both = lexicon.withColumn("_new", F.lit(0)).unionByName(new.withColumn("seq", F.coalesce(F.col("seq") if "seq" in new.columns else F.lit(None), F.lit(0))).select("kata", "kelas", "domain", "seq").withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def animate(kata, kelas):
    """Known humans and animals, or a pronoun of the lexicon."""
    return in_list(kata, [*R.HUMANS, *R.ANIMALS]) | F.coalesce(F.lower(kelas) == "pron", F.lit(False))


def domain_sizes(lexicon: DataFrame) -> DataFrame:
    return lexicon.where("domain IS NOT NULL").groupBy("domain").agg(F.count(F.lit(1)).alias("n_words"))


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """Broadcast where a count shows at most `most` rows; else joins shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def pos_bonus(a, b):
    a, b = F.lower(a), F.lower(b)
    pair = ((a == "adj") & (b == "n")) | ((a == "n") & (b == "adj"))
    return F.when(a.isNull() | b.isNull(), 0.0).when((a == b) & (a != "?"), 0.2).when(pair, 0.1).otherwise(0.0)


def distance(ra, da, pa, rb, db, pb):
    """Semantic distance of two words (root, domain, class), the earlier one first."""
    bonus = pos_bonus(pa, pb)
    pairs = F.create_map(*[F.lit(x) for (x1, x2), v in R.DOMAIN_PAIRS.items() for x in (f"{x1}>{x2}", v)])
    ga, gb = chosen(da, R.DOMAIN_GROUPS), chosen(db, R.DOMAIN_GROUPS)
    told = F.try_element_at(pairs, F.concat(da, F.lit(">"), db))
    base = F.coalesce(told, F.when(da == db, F.lit(R.SAME_DOMAIN)).when(ga == gb, F.lit(R.RELATED_DOMAIN)).otherwise(F.lit(R.OTHER_DOMAIN)))
    return (F.when(F.lower(ra) == F.lower(rb), 0.0)
            .when(da.isNotNull() & db.isNotNull(), F.greatest(F.lit(0.0), base - bonus))
            .when(da.isNotNull() | db.isNotNull(), F.lit(R.ONE_UNKNOWN))
            .otherwise(F.lit(R.BOTH_UNKNOWN) - bonus * 0.3))


def gap(da, pa, db, pb) -> float:
    """distance() of two different words by the domain and lower-cased class of both, in plain Python: for the few kinds of a sentence's words."""
    bonus = 0.0 if pa is None or pb is None else 0.2 if pa == pb != "?" else 0.1 if {pa, pb} == {"adj", "n"} else 0.0
    if da is None or db is None:
        return R.BOTH_UNKNOWN - bonus * 0.3 if da is db else R.ONE_UNKNOWN
    group = R.DOMAIN_GROUPS.get(da)
    related = R.RELATED_DOMAIN if group is not None and group == R.DOMAIN_GROUPS.get(db) else R.OTHER_DOMAIN
    return max(0.0, R.DOMAIN_PAIRS.get((da, db), R.SAME_DOMAIN if da == db else related) - bonus)


def compatible(ra, da, pa, rb, db, pb, threshold: float = R.THRESHOLD):
    """Whether two words' distance is within the threshold."""
    return distance(ra, da, pa, rb, db, pb) <= threshold


def path(ra, da, rb, db):
    """The words between two words, by their domains: one word, if they are the same."""
    a, b = F.lower(ra), F.lower(rb)
    box = lambda d: F.concat(F.lit("["), d, F.lit("]"))
    return (F.when(a == b, F.array(a)).when(da == db, F.array(a, box(da), b)).when(da.isNotNull() & db.isNotNull(), F.array(a, box(da), F.lit("↔"), box(db), b))
            .when(da.isNotNull(), F.array(a, box(da), F.lit("→?"), b)).when(db.isNotNull(), F.array(a, F.lit("?→"), box(db), b)).otherwise(F.array(a, F.lit("[?]"), b)))


def looked_up(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words (word) with ada, kelas, domain of their entries, whatever their case."""
    e = small(lexicon.select(F.col("kata").alias("_k"), "kelas", "domain"))
    return words.join(e, F.lower("word") == F.col("_k"), "left").withColumn("ada", F.col("_k").isNotNull()).drop("_k")


def words_of_domain(lexicon: DataFrame, domain: str) -> DataFrame:
    return lexicon.where(F.col("domain") == domain).select("kata")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a dictionary file in any of its shapes: {entries: [..]}, a list, or {lemma: {pos, domain} or pos}.

    Gives (lemma, pos, domain, definition, seq).
    """
    raw = spark.read.text(path, wholetext=True)
    item = "struct<id:string,lemma:string,kata:string,pos:string,kelas:string,domain:string,bidang:string,clean_definition:string,definition:string>"
    listed = F.coalesce(F.from_json("value", f"struct<entries:array<{item}>>")["entries"], F.from_json("value", f"array<{item}>"))
    a = raw.select(F.posexplode(listed).alias("seq", "e")).select(
        F.coalesce("e.lemma", "e.kata").alias("lemma"), F.coalesce("e.pos", "e.kelas").alias("pos"), F.coalesce("e.domain", "e.bidang").alias("domain"), F.coalesce("e.clean_definition", "e.definition").alias("definition"), "seq")
    keyed = raw.where(~F.ltrim("value").startswith("[") & F.get_json_object("value", "$.entries").isNull())
    m = keyed.select(F.posexplode(F.from_json("value", "map<string,string>")).alias("seq", "lemma", "v"))
    obj = F.from_json("v", "struct<pos:string,kelas:string,domain:string,bidang:string>")
    b = m.select("lemma", F.when(F.col("v").startswith("{"), F.coalesce(obj["pos"], obj["kelas"])).otherwise(F.col("v")).alias("pos"),
                 F.when(F.col("v").startswith("{"), F.coalesce(obj["domain"], obj["bidang"])).alias("domain"), F.lit(None).cast("string").alias("definition"), "seq")
    first = F.when(F.col("domain").startswith("["), F.get_json_object("domain", "$[0]")).otherwise(F.col("domain"))
    return a.unionByName(b).where(F.col("lemma").isNotNull()).withColumn("domain", first)
