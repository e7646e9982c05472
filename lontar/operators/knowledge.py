"""The knowledge base as tables: words and their types, types and those above them, rules and what they conclude.

A base is four DataFrames, so words, types and rules are added at run time as rows, from any source, and a base can be
written and read like any table. Forward chaining joins a sentence's words with their types, the types with all above
them, and the action with its rules; what a rule concludes is then an expression on the row.

Words, types and rules are broadcast where a count shows that they are few, else they are met by joins in which frequent
words are dealt in pieces. Types above a type come from iterated joins: paths double in length each round until none is
new. Pairs are a set, so types that stand in a circle are each above the other and the rounds end all the same.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import rules as R
from .semantics import bare
from .storage import held, looked_up, release, stored

ANY_PERSON, ANY = "PERSONA", "ENTITAS"
CONCLUSION = "struct<pernyataan:string,subjek:string,relasi:string,objek:string,aturan:string,keyakinan:double,domain:string>"


@dataclass(frozen=True)
class Base:
    #: kata, tipe of entities, and of actions
    entities: DataFrame
    actions: DataFrame
    #: tipe, induk: a type and one directly above it
    supertypes: DataFrame
    #: aturan, aksi, agen, pasien (null: any), kesimpulan (array), domain, prioritas, urut (order of adding)
    rules: DataFrame


def base(spark: SparkSession) -> Base:
    """The base of the fixed rule tables."""
    pairs = lambda d, cols: spark.createDataFrame(list(d.items()), cols)
    rules = [(name, act, ag, pa, says, domain, prio, i) for i, (name, act, ag, pa, says, domain, prio) in enumerate(R.WORLD_RULES)]
    return Base(pairs(R.ENTITY_TYPES, "kata string, tipe string"), pairs(R.ACTION_TYPES, "kata string, tipe string"), pairs(R.SUPERTYPES, "tipe string, induk string"),
                spark.createDataFrame(rules, "aturan string, aksi string, agen string, pasien string, kesimpulan array<string>, domain string, prioritas int, urut long"))


def _renewed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Words of new (kata, tipe) replace or extend those of old; of several rows of a word in new the least type stays."""
    new = new.where(F.col("kata").isNotNull() & F.col("tipe").isNotNull()).groupBy(F.lower("kata").alias("kata")).agg(F.min("tipe").alias("tipe"))
    return old.join(new.select("kata"), "kata", "left_anti").select("kata", "tipe").unionByName(new)


def add_words(kb: Base, words: DataFrame) -> Base:
    """kb with entities of words (kata, tipe): lower-cased, in place of what they were."""
    return replace(kb, entities=_renewed(kb.entities, words))


def add_actions(kb: Base, words: DataFrame) -> Base:
    """kb with action words (kata, tipe)."""
    return replace(kb, actions=_renewed(kb.actions, words))


def add_types(kb: Base, types: DataFrame) -> Base:
    """kb with (tipe, induk): a type may have several above it."""
    return replace(kb, supertypes=kb.supertypes.unionByName(types.select("tipe", "induk")).distinct())


def add_rules(kb: Base, rules: DataFrame) -> Base:
    """kb with further rules (aturan, aksi, agen, pasien, kesimpulan, domain, prioritas): of equal priority they come last, by name."""
    last = F.coalesce(F.max("urut"), F.lit(-1)).alias("_last")
    place = F.row_number().over(Window.orderBy("aturan", "aksi", F.to_json("kesimpulan")))  # the rules that one call adds
    new = rules.withColumn("prioritas", F.col("prioritas").cast("int")).withColumn("urut", place).crossJoin(kb.rules.agg(last))
    return replace(kb, rules=kb.rules.unionByName(new.withColumn("urut", F.col("urut") + F.col("_last")).drop("_last")))


def rules_for(kb: Base, action: str) -> DataFrame:
    return kb.rules.where(F.col("aksi") == action)


def sizes(kb: Base) -> DataFrame:
    """One row: n_aturan, n_entitas, n_aksi, n_tipe."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    types = kb.supertypes.select("tipe").unionByName(kb.supertypes.select(F.col("induk").alias("tipe"))).distinct()
    return count(kb.rules, "n_aturan").crossJoin(count(kb.entities, "n_entitas")).crossJoin(count(kb.actions, "n_aksi")).crossJoin(count(types, "n_tipe"))  # one row each


def closure(supertypes: DataFrame) -> DataFrame:
    """(tipe, supertipe): each type with itself and with every type above it."""
    known = stored(supertypes.select("tipe", F.col("induk").alias("supertipe")).where("tipe IS NOT NULL AND supertipe IS NOT NULL").distinct())
    n = known.count()
    while True:
        further = known.alias("a").join(known.alias("b"), F.col("a.supertipe") == F.col("b.tipe")).select("a.tipe", "b.supertipe")
        more = stored(known.unionByName(further).distinct())
        m = more.count()
        release(known)
        known = more
        if m == n:
            break
        n = m
    kinds = known.select("tipe").unionByName(known.select(F.col("supertipe").alias("tipe")))
    return known.unionByName(kinds.select("tipe", F.col("tipe").alias("supertipe"))).distinct()


def is_subtype(pairs: DataFrame, above: DataFrame) -> DataFrame:
    """pairs (tipe, supertipe) with adalah: whether the one is the other or below it; a type is always its own."""
    known = above.select("tipe", "supertipe").withColumn("_ada", F.lit(True))
    return pairs.join(known, ["tipe", "supertipe"], "left").withColumn("adalah", F.coalesce("_ada", F.col("tipe") == F.col("supertipe"))).drop("_ada")


def _with_types(df: DataFrame, kb: Base, above: DataFrame, slot: str, name: str) -> DataFrame:
    """Adds the type of a slot's value (column `name`) and all types above it (_atas_`name`). above: (tipe, _atas)."""
    value = F.col(f"prop.{slot}.nilai")
    df = looked_up(df.withColumn("kata", F.lower(value)), "kata", kb.entities).drop("kata")
    kind = F.when(value.isNotNull(), F.coalesce("tipe", F.when(value.rlike(r"^\p{Lu}"), ANY_PERSON), F.lit(ANY)))
    df = df.withColumn("tipe", kind)
    df = looked_up(df, "tipe", above)
    return df.withColumn(f"_atas_{name}", F.coalesce("_atas", F.array("tipe"))).drop("_atas").withColumnRenamed("tipe", name)


def inferences(df: DataFrame, kb: Base) -> DataFrame:
    """Adds tipe_agen, tipe_pasien, tipe_aksi, inferensi: what the base's rules conclude from prop, by priority.

    prop as semantics.proposition gives it; null gives no types and an empty array. A rule needs an affirmed proposition,
    its action type, and agent and patient of its types or below them. The base is worked out once and stored: words are
    looked up four times. So are the propositions.
    """
    kb = Base(*(stored(getattr(kb, f.name)) for f in fields(Base)))
    above = stored(closure(kb.supertypes).groupBy("tipe").agg(F.collect_set("supertipe").alias("_atas")))
    df = stored(df.drop("tipe_agen", "tipe_pasien", "tipe_aksi", "inferensi", "kata", "tipe"))
    df = _with_types(_with_types(df, kb, above, "AGEN", "tipe_agen"), kb, above, "PASIEN", "tipe_pasien")
    action = F.lower("prop.aksi")
    for name, word in (("_a0", action), ("_a1", bare(action, R.ACTION_PREFIXES))):
        df = looked_up(df.withColumn("kata", word), "kata", kb.actions).drop("kata").withColumnRenamed("tipe", name)
    df = df.withColumn("tipe_aksi", F.coalesce("_a0", "_a1")).drop("_a0", "_a1")
    rule = F.struct((-F.col("prioritas")).alias("p"), "urut", "aturan", "agen", "pasien", "kesimpulan", "domain")
    by_action = kb.rules.groupBy(F.col("aksi").alias("tipe_aksi")).agg(F.array_sort(F.collect_list(rule)).alias("_aturan"))
    df = held(looked_up(df, "tipe_aksi", by_action), "_aturan", F.col("_aturan"))
    agent, patient = F.coalesce("prop.AGEN.root", F.lit("agen_tidak_diketahui")), F.coalesce("prop.PASIEN.root", F.lit("pasien_tidak_diketahui"))
    to = F.coalesce("prop.PENERIMA.root", "prop.PASIEN.root", F.lit("penerima_tidak_diketahui"))
    may = lambda kind, of: kind.isNull() | F.coalesce(F.array_contains(F.col(of), kind), F.lit(False))
    fitting = F.filter("_aturan", lambda r: may(r["agen"], "_atas_tipe_agen") & may(r["pasien"], "_atas_tipe_pasien"))

    def said(r, s):
        part = F.split(s, " ", 3)
        good = (F.size(part) >= 3) & ~F.contains(F.get(part, 0), F.lit("tidak_diketahui")) & ~F.contains(F.get(part, 2), F.lit("tidak_diketahui"))
        sure = F.round(F.col("prop.kelengkapan") * F.when(r["agen"].isNotNull(), 1.0).otherwise(0.9), 3)
        return F.when(good, F.struct(s.alias("pernyataan"), F.get(part, 0).alias("subjek"), F.get(part, 1).alias("relasi"), F.get(part, 2).alias("objek"), r["aturan"].alias("aturan"), sure.alias("keyakinan"), r["domain"].alias("domain")))

    filled = lambda s: F.replace(F.replace(F.replace(s, F.lit("agen"), agent), F.lit("pasien"), patient), F.lit("penerima"), to)
    out = F.flatten(F.transform(fitting, lambda r: F.transform(F.transform(r["kesimpulan"], filled), lambda s: said(r, s))))
    out = F.coalesce(F.when(F.coalesce(F.col("prop.polaritas"), F.lit(False)), F.filter(out, lambda x: x.isNotNull())), F.array().cast(f"array<{CONCLUSION}>"))
    return held(df, "inferensi", out).drop("_aturan", "_atas_tipe_agen", "_atas_tipe_pasien")


def facts(inferred: DataFrame, key: tuple = ("doc_id",)) -> DataFrame:
    """(key..., subjek, relasi, objek, n, keyakinan): what is concluded of each key, how often, and the surest time."""
    x = inferred.select(*key, F.explode("inferensi").alias("x")).select(*key, "x.*")
    return x.groupBy(*key, "subjek", "relasi", "objek").agg(F.count(F.lit(1)).alias("n"), F.max("keyakinan").alias("keyakinan"))
