"""A dictionary store as tables: dense ids, classes with counts, definitions, look-ups with confidence, coverage.

Entries are (lemma, pos, definition, seq). Lemmas are trimmed and lower-cased, and numbered from 1 as they first come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import rules as R
from . import homology
from .storage import ranked


def _entries(entries: DataFrame) -> DataFrame:
    e = entries.select(F.lower(F.trim("lemma")).alias("lemma"), F.coalesce("pos", F.lit("unk")).alias("pos"), "definition", "seq")
    return e.where("lemma IS NOT NULL AND lemma <> ''")


def load(entries: DataFrame, most: int | None = None) -> DataFrame:
    """(lemma, id, pos, n_entries, definitions): pos is the first entry's; most: ids stay below it, as reading stops there."""
    e = _entries(entries)
    g = e.groupBy("lemma").agg(F.min("seq").alias("seq"), F.min_by("pos", "seq").alias("pos"), F.count(F.lit(1)).alias("n_entries"),
                               F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("definition", F.lit("")) != "", F.struct("seq", "definition")))), lambda x: x["definition"]).alias("definitions"))
    g = ranked(g, "id", F.col("seq"), F.col("lemma"))
    g = g.where(F.col("id") < most) if most else g
    return g.select("lemma", "id", "pos", "n_entries", "definitions")


def classes(entries: DataFrame) -> DataFrame:
    """(lemma, pos, freq, first): how often a lemma has a class, and where it first does."""
    return _entries(entries).groupBy("lemma", "pos").agg(F.count(F.lit(1)).alias("freq"), F.min("seq").alias("first"))


def top_classes(counts: DataFrame, n: int = 5) -> DataFrame:
    """(lemma, pos_list): a lemma's n most frequent classes, the first seen of equals."""
    s = F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "first", "pos")))
    return counts.groupBy("lemma").agg(F.transform(F.slice(s, 1, n), lambda x: x["pos"]).alias("pos_list"))


def lookup(words: DataFrame, store: DataFrame, slang: DataFrame | None = None, least: float = 0.75) -> DataFrame:
    """(word, lemma, id, confidence): exact after slang, exact as it is, else the most similar lemma; (null, 0, 0) if none.

    slang: (informal, formal). least above 0.85 leaves out similar lemmas.
    """
    w = words.select("word").distinct().withColumn("clean", F.lower(F.trim("word")))
    w = w.join(slang.select(F.lower(F.trim("informal")).alias("clean"), F.lower(F.trim("formal")).alias("formal")), "clean", "left") if slang is not None else w.withColumn("formal", F.lit(None).cast("string"))
    w = w.withColumn("formal", F.coalesce("formal", "clean"))
    s = store.select("lemma", "id")
    w = w.join(s.withColumnsRenamed({"lemma": "formal", "id": "_f"}), "formal", "left").join(s.withColumnsRenamed({"lemma": "clean", "id": "_c"}), "clean", "left")
    w = w.withColumn("_id", F.coalesce("_f", "_c")).withColumn("lemma", F.when(F.col("_f").isNotNull(), F.col("formal")).when(F.col("_c").isNotNull(), F.col("clean")))
    if least > 0.85:
        return w.select("word", "lemma", F.coalesce("_id", F.lit(0)).alias("id"), F.when(F.col("_id").isNotNull(), 1.0).otherwise(0.0).alias("confidence"))
    near = homology.fuzzy(w.where("_id IS NULL").select(F.col("formal").alias("word")), s.withColumnRenamed("lemma", "kata"), max(least, 0.75))
    near = near.join(s.withColumnRenamed("lemma", "kata"), "kata").select(F.col("word").alias("formal"), F.col("kata").alias("_near"), F.col("id").alias("_n"), "ratio")
    w = w.join(near, "formal", "left")
    return w.select("word", F.coalesce("lemma", "_near").alias("lemma"), F.coalesce("_id", "_n", F.lit(0)).alias("id"), F.when(F.col("_id").isNotNull(), 1.0).otherwise(F.coalesce("ratio", F.lit(0.0))).alias("confidence"))


def contains(words: DataFrame, store: DataFrame) -> DataFrame:
    """words with known."""
    s = store.select(F.col("lemma").alias("_l"), F.lit(True).alias("_k"))
    return words.join(s, F.lower(F.trim("word")) == F.col("_l"), "left").withColumn("known", F.coalesce("_k", F.lit(False))).drop("_l", "_k")


def vocabulary_map(vocab: DataFrame, store: DataFrame, slang: DataFrame | None = None) -> DataFrame:
    """(token, id, lemma_id): a vocabulary's ids and the dictionary's (0: none); specials are left out."""
    v = vocab.where(~F.col("token").isin(R.SPECIALS)).select("token", "id")
    found = lookup(v.select(F.col("token").alias("word")), store, slang, 1.0).select(F.col("word").alias("token"), F.col("id").alias("lemma_id"))
    return v.join(found, "token").select("token", "id", "lemma_id")


def coverage(mapping: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """One row: vocab_size, hits, initial_coverage; with (token, freq): tokens seen, hits among them, runtime_coverage."""
    m = mapping.agg(F.count(F.lit(1)).alias("vocab_size"), F.count_if(F.col("lemma_id") > 0).alias("hits")).withColumn("initial_coverage", F.col("hits") / F.greatest(F.col("vocab_size"), F.lit(1)))
    if freq is None:
        return m
    f = freq.join(mapping.select("token", "lemma_id"), "token", "left")
    hit = F.sum(F.when(F.col("lemma_id") > 0, F.col("freq")).otherwise(0))
    r = f.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("total_tokens_seen"), F.coalesce(hit, F.lit(0)).alias("dictionary_hits"))
    r = r.withColumn("runtime_coverage", F.when(F.col("total_tokens_seen") > 0, F.col("dictionary_hits") / F.col("total_tokens_seen")))
    return m.crossJoin(r).withColumn("runtime_coverage", F.coalesce("runtime_coverage", "initial_coverage"))  # one row each


def fitted(vector, size: int):
    """A vector cut off at `size` dimensions, or repeated up to it."""
    n = F.size(vector)
    return F.when(n > 0, F.slice(F.flatten(F.array_repeat(vector, F.ceil(F.lit(size) / n).cast("int"))), 1, size)).otherwise(vector)


def anchors(tokens: DataFrame, mapping: DataFrame, vectors: DataFrame, size: int | None = None) -> DataFrame:
    """tokens (.., id) with anchor, the vector (lemma_id, vector) of their dictionary entry, fitted to size; null if none."""
    v = mapping.where("lemma_id > 0").select("id", "lemma_id").join(vectors.select("lemma_id", "vector"), "lemma_id").select("id", F.col("vector").alias("anchor"))
    out = tokens.join(v, "id", "left")
    return out.withColumn("anchor", fitted(F.col("anchor"), size)) if size else out
