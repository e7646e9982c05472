"""Metrics of texts, parses, vectors and training curves, as declarative aggregates.

Inputs of the text metrics have `ids`: an array of tokens (0 or null entries are padding).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_list
from ..plans import rules as R

# ---- outputs -----------------------------------------------------------------------------------------------------------


def verb_hit_rate(df: DataFrame, verbs: list) -> DataFrame:
    """One row: share of outputs with a verb (0 for none)."""
    v = F.array(*[F.lit(x) for x in verbs])
    return df.agg(F.coalesce(F.avg(F.arrays_overlap("ids", v).cast("double")), F.lit(0.0)).alias("verb_hit_rate"))


def structure(df: DataFrame, verbs: list, subjects: list | None = None, objects: list | None = None) -> DataFrame:
    """One row: mean of {verb, subject, object} / 3. Without lists, a word before or behind the verb stands for them."""
    at = F.array_min(F.filter(F.transform("ids", lambda x, i: F.when(x.isin(verbs), i)), lambda i: i.isNotNull()))
    before = F.slice("ids", 1, F.greatest(F.coalesce(at, F.lit(0)), F.lit(1)))
    after = F.when(at.isNotNull(), F.slice("ids", at + 2, F.size("ids")))
    subj = F.exists(before, lambda x: x.isin(subjects)) if subjects else at > 0
    obj = F.exists(after, lambda x: x.isin(objects)) if objects else F.size(after) > 0
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    s = F.when(F.size("ids") > 0, (one(at.isNotNull()) + one(subj) + one(obj)) / 3.0).otherwise(0.0)
    return df.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("structure_score"))


def diversity(df: DataFrame) -> DataFrame:
    """One row: mean share of distinct tokens, padding left out."""
    real = F.filter("ids", lambda x: x.isNotNull() & (x.cast("string") != "0"))
    s = F.when(F.size(real) > 0, F.size(F.array_distinct(real)) / F.size(real)).otherwise(0.0)
    return df.agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("diversity_score"))


def coherence(df: DataFrame, pmi: DataFrame, key: str = "doc_id", window: int = 3) -> DataFrame:
    """One row: mean over outputs of the mean PMI of their known pairs within a window (0 for none)."""
    pairs = lambda k: F.zip_with(F.slice("ids", 1, F.greatest(F.size("ids") - k, F.lit(0))), F.slice("ids", k + 1, F.greatest(F.size("ids") - k, F.lit(0))), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    p = df.select(key, F.explode(F.concat(*[pairs(k) for k in range(1, window + 1)])).alias("p")).groupBy(key, "p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
    j = p.join(pmi.select("a", "b", "pmi"), ["a", "b"])
    by = j.groupBy(key).agg((F.sum(F.col("pmi") * F.col("n")) / F.sum("n")).alias("s"))
    return df.select(key).join(by, key, "left").agg(F.coalesce(F.avg(F.coalesce("s", F.lit(0.0))), F.lit(0.0)).alias("coherence_score"))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b):
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 1e-8, dot(a, b) / n).otherwise(0.0)


def relation_by(df: DataFrame, vectors: DataFrame, verbs: list, key: str = "doc_id") -> DataFrame:
    """(key, s): for outputs with a verb that is not the last token, the mean cosine of the first verb's vector and those of later tokens."""
    at = F.array_min(F.filter(F.transform("ids", lambda x, i: F.when(x.isin(verbs), i)), lambda i: i.isNotNull()))
    p = df.withColumn("_at", at).where(F.col("_at") < F.size("ids") - 1).select(key, F.get("ids", F.col("_at")).alias("verb"), F.explode(F.slice("ids", F.col("_at") + 2, F.size("ids"))).alias("token"))
    p = p.groupBy(key, "verb", "token").agg(F.count(F.lit(1)).alias("n"))
    v = vectors.select("token", "vector")
    j = p.join(v, "token").join(v.select(F.col("token").alias("verb"), F.col("vector").alias("verb_vector")), "verb")
    return j.groupBy(key).agg((F.sum(cosine(F.col("vector"), F.col("verb_vector")) * F.col("n")) / F.sum("n")).alias("s"))


def relation(df: DataFrame, vectors: DataFrame, verbs: list, key: str = "doc_id") -> DataFrame:
    """One row: the mean of relation_by over outputs that have one."""
    return relation_by(df, vectors, verbs, key).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("relation_score"))


def bundle(df: DataFrame, verbs: list, pmi: DataFrame, vectors: DataFrame | None = None, subjects: list | None = None, key: str = "doc_id") -> DataFrame:
    """One row: all metrics of outputs (key, ids): verb hits, structure, coherence, diversity and, with vectors, relation."""
    parts = [verb_hit_rate(df, verbs), structure(df, verbs, subjects), coherence(df, pmi, key), diversity(df)]
    parts += [relation(df, vectors, verbs, key)] if vectors is not None else []
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


# ---- morphology, structure, drift -----------------------------------------------------------------------------------------
def morphological(df: DataFrame, valid_affixes: list, weight: str | None = None) -> DataFrame:
    """One row from (root, affix): validity, coherence, consistency of the affix by root, and their mean; rows count
    once, or as often as the column `weight` says."""
    n = F.col(weight) if weight else F.lit(1)
    d = df.select("root", "affix", n.alias("_w"))
    bad = (F.col("affix").isin(R.ACTIVE_PREFIXES) & (F.char_length("root") < 3)) | (F.lower("root").isin(R.UNDERIVED) & (F.col("affix") != "<NONE>"))
    mean = lambda ok: F.sum(F.when(ok, F.col("_w")).otherwise(0)) / F.sum("_w")
    a = d.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("n"), mean(F.col("affix").isin(valid_affixes)).alias("affix_validity"), mean(~bad).alias("root_affix_coherence"))
    by = d.groupBy("root", "affix").agg(F.sum("_w").alias("k")).groupBy("root").agg((F.max("k") / F.sum("k")).alias("share"), F.sum("k").alias("n")).where("n >= 2")
    c = by.agg(F.coalesce(F.avg("share"), F.lit(1.0)).alias("transform_consistency"))
    j = a.crossJoin(c)  # one row each
    part = lambda x: F.when(F.col("n") > 0, F.col(x)).otherwise(0.0).alias(x)
    names = ["affix_validity", "root_affix_coherence", "transform_consistency"]
    j = j.select("n", *[part(x) for x in names])
    return j.withColumn("overall", sum((F.col(x) for x in names), F.lit(0.0)) / 3).withColumnRenamed("n", "n_tokens")


def structural(parsed: DataFrame) -> DataFrame:
    """One row from sentences with tokens and edges: S and P present, valid role steps, tokens with an edge, mean."""
    r = F.transform(F.col("tokens"), lambda t: F.when(t["peran"].isin("S", "P", "O", "K"), t["peran"]).otherwise("?"))
    df = parsed.withColumn("_r", r)
    steps = F.zip_with(F.slice("_r", 1, F.greatest(F.size("_r") - 1, F.lit(0))), F.slice("_r", 2, F.greatest(F.size("_r") - 1, F.lit(0))), lambda a, b: F.concat(a, b))
    good = F.size(F.filter(steps, lambda s: s.isin([a + b for a, b in R.ROLE_STEPS])))
    both = F.array_contains("_r", "S") & F.array_contains("_r", "P")
    linked = F.size(F.array_distinct(F.flatten(F.transform("edges", lambda e: F.array(e["i"], e["j"])))))
    a = df.agg(F.count(F.lit(1)).alias("n_sentences"), F.avg(both.cast("double")).alias("spok"), F.sum(good).alias("g"), F.sum(F.size(steps)).alias("s"), F.avg(F.when(F.size("tokens") > 0, linked / F.size("tokens")).otherwise(0.0)).alias("dep"))
    a = a.select("n_sentences", F.coalesce("spok", F.lit(0.0)).alias("spok_completeness"), F.when(F.col("s") > 0, F.col("g") / F.col("s")).otherwise(0.0).alias("order_validity"), F.coalesce("dep", F.lit(0.0)).alias("dep_coherence"))
    return a.withColumn("overall", (F.col("spok_completeness") + F.col("order_validity") + F.col("dep_coherence")) / 3)


def drift(df: DataFrame, by: list[str] | None = None, grounded: float = 0.95) -> DataFrame:
    """From (vector, anchor): mean cosine distance to the anchor, mean norm, share under `grounded`; by groups."""
    d = 1 - cosine(F.col("vector"), F.col("anchor"))
    x = df.where(dot(F.col("anchor"), F.col("anchor")) > 0).withColumn("_d", d).withColumn("_n", F.sqrt(dot(F.col("vector"), F.col("vector"))))
    return x.groupBy(*(by or [])).agg(F.avg("_d").alias("anchor_distance"), F.avg("_n").alias("slot_norm"), F.avg((F.col("_d") < grounded).cast("double")).alias("coverage"), F.count(F.lit(1)).alias("n_tokens"))


def drift_velocity(snapshots: DataFrame, epoch: str) -> DataFrame:
    """Adds velocity (change since the epoch before) and overall. One row for each epoch, so the window is small."""
    v = F.coalesce(F.col("anchor_distance") - F.lag("anchor_distance").over(Window.orderBy(epoch)), F.lit(0.0))
    return snapshots.withColumn("velocity", v).withColumn("overall", F.greatest(F.lit(0.0), 1 - F.col("anchor_distance") - 0.5 * F.greatest(F.lit(0.0), F.col("velocity"))))


# ---- evaluation ---------------------------------------------------------------------------------------------------------
def paired(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row: accuracy at 0.5, mean score of each label, their separation."""
    hit = ((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("double")
    mean = lambda k: F.coalesce(F.avg(F.when(F.col(label) == k, F.col(score))), F.lit(0.0))
    return df.agg(F.avg(hit).alias("accuracy"), mean(1).alias("avg_pos"), mean(0).alias("avg_neg")).withColumn("separation", F.col("avg_pos") - F.col("avg_neg"))


def robustness(scored: DataFrame, category: str = "kategori") -> DataFrame:
    """By category and for all (null): run_size, valid_count, valid_rate, average_score."""
    a = scored.rollup(category).agg(F.count(F.lit(1)).alias("run_size"), F.count_if("valid").alias("valid_count"), F.avg("skor").alias("average_score"))
    return a.withColumn("valid_rate", F.col("valid_count") / F.col("run_size"))


def perplexity(df: DataFrame, nll: str) -> DataFrame:
    return df.agg(F.exp(F.least(F.avg(nll), F.lit(20.0))).alias("perplexity"))


def accuracy(df: DataFrame, predicted: str, true: str, ignore=0) -> DataFrame:
    """One row: share of equal entries where the true one is not padding."""
    ok = F.when(F.col(true) != ignore, (F.col(predicted) == F.col(true)).cast("double"))
    return df.agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("accuracy"))


def degradation(df: DataFrame, by: list[str], intensity: str, loss: str, base: str, mcs: str | None = None, base_mcs: str | None = None) -> DataFrame:
    """By group: slope of the loss's change against the noise's intensity, worst change, recovery 1 - worst / base (not
    below 0) and, with mcs, stability: the least score over the base's."""
    change = F.col(loss) - F.col(base)
    out = [F.regr_slope(change, F.col(intensity)).alias("slope"), F.max(change).alias("worst"), F.greatest(F.lit(0.0), 1 - F.max(change) / F.greatest(F.max(base), F.lit(1e-6))).alias("recovery")]
    out += [(F.min(mcs) / F.greatest(F.max(base_mcs), F.lit(1e-6))).alias("stability")] if mcs else []
    return df.groupBy(*by).agg(*out)


def transfer(df: DataFrame, name: str, value: str, pairs: dict[str, str]) -> DataFrame:
    """(name, baseline, ratio) of runs (name, value): each run's score over that of the run it is held against; 0 if that is 0."""
    m = df.select(F.col(name).alias("name"), F.col(value).alias("v"))
    told = df.sparkSession.createDataFrame(list(pairs.items()), "name string, baseline string")
    j = told.join(m, "name").join(m.withColumnsRenamed({"name": "baseline", "v": "b"}), "baseline")
    return j.select("name", "baseline", F.when(F.col("b") != 0, F.col("v") / F.col("b")).otherwise(0.0).alias("ratio"))


def loop_verdict(history: DataFrame, epoch: str = "epoch") -> DataFrame:
    """One row from epochs (epoch, loss, mcs, svs, sds, velocity, root_ppl, grad_ok): seven criteria and how many hold."""
    row = F.struct(*[c for c in history.columns if c != epoch])
    first, last = F.min_by(row, epoch), F.max_by(row, epoch)
    later = history.join(F.broadcast(history.agg(F.min(epoch).alias("_first"))), F.col(epoch) > F.col("_first")).agg(F.coalesce(F.avg((F.col("sds") < 0.001).cast("double")), F.lit(0.0)).alias("_c"))  # one row
    a = history.agg(first.alias("f"), last.alias("l"), F.bool_and("grad_ok").alias("grad_ok")).crossJoin(later)  # one row each
    c = {"loss_falls": F.col("l.loss") < F.col("f.loss") * 0.85, "mcs_holds": F.col("l.mcs") >= F.col("f.mcs") - 0.05, "svs_holds": F.col("l.svs") >= F.col("f.svs") - 0.10,
         "drift_small": F.abs("l.velocity") < 0.20, "no_collapse": F.col("_c") < 0.70, "perplexity_falls": F.col("l.root_ppl") < F.col("f.root_ppl") * 0.95, "gradients_sound": F.col("grad_ok")}
    a = a.select(*[v.alias(k) for k, v in c.items()])
    return a.withColumn("passed", sum((F.col(k).cast("int") for k in c), F.lit(0)))


def ablation(df: DataFrame, config: str, value: str, full: str = "FULL") -> DataFrame:
    """By configuration: mean and population deviation over seeds, change to the full one, verdict."""
    a = df.groupBy(config).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    ref = a.where(F.col(config) == full).select(F.col("mean").alias("_full"))
    a = a.crossJoin(F.broadcast(ref)).withColumn("delta", F.col("_full") - F.col("mean")).drop("_full")  # one row
    return a.withColumn("verdict", F.when(F.col(config) == full, "reference").when(F.col("delta") > 0.01, "important").when(F.col("delta") > 0.001, "minor").otherwise("none"))


def convergence(df: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """By run: the first epoch whose loss is under half of the initial one (null: none)."""
    first = F.min_by(loss, epoch)
    a = df.groupBy(run).agg(first.alias("_first"))
    return df.join(a, run).groupBy(run).agg(F.min(F.when(F.col(loss) < 0.5 * F.col("_first"), F.col(epoch))).alias("epoch"))


def animate_share(df: DataFrame, words: list) -> DataFrame:
    return df.agg(F.avg(in_list(F.col("token"), words).cast("double")).alias("share"))
