"""Data for training: co-occurrence, action and domain labels, synthetic relations, loss curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import pairs as pairing
from . import sequences
from ..functions.text import in_list
from .lexicon import small
from ..plans.rules import ACTION_VERBS, DOMAIN_WORDS, OBJECTS, SUBJECTS, TEMPLATES


def words(c):
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[ \t\r\n]+"), lambda w: w != "")


def pmi(texts: DataFrame, vocab: DataFrame | None = None, window: int = 4, min_count: int = 2) -> DataFrame:
    """(a, b, n, pmi): unordered pairs of different words within a window of a text, with positive PMI.

    All probabilities are over the number of tokens. Words are numbered and pairs counted by buckets (`pairs`). Beyond the
    words that may be broadcast, pairs come from shifted arrays in each row, and are joined with the words' counts.
    """
    ws = texts.select(words(F.col("text")).alias("w"))
    num = pairing.numbered(ws, "w") if vocab is None else None
    if num is not None:
        name = lambda c: small(num.words.select(F.col("t").alias(f"_{c}"), F.col("n").alias(c)))
        p = pairing.scored(num, window, min_count).join(name("x"), "x").join(name("y"), "y")
        return p.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "n", "pmi")
    if vocab is not None:
        # words outside the vocabulary close up, so they go before pairs are formed
        known = vocab.select(F.col("token").alias("t")).distinct()
        pos = ws.withColumn("id", F.monotonically_increasing_id()).select("id", F.posexplode("w").alias("i", "t")).join(known, "t", "left_semi")
        ws = pos.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("w"))
    pairs = lambda k: F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - k, F.lit(0))), F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    p = ws.select(F.explode(F.concat(*[pairs(k) for k in range(1, window + 1)])).alias("p")).where("p.a <> p.b").groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)
    c = ws.select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("c"))
    total = ws.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("total"))
    j = p.join(c.select(F.col("t").alias("a"), F.col("c").alias("ca")), "a").join(c.select(F.col("t").alias("b"), F.col("c").alias("cb")), "b").crossJoin(F.broadcast(total))  # one row
    t = F.col("total").cast("double")
    v = F.log(F.col("n") / t / (F.col("ca") / t * (F.col("cb") / t) + 1e-9) + 1e-9)
    return j.withColumn("pmi", v).where("pmi > 0").select("a", "b", "n", "pmi")


def has_action(c):
    return F.arrays_overlap(words(c), F.array(*[F.lit(w) for w in ACTION_VERBS]))


def domain_label(c):
    """The domain with the most of its words in the text (as parts), the first of equals; other, if none."""
    t = F.lower(c)
    hits = F.array(*[F.struct(F.size(F.filter(F.array(*[F.lit(w) for w in ws.split()]), lambda w: F.contains(t, w))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, (d, ws) in enumerate(DOMAIN_WORDS.items())])
    best = F.array_max(hits)
    return F.when(best["n"] > 0, best["d"]).otherwise("other")


def _seeded(df: DataFrame, name: str, seed: int, text: str = "text") -> DataFrame:
    """df with its rows' places, from 1, in a seeded order: that of digests of their texts. Equal rows stand together."""
    from .storage import ranked

    u = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(text), F.lit(""))).cast("binary"))
    others = [F.col(c) for c in df.columns if c != text and df.schema[c].dataType.typeName() not in ("map", "variant")]
    return ranked(df.withColumn("_u", u), name, F.col("_u"), *others).drop("_u")


def sampled(df: DataFrame, n, seed: int, text: str = "text") -> DataFrame:
    """n rows (all, if there are fewer) in a seeded order; n: a number, or a one-row table with the column n."""
    r = _seeded(df, "_at", seed, text)
    if isinstance(n, DataFrame):
        return r.crossJoin(F.broadcast(n.select(F.col("n").alias("_n")))).where("_at <= _n").drop("_at", "_n")  # one row
    return r.where(F.col("_at") <= int(n)).drop("_at")


def filter_actions(texts: DataFrame, other_limit: float = 0.15, seed: int = 42) -> DataFrame:
    """All rows with an action, and of the others, in a seeded order, so many that they are other_limit of the result."""
    t = texts.withColumn("_action", F.coalesce(has_action(F.col("text")), F.lit(False)))
    n = t.agg(F.floor(F.count_if("_action") * other_limit / max(1 - other_limit, 1e-6)).alias("n"))
    return t.where("_action").drop("_action").unionByName(sampled(t.where("NOT _action").drop("_action"), n, seed))


def _drawn(name: str, seed: int, i, n):
    """The i-th of a run of seeded draws from 0 up to n."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{name}:"), i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n


def phase_mix(actions: DataFrame, others: DataFrame, action_ratio: float = 0.4, seed: int = 42) -> DataFrame:
    """(part, text): all of `others`, and actions drawn with replacement up to action_ratio of the whole, three times each at most on average."""
    from .storage import stored

    a = stored(_seeded(actions.select("text"), "_at", seed))
    m, k = a.count(), int(others.count() * action_ratio / max(1 - action_ratio, 1e-6))
    draws = actions.sparkSession.range(1, min(k, 3 * m) + 1).select((_drawn("mix", seed, F.col("id"), max(m, 1)) + 1).alias("_at"))
    # equal draws are counted first, so that no row is joined with many
    draws = draws.groupBy("_at").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    drawn = a.join(draws, "_at").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(F.lit("action").alias("part"), "text")
    return drawn.unionByName(others.select(F.lit("other").alias("part"), "text"))


def relations(spark: SparkSession, n: int = 6000, seed: int = 42) -> DataFrame:
    """(id, text): n sentences of seeded verb-object pairs, subjects and templates, with replacement."""
    pairs = [(v, o) for v, os in OBJECTS.items() for o in os.split()]
    pick = lambda name, xs: F.get(F.array(*[F.lit(x) for x in xs]), _drawn(name, seed, F.col("id"), len(xs)).cast("int"))
    r = spark.range(1, n + 1).select("id", pick("pair", [f"{v} {o}" for v, o in pairs]).alias("p"), pick("subject", SUBJECTS).alias("s"), pick("template", TEMPLATES).alias("t"))
    verb, obj = F.split_part("p", F.lit(" "), F.lit(1)), F.split_part("p", F.lit(" "), F.lit(2))
    return r.select("id", F.replace(F.replace(F.replace("t", F.lit("{subj}"), F.col("s")), F.lit("{verb}"), verb), F.lit("{obj}"), obj).alias("text"))


def curriculum(actions: DataFrame, others: DataFrame, replay: float = 0.3, n_relations: int = 6000, most_others: int = 5000, seed: int = 42) -> DataFrame:
    """(phase, part, text). 1: the actions, filtered; 2: relations and a replay of phase 1; 3: at most most_others of the
    others, half a replay of phase 1 and a replay of phase 2."""
    from .storage import stored

    spark = actions.sparkSession
    one = stored(filter_actions(actions.select("text"), seed=seed))
    n1 = one.count()
    two = relations(spark, n_relations, seed).select(F.lit("relation").alias("part"), "text").unionByName(sampled(one, int(n1 * replay), seed + 1).select(F.lit("replay 1").alias("part"), "text"))
    two = stored(two)
    n2 = two.count()
    three = sampled(others.select("text"), most_others, seed + 2).select(F.lit("other").alias("part"), "text")
    three = three.unionByName(sampled(one, int(n1 * replay * 0.5), seed + 3).select(F.lit("replay 1").alias("part"), "text"))
    three = three.unionByName(sampled(two.select("text"), int(n2 * replay), seed + 4).select(F.lit("replay 2").alias("part"), "text"))
    phase = lambda k, df: df.select(F.lit(k).alias("phase"), "part", "text")
    return phase(1, one.withColumn("part", F.lit("action"))).unionByName(phase(2, two)).unionByName(phase(3, three))


def relation_corpus(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """(verb, object, text): all templates with all subjects and valid verb-object pairs; more: further pairs (verb, object)."""
    vo = spark.createDataFrame([(v, o) for v, os in OBJECTS.items() for o in os.split()], "verb string, object string")
    if more is not None:
        vo = vo.unionByName(more.select("verb", "object")).distinct()
    s = F.explode(F.array(*[F.lit(x) for x in SUBJECTS])).alias("subject")
    t = F.explode(F.array(*[F.lit(x) for x in TEMPLATES])).alias("template")
    r = vo.select("verb", "object", s).select("*", t)
    text = F.replace(F.replace(F.replace("template", F.lit("{subj}"), F.col("subject")), F.lit("{verb}"), F.col("verb")), F.lit("{obj}"), F.col("object"))
    return r.select("verb", "object", text.alias("text"))


def vo_pairs(texts: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(verb, object, n): valid verb-object neighbours found in texts; more: pairs (verb, object) that are valid too."""
    w = texts.select(words(F.col("text")).alias("w"))
    p = w.select(F.explode(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("verb"), b.alias("object")))).alias("p")).select("p.*")
    known = F.lit(False)
    for v, os in OBJECTS.items():
        known = known | ((F.col("verb") == v) & in_list(F.col("object"), os.split()))
    n = (p.where(known) if more is None else p).groupBy("verb", "object").agg(F.count(F.lit(1)).alias("n"))
    if more is None:
        return n
    # neighbours are counted before they meet the pairs, so no pair is hot
    fixed = texts.sparkSession.createDataFrame([(v, o) for v, os in OBJECTS.items() for o in os.split()], "verb string, object string")
    return n.join(fixed.unionByName(more.select("verb", "object")).distinct(), ["verb", "object"], "left_semi")


# ---- loss curves: (key, step, loss) ---------------------------------------------------------------------------------
curve, ema = sequences.curve, sequences.ema


def relation_loss(by: DataFrame, least: float = 0.3) -> DataFrame:
    """One row: mean shortfall of outputs' mean similarity (s, as metrics.relation_by gives it) below `least`; 0 for none."""
    return by.agg(F.coalesce(F.avg(F.greatest(F.lit(0.0), least - F.col("s"))), F.lit(0.0)).alias("relation_loss"))


def cooccurrence_loss(df: DataFrame, pmi: DataFrame, window: int = 3) -> DataFrame:
    """One row: minus the mean PMI of all known pairs of ids within a window; 0 for none. 0 and null are padding."""
    at = lambda x, i: F.when(x.isNotNull() & (x.cast("string") != "0"), x)
    ids = F.transform("ids", at)
    pairs = lambda k: F.zip_with(F.slice("_x", 1, F.greatest(F.size("_x") - k, F.lit(0))), F.slice("_x", k + 1, F.greatest(F.size("_x") - k, F.lit(0))), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))))
    p = df.select(ids.alias("_x")).select(F.explode(F.concat(*[pairs(k) for k in range(1, window + 1)])).alias("p")).where("p IS NOT NULL")
    n = p.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).join(pmi.select("a", "b", "pmi"), ["a", "b"])
    return n.agg(F.coalesce(-F.sum(F.col("n") * F.col("pmi")) / F.sum("n"), F.lit(0.0)).alias("cooccurrence_loss"))


def own_cooccurrence_loss(texts: DataFrame, window: int = 3) -> DataFrame:
    """cooccurrence_loss of texts by their own PMI: a pair's occurrences within both windows are counted at once."""
    num = pairing.numbered(texts.select(words(F.col("text")).alias("ids")))
    if num is None:
        return cooccurrence_loss(texts.select(words(F.col("text")).alias("ids")), pmi(texts), window)
    n = pairing.scored(num, near=window, ignored="0")
    return n.agg(F.coalesce(-F.sum(F.col("m") * F.col("pmi")) / F.nullif(F.sum("m"), F.lit(0)), F.lit(0.0)).alias("cooccurrence_loss"))


def own_coherence(texts: DataFrame, key: str = "doc_id", window: int = 3) -> DataFrame:
    """metrics.coherence of texts by their own PMI."""
    from . import metrics

    ids = texts.select(key, words(F.col("text")).alias("ids"))
    num = pairing.numbered(ids, key=(key,))
    if num is None:
        return metrics.coherence(ids, pmi(texts), key, window)
    by = pairing.by_text(num, near=window).join(num.texts.select("id", key), "id").groupBy(key).agg((F.sum("s") / F.sum("n")).alias("s"))
    return texts.select(key).join(by, key, "left").agg(F.coalesce(F.avg(F.coalesce("s", F.lit(0.0))), F.lit(0.0)).alias("coherence_score"))


def negatives(df: DataFrame, n: int = 1, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """(key, copy, ids): n versions of each row with its ids in a seeded order; two or fewer stay. Padding (0) is at the end."""
    real = F.filter("ids", lambda x: x.cast("string") != "0")
    d = df.select(key, "ids", real.alias("_r"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("copy"))
    u = lambda i: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.col("copy").cast("string"), F.lit(":"), i.cast("string")).cast("binary"))
    mixed = F.transform(F.array_sort(F.transform("_r", lambda x, i: F.struct(u(i).alias("u"), i.alias("i"), x.alias("x")))), lambda s: s["x"])
    out = F.concat(mixed, F.slice("ids", F.size("_r") + 1, F.size("ids")))
    return d.select(key, "copy", F.when(F.size("_r") > 2, out).otherwise(F.col("ids")).alias("ids"))


def correctness_loss(df: DataFrame, binary: float = 1.0, margin: float = 0.3, consist: float = 0.1) -> DataFrame:
    """One row from (score, label, morph, struct, semantic, lexical): cross-entropy, how far wrong rows score above right
    ones, mean variance of the four parts, and their weighted sum."""
    floor = lambda x: F.greatest(F.when(x > 0, F.log(x)).otherwise(-100.0), F.lit(-100.0))
    bce = -(F.col("label") * floor(F.col("score")) + (1 - F.col("label")) * floor(1 - F.col("score")))
    parts = [F.col(c) for c in ("morph", "struct", "semantic", "lexical")]
    mean = sum(parts, F.lit(0.0)) / 4
    spread = sum(((p - mean) * (p - mean) for p in parts), F.lit(0.0)) / 3
    good, bad = F.avg(F.when(F.col("label") > 0.5, F.col("score"))), F.avg(F.when(F.col("label") <= 0.5, F.col("score")))
    a = df.agg(F.coalesce(F.avg(bce), F.lit(0.0)).alias("l_binary"), F.when(good.isNotNull() & bad.isNotNull(), F.greatest(F.lit(0.0), bad - good)).otherwise(0.0).alias("l_margin"), F.coalesce(F.avg(spread), F.lit(0.0)).alias("l_consist"))
    return a.withColumn("total", binary * F.col("l_binary") + margin * F.col("l_margin") + consist * F.col("l_consist"))


def averaged(df: DataFrame, by: list[str], losses: list[str]) -> DataFrame:
    """By group: the mean of each loss, NaN left out."""
    return df.groupBy(*by).agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in losses])


def adapted(lam, loss, threshold: float, rate: float, low: float, high: float):
    """A loss weight's next value: raised where the loss is above its threshold, lowered where it is under half."""
    out = F.when(loss > threshold * 1.5, lam * (1 + rate * 2)).when(loss > threshold, lam * (1 + rate)).when(loss < threshold * 0.5, lam * (1 - rate * 0.5)).otherwise(lam)
    return F.greatest(F.lit(low), F.least(F.lit(high), out))


def learning_rate(step, base: float, warmup: int, total: int):
    """Linear warm-up, then half a cosine."""
    p = (step - warmup) / float(max(1, total - warmup))
    return F.when(step < warmup, base * step / float(max(1, warmup))).otherwise(base * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * p)))


# ---- loss weights that follow the losses -----------------------------------------------------------------------------
#: Of each loss, its weight's first value, its bounds, and the loss's threshold.
LOSS_WEIGHTS = {"morph": (1.0, 0.3, 2.0, 0.3), "struct": (0.8, 0.3, 1.5, 0.4), "sem": (0.6, 0.2, 1.2, 0.5), "ctx": (1.0, 0.5, 2.0, 0.3), "ar": (1.5, 0.5, 3.0, 0.5)}
ADAPT_EVERY, ADAPT_RATE, MOST_WEIGHT = 10, 0.05, 8.0


def next_weights(weights: list[float], recent: list[float], rate: float = ADAPT_RATE) -> list[float]:
    """All weights' next values from their losses' recent means (adapted()'s rule), scaled down where they pass MOST_WEIGHT together."""
    out = []
    for w, loss, (_, low, high, threshold) in zip(weights, recent, LOSS_WEIGHTS.values()):
        w *= 1 + 2 * rate if loss > threshold * 1.5 else 1 + rate if loss > threshold else 1 - rate * 0.5 if loss < threshold * 0.5 else 1.0
        out.append(max(low, min(high, w)))
    total = sum(out)
    return [w * (MOST_WEIGHT / total) for w in out] if total > MOST_WEIGHT else out


def controlled(df: DataFrame, key: str, step: str, rate: float = ADAPT_RATE) -> DataFrame:
    """(key, step, l_<loss>..., w_<loss>...): the weights in force after each step of a run.

    df has a column l_<loss> for each of LOSS_WEIGHTS; null: not measured at that step. Every ten steps the weights follow the
    means of the losses measured in the last ten (none: 0). The means come from ranges of the run; the weights depend on each
    other and on their own bounds, so they are a fold in order: one row of ten goes through it, in a stream that keeps five
    numbers, and all other rows look up theirs.
    """
    import pandas as pd

    names = list(LOSS_WEIGHTS)
    rows, segments = sequences.laid_out(df.select(key, step, *[F.col(f"l_{x}").cast("double").alias(f"l_{x}") for x in names]), [key], [step])
    d = sequences.with_halo(rows, segments, [key], ADAPT_EVERY - 1)
    last = Window.partitionBy(key, "_p").orderBy("_n").rowsBetween(-(ADAPT_EVERY - 1), 0)
    at = d.select(key, "_n", "_halo", *[F.coalesce(F.avg(f"l_{x}").over(last), F.lit(0.0)).alias(f"r_{x}") for x in names])
    at = at.where(f"NOT _halo AND (_n + 1) % {ADAPT_EVERY} = 0").select(key, (F.col("_n") + 1).alias("_n"), *[f"r_{x}" for x in names])

    def fold(batches):
        now, weights = None, []
        for p in batches:
            out = []
            for row in p.itertuples(index=False):
                k = None if pd.isna(row[0]) else row[0]
                if (k,) != now:
                    now, weights = (k,), [x[0] for x in LOSS_WEIGHTS.values()]
                weights = next_weights(weights, list(row[2:]), rate)
                out.append((row[0], row[1], *weights))
            yield pd.DataFrame(out, columns=[key, "_n", *[f"w_{x}" for x in names]])

    kind = df.schema[key].dataType.simpleString()
    done = at.repartition(key).sortWithinPartitions(key, "_n").mapInPandas(fold, f"{key} {kind}, _n long, " + ", ".join(f"w_{x} double" for x in names))
    j = rows.withColumn("_m", F.floor((F.col("_n") + 1) / ADAPT_EVERY) * ADAPT_EVERY).alias("l")
    j = j.join(done.alias("r"), F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")) & (F.col("l._m") == F.col("r._n")), "left")
    return j.select(f"l.{key}", f"l.{step}", *[f"l.l_{x}" for x in names], *[F.coalesce(F.col(f"r.w_{x}"), F.lit(LOSS_WEIGHTS[x][0])).alias(f"w_{x}") for x in names])
