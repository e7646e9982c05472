"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding: case is folded, look-alike letters of other scripts become Latin ones, and digits and signs that stand for
letters inside a word become those letters; words are then runs of letters between single spaces. The lexicon holds
whole words and word beginnings with weights, and exception phrases; a word counts by its longest entry, once, and not
at all where an exception begins with it. A text's weights are summed, divided by a slowly growing function of its length, and turned into a
probability by a logistic curve.

The weights are log-odds learned from labelled rows (a sample bounded by MOST_ROWS rows, least hash of doc_id first; of
rows that share a doc_id the one whose text has the least hash), in which near copies, found by a one-value sketch of their four-word shingles, count once. Exceptions are learned too:
longer words that begin like an entry but are mostly found in clean rows, and two-word phrases of which that holds. The number of
entries follows from the sample alone: each stands in LEAST_TOXIC of its rows or more, far oftener than by chance.

Null and empty texts score by the curve at zero. Every row gets a score; repeated rows each get theirs. Rows whose
doc_id is null are never held out. With no toxic training rows the lexicon is DEFAULT, with weight 4 each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_training

MOST_ROWS = 16_000
SHORTEST, LONGEST = 3, 9
LEAST_TOXIC, LEAST_SHARE, LEAST_Z = 4, 0.6, 5.0
DEFAULT = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting", "loser", "trash", "clown")
DEFAULT_EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "sore loser")

#: Letters of other scripts that look like Latin ones.
ALIKE = str.maketrans(dict(zip(
    "авсеніјкмоорԛѕтухуԝɑαβγεικνορτυχωϲ" + "ｏ",
    "abcehijkmoopqstyxywaabyeiknoptuxwc" + "o", strict=True)))
_AS = str.maketrans("01345789@$!", "oieastbgasi")
_GAP = re.compile(r"[\W\d_]+")
#: A whole run of letters, digits and signs, if it is not of letters alone; each text is gone through once.
_SIGNED = re.compile(r"(?<![^\W_])(?<![@$!])[^\W\d_]*+[\d@$!](?:[^\W_]|[@$!])*+")
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(f"[{''.join(map(chr, ALIKE))}]")


def _sign(m) -> str:
    w = m[0].lstrip("!").rstrip("@$!")
    return w.translate(_AS) if _LETTER.search(w) else w


def fold(text: str) -> str:
    """Folded words, each between single spaces, with one in front and one behind."""
    if text.isascii():
        t = text.lower()
    else:
        t = text.casefold()
        if _OTHER.search(t):
            t = t.translate(ALIKE)
    if any(c in t for c in "01345789@$!"):
        t = _SIGNED.sub(_sign, t)
    return f" {_GAP.sub(' ', t).strip()} "


def automaton(terms: dict[str, float], exceptions: dict[str, str]):
    """Entries carry (length, weight), exceptions (length, None)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for t, w in terms.items():
        a.add_word(t, (len(t), w))
    for e in exceptions:
        a.add_word(e, (len(e), None))
    if len(a):
        a.make_automaton()
    return a


def weigh(a, folded: str) -> tuple[float, int]:
    """(summed weights, words with an entry) of a folded text."""
    if not len(a):
        return 0.0, 0
    best: dict[int, tuple[int, float]] = {}
    free = set()
    for end, (n, w) in a.iter(folded):
        at = end - n + 1
        if w is None:
            free.add(at)
        elif at not in best or n > best[at][0]:
            best[at] = (n, w)
    return sum(w for at, (_, w) in best.items() if at not in free), len(best)


def features(total: float, n: int, n_words: int) -> tuple[float, float, float]:
    return total / (1 + math.log1p(n_words)), math.log1p(total), float(n > 0)


def _signature(words: list[str]) -> int:
    import xxhash

    if len(words) < 4:
        return xxhash.xxh64_intdigest(" ".join(words)) >> 1
    return min(xxhash.xxh64_intdigest(" ".join(words[i : i + 4])) for i in range(len(words) - 3)) >> 1


def _begins(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words}
    for w in words:
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def sample(docs: DataFrame, labels: DataFrame, most: int, label: str) -> DataFrame:
    """(doc_id, text, y) of training rows: those of the `most` labels with the least hash of doc_id, one row for each."""
    rows = labels.where(in_training(5, 0) & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(most)  # at most `most` pairs of numbers
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"), F.min("y").alias("y"))


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> dict:
    """The model: terms, exceptions and the curve's coefficients."""
    spark = docs.sparkSession
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def prepare(batches):
        for b in batches:
            f = [fold(x or "") for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(f, pa.string()), pa.array([_signature(x.split()) for x in f], pa.int64())], ["doc_id", "y", "folded", "sig"])

    from .common import stored

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample(docs, labels, most, "toxic").select("doc_id", "y", "text").mapInArrow(prepare, f"doc_id {kind}, y int, folded string, sig long")
    rows = stored(rows.repartition(tasks, "sig"))
    one = rows.groupBy("sig", "y").agg(F.min_by("folded", "doc_id").alias("folded"))
    n = {r.y: r.n for r in one.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        terms, gone = {f" {w} ": 4.0 for w in DEFAULT}, {}
    else:
        def count(batches):
            pos, neg = Counter(), Counter()
            for b in batches:
                for y, x in zip(b.column("y").to_pylist(), b.column("folded").to_pylist()):
                    (pos if y else neg).update(_begins(set(x.split())))
                if len(pos) + len(neg) > 400_000:
                    yield out(pos, neg)
                    pos, neg = Counter(), Counter()
            yield out(pos, neg)

        def out(pos, neg):
            t = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array([pos[x] for x in t], pa.int64()), pa.array([neg[x] for x in t], pa.int64())], ["t", "pos", "neg"])

        f = one.mapInArrow(count, "t string, pos long, neg long").groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        f = f.where((F.col("pos") >= LEAST_TOXIC) & (F.col("pos") >= LEAST_SHARE * (F.col("pos") + F.col("neg"))))
        weight = F.log((F.col("pos") + 0.5) / float(n_pos + 1)) - F.log((F.col("neg") + 0.5) / float(n_neg + 1))
        # how unlikely the count is by chance, from the share of toxic rows
        chance = (F.col("pos") + F.col("neg")) * (n_pos / (n_pos + n_neg))
        f = f.withColumn("w", weight).where((F.col("w") > 0) & ((F.col("pos") - chance) / F.sqrt(chance + 1e-9) > LEAST_Z))
        found = {r.t: (r.w, r.pos, r.neg) for r in f.orderBy("t").collect()}
        # an entry that only repeats what a shorter beginning says is not needed
        terms = {t: v[0] for t, v in found.items() if not any((u := t[:k]) in found and found[u][2] <= 0.1 * found[u][1] for k in range(SHORTEST + 1, len(t)))}
        gone = exceptions(one, terms)
    gone = {f" {e} ": f" {e.split()[0]} " for e in DEFAULT_EXCEPTIONS if f" {e.split()[0]} " in terms} | gone
    model = {"terms": terms, "exceptions": gone}

    def measure(batches):
        a = automaton(terms, gone)
        for b in batches:
            v = [features(*weigh(a, x), x.count(" ") - 1) for x in b.column("folded").to_pylist()]
            v = np.array(v, float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v[:, i])) for i in range(3)] + [b.column("y")], ["a", "b", "c", "y"])

    x = rows.mapInArrow(measure, "a double, b double, c double, y int").toPandas()  # at most `most` rows of four numbers
    model["curve"] = logistic(x[["a", "b", "c"]].to_numpy(), x["y"].to_numpy())
    return model


def exceptions(one: DataFrame, terms: dict[str, float]) -> dict[str, str]:
    """Phrases and longer words that hold an entry yet stand in clean rows: phrase -> the entry it takes back."""
    def near(batches):
        a = automaton(terms, {})
        pos, neg = Counter(), Counter()
        for b in batches:
            for y, x in zip(b.column("y").to_pylist(), b.column("folded").to_pylist()):
                seen = set()
                for end, (n, _) in a.iter(x) if len(a) else ():
                    at = end - n + 1
                    stop = x.find(" ", at + 1)
                    nxt = x.find(" ", stop + 1)
                    if x[at : end + 1] != x[at : stop + 1]:
                        seen.add((x[at : stop + 1], x[at : end + 1]))
                    if nxt > 0:
                        seen.add((x[at : nxt + 1], x[at : end + 1]))
                (pos if y else neg).update(seen)
        t = list(pos.keys() | neg.keys())
        cells = [[x[0] for x in t], [x[1] for x in t]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells] + [pa.array([c[x] for x in t], pa.int64()) for c in (pos, neg)], ["phrase", "term", "pos", "neg"])

    f = one.mapInArrow(near, "phrase string, term string, pos long, neg long").groupBy("phrase", "term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    f = f.where("neg >= 3 AND pos = 0").select("phrase", "term").orderBy("phrase", "term").toPandas()
    return dict(zip(f.phrase, f.term))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Coefficients of a logistic curve with a light ridge, the constant last."""
    x = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, 4))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def score(docs: DataFrame, model: dict, text: str = "text"):
    """A column with the probability of each row's text."""
    terms, gone, curve = model["terms"], model["exceptions"], model["curve"]
    cast = docs.sparkSession.sparkContext.broadcast((terms, gone))  # what the sample taught

    def of(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = automaton(*cast.value)
        for s in it:
            out = []
            for x in s:
                f = fold(x or "")
                v = features(*weigh(a, f), f.count(" ") - 1)
                z = sum(c * u for c, u in zip(curve, v)) + curve[-1]
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pd.Series(out, dtype="float64")

    of.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(of, "double")(F.col(text))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = learn(docs, labels)
    out = docs.select("doc_id", (~in_training(5, 0)).alias("held_out"), score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted toxic."""
    model = learn(docs, labels)
    whole = docs.select(F.struct("*").alias("_row"), score(docs, model).alias("_score"))
    return whole.where(F.col("_score") < 0.5).select("_row.*")
