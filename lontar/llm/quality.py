"""Quality by a kernel model of document statistics.

Each text gives STATS (shares of letters, capitals, signs; repetition of words, word pairs and lines; word lengths).
Standardised, they go through DIMS random Fourier features, cosines of random projections that approximate a Gaussian
kernel. Ridge scores solve the normal equations, whose matrices are summed over partitions, by FOLDS of the rows: each
fold is scored by the solution without its own matrices, and isotonic regression (pool adjacent violators) of labels on
these scores, which no row had a part in, turns the whole solution's scores into probabilities.

Training uses the labelled rows with the least hash of doc_id, MOST_ROWS at most; of rows that share a doc_id the one
whose text has the least hash. Null counts as the empty text, which
has statistics too (zeros) and so a score. Every row gets a score; repeated rows each get theirs. With no training
rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import in_training
from .toxicity import sample

MOST_ROWS, DIMS, GAMMA, RIDGE, SEED, FOLDS = 40_000, 256, 0.04, 1e-3, 29, 5
U = np.uint64
STATS = ("log_bytes", "log_words", "capitals", "letters", "digits", "spaces", "marks", "ends", "bars", "signs", "bangs", "lines",
         "mean_word", "sd_word", "once", "again", "pairs", "line_copies", "sign_words", "big_words")


def _classes():
    c = np.zeros(256, np.int64)
    c[65:91] = 1
    c[97:123] = 2
    c[128:] = 2
    c[48:58] = 3
    c[[32, 9, 11, 12, 13]] = 4
    c[[46, 44]] = 5  # ends of clauses
    c[124] = 6
    c[[ord(x) for x in "#$%&*@~^=+<>{}[]\\`"]] = 7
    c[33] = 8
    c[10] = 9
    c[[ord(x) for x in "\"'()-/:;?_"]] = 10
    return c


def _uniques(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of h in each document."""
    if not len(h):
        return np.zeros(n, np.int64)
    o = np.argsort(h, kind="stable")
    o = o[np.argsort(doc[o], kind="stable")]
    a, d = h[o], doc[o]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=n)


def statistics(texts) -> np.ndarray:
    """A row of STATS for each text of an Arrow string column."""
    cls = K.kept("byte classes", _classes)
    out = [np.zeros((0, len(STATS)))]
    for _, _, raw, offs in K.chunks(texts):
        n = len(offs) - 1
        size = np.diff(offs)
        by = np.bincount(np.repeat(np.arange(n), size) * 11 + cls[raw], minlength=n * 11).reshape(n, 11).astype(float)
        # capital letters of two bytes that begin with C3
        if len(raw) > 1:
            at = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E))
            two = np.bincount(np.searchsorted(offs, at, "right") - 1, minlength=n)[:n]
            by[:, 1] += 2 * two
            by[:, 2] -= 2 * two
        h, start, end, first = K.words(raw, offs)
        nw = np.diff(first)
        doc = np.repeat(np.arange(n), nw)
        lens = (end - start).astype(float)
        one, w1 = np.maximum(size, 1), np.maximum(nw, 1)
        mean = np.bincount(doc, lens, n) / w1
        sd = np.sqrt(np.maximum(0, np.bincount(doc, lens * lens, n) / w1 - mean**2))
        again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        g = K.grams(h, 2)
        gd = doc[: len(g)][doc[1:] == doc[:-1]] if len(g) else doc[:0]
        pair = g[doc[1:] == doc[:-1]] if len(g) else g
        tail = cls[raw[end - 1]] if len(end) else end
        head = cls[raw[start]] if len(start) else start
        # lines: ended by a line feed
        nl = np.flatnonzero(raw == 10)
        lines = by[:, 9]
        copies = np.zeros(n)
        if len(nl) and len(h):
            line = np.searchsorted(nl, start)  # number of line feeds before each word
            key = line + doc  # words of one line of one document
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            lh = K.mix(np.add.reduceat(h * K.mix((np.arange(len(h)) - np.repeat(cut, np.diff(np.r_[cut, len(h)]))).astype(U) + U(7)), cut))
            ld = doc[cut]
            of = np.bincount(ld, minlength=n)
            copies = np.where(of > 0, 1 - _uniques(lh, ld, n) / np.maximum(of, 1), 0.0)
        out.append(np.column_stack([
            np.log1p(size), np.log1p(nw), by[:, 1] / one, (by[:, 1] + by[:, 2]) / one, by[:, 3] / one, by[:, 4] / one, by[:, 10] / one,
            by[:, 5] / w1, by[:, 6] / w1, by[:, 7] / w1, by[:, 8] / w1, lines / w1, mean, sd,
            _uniques(h, doc, n) / w1, np.bincount(doc[1:][again], minlength=n) / w1, 1 - _uniques(pair, gd, n) / np.maximum(np.bincount(gd, minlength=n), 1), copies,
            np.bincount(doc[tail == 7], minlength=n) / w1, np.bincount(doc[head == 1], minlength=n) / w1]))
    return np.vstack(out)


def _waves(d: int, dims: int, gamma: float, seed: int):
    r = np.random.Generator(np.random.PCG64(seed))
    return r.standard_normal((d, dims)) * np.sqrt(2 * gamma), r.uniform(0, 2 * np.pi, dims)


def fourier(x: np.ndarray, m: dict) -> np.ndarray:
    w, b = _waves(x.shape[1], m["dims"], m["gamma"], m["seed"])
    z = np.clip((x - m["mean"]) / m["sd"], -6, 6)
    return np.column_stack([np.sqrt(2 / m["dims"]) * np.cos(z @ w + b), np.ones(len(z))])


def isotonic(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, value): knots of the rising step fit, by pooling adjacent violators."""
    o = np.argsort(s, kind="stable")
    at, inv = np.unique(s[o], return_inverse=True)
    tot, wt = np.bincount(inv, y[o]), np.bincount(inv).astype(float)
    v, w, lo, hi = [], [], [], []
    for a, t, c in zip(at, tot, wt):
        v.append(t / c), w.append(c), lo.append(a), hi.append(a)
        while len(v) > 1 and v[-2] >= v[-1]:
            c2 = w[-2] + w[-1]
            v[-2:] = [(v[-2] * w[-2] + v[-1] * w[-1]) / c2]
            w[-2:] = [c2]
            hi[-2:] = [hi[-1]]
            lo.pop()
    return np.ravel(np.column_stack([lo, hi])), np.repeat(v, 2)


def solve(a: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    return np.linalg.solve(a + RIDGE * max(1.0, n / 100) * np.eye(len(r)), r)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> dict | None:
    """The model, or None without training rows. Matrices of DIMS + 1 squared are summed in each partition, one for each fold."""
    from .common import stored

    def measure(batches):
        for b in batches:
            x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("fold"), b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["fold", "y", "x"])

    rows = sample(docs, labels, most, "quality").select(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(FOLDS)).cast("int").alias("fold"), "y", "text")
    rows = stored(rows.mapInArrow(measure, "fold int, y int, x array<double>").repartitionById(FOLDS, "fold"))  # statistics only, `most` rows
    d = len(STATS)
    sums = rows.select(*[f(F.get("x", i)).alias(f"{n}{i}") for i in range(d) for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n")).first()
    if not sums.n:
        return None
    m = {"mean": np.array([sums[f"m{i}"] for i in range(d)]), "sd": np.array([sums[f"s{i}"] or 0 for i in range(d)]) + 1e-3, "dims": DIMS, "gamma": GAMMA, "seed": SEED}

    def add(batches):
        a: dict[int, np.ndarray] = {}
        for b in batches:
            z, y, fold = fourier(np.array(b.column("x").to_pylist(), float).reshape(-1, d), m), b.column("y").to_numpy(zero_copy_only=False), b.column("fold").to_numpy()
            for k in np.unique(fold).tolist():
                of = fold == k
                a[k] = a.get(k, 0) + np.vstack([z[of].T @ z[of], z[of].T @ y[of], np.full(DIMS + 1, of.sum())])
        yield pa.RecordBatch.from_arrays([pa.array(list(a), pa.int32()), pa.array([x.tobytes() for x in a.values()], pa.binary())], ["fold", "m"])

    folds = np.zeros((FOLDS, DIMS + 3, DIMS + 1))
    for row in rows.mapInArrow(add, "fold int, m binary").collect():  # FOLDS matrices, or some more where a fold is in two files
        folds[row.fold] += np.frombuffer(bytes(row.m)).reshape(DIMS + 3, DIMS + 1)
    whole = folds.sum(0)
    m["coef"] = solve(whole[:-2], whole[-2], whole[-1, 0])
    without = [solve(x[:-2], x[-2], x[-1, 0]) for x in whole - folds]

    def fit(batches):
        for b in batches:
            z = fourier(np.array(b.column("x").to_pylist(), float).reshape(-1, d), m)
            s = np.einsum("ij,ij->i", z, np.array(without)[b.column("fold").to_numpy()])
            yield pa.RecordBatch.from_arrays([pa.array(s), b.column("y")], ["s", "y"])

    p = rows.mapInArrow(fit, "s double, y int").toPandas()  # `most` pairs of numbers
    m["knots"], m["values"] = isotonic(p.s.to_numpy(), p.y.to_numpy().astype(float))
    return m


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score of each row."""
    base = docs.select("doc_id", (~in_training(5, 0)).alias("held_out"), "text")
    if model is None:
        return base.select("doc_id", "held_out", F.lit(0.5).alias("score"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            s = fourier(statistics(b.column("text")), model) @ model["coef"]
            v = np.clip(np.interp(s, model["knots"], model["values"]) + 1e-6 * np.tanh(s), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(v)], ["doc_id", "held_out", "score"])

    return base.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    out = scored(docs, learn(docs, labels))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
