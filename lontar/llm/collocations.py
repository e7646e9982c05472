"""Phrases that stand together more often than by chance, mined by Apriori passes over word runs.

Texts (A-Z lower-cased) are cut into pieces at punctuation and line ends, pieces into words. Level by level, phrases of k
words are counted only where both of their (k-1)-word parts were frequent. What the level before found frequent is
broadcast as a bitmap of hashes: 16 bits a phrase, MOST_BITS (16 MB) at most however many there are. A phrase that the
bitmap lets through by chance is counted like any other and dropped by its exact count, so results do not depend on the
bitmap. Pairs of frequent words are first counted by hash, which says which may be frequent (two of one hash count
together, so none is missed); a pass keeps the runs in which every pair may be, equal ones once with their number. Pairs
and longer phrases are counted by their words in these runs alone, without reading the texts again. Tasks count FLUSH words at a time before anything is
shuffled, so the most frequent phrase is a few rows. Counts and scores are exact (decimals of 38 digits, whole-number
division).

Everything is per lang (null: `und`). Null and empty texts have no words. Rows are counted each for itself, repeated or
not; doc_id is not used, and extra columns are ignored. Very long texts are read whole, one at a time. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, split_join, stored

LONGEST, LEAST, TOP, MISSING = 5, 100, 2000, "und"
MOST_BITS = 1 << 27
FLUSH = 1 << 20
_CUT = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_U = np.uint64


class _Words(dict):
    """Numbers for words of a lang as they are first met; 0 is the end of a piece. known: their langs and the words."""

    def __init__(self, lang: str, known: tuple):
        super().__init__({b".": 0})
        self.lang, (self.langs, self.words) = lang, known

    def __missing__(self, w: bytes) -> int:
        self.langs.append(self.lang)
        self.words.append(w)
        self[w] = len(self.words) - 1
        return self[w]


def _blocks(batches):
    """(known words, their numbers in order of text, how often each text stands) of FLUSH words and more at a time; a text is never parted."""
    known, ids, langs, ends, times = ([""], [b""]), [], {}, [0], []

    def block():
        return known, np.array(ids, np.int64), np.repeat(np.array(times, np.int64), np.diff(ends))

    for b in batches:
        n = b.column("n").to_pylist() if "n" in b.schema.names else [1] * b.num_rows
        for lang, text, k in zip(b.column("lang").to_pylist(), b.column("text"), n):
            if lang not in langs:
                langs[lang] = _Words(lang, known)
            ids.extend(map(langs[lang].__getitem__, text.as_py().lower().translate(_CUT).replace(b".", b" . ").split()))
            ids.append(0)
            ends.append(len(ids))
            times.append(k)
            if len(ids) > FLUSH:
                yield block()
                known, ids, langs, ends, times = ([""], [b""]), [], {}, [0], []
    if ids:
        yield block()


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a phrase from that of its words but the last, and the last's."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9) + w
        return h ^ (h >> _U(32))


def _word_hash(lang: str, w: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang.encode() + b"\0" + w)


def _starts(known, ids, k: int) -> np.ndarray:
    """Hash of the k-word phrase that begins at each place (of no meaning where a piece ends before)."""
    word = np.array(list(map(_word_hash, *known)), _U)[ids]
    h = word
    for j in range(1, k):
        h = _mixed(h[:-1], word[j:])
    return h


def _may(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % _U(len(bits) * 64)
    return (bits[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1


def _rows(known, ids, at: np.ndarray, k: int, n: np.ndarray):
    """Arrow rows (lang, phrase, f) of the phrases at the given places."""
    langs, words = pa.array(known[0]), pa.array(known[1], pa.binary())
    for i in range(0, len(at), 1 << 16):
        some = at[i : i + (1 << 16)]
        phrases = [words.take(pa.array(ids[some + j])) for j in range(k)]
        phrases = pc.binary_join_element_wise(*phrases, b" ") if k > 1 else phrases[0]
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(ids[some])), phrases.cast(pa.string()), pa.array(n[i : i + (1 << 16)].astype(np.int64))], ["lang", "phrase", "f"])


def _open(known, ids, k: int, bits: np.ndarray) -> np.ndarray:
    """Places at which a phrase of k words begins both of whose (k-1)-word parts may be frequent."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    for j in range(k):
        ok &= ids[j : j + n] > 0
    may = _may(bits, _starts(known, ids, k - 1))
    return np.flatnonzero(ok & may[:n] & may[1 : n + 1])


def _words(texts: DataFrame) -> DataFrame:
    def run(batches):
        for known, ids, times in _blocks(batches):
            n = np.bincount(ids, minlength=len(known[0]))
            first = np.full(len(n), -1)
            first[ids[::-1]] = np.arange(len(ids))[::-1]
            first, n = first[1:], n[1:]
            yield from _rows(known, ids, first[n > 0], 1, n[n > 0])

    return texts.mapInArrow(run, "lang string, phrase string, f long")


def _phrases(texts: DataFrame, k: int, bitmap) -> DataFrame:
    """(lang, phrase, f) of each task's FLUSH words: phrases of k words with two parts that may be frequent."""
    def run(batches):
        bits = np.frombuffer(bitmap.value, _U)
        for known, ids, times in _blocks(batches):
            at = _open(known, ids, k, bits)
            h = _starts(known, ids, k)[at] if len(at) else np.zeros(0, _U)
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            if len(at) and any((ids[at + j] != ids[at[first][back] + j]).any() for j in range(k)):  # two phrases of one hash
                whole = np.stack([ids[at + j] for j in range(k)], 1)
                _, first, back = np.unique(whole, axis=0, return_index=True, return_inverse=True)
                back = back.reshape(-1)
            n = np.zeros(len(first), np.int64)
            np.add.at(n, back, times[at])
            yield from _rows(known, ids, at[first], k, n)

    return texts.mapInArrow(run, "lang string, phrase string, f long")


def _pairs(texts: DataFrame, bitmap) -> DataFrame:
    """(h, f): hashes of pairs of frequent words, and how often each task met them."""
    def run(batches):
        bits = np.frombuffer(bitmap.value, _U)
        for known, ids, times in _blocks(batches):
            h, n = np.unique(_starts(known, ids, 2)[_open(known, ids, 2, bits)], return_counts=True)
            for i in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)].astype(np.int64))], ["h", "f"])

    return texts.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))


def _runs(texts: DataFrame, bitmap) -> DataFrame:
    """(lang, text, n): the longest runs of two words and more in which every pair may be frequent, and how often each stands."""
    def run(batches):
        bits = np.frombuffer(bitmap.value, _U)
        for known, ids, _ in _blocks(batches):
            if len(ids) < 2:
                continue
            pair = (ids[:-1] > 0) & (ids[1:] > 0) & _may(bits, _starts(known, ids, 2))
            edge = np.flatnonzero(np.diff(np.r_[False, pair, False].astype(np.int8)))
            whole = ids.astype(np.int32).tobytes()
            found = Counter(whole[a:b] for a, b in zip((edge[::2] * 4).tolist(), (edge[1::2] * 4 + 4).tolist()))
            keys, n = list(found), list(found.values())
            for i in range(0, len(keys), 1 << 14):
                some = [np.frombuffer(x, np.int32).tolist() for x in keys[i : i + (1 << 14)]]
                yield pa.RecordBatch.from_arrays([pa.array([known[0][x[0]] for x in some]), pa.array([b" ".join([known[1][w] for w in x]) for x in some], pa.binary()), pa.array(n[i : i + (1 << 14)], pa.int64())], ["lang", "text", "n"])

    return texts.mapInArrow(run, "lang string, text binary, n long").groupBy("lang", "text").agg(F.sum("n").alias("n"))


def _bitmap(level: DataFrame):
    """A broadcast bitmap of hashes (h), or of the phrases' hashes: 16 bits for each, between 2^16 and MOST_BITS in all."""
    size = 1 << min(MOST_BITS.bit_length() - 1, max(16, (level.count() * 16).bit_length()))

    def run(batches):
        for b in batches:
            at = b.column("h").to_numpy().view(_U) % _U(size)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["at"])

    def run_phrases(batches):
        for b in batches:
            h = []
            for lang, phrase in zip(b.column("lang").to_pylist(), b.column("phrase").to_pylist()):
                first, *rest = [np.array([_word_hash(lang, w)], _U) for w in phrase.encode().split()]
                for w in rest:
                    first = _mixed(first, w)
                h.append(first)
            at = np.concatenate(h).astype(_U) % _U(size) if h else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["at"])

    at = level.select("h").mapInArrow(run, "at long") if "h" in level.columns else level.select("lang", "phrase").mapInArrow(run_phrases, "at long")
    words = at.selectExpr("at div 64 AS i", "shiftleft(1L, CAST(at & 63 AS INT)) AS bit")
    got = words.groupBy("i").agg(F.bit_or("bit").alias("bits")).toArrow()  # size / 64 rows at most
    bits = np.zeros(size // 64, np.int64)
    bits[got.column("i").to_numpy()] = got.column("bits").to_numpy()
    return level.sparkSession.sparkContext.broadcast(bits.tobytes())


def _frequent(counted: DataFrame, least: int) -> DataFrame:
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, m, phrase, f) of every phrase of m = 1 to `longest` words with f >= least, and (lang, n) of all words."""
    texts = docs.select(F.coalesce("lang", F.lit(MISSING)).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    words = stored(_words(texts).groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
    totals = stored(words.groupBy("lang").agg(F.sum("f").alias("n")))
    found = [stored(words.where(F.col("f") >= least))]
    release(docs.sparkSession, words)
    if longest > 1:
        bitmap = _bitmap(found[0])
        pairs = stored(_pairs(texts, bitmap).where(F.col("f") >= least))
        likely = _bitmap(pairs)
        texts = stored(_runs(texts, likely))
        release(docs.sparkSession, pairs)
        bitmap.unpersist()
        likely.unpersist()
    for k in range(2, longest + 1):
        bitmap = _bitmap(found[-1])
        found.append(stored(_frequent(_phrases(texts, k, bitmap), least)))
        bitmap.unpersist()
    if longest > 1:
        release(docs.sparkSession, texts)
    out = found[0].withColumn("m", F.lit(1))
    for m, level in enumerate(found[1:], 2):
        out = out.unionByName(level.withColumn("m", F.lit(m)))
    return out, totals


def _key(*phrase):
    return F.concat_ws("\0", F.col("lang"), *phrase)


def _looked_up(rows: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """rows with the count of the phrase in column `part`; a part that many phrases share is dealt in pieces."""
    rows = rows.withColumn("_k", _key(part))
    uses = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))
    right = counts.select(_key("phrase").alias("_k"), F.col("f").alias(name)).join(uses, "_k")
    return split_join(rows, right, "_k", "_n", ("phrase",)).drop("_k")


def scored(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of each candidate that no longer one holds as often."""
    counts, totals = levels(docs, longest, least)
    c = counts.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"))
    words = F.split("phrase", " ")
    # a longer phrase as frequent means one of one more word as frequent, which is itself a candidate
    over = c.where("m > 2").withColumn("w", words)
    inner = F.explode(F.array(F.concat_ws(" ", F.slice("w", 1, F.col("m") - 1)), F.concat_ws(" ", F.slice("w", 2, F.col("m") - 1))))
    c = c.join(over.select("lang", inner.alias("phrase"), "a").distinct(), ["lang", "phrase", "a"], "left_anti")
    cuts = c.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("head"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("m") - F.col("k"))).alias("rest"))
    cuts = _looked_up(stored(_looked_up(stored(cuts), counts, "head", "l")), counts, "rest", "r")
    cuts = cuts.join(totals, "lang")
    wide = lambda x: F.col(x).cast("decimal(18,0)")
    cuts = cuts.withColumn("_above", (F.col("a") * 1000).cast("decimal(19,0)") * wide("n")).withColumn("_below", wide("l") * wide("r"))
    cut = F.struct(F.expr("_above div _below").alias("score"), "k", "l", "r")
    best = cuts.withColumn("cut", cut).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def report(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's `top` phrases. A lang's rows are first cut down in pieces."""
    s = scored(docs)
    order = F.col("score").desc(), F.col("a").desc(), F.col("phrase")
    for by in (("lang", "_piece"), ("lang",)):
        s = s.withColumn("_piece", F.pmod(F.xxhash64("phrase"), F.lit(64))) if len(by) == 2 else s
        s = s.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return s.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in SQL, without pruning.
SQL = """WITH pieces AS (
  SELECT row_number() OVER () AS pid, lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, m, list_slice(w, i, i + m - 1) AS g FROM (
    SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, range(1, 6) t(m) WHERE len(w) >= m)),
freq AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
inner_parts AS (SELECT DISTINCT lang, f, unnest([list_slice(g, 1, m - 1), list_slice(g, 2, m)]) AS g FROM freq WHERE m > 2),
cand AS (SELECT * FROM freq c WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = c.lang AND i.g = c.g AND i.f = c.f)),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c
  JOIN freq l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, k) JOIN freq r ON r.lang = c.lang AND r.g = list_slice(c.g, k + 1, c.m) JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM ranked
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
