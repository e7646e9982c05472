"""Seeded noise in texts, in three layers: letters, affixes, order of words.

Draws are digests of seed, key, what is drawn, and place, so a row's noise depends on the row alone and not on where or
how often it is worked out. All of it is expressions on the array of a text's words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import rules as R
from .storage import held

KINDS = ("typo", "affix", "chaos")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _digest(name: str, seed: int, key: str, i):
    return F.md5(F.concat(F.lit(f"{seed}:{name}:"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), i.cast("string")).cast("binary"))


def draw(name: str, seed: int, key: str, i):
    """From 0 up to 1."""
    return F.conv(F.substring(_digest(name, seed, key, i), 1, 8), 16, 10).cast("double") / 4294967296.0


def _pick(words, u):
    return F.get(F.array(*[F.lit(w) for w in words]), F.floor(u * len(words)).cast("int"))


def _typo(w, i, p, d):
    n = F.char_length(w)
    at, op = F.floor(d("place", i) * n).cast("int"), F.floor(d("edit", i) * 4)
    left, c, rest = F.substr(w, F.lit(1), at), F.substr(w, at + 1, F.lit(1)), F.substr(w, at + 2)
    swapped = F.when(at < n - 1, F.concat(left, F.substr(w, at + 2, F.lit(1)), c, F.substr(w, at + 3))).otherwise(w)
    made = F.when(op == 0, swapped).when(op == 1, F.concat(left, c, c, rest)).when(op == 2, F.concat(left, rest)).otherwise(F.concat(left, _pick(LETTERS, d("letter", i)), c, rest))
    out = F.when((n >= 3) & (d("typo", i) <= p), made).otherwise(w)
    return F.when(d("fragment", i) < p * 0.3, F.concat(out, F.lit(" "), F.substr(out, F.lit(1), F.lit(2)))).otherwise(out)


def _affix(w, i, p, d):
    op = F.floor(d("edit", i) * 4)
    pre, suf = _pick(R.NOISE_PREFIXES, d("prefix", i)), _pick(R.NOISE_SUFFIXES, d("suffix", i))
    bare = w
    for x in reversed(R.NOISE_PREFIXES):
        bare = F.when(w.startswith(x) & (F.char_length(w) > len(x) + 2), F.substr(w, F.lit(len(x) + 1))).otherwise(bare)
    made = F.when(op == 0, F.concat(pre, w)).when(op == 1, F.concat(pre, w, suf)).when(op == 2, bare).otherwise(F.concat(w, suf))
    return F.when((F.char_length(w) >= 4) & (d("affix", i) <= p), made).otherwise(w)


def _order(words, name, digest):
    """Places of words by a digest of each."""
    return F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct(digest(name, i).alias("u"), i.alias("i")))), lambda s: s["i"])


def _chaos(df: DataFrame, words, p, d, digest) -> DataFrame:
    """Adds _w: the words with some shuffled, some dropped, one repeated; which of these by three draws, at least one."""
    zero = F.lit(0)
    hit = [d(x, zero) < p for x in ("shuffle", "drop", "repeat")]
    none, one = ~(hit[0] | hit[1] | hit[2]), F.floor(d("else", zero) * 3)
    df = held(df, "_on", F.array(*[h | (none & (one == k)) for k, h in enumerate(hit)]))
    df = held(df, "_w", words)
    n, w = F.size("_w"), F.col("_w")
    df = held(df, "_at", F.slice(_order(w, "which", digest), 1, F.least(n, F.greatest(F.lit(2), F.floor(n * p).cast("int")))))
    to = F.transform(F.array_sort(F.transform("_at", lambda x: F.struct(digest("where", x).alias("u"), x.alias("i")))), lambda s: s["i"])
    df = held(df, "_to", to)
    # the places in order of their digests change with those in order of their second digests
    moved = F.transform(w, lambda x, i: F.coalesce(F.get(w, F.get("_to", (F.array_position("_at", i) - 1).cast("int"))), x))
    df = held(df, "_w", F.when(F.get("_on", 0) & (n > 0), moved).otherwise(w))
    fewer = F.greatest(F.lit(0), F.least(n - 2, F.greatest(F.lit(1), F.floor(n * p * 0.5).cast("int"))))
    df = held(df, "_gone", F.slice(_order(w, "lost", digest), 1, fewer))
    df = held(df, "_w", F.when(F.get("_on", 1), F.filter(w, lambda x, i: ~F.array_contains("_gone", i))).otherwise(w))
    at = F.floor(d("again", zero) * n).cast("int")
    again = F.concat(F.slice(w, 1, at + 1), F.slice(w, at + 1, F.greatest(n, F.lit(1))))
    return held(df, "_w", F.when(F.get("_on", 2) & (n > 0), again).otherwise(w)).drop("_on", "_at", "_to", "_gone")


def noise(df: DataFrame, kind: str, intensity: float = 0.3, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with a noisy text. typo: letters swapped, doubled, lost or put in, fragments of words behind them, a space lost;
    affix: wrong, double, stripped prefixes and wrong suffixes; chaos: words shuffled, lost and repeated.

    White space runs become single spaces; null becomes the empty text; rows that share the key share its draws.
    """
    if kind not in KINDS:
        raise ValueError(kind)
    p = float(intensity)
    d = lambda name, i: draw(name, seed, key, i)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")
    if kind == "chaos":
        return _chaos(df, words, p, d, lambda name, i: _digest(name, seed, key, i)).withColumn(text, F.array_join("_w", " ")).drop("_w")
    edit = _typo if kind == "typo" else _affix
    df = df.withColumn(text, F.array_join(F.transform(words, lambda w, i: edit(w, i, p, d)), " "))
    if kind == "affix":
        return df
    zero, t = F.lit(0), F.col(text)
    at = F.floor(d("gap", zero) * (F.greatest(F.char_length(t) - 5, F.lit(0)) + 1)).cast("int")
    space = F.when(F.instr(F.substr(t, at + 1), F.lit(" ")) > 0, F.instr(F.substr(t, at + 1), F.lit(" ")) + at)
    return df.withColumn(text, F.when((d("close", zero) < p * 0.2) & space.isNotNull(), F.concat(F.substr(t, F.lit(1), space - 1), F.substr(t, space + 1))).otherwise(t))
