"""Topology of a sentence at any threshold: persistent components, counts of joined words; fuzzy look-ups.

These have no form in built-in expressions (union-find, sequence matching), so they run as Arrow UDFs on
rows that hold all they need.
"""

from __future__ import annotations

import bisect
import difflib
import math
from collections import Counter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checks
from .lexicon import gap
from .storage import held

BAR = "struct<birth:double,death:double,root:string>"


def distances(df: DataFrame) -> DataFrame:
    """Adds gaps (i, j, distance) of each pair of tokens: as many as pairs, for sentences."""
    pairs = checks._pairs(F.size("tokens"), None)
    return held(df, "gaps", F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), p["j"].alias("j"), checks._gap(F.get("tokens", p["i"]), F.get("tokens", p["j"])).alias("d"))))


def kinds(df: DataFrame) -> DataFrame:
    """Adds titik (distinct roots: root, sama: lower-cased, jenis, awal, akhir: first and last place) and jarak: distances of kinds.

    Two different words' distance follows from the domain and class of both, and which comes first; tokens of one domain and
    class are of a kind. A sentence has few kinds, so distances are worked out between these: (a, b, d), a's word first.
    """
    d = held(df, "_n", F.array_sort(F.array_distinct(F.transform("tokens", lambda t: F.struct(t["domain"].alias("domain"), t["pos"].alias("pos"))))))
    dot = lambda x, name: F.struct(F.lit(name).alias("root"), x["domain"].alias("domain"), x["pos"].alias("pos"))
    gap = lambda x, i: F.transform("_n", lambda y, j: F.struct(i.alias("a"), j.alias("b"), checks._gap(dot(x, "a"), dot(y, "b")).alias("d")))
    d = held(d, "jarak", F.flatten(F.transform("_n", gap)))
    d = held(d, "_t", F.array_sort(F.transform("tokens", lambda t: F.struct(t["root"].alias("root"), t["idx"].alias("idx"), (F.array_position("_n", F.struct(t["domain"].alias("domain"), t["pos"].alias("pos"))) - 1).cast("int").alias("jenis")))))
    t = F.col("_t")
    same = lambda x, i: F.coalesce(F.get(t, i)["root"] == x["root"], F.lit(False))
    begins = F.filter(F.transform(t, lambda x, i: F.when(~((i > 0) & same(x, i - 1)), x)), lambda x: x.isNotNull())
    ends = F.filter(F.transform(t, lambda x, i: F.when(~same(x, i + 1), x["idx"])), lambda x: x.isNotNull())
    points = F.zip_with(begins, ends, lambda x, e: F.struct(x["root"].alias("root"), F.lower(x["root"]).alias("sama"), x["jenis"].alias("jenis"), x["idx"].alias("awal"), e.alias("akhir")))
    return held(d, "titik", points).drop("_n", "_t")


def _points(points, gaps):
    """(points by first place, places of each kind's points, distances by kinds)."""
    p = sorted(([x["root"], x["sama"], x["jenis"], x["awal"], x["akhir"]] for x in points), key=lambda x: x[3])
    of = {}
    for i, x in enumerate(p):
        of.setdefault(x[2], []).append(i)
    return p, of, {(x["a"], x["b"]): x["d"] for x in gaps if x["a"] in of and x["b"] in of}


class _Forest:
    """Sets of numbers; a set's top is its least."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, members) -> list[int]:
        """Puts all in one set; the tops that are none any more."""
        tops = sorted({self.top(i) for i in members})
        for t in tops[1:]:
            self.up[t] = tops[0]
        return tops[1:]


def _met(p, of, a: int, b: int) -> list[int]:
    """Points of kinds a and b that are joined when a's come first: those of a before b's last end, and of b that end behind a's first."""
    if a == b:
        return of[a] if len(of[a]) > 1 else []
    first, last = p[of[a][0]][3], max(p[i][4] for i in of[b])
    some, others = [i for i in of[a] if p[i][3] < last], [i for i in of[b] if p[i][4] > first]
    return some + others if some and others else []


def merges(points, gaps) -> list[tuple[float, float, str]]:
    """Bars of components as the threshold grows: one for each distinct root, born at 0; the last never dies."""
    return _bars(*_points(points, gaps))


def _bars(p, of, dist) -> list[tuple[float, float, str]]:
    """Where components meet the one with the earliest root lives on; once all are one component, nothing dies any more.

    Points of two kinds that meet at all are one component, so each pair of kinds is one step, whatever the number of points.
    Two kinds of one distance both ways meet wholly, and a kind that is whole counts as its first point from then on.
    """
    forest, bars = _Forest(len(p)), []
    same = {}
    for i, x in enumerate(p):
        same.setdefault(x[1], []).append(i)
    if len(same) < len(p):
        for x in same.values():
            if len(x) > 1:
                bars += [(0.0, 0.0, p[t][0]) for t in forest.join(x)]
    kinds, steps = [*of], []
    for i, a in enumerate(kinds):
        for b in kinds[i:]:
            d, back = dist[a, b], dist[b, a]
            steps.append((d, a, b, d == back))
            if d != back:
                steps.append((back, b, a, False))
    steps.sort(key=lambda x: x[0])
    whole, top = {k for k, x in of.items() if len(x) == 1}, forest.top
    for d, a, b, wholly in steps:
        if len(bars) >= len(p) - 1:
            break
        if not wholly:
            members = _met(p, of, a, b)
        elif a in whole and b in whole:
            members = (of[a][0], of[b][0])
            if top(members[0]) == top(members[1]):
                continue
        else:
            members = of[a] + of[b]
            whole |= {a, b}
        bars += [(0.0, float(d), p[t][0]) for t in forest.join(members)]
    return bars + [(0.0, float("inf"), x[0]) for i, x in enumerate(p) if top(i) == i]


#: What bars need of a token.
BAR_FIELDS = ("idx", "root", "domain", "pos")


class _Gaps(dict):
    """Distances of two kinds, (domain, class) each, worked out as they are asked for: the same in any sentence."""

    def __missing__(self, pair):
        self[pair] = d = gap(*pair[0], *pair[1])
        return d


def _kinds(roots, lower, places, domains, classes):
    """(points by first place, places of each kind's points) of a sentence's tokens in order."""
    seen, of = {}, {}
    for root, sama, idx, kind in zip(roots, lower, places, zip(domains, classes)):
        if (x := seen.get(root)) is None:
            of.setdefault(kind, []).append(len(seen))
            seen[root] = [root, sama, kind, idx, idx]
        else:
            x[4] = idx
    return [*seen.values()], of


def barcode(df: DataFrame) -> DataFrame:
    """Adds bars of the sentence's components; components at a threshold are the bars that outlive it. Memory is linear in the
    sentence. Of tokens only BAR_FIELDS go to Python, column by column; distances are worked out there, once for each pair of kinds."""
    def run(tokens):
        known, ends, out = _Gaps(), [0], []
        x = tokens.flatten()
        columns = [x.field(c).to_pylist() for c in ("root", "sama", "idx", "domain", "pos")]
        at = 0
        for n in pc.list_value_length(tokens).to_pylist():
            out += _bars(*_kinds(*[c[at : at + (n or 0)] for c in columns]), known)
            at += n or 0
            ends.append(len(out))
        parts = [pa.array([b[k] for b in out], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.string()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, ["birth", "death", "root"]))

    run.__annotations__ = {"tokens": pa.Array, "return": pa.Array}
    few = F.transform("tokens", lambda t: F.struct(t["root"].alias("root"), F.lower(t["root"]).alias("sama"), t["idx"].alias("idx"), t["domain"].alias("domain"), F.lower(t["pos"]).alias("pos")))
    return df.withColumn("bars", F.arrow_udf(run, f"array<{BAR}>")(few))


COUNTS = "struct<sisi:long,sendiri:long,segitiga:long,betti0:int,terpencil:array<string>>"


def joined(points, gaps, once: set, threshold: float) -> tuple:
    """(joined pairs of roots, those among roots that stand once, triangles, components, lonely roots that stand once), at any threshold.

    Two kinds are joined wholly, not at all, or where the one's word comes first; pairs and triangles are counted from the
    kinds' sizes, and from how many words of the one come before the last place of each of the other. Words that differ in
    case alone are always joined; where their kind is not, they are counted one by one.
    """
    p, of, dist = _points(points, gaps)
    near = {k for k, d in dist.items() if d <= threshold}
    n, whole, part = {k: len(v) for k, v in of.items()}, set(), {}
    for a, b in near:
        if a == b or (b, a) in near:
            whole.add((a, b))
        else:
            starts = sorted(p[i][3] for i in of[a])
            part[a, b] = {i: bisect.bisect_left(starts, p[i][4]) for i in of[b]}  # of each of b, how many of a come before
    forest = _Forest(len(p))
    for a, b in near:
        forest.join(_met(p, of, a, b))
    twins = {}
    for i, x in enumerate(p):
        twins.setdefault(x[1], []).append(i)
    twins = [x for x in twins.values() if len(x) > 1 and (p[x[0]][2],) * 2 not in near]
    for x in twins:
        forest.join(x)

    def rel(a, b):
        return "all" if (a, b) in whole else (a, b) if (a, b) in part else (b, a) if (b, a) in part else None

    def behind(way, i):  # of a word of the later kind: the words of the earlier before it
        return part[way][i]

    def ahead(way, i):  # of a word of the earlier kind: the words of the later that end behind it
        if (way, i) not in cache:
            ends = cache.setdefault(way, sorted(p[j][4] for j in of[way[1]]))
            cache[way, i] = len(ends) - bisect.bisect_right(ends, p[i][3])
        return cache[way, i]

    cache: dict = {}
    ks = sorted(of)
    met = {(a, b): rel(a, b) for a in ks for b in ks if a <= b}
    pairs = lambda way: sum(part[way].values())
    sisi = sum(n[a] * (n[a] - 1) // 2 if a == b else n[a] * n[b] if m == "all" else pairs(m) for (a, b), m in met.items() if m)
    tri = 0
    for x, a in enumerate(ks):
        for y, b in enumerate(ks[x:], x):
            if not met[a, b]:
                continue
            for c in ks[y:]:
                ways = met[a, b], met[a, c], met[b, c]
                if not all(ways):
                    continue
                dirs = [w for w in ways if w != "all"]
                if a == b == c:
                    tri += n[a] * (n[a] - 1) * (n[a] - 2) // 6
                elif not dirs:
                    tri += n[a] * (n[a] - 1) // 2 * n[c] if a == b else n[b] * (n[b] - 1) // 2 * n[a] if b == c else n[a] * n[b] * n[c]
                elif a == b or b == c:  # two of one kind, one of another that the order joins
                    way, two = dirs[0], a if a == b else b
                    count = (behind, of[way[1]]) if way[0] == two else (ahead, of[way[0]])
                    tri += sum(k * (k - 1) // 2 for k in (count[0](way, i) for i in count[1]))
                elif len(dirs) == 1:
                    third = ({a, b, c} - set(dirs[0])).pop()
                    tri += pairs(dirs[0]) * n[third]
                else:  # both share a kind, on the same side
                    u, v = dirs
                    tri += sum(behind(u, i) * behind(v, i) for i in of[u[1]]) if u[1] == v[1] else sum(ahead(u, i) * ahead(v, i) for i in of[u[0]])
    neighbours = lambda i: sum((n[k] - (k == p[i][2])) if (m := rel(min(k, p[i][2]), max(k, p[i][2]))) == "all" else 0 if m is None else behind(m, i) if m[1] == p[i][2] else ahead(m, i) for k in ks)
    for x in twins:
        k = len(x)
        sisi += k * (k - 1) // 2
        tri += k * (k - 1) * (k - 2) // 6
        for m in ks:  # words that both of a pair of twins are joined with
            way = rel(min(m, p[x[0]][2]), max(m, p[x[0]][2]))
            if way == "all":
                tri += k * (k - 1) // 2 * n[m]
            elif way:
                seen = sorted(behind(way, i) if way[1] == p[i][2] else ahead(way, i) for i in x)
                tri += sum(v * (k - 1 - j) for j, v in enumerate(seen))
    lonely = [x[0] for i, x in enumerate(p) if x[0] in once and forest.top(i) == i and not neighbours(i) and not any(i in t for t in twins)]
    return sisi, tri, len({forest.top(i) for i in range(len(p))}), lonely


def counted(df: DataFrame, threshold: float) -> DataFrame:
    """Adds hitung (sisi, sendiri, segitiga, betti0, terpencil) of distinct roots at any threshold; _a: roots that stand once."""
    def run(points: pd.Series, gaps: pd.Series, once: pd.Series) -> pd.DataFrame:
        out = []
        for p, g, o in zip(points, gaps, once):
            o = set(o)
            sisi, tri, parts, lonely = joined(p, g, o, threshold)
            out.append((sisi, joined([x for x in p if x["root"] in o], g, o, threshold)[0], tri, parts, lonely))
        return pd.DataFrame(out, columns=["sisi", "sendiri", "segitiga", "betti0", "terpencil"])

    run.__annotations__ = {"points": pd.Series, "gaps": pd.Series, "once": pd.Series, "return": pd.DataFrame}
    return kinds(df).withColumn("hitung", F.pandas_udf(run, COUNTS)("titik", "jarak", F.transform("_a", lambda x: x["root"]))).drop("titik", "jarak")


#: Letters, rare ones first; others come before them. Any order is right, this one makes few candidates.
RARE = "xqvzfwycjohpbdlmsgtrkuiena"


def rare_letters(word: str, least: float) -> list[str]:
    """A word's rarest letters, numbered by occurrence: any word with a ratio of `least` or more to it has one of them.

    The matching letters are at least least / 2 of both lengths together, and the other length is at least
    least / (2 - least) of this one, so at least that share of this word's letters is in the other one too.
    """
    seen, out = Counter(), []
    for c in word:
        seen[c] += 1
        out.append((-seen[c], RARE.find(c), c))
    n = len(word) - math.ceil(least * len(word) / (2 - least) - 1e-9) + 1
    return [f"{c}{-k}" for k, _, c in sorted(out)[:n]]


def fuzzy(words: DataFrame, lexicon: DataFrame, least: float = 0.75) -> DataFrame:
    """(word, kata, ratio): the most similar entry (ratio of matching blocks, `least` or more) of words that have none.

    Every entry that can reach the ratio is compared: candidates share one of the rare letters of both and have lengths
    that allow the ratio; of these, the matching blocks are found where the letters in common allow it.
    """
    w = words.select(F.lower("word").alias("word")).distinct().join(lexicon.select(F.col("kata").alias("word")), "word", "left_anti")

    def letters(a: pd.Series) -> pd.Series:
        return pd.Series([rare_letters(x, least) if x else [] for x in a], dtype=object)

    letters.__annotations__ = {"a": pd.Series, "return": pd.Series}
    by = lambda df, c: df.select(c, F.explode(F.pandas_udf(letters, "array<string>")(c)).alias("letter"))
    m, n = F.char_length("word"), F.char_length("kata")
    near = by(w, "word").join(by(lexicon.select("kata").distinct(), "kata"), "letter").where(2 * F.least(m, n) >= least * (m + n) - 1e-9).select("word", "kata").distinct()

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            s = difflib.SequenceMatcher(None, x, y)
            out.append(s.ratio() if s.quick_ratio() >= least else 0.0)
        return pd.Series(out, dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    r = near.withColumn("ratio", F.pandas_udf(run, "double")("word", "kata")).where(F.col("ratio") >= least)
    best = r.groupBy("word").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "kata")).alias("b"))
    return best.select("word", "b.kata", (-F.col("b.r")).alias("ratio"))
