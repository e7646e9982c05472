"""Row-local checks of a parsed sentence: dependency edges, constraints, word order, composition, topology, score.

Input has `tokens` as morphology.parse gives it. Everything here is expressions on that array: no shuffle, no Python.
Pairs are formed within a sentence only, so split long documents into sentences first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import chosen, in_list
from ..plans import rules as R
from . import lexicon as L
from .storage import held

EDGE = "struct<i:int,j:int,rel:string>"
VIOLATION = "struct<tipe:string,tokens:array<string>,dimensi:string,severitas:double,asal:string>"
NOUNS = ["N", "N_proper", "N_serapan"]


def _none(kind: str):
    return F.array().cast(f"array<{kind}>")


def _first(tokens, test):
    return F.array_min(F.transform(F.filter(tokens, test), lambda t: t["idx"]))


def _pairs(n, width):
    """(i, j) with i < j <= i + width (all pairs, if width is None), ordered."""
    top = lambda i: n - 1 if width is None else F.least(i + width, n - 1)
    rows = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.when(i + 1 <= n - 1, F.transform(F.sequence(i + 1, top(i)), lambda j: F.struct(i.alias("i"), j.alias("j")))).otherwise(_none("struct<i:int,j:int>")))
    return F.when(n >= 2, F.flatten(rows)).otherwise(_none("struct<i:int,j:int>"))


def edges(df: DataFrame) -> DataFrame:
    """Adds n and edges: neighbours within 2, subject-predicate, predicate-object, subject-complement, modifier-head."""
    t, n = F.col("tokens"), F.size("tokens")
    df = held(df, "n", n)
    with_role = lambda role: _first(t, lambda x: x["peran"] == role)
    for name, role in (("_s", "S"), ("_p", "P"), ("_o", "O")):
        df = held(df, name, with_role(role))
    edge = lambda i, j, r: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(r).alias("rel"))
    near = F.transform(_pairs(F.col("n"), 2), lambda p: edge(p["i"], p["j"], "adjacent"))
    s, p, o = F.col("_s"), F.col("_p"), F.col("_o")
    subj = F.when(s.isNotNull() & p.isNotNull(), F.array(edge(s, p, "subj-pred"))).otherwise(_none(EDGE))
    obj = F.when(p.isNotNull() & o.isNotNull(), F.array(edge(p, o, "pred-obj"))).otherwise(_none(EDGE))
    comp = F.filter(t, lambda x: x["kelas"].isin("N", "N_serapan", "Adj") & ~x["peran"].isin("S", "O") & F.coalesce(x["idx"] > s, F.lit(False)))
    comp = F.transform(comp, lambda x: edge(s, x["idx"], "subj-komplemen"))

    def head(m):
        """The first of the two words before and after a modifier that it can go with."""
        temporal = (m["kelas"] == "Adv") & F.lower(m["root"]).isin(R.TEMPORAL)
        near = F.slice(t, F.greatest(m["idx"] - 1, F.lit(1)), 5)  # places are indexes
        fits = F.filter(near, lambda x: (F.abs(x["idx"] - m["idx"]) <= 2) & (x["idx"] != m["idx"]) & x["kelas"].isin("N", "V", "N_proper", "N_serapan", "V_serapan") & (~temporal | x["kelas"].isin("V", "V_serapan")))
        return F.array_min(F.transform(fits, lambda x: x["idx"]))

    mods = F.transform(F.filter(t, lambda x: x["peran"] == "Mod"), lambda m: edge(m["idx"], head(m), "modifier"))
    mods = F.filter(mods, lambda e: e["j"].isNotNull())
    # no two of one kind have the same places
    return held(df, "edges", F.concat(near, subj, obj, comp, mods))


def vector(t):
    """The 31 features of a token: 20 domains, 9 classes, register, certainty."""
    d = F.lower(t["domain"])
    which = F.array_position(F.transform(F.array(*[F.lit(x) for x in R.DOMAINS]), lambda c: F.coalesce(F.contains(d, c) | F.contains(c, d), F.lit(False))), True)
    domains = F.transform(F.sequence(F.lit(1), F.lit(len(R.DOMAINS))), lambda i: F.when(i == which, 1.0).otherwise(0.0))
    parsed = chosen(F.lower(t["kelas"]), R.CLASS_DIMENSION)
    listed = chosen(F.lower(t["pos"]), R.CLASS_DIMENSION)
    classes = F.array(*[F.when(parsed == k, 1.0).when(parsed.isNull() & (listed == k), 0.8).otherwise(0.0) for k in R.VECTOR_CLASSES])
    known = t["pos"].isNotNull()
    register = F.when(t["serapan"], 0.5).when(t["proper"] | known, 1.0).otherwise(0.5)
    sure = F.when(known, 0.8).otherwise(0.2)
    return F.concat(domains, classes, F.array(register, sure))


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def _features(t):
    """A token's vector by its parts: place of its domain (0: none), class and its weight, register, certainty."""
    d = F.lower(t["domain"])
    which = F.array_position(F.transform(F.array(*[F.lit(x) for x in R.DOMAINS]), lambda c: F.contains(d, c) | F.contains(c, d)), True)
    parsed, listed = (chosen(F.lower(t[c]), R.CLASS_DIMENSION) for c in ("kelas", "pos"))
    kind = F.when(F.coalesce(parsed, listed).isin(*R.VECTOR_CLASSES), F.coalesce(parsed, listed))
    known = t["pos"].isNotNull()
    return F.struct(F.when(d.isNull(), F.lit(0).cast("long")).otherwise(which).alias("domain"), kind.alias("kelas"), F.when(parsed.isNotNull(), 1.0).otherwise(0.8).alias("bobot"),
                    F.when(t["serapan"], 0.5).when(t["proper"] | known, 1.0).otherwise(0.5).alias("register"), F.when(known, 0.8).otherwise(0.2).alias("yakin"))


def _likeness(a, b, of_a=None, of_b=None):
    """Cosine of two tokens' vectors, from their features: of domains and classes one entry each is not zero. of_a, of_b: each one's product with itself, where it is known."""
    norm = lambda x, known: F.sqrt(_dot(x, x) if known is None else known)
    return _dot(a, b) / (norm(a, of_a) * norm(b, of_b))


def _dot(x, y):
    same = F.when((x["domain"] > 0) & (x["domain"] == y["domain"]), 1.0).otherwise(0.0) + F.when(x["kelas"] == y["kelas"], x["bobot"] * y["bobot"]).otherwise(0.0)
    return same + x["register"] * y["register"] + x["yakin"] * y["yakin"]


def _neutral(root, verbs):
    """Whether a root is one of the verbs or ends in one."""
    r, by = F.lower(root), {}
    for v in sorted(verbs):
        by.setdefault(len(v), []).append(v)
    out = F.lit(False)
    for n, some in sorted(by.items()):
        out = out | F.right(r, F.lit(n)).isin(*some)
    return out


def _gap(a, b):
    return L.distance(a["root"], a["domain"], a["pos"], b["root"], b["domain"], b["pos"])


def tensions(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Adds checks (one for each edge: five tensions, which are violated), energi (by dimension) and violations."""
    config = config or Config()
    thr = float(config.threshold)
    # a value that a lambda uses twice is a field of the row before it: lambdas work out an expression at each use
    df = held(df, "_f", F.transform(F.transform("tokens", lambda t: F.struct(_features(t).alias("v"), _neutral(t["root"], config.neutral).alias("netral"), F.exists(t["afiks"], lambda a: ~a["valid"]).alias("rusak"),
                                                                    (t["kelas"].isin("N_proper", "Pron") | L.animate(F.lower(t["root"]), t["pos"])).alias("hidup"))),
                                lambda f: F.struct(f["v"].withField("panjang", _dot(f["v"], f["v"])).alias("v"), f["netral"].alias("netral"), f["rusak"].alias("rusak"), f["hidup"].alias("hidup"))))

    def check(e):
        a, b, fa, fb, d = e["a"], e["b"], e["fa"], e["fb"], e["d"]
        morph = F.when(fa["rusak"] | fb["rusak"], 1.0).otherwise(0.0)
        mod, head = F.when(a["peran"] == "Mod", a).otherwise(b), F.when(a["peran"] == "Mod", b).otherwise(a)
        bad = F.lit(False)
        for k, to in R.MODIFIES.items():
            bad = bad | ((mod["kelas"] == k) & ~head["kelas"].isin(to.split()))
        synt = F.when((e["rel"] == "modifier") & ((a["peran"] == "Mod") | (b["peran"] == "Mod")) & bad, 0.7).otherwise(0.0)
        free = (a["kelas"] == "N_proper") | (b["kelas"] == "N_proper") | fa["netral"] | fb["netral"]
        sem = F.when(free, 0.0).when(d <= thr, d / thr * 0.3).otherwise(F.least(F.lit(1.0), (d - thr) / 2.0))
        reg = lambda t: F.when(t["serapan"], 0.5).otherwise(1.0)
        diff = F.abs(reg(a) - reg(b))
        lex = F.when(diff > 0.5, diff).otherwise(diff * 0.3)
        subj, pred = F.when(b["peran"] == "S", b).when(a["peran"] == "S", a), F.when(a["peran"] == "P", a).when(b["peran"] == "P", b)
        alive = F.when(b["peran"] == "S", fb["hidup"]).otherwise(fa["hidup"])
        verb = F.lower(pred["root"])
        bare = verb
        for p in reversed(R.ANIMATE_PREFIXES):
            bare = F.when(verb.startswith(p) & (F.char_length(verb) > len(p) + 2), F.substr(verb, F.lit(len(p) + 1))).otherwise(bare)
        needs = in_list(verb, R.ANIMATE_VERBS) | in_list(bare, R.ANIMATE_VERBS) | in_list(F.lower(pred["teks"]), R.ANIMATE_VERBS)
        anim = F.when((e["rel"] == "subj-pred") & subj.isNotNull() & pred.isNotNull() & needs & ~alive, 0.85).otherwise(0.0)
        geo = F.greatest(F.lit(0.0), (1 - _likeness(fa["v"], fb["v"], fa["v"]["panjang"], fb["v"]["panjang"])) / 2) * 0.05
        return F.struct(e["i"].alias("i"), e["j"].alias("j"), e["rel"].alias("rel"), a["root"].alias("a"), b["root"].alias("b"), morph.alias("morfologis"), synt.alias("sintaktis"), sem.alias("semantik"), lex.alias("leksikal"), anim.alias("animasi"),
                        geo.alias("geometrik"), (~free & (d > thr)).alias("jauh"), (diff > 0.5).alias("campur"), F.coalesce(subj["root"], a["root"]).alias("subj"), F.coalesce(pred["root"], b["root"]).alias("pred"))

    ends = F.transform("edges", lambda e: F.struct(e["i"].alias("i"), e["j"].alias("j"), e["rel"].alias("rel"), F.get("tokens", e["i"]).alias("a"), F.get("tokens", e["j"]).alias("b"), F.get("_f", e["i"]).alias("fa"), F.get("_f", e["j"]).alias("fb")))
    apart = F.transform(ends, lambda e: F.struct(*[e[c].alias(c) for c in ("i", "j", "rel", "a", "b", "fa", "fb")], _gap(e["a"], e["b"]).alias("d")))
    df = held(df, "checks", F.transform(apart, check))
    total = lambda f: F.aggregate(F.transform("checks", f), F.lit(0.0), lambda s, v: s + v)
    tension = lambda dim: total(lambda c: c["semantik"] + c["geometrik"] if dim == "semantik" else c[dim])
    k = F.greatest(F.size("edges"), F.lit(1))
    for dim in R.WEIGHTS:
        df = df.withColumn(f"e_{dim}", tension(dim) / k)

    def told(dim, broken, severity, a="a", b="b"):
        rows = F.filter("checks", broken)
        return F.transform(rows, lambda c: F.struct(F.lit(dim).alias("tipe"), F.array(c[a], c[b]).alias("tokens"), F.lit(dim).alias("dimensi"), severity(c).cast("double").alias("severitas"), F.lit("pasangan").alias("asal")))

    # first of each (type, a, b): rows of one type and pair have one severity but for the semantic ones
    found = F.concat(told("morfologis", lambda c: c["morfologis"] > 0, lambda c: c["morfologis"]), told("sintaktis", lambda c: c["sintaktis"] > 0, lambda c: c["sintaktis"]),
                     told("semantik", lambda c: c["jauh"], lambda c: c["semantik"]), told("leksikal", lambda c: c["campur"], lambda c: c["leksikal"]),
                     told("animasi", lambda c: c["animasi"] > 0, lambda c: c["animasi"], "subj", "pred"))
    df = held(df, "_v", F.array_sort(F.transform(found, lambda v, i: F.struct(v["tipe"].alias("tipe"), v["tokens"].alias("tokens"), i.alias("i"), v.alias("v")))))
    again = lambda x, y: F.coalesce((x["tipe"] == y["tipe"]) & (x["tokens"] == y["tokens"]), F.lit(False))
    once = F.filter("_v", lambda x, i: (i == 0) | ~again(x, F.get("_v", i - 1)))
    once = F.transform(F.array_sort(F.transform(once, lambda x: F.struct(x["i"], x["v"]))), lambda x: x["v"])
    return held(df, "violations", once).drop("_f", "_v")


def word_order(df: DataFrame) -> DataFrame:
    """Adds order: stranded, doubled and framing prepositions, inanimate recipients, agents in front of a passive."""
    t, n = F.col("tokens"), F.col("n")
    last, first = F.get(t, n - 1), F.get(t, 0)
    v = lambda tipe, words, sev: F.struct(F.lit(tipe).alias("tipe"), words.alias("tokens"), F.lit(tipe).alias("dimensi"), F.lit(sev).alias("severitas"), F.lit("urutan").alias("asal"))
    one = lambda test, x: F.when(F.coalesce(test, F.lit(False)), F.array(x)).otherwise(_none(VIOLATION))
    end = one(last["kelas"] == "Prep", v("topologis", F.array(last["root"]), 0.80))
    nexts = F.filter(F.transform(t, lambda x, i: F.struct(x.alias("a"), F.get(t, i + 1).alias("b"))), lambda p: p["b"].isNotNull())
    double = F.transform(F.filter(nexts, lambda p: (p["a"]["kelas"] == "Prep") & (p["b"]["kelas"] == "Prep")), lambda p: v("topologis", F.array(p["a"]["root"], p["b"]["root"]), 0.70))
    frame = one((first["kelas"] == "Prep") & (last["kelas"] == "Prep") & (first["root"] == last["root"]), v("topologis", F.array(first["root"]), 0.90))
    dative = F.filter(nexts, lambda p: (p["a"]["kelas"] == "Prep") & F.lower(p["a"]["root"]).isin(R.DATIVE) & p["b"]["kelas"].isin("N", "N_serapan") & ~L.animate(F.lower(p["b"]["root"]), p["b"]["pos"]))
    dative = F.transform(dative, lambda p: v("semantik", F.array(p["a"]["root"], p["b"]["root"]), 0.75))
    passive = lambda x: (x["kelas"] == "V") & F.lower(x["teks"]).startswith("di")
    inflected = F.exists(t, lambda x: passive(x) & (F.lower(x["root"]) != F.lower(x["teks"])))
    at = _first(t, passive)
    true_subject = F.exists(t, lambda x: (x["idx"] < at) & (x["peran"] == "S") & (x["idx"] != 1) & ~x["kelas"].isin("Prep", "Konj"))
    agent = one(inflected & (first["kelas"] == "Prep") & (F.lower(first["root"]) == "oleh") & ~F.coalesce(true_subject, F.lit(False)),
                v("sintaktis", F.array(F.lit("oleh"), F.coalesce(F.get(t, 1)["root"], F.lit("?"))), 0.80))
    return held(df, "order", F.concat(end, double, frame, dative, agent))


def completeness(df: DataFrame) -> DataFrame:
    """Adds lengkap and register; a sentence without words has 0 and formal."""
    t = F.col("tokens")
    has = lambda f: F.exists(t, f)
    mark, noun, adj = has(lambda x: F.lower(x["root"]).isin(R.COMPLEMENT_MARKS)), has(lambda x: x["kelas"].isin(NOUNS)), has(lambda x: x["kelas"] == "Adj")
    pred, subj = has(lambda x: x["peran"] == "P"), has(lambda x: x["peran"] == "S")
    full = F.lit(1.0) - F.when(~pred & ~(mark & noun) & ~(noun & adj), 0.5).otherwise(0.0) - F.when(~subj & ~mark & ~(noun & adj), 0.3).otherwise(0.0)
    loans = F.size(F.filter(t, lambda x: x["serapan"])) / F.greatest(F.col("n"), F.lit(1))
    return df.withColumn("lengkap", F.when(F.col("n") == 0, 0.0).otherwise(full)).withColumn("register", F.when(loans > 0.3, "mixed").otherwise("formal"))


def composition(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Adds n_morfisme, n_rusak, e_komposisi and komposisi (violations): adjective-noun, dangling, verb-object."""
    config = config or Config()
    t, n = F.col("tokens"), F.col("n")
    df = held(df, "_pair", F.transform(_pairs(n, 2), lambda p: F.struct(F.get(t, p["i"]).alias("a"), F.get(t, p["j"]).alias("b"))))
    pair = F.col("_pair")
    is_mod = lambda p: (p["a"]["kelas"] == "Adj") & p["b"]["kelas"].isin(NOUNS)
    is_verb = lambda p: ((p["a"]["peran"] == "S") & (p["b"]["peran"] == "P")) | ((p["a"]["peran"] == "P") & (p["b"]["peran"] == "O"))
    v = lambda words, dim, sev: F.struct(F.lit("komposisi").alias("tipe"), words.alias("tokens"), F.lit(dim).alias("dimensi"), F.lit(sev).alias("severitas"), F.lit("komposisi").alias("asal"))
    bad_mod = F.filter(pair, lambda p: is_mod(p) & p["a"]["domain"].isNotNull() & p["b"]["domain"].isNotNull() & (p["a"]["domain"] != p["b"]["domain"]))
    n_pairs = F.size(F.filter(pair, lambda p: is_mod(p) | is_verb(p)))
    df = held(df, "_low", F.transform(t, lambda x: F.lower(x["teks"])))
    low = F.col("_low")
    # where the first complement mark ends
    phrase = lambda a, b: F.array_min(F.filter(F.transform(low, lambda w, i: F.when((w == a) & (F.get(low, i + 1) == b), i + 1)), lambda x: x.isNotNull()))
    marks = []
    for ph in R.COMPLEMENT_PHRASES:
        a, b = ph.split()
        at = phrase(a, b)
        marks.append(F.when(at.isNotNull(), F.struct(at.cast("int").alias("at"), F.lit(ph).alias("mark"))))
    # yaitu, yakni, adalah also stand among the phrases and so come before the other single words
    for w in ["yaitu", "yakni", "adalah", *[x for x in R.COMPLEMENT_WORDS if x not in ("yaitu", "yakni", "adalah")]]:
        at = F.array_position(low, w)
        marks.append(F.when(at > 0, F.struct((at - 1).cast("int").alias("at"), F.lit(w).alias("mark"))))
    # held: the filter below would look for it again at each token
    df = held(df, "_mark", F.coalesce(*marks))
    mark = F.col("_mark")
    full = F.size(F.filter(t, lambda x: (x["idx"] > mark["at"]) & x["kelas"].isin("N", "V", "Adj", "N_proper", "N_serapan", "V_serapan")))
    dangling = F.when(mark.isNotNull() & (full < 2), F.array(v(F.array(mark["mark"]), "semantik", 0.90))).otherwise(_none(VIOLATION))

    def first_clash(x):
        return F.array_min(F.transform(F.filter(F.slice(t, x["idx"] + 2, 3), lambda y: y["kelas"].isin(NOUNS) & _clash(x["domain"], y["domain"], config.incompatible)), lambda y: y["idx"]))

    verbs = F.filter(t, lambda x: x["kelas"].isin("V", "V_serapan") & ~_neutral(x["root"], config.neutral) & x["domain"].isNotNull())
    objects = F.filter(F.transform(verbs, lambda x: F.struct(x["root"].alias("root"), first_clash(x).alias("j"))), lambda p: p["j"].isNotNull())
    bad_vo = F.transform(objects, lambda p: v(F.array(p["root"], F.get(t, p["j"])["root"]), "semantik", 0.70))
    found = F.concat(F.transform(bad_mod, lambda p: v(F.array(p["a"]["root"], p["b"]["root"]), "sintaktis", 0.65)), dangling, bad_vo)
    df = held(df, "komposisi", found).withColumn("n_rusak", F.size("komposisi"))
    df = df.withColumn("n_morfisme", n + n_pairs + F.size(dangling) + F.size(objects))
    return df.withColumn("e_komposisi", F.col("n_rusak") / F.greatest(F.col("n_morfisme"), F.lit(1))).drop("_pair", "_low", "_mark")


def _clash(verb, noun, incompatible: dict):
    out = F.lit(False)
    for d, others in incompatible.items():
        out = out | ((verb == d) & noun.isin(sorted(others)))
    return F.coalesce(out, F.lit(False))


LAW = ("hukum", "pendidikan")


def _choose2(k):
    return (k * (k - 1) / 2).cast("long")


def _choose3(k):
    return (k * (k - 1) * (k - 2) / 6).cast("long")


def _total(rows, count):
    return F.aggregate(F.transform(rows, count), F.lit(0).cast("long"), lambda s, v: s + v)


def _roots(df: DataFrame) -> DataFrame:
    """Adds _k: (first, root, last, domain, group, twice, thrice) of the distinct roots, in order: places of the first and the last, whether it stands twice, three times."""
    df = held(df, "_s", F.array_sort(F.transform("tokens", lambda x: F.struct(x["root"].alias("root"), x["idx"].alias("idx"), x["domain"].alias("domain")))))
    s = F.col("_s")
    same = lambda x, i: F.coalesce(F.get(s, i)["root"] == x["root"], F.lit(False))
    # some domains are called like groups of others
    group = lambda x: F.coalesce(F.concat(F.lit("="), chosen(x["domain"], R.DOMAIN_GROUPS)), x["domain"])
    runs = F.transform(s, lambda x, i: F.struct(x["idx"].alias("first"), x["root"].alias("root"), ((i > 0) & same(x, i - 1)).alias("again"), x["domain"].alias("domain"), group(x).alias("group"), same(x, i + 1).alias("twice"), same(x, i + 2).alias("thrice")))
    starts = F.filter(runs, lambda x: ~x["again"])
    last = F.transform(F.filter(runs, lambda x: ~x["twice"]), lambda x: x["first"])
    return held(df, "_k", F.array_sort(F.zip_with(starts, last, lambda x, y: F.struct(x["first"].alias("first"), x["root"].alias("root"), y.alias("last"), x["domain"].alias("domain"), x["group"].alias("group"), x["twice"].alias("twice"), x["thrice"].alias("thrice"))))).drop("_s")


def _law(k):
    return F.filter(k, lambda x: F.coalesce(x["domain"].isin(*LAW), F.lit(False)))


def _trade(k):
    return F.filter(k, lambda x: F.coalesce(x["domain"] == "ekonomi", F.lit(False)))


def _before(trade, b):
    """How many of `trade` stand somewhere before b."""
    return F.size(F.filter(trade, lambda a: a["first"] < b["last"])).cast("long")


def _behind(law, a):
    return F.size(F.filter(law, lambda b: a["first"] < b["last"])).cast("long")


def _joined(df: DataFrame, name: str, roots: str) -> DataFrame:
    """Adds (cross, known, all): joined pairs of roots between ekonomi and law, of roots with domains, of all roots."""
    k = F.col(roots)
    df = held(held(held(df, "_law", _law(k)), "_trade", _trade(k)), "_bound", F.filter(k, lambda x: x["domain"].isNotNull()))
    groups = F.array_distinct(F.transform("_bound", lambda x: x["group"]))
    cross = _total("_law", lambda b: _before("_trade", b))
    inside = _total(groups, lambda g: _choose2(F.size(F.filter("_bound", lambda x: x["group"] == g)).cast("long")))
    df = held(df, name, F.struct(cross.alias("cross"), inside.alias("inside")))
    known = F.col(name)["inside"] + F.col(name)["cross"]
    whole = _choose2(F.size(k).cast("long")) - _choose2(F.size("_bound").cast("long")) + known
    return held(df, name, F.struct(F.col(name)["cross"].alias("cross"), known.alias("known"), whole.alias("all"))).drop("_law", "_trade", "_bound")


def topology(df: DataFrame, config: Config | None = None) -> DataFrame:
    """Adds n_sisi, n_segitiga, betti0, betti1, euler, terpencil, anomali, e_topologis and topologi (violations).

    A sentence's roots are points, joined if their distance is within the threshold. For thresholds from 1.5 to 2.3,
    as all presets have, a root without a domain joins all, so components are those of the sentence's domains; beyond
    that range kinds of words decide, and an Arrow function counts (homology.joined). Likewise two roots with domains are joined if their domains are of one group, or one is
    of ekonomi and stands somewhere before the other, of hukum or pendidikan. So edges and triangles are counted from
    how many roots each group has; pairs are not formed, and the work grows with the sentence's length.
    """
    config = config or Config()
    thr = float(config.threshold)
    t, n = F.col("tokens"), F.col("n")
    df = _roots(df)
    k = F.col("_k")
    if not 1.5 <= thr < 2.3:
        from .homology import counted

        df = counted(held(df, "_a", F.filter(k, lambda x: ~x["twice"])), thr)
        df = held(df, "n_sisi", F.col("hitung.sisi") + F.size(F.filter(k, lambda x: x["twice"])))
        df = df.withColumn("n_segitiga", F.col("hitung.segitiga") + F.col("hitung.sisi") - F.col("hitung.sendiri") + F.size(F.filter(k, lambda x: x["thrice"])))
        return _topological(df.withColumn("_lonely", F.col("hitung.terpencil")).withColumn("betti0", F.col("hitung.betti0")), t, n).drop("_a", "hitung")
    known = F.filter(k, lambda x: x["domain"].isNotNull())
    df = held(df, "_a", F.filter(k, lambda x: ~x["twice"]))
    df = held(held(_joined(_joined(df, "_e", "_k"), "_e1", "_a"), "_law", _law(k)), "_trade", _trade(k))
    groups = F.transform(F.array_distinct(F.transform(known, lambda x: x["group"])), lambda g: F.struct(g.alias("g"), F.size(F.filter(k, lambda x: x["group"] == g)).cast("long").alias("k")))
    df = held(df, "_g", groups)
    free, bound = F.size(F.filter(k, lambda x: x["domain"].isNull())).cast("long"), F.size(known).cast("long")
    law, trade = "_law", "_trade"
    inside = _total("_g", lambda x: _choose3(x["k"])) + _total(law, lambda b: _choose2(_before(trade, b))) + _total(trade, lambda a: _choose2(_behind(law, a)))
    triangles = _choose3(free) + _choose2(free) * bound + free * F.col("_e.known") + inside
    # three tokens of which two or all share a root give sets of two or one
    twice, thrice = F.col("_e.all") - F.col("_e1.all"), F.size(F.filter(k, lambda x: x["thrice"]))
    single = lambda x: F.exists("_g", lambda y: (y["g"] == x["group"]) & (y["k"] == 1))
    lonely = F.filter(k, lambda x: ~x["twice"] & single(x) & ~(F.coalesce(x["domain"] == "ekonomi", F.lit(False)) & (_behind(law, x) > 0)) & ~(F.coalesce(x["domain"].isin(*LAW), F.lit(False)) & (_before(trade, x) > 0)))
    b0 = F.when(n == 0, 0).when((n == 1) | (free > 0), 1).otherwise(F.size("_g") - F.when(F.col("_e.cross") > 0, 1).otherwise(0))
    df = held(df, "n_sisi", F.col("_e.all") + F.size(F.filter(k, lambda x: x["twice"])))
    df = held(df.withColumn("n_segitiga", triangles + twice + thrice).withColumn("_lonely", F.when(free > 0, _none("string")).otherwise(F.transform(lonely, lambda x: x["root"]))), "betti0", b0.cast("int"))
    return _topological(df, t, n).drop("_a", "_law", "_trade", "_e", "_e1", "_g")


def _topological(df: DataFrame, t, n) -> DataFrame:
    """What follows from n_sisi, n_segitiga, betti0 and _lonely."""
    df = df.withColumn("_r", F.transform("_k", lambda x: x["root"]))
    df = df.withColumn("betti1", F.greatest(F.lit(0), F.col("n_sisi") - n + F.col("betti0"))).withColumn("euler", n - F.col("n_sisi") + F.col("n_segitiga"))
    df = df.withColumn("terpencil", F.when(n >= 2, F.col("_lonely")).otherwise(_none("string")))
    trivial = n <= 1
    excess = F.when(trivial, 0).otherwise(F.greatest(F.lit(0), F.col("betti1") - F.greatest(F.lit(0), F.col("n_sisi") - n)))
    df = held(df.withColumn("betti1", F.when(trivial, 0).otherwise(F.col("betti1"))), "_x", excess)
    df = df.withColumn("anomali", ~trivial & ((F.col("betti0") > 1) | (F.col("_x") > 2) | (F.size("terpencil") > 0)))
    df = df.withColumn("e_topologis", F.col("_x") * 0.2 + F.size("terpencil") * 0.3)
    v = lambda words, sev: F.struct(F.lit("topologis").alias("tipe"), words.alias("tokens"), F.lit("topologis").alias("dimensi"), F.lit(sev).alias("severitas"), F.lit("topologi").alias("asal"))
    apart = F.when(~trivial & (F.col("betti0") > 1), F.array(v(F.slice("_r", 1, 4), 0.8))).otherwise(_none(VIOLATION))
    cycle = F.when(F.col("_x") > 0, F.array(v(F.transform(F.slice(t, 1, 3), lambda x: x["root"]), 0.5))).otherwise(_none(VIOLATION))
    return held(df, "topologi", F.concat(F.transform("terpencil", lambda r: v(F.array(r), 0.7)), apart, cycle)).drop("_k", "_lonely", "_r", "_x")


def score(df: DataFrame) -> DataFrame:
    """Adds pelanggaran (all violations), energi, kepuasan (by dimension), skor, valid and spans."""
    df = held(df, "pelanggaran", F.concat("violations", "order", "komposisi", "topologi"))
    top = sum(2.718281828459045 ** w for w in R.WEIGHTS.values())
    base = sum((F.col(f"e_{d}") * (2.718281828459045 ** w / top) for d, w in R.WEIGHTS.items()), F.lit(0.0))
    cpe = F.when(F.size("order") > 0, F.least(F.lit(1.0), base + 0.15 * F.size("order"))).otherwise(base)
    energy = F.when(F.col("n") == 0, 0.0).otherwise(cpe + F.col("e_komposisi") * 0.2 + F.col("e_topologis") * 0.15)
    df = df.withColumn("energi", energy)
    k = F.greatest(F.size("edges"), F.lit(1))
    sat = []
    grave = lambda d: F.size(F.filter("pelanggaran", lambda p: (p["dimensi"] == d) & (p["severitas"] > 0.5)))
    for d in R.DIMENSIONS:
        heavy = grave(d)
        sat.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col(f"e_{d}") - 0.1 * heavy / k)).alias(d))
    df = df.withColumn("kepuasan", F.struct(*sat)).withColumn("rata_kepuasan", sum((F.col(f"kepuasan.{d}") for d in R.DIMENSIONS), F.lit(0.0)) / len(R.DIMENSIONS))
    e = F.greatest(F.lit(0.0), F.least(F.col("energi"), F.lit(5.0)))
    heavy = F.size(F.filter("pelanggaran", lambda p: p["severitas"] > 0.5))
    raw = 0.5 / (1.0 + F.exp(e)) + 0.3 * F.col("rata_kepuasan") + 0.2 * F.when(F.col("anomali"), 0.7).otherwise(1.0)
    raw = F.greatest(F.lit(0.0), raw - F.least(F.lit(0.4), heavy * 0.08)) * (0.5 + 0.5 * F.col("lengkap"))
    df = df.withColumn("skor", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).withColumn("valid", (F.col("energi") < 0.5) & ~F.col("anomali"))
    return df.withColumn("ringkasan", F.format_string("[%s] skor=%.3f energi=%.3f pelanggaran=%d morfem=%d", F.when(F.col("valid"), "VALID").otherwise("INVALID"), F.col("skor"), F.col("energi"), F.size("pelanggaran"), F.col("n")))


def spans(df: DataFrame) -> DataFrame:
    """Adds spans: (mulai, akhir, token, root, dimensi, severitas) of violations' tokens in the text, by start."""
    low = F.lower(F.coalesce("text", F.lit("")))
    kind = "struct<kunci:string,mulai:int,akhir:int,token:string>"
    start = F.struct(F.lit(0).alias("at"), _none(kind).alias("map"))

    def step(acc, t):
        word = F.lower(t["teks"])
        ahead = F.instr(F.substr(low, acc["at"] + 1), word)
        pos = F.when(ahead > 0, acc["at"] + ahead - 1).otherwise(F.instr(low, word) - 1).cast("int")
        end = pos + F.char_length(t["teks"])
        row = lambda k: F.struct(k.alias("kunci"), pos.alias("mulai"), end.alias("akhir"), t["teks"].alias("token"))
        return F.struct(F.when(pos >= 0, end).otherwise(acc["at"]).alias("at"), F.when(pos >= 0, F.concat(acc["map"], F.array(row(F.lower(t["root"])), row(word)))).otherwise(acc["map"]).alias("map"))

    places = F.aggregate("tokens", start, step, lambda a: a["map"])
    df = held(df, "_at", places)
    named = F.flatten(F.transform("pelanggaran", lambda p: F.transform(p["tokens"], lambda r: F.struct(F.element_at(F.filter(F.concat(F.array(F.lit(None).cast(kind)), "_at"), lambda x: x.isNull() | (x["kunci"] == F.lower(r))), -1).alias("x"), r.alias("root"), p["dimensi"].alias("dimensi"), p["severitas"].alias("severitas")))))
    named = F.transform(F.filter(named, lambda s: s["x"].isNotNull()), lambda s: F.struct(s["x"]["mulai"].alias("mulai"), s["x"]["akhir"].alias("akhir"), s["x"]["token"].alias("token"), s["root"].alias("root"), s["dimensi"].alias("dimensi"), s["severitas"].alias("severitas")))
    empty = _none("struct<mulai:int,akhir:int,token:string,root:string,dimensi:string,severitas:double>")
    once = F.aggregate(named, empty, lambda acc, s: F.when(F.exists(acc, lambda x: (x["mulai"] == s["mulai"]) & (x["akhir"] == s["akhir"]) & (x["dimensi"] == s["dimensi"])), acc).otherwise(F.concat(acc, F.array(s))))
    return df.withColumn("spans", F.array_sort(once, lambda a, b: F.when(a["mulai"] < b["mulai"], -1).when(a["mulai"] > b["mulai"], 1).otherwise(0))).drop("_at")


def prepared(parsed: DataFrame) -> DataFrame:
    """What analyse works out first, whatever the settings: edges, completeness, word order."""
    return word_order(completeness(edges(parsed)))


def analyse(parsed: DataFrame, config: Config | None = None) -> DataFrame:
    """All checks of parsed sentences. Columns that are not selected later cost nothing."""
    return score(topology(composition(tensions(prepared(parsed), config), config), config))


def analyses(parsed: DataFrame, configs: list[Config]) -> list[DataFrame]:
    """analyse() for each of configs. What does not depend on the settings is worked out once and stored; topology, once for all thresholds of one range."""
    from .storage import stored

    first, done = prepared(parsed), {}
    out = []
    for c in configs:
        range_ = 0.0 if 1.5 <= c.threshold < 2.3 else c.threshold
        if range_ not in done:
            done[range_] = stored(topology(first, c))
        out.append(score(composition(tensions(done[range_], c), c)))
    return out
