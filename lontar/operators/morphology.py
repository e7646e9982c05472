"""Words to morphemes: affixes, roots, classes and roles.

Each distinct word is analysed once: its candidate roots are looked up in the lexicon by a join, and the decision is
one expression. Tokens then get their words' analyses back, and roles by windows over their sentence: linear in its
length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chosen, composed, in_list, normalise, segments
from ..plans import rules as R
from . import lexicon as L
from .storage import held, stored

AFFIX = "struct<bentuk:string,tipe:string,fungsi:string,valid:boolean>"
NOMINAL = ["N", "Pron", "N_proper", "N_serapan"]


def _spellings(of=None):
    """(canonical, spelling, letters to strip), longest first."""
    rows = [(c, a, len(a) - 1) for c, _, _, _, forms in R.PREFIXES for a in forms.split() if of is None or of(c)]
    return sorted(rows, key=lambda r: -r[2])


def _stripped(w, spelling: str):
    root = F.substr(w, F.lit(len(spelling)))
    back = R.RESTORED.get(spelling)
    return F.when(~root.startswith(back), F.concat(F.lit(back), root)).otherwise(root) if back else root


def _has_prefix(w, spelling: str, n: int):
    return w.startswith(spelling[:-1]) & (F.char_length(w) > n + 2)


def prefix_of(w):
    """struct(bentuk, ejaan, root) of the longest prefix, or null."""
    cases = [F.when(_has_prefix(w, a, n), F.struct(F.lit(c).alias("bentuk"), F.lit(a).alias("ejaan"), _stripped(w, a).alias("root"))) for c, a, n in _spellings()]
    return F.coalesce(*cases)


def suffix_of(w):
    """struct(bentuk, root) of the first suffix in table order, or null."""
    cases = [F.when(w.endswith(s[1:]) & (F.char_length(w) > len(s) - 1 + 2), F.struct(F.lit(s).alias("bentuk"), F.substr(w, F.lit(1), F.char_length(w) - (len(s) - 1)).alias("root"))) for s, *_ in R.SUFFIXES]
    return F.coalesce(*cases)


def confix_roots(w) -> list:
    """For each confix, the root between its parts (three letters at least), or null."""
    out = []
    for c, *_ in R.CONFIXES:
        p, s = c.split("-")
        inner = F.coalesce(*[F.when(_has_prefix(w, a, n), _stripped(w, a)) for _, a, n in _spellings(lambda x, p=p: x.startswith(p) or p in x)])
        root = F.when(inner.endswith(s), F.substr(inner, F.lit(1), F.char_length(inner) - len(s)))
        out.append(F.when(F.char_length(root) >= 3, root))
    return out


def informal(w):
    """Whether a word is part of an informal form's example."""
    return F.exists(F.array(*[F.lit(x.lower()) for x in R.INFORMAL_EXAMPLES]), lambda x: F.contains(x, F.lower(w)))


def _forms(words: DataFrame) -> DataFrame:
    """words with lw and what its affixes leave: p, k, inner, s, and c: all forms that are looked up."""
    w = words.select("teks", "lanjut").distinct().withColumn("lw", F.lower("teks"))
    w = held(held(w, "p", prefix_of(F.col("lw"))), "k", F.array(*confix_roots(F.col("lw"))))
    w = held(held(w, "inner", F.coalesce("p.root", "lw")), "s", suffix_of(F.col("inner")))
    return w.withColumn("c", F.array_distinct(F.filter(F.concat(F.array("lw", "p.root", "inner", "s.root"), F.col("k")), lambda x: x.isNotNull())))


def needs(words: DataFrame) -> DataFrame:
    """(kata, teks, lanjut): the entries, there or not, on which each word's analysis depends."""
    w = _forms(words)
    halves = F.split("lw", "-")  # of a repeated word, either half may be the root
    return w.select("teks", "lanjut", F.explode(F.array_distinct(F.concat("c", F.when(F.size(halves) == 2, halves).otherwise(F.array().cast("array<string>"))))).alias("kata")).select("kata", "teks", "lanjut")


def analyse_words(words: DataFrame, lexicon: DataFrame, parts: int | None = None) -> DataFrame:
    """words (teks, lanjut: not a sentence's first) -> one row each: root, kelas, peran, afiks, redup, base, serapan,
    proper, ada, and of the root's entry: domain, pos. parts: into how many tasks the words are dealt, if that is told."""
    dealt = lambda df: df.repartition(parts, "teks", "lanjut") if parts else df
    w = _forms(dealt(words))
    lex = L.small(lexicon.select("kata", "kelas"))
    hits = w.select("teks", "lanjut", F.explode("c").alias("kata")).join(lex, "kata")
    hits = dealt(hits).groupBy("teks", "lanjut").agg(F.map_from_entries(F.collect_list(F.struct("kata", "kelas"))).alias("m"))
    w = w.join(hits, ["teks", "lanjut"], "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,string>")))

    entry = lambda x: F.try_element_at(F.col("m"), x)
    kelas = lambda x: F.coalesce(chosen(F.lower(entry(x)), R.POS_CLASS), F.lit("?"))
    none = F.array().cast(f"array<{AFFIX}>")
    affix = lambda form, kind, use, ok: F.struct(F.lit(form).alias("bentuk") if isinstance(form, str) else form.alias("bentuk"), F.lit(kind).alias("tipe"), use.alias("fungsi"), ok.alias("valid"))

    def cand(root, afiks, kls):
        return F.struct(root.alias("root"), F.array(afiks).alias("afiks"), kls.alias("kelas"))

    p, s = F.col("p"), F.col("s")
    pre = {c: (f, v, o) for c, f, v, o, _ in R.PREFIXES}
    suf = {c: (f, v, o) for c, f, v, o in R.SUFFIXES}
    table = lambda t, key, i: chosen(key, {c: x[i] for c, x in t.items() if x[i]})
    allowed = lambda t, key, k: F.coalesce(F.array_contains(F.split(table(t, key, 1), " "), k), F.lit(False))
    pk = kelas(p["root"])
    prefix_cand = F.when(p.isNotNull(), cand(p["root"], affix(p["bentuk"], "prefiks", table(pre, p["bentuk"], 0), allowed(pre, p["bentuk"], pk)), F.coalesce(table(pre, p["bentuk"], 2), pk)))
    confix = []
    for i, (c, use, valid, out) in enumerate(R.CONFIXES):
        root = F.get("k", i)
        confix.append(F.when(root.isNotNull(), cand(root, affix(c, "konfiks", F.lit(use), F.array_contains(F.array(*[F.lit(x) for x in valid.split()]), kelas(root))), F.lit(out))))
    some = F.filter(F.array(*confix), lambda x: x.isNotNull())
    w = held(held(w, "ck", some), "pc", prefix_cand)
    known = F.filter(F.concat("ck", F.filter(F.array("pc"), lambda x: x.isNotNull())), lambda x: entry(x["root"]).isNotNull())
    w = held(w, "known", known)
    # the longest known root, the first of equals
    longest = F.array_max(F.transform("known", lambda x, i: F.struct(F.char_length(x["root"]).alias("n"), (-i).alias("i"))))
    by_confix = F.coalesce(F.get("known", -longest["i"]), F.get("ck", 0))
    # prefix, then suffix
    strip = s.isNotNull() & (F.char_length(s["root"]) >= 3) & ~(entry(F.col("inner")).isNotNull() & entry(s["root"]).isNull())
    sk = kelas(s["root"])
    afiks = F.concat(F.when(p.isNotNull(), F.col("pc.afiks")).otherwise(none), F.when(strip, F.array(affix(s["bentuk"], "sufiks", table(suf, s["bentuk"], 0), allowed(suf, s["bentuk"], sk)))).otherwise(none))
    root = F.when(strip, s["root"]).otherwise(F.col("inner"))
    kls = F.coalesce(F.when(strip, table(suf, s["bentuk"], 2)), F.when(p.isNotNull(), F.col("pc.kelas")), F.lit("?"))
    w = held(held(held(held(w, "bc", F.when(F.size("ck") > 0, by_confix)), "sr", root), "sa", afiks), "_sk", kls)
    w = held(w, "sk", F.when(F.col("_sk") == "?", kelas(F.col("sr"))).otherwise(F.col("_sk")))

    lw, t = F.col("lw"), F.col("teks")
    whole, part = t.rlike(r"(?iU)^(\w+)-\1$"), F.regexp_extract(t, r"(?iU)^(\w{2,3})-(\w+)$", 1)
    base = F.regexp_extract(t, r"(?iU)^(\w{2,3})-(\w+)$", 2)
    partial = (part != "") & base.startswith(F.substr(part, F.lit(1), F.lit(2)))
    closed, role = F.lit(None).cast("string"), F.lit(None).cast("string")
    for ws, k, r in reversed(R.CLOSED):
        closed, role = F.when(in_list(lw, ws), k).otherwise(closed), F.when(in_list(lw, ws), r).otherwise(role)
    proper = t.rlike(r"^\p{Lu}") & F.col("lanjut")
    keep = in_list(lw, R.WHOLE)
    loan = lw.rlike(r"(?U)^(" + "|".join(R.LOANWORDS) + r")\b")
    cut_root = suffix_of(p["root"])["root"]
    whole_pos, root_pos = entry(lw), entry(cut_root)
    split = F.coalesce(p.isNotNull() & (F.char_length(cut_root) >= 3) & root_pos.isNotNull() & (whole_pos == root_pos), F.lit(False))
    stays = whole_pos.isNotNull() & ~split
    wk = kelas(lw)
    step = (F.when(whole, "full").when(partial, "part").when(closed.isNotNull(), "closed").when(proper, "proper").when(keep, "keep").when(loan, "loan")
            .when(stays, "entry").when(F.col("bc").isNotNull(), "confix").otherwise("affix"))
    w = held(w, "step", step)
    at = lambda cases, other=None: _cases(F.col("step"), cases, other)
    out = w.select("teks", "lanjut",
        at({"full": F.lower(F.split_part(t, F.lit("-"), F.lit(1))), "part": F.lower(base), "proper": t, "confix": F.col("bc.root"), "affix": F.col("sr")}, lw).alias("root"),
        at({"full": F.lit("N"), "part": F.lit("N"), "closed": closed, "proper": F.lit("N_proper"), "keep": F.when(wk == "?", "Adj").otherwise(wk), "loan": F.lit("N_serapan"), "entry": wk, "confix": F.col("bc.kelas")}, F.col("sk")).alias("kelas"),
        at({"closed": role}, F.lit("?")).alias("peran"),
        at({"confix": F.col("bc.afiks"), "affix": F.col("sa")}, none).alias("afiks"),
        at({"full": F.lit("penuh"), "part": F.lit("parsial")}).alias("redup"),
        (F.col("step") == "loan").alias("serapan"), (F.col("step") == "proper").alias("proper"),
        at({"closed": F.lit(True), "keep": whole_pos.isNotNull(), "entry": F.lit(True), "confix": entry(F.col("bc.root")).isNotNull(), "affix": entry(F.col("sr")).isNotNull()}, F.lit(False)).alias("ada"))
    e = L.small(lexicon.select(F.col("kata").alias("_k"), F.col("kelas").alias("pos"), "domain"))
    return out.join(e, F.lower("root") == F.col("_k"), "left").drop("_k")


def _cases(step, cases: dict, other):
    out = other if other is not None else F.lit(None).cast("string")
    for k, v in reversed(cases.items()):
        out = F.when(step == k, v).otherwise(out)
    return out


def words_of(sentences: DataFrame, key: list[str]) -> DataFrame:
    """(key..., idx, teks) of the words of text, in canonical composition."""
    return composed(sentences.select(*key, "text")).select(*key, F.posexplode(segments(normalise(F.col("text")))).alias("idx", "teks"))


def with_roles(done: DataFrame, key: list[str]) -> DataFrame:
    """Analysed tokens (key..., idx, kelas, peran) with their roles in the sentence.

    The first verb is the predicate. Of the tokens without a role, the one behind a preposition is K; of the other
    nominals the first before the verb is S, the first after it O and the rest Pel; adjectives are Mod.
    """
    whole = Window.partitionBy(*key)
    d = done.withColumn("_v", F.min(F.when(F.col("kelas") == "V", F.col("idx"))).over(whole))
    verb = F.coalesce(F.col("idx") == F.col("_v"), F.lit(False))
    d = d.withColumn("_open", (F.col("peran") == "?") & ~verb)
    last = F.lag("kelas").over(Window.partitionBy(*key, "_open").orderBy("idx"))
    d = d.withColumn("_behind", F.col("_open") & (F.col("kelas") != "Prep") & F.coalesce(last == "Prep", F.lit(False)))
    d = d.withColumn("_free", F.col("_open") & (F.col("kelas") != "Prep") & ~F.col("_behind")).withColumn("_noun", F.col("_free") & F.col("kelas").isin(NOMINAL)).withColumn("_after", F.coalesce(F.col("idx") > F.col("_v"), F.lit(False)))
    first = F.row_number().over(Window.partitionBy(*key, "_noun", "_after").orderBy("idx")) == 1
    d = d.withColumn("_first", first)
    noun, after = F.col("_noun"), F.col("_after")
    role = (F.when(verb, "P").when(~F.col("_open"), F.col("peran")).when(F.col("_behind"), "K").when(noun & ~after & F.col("_first"), "S").when(noun & after & F.col("_first"), "O")
            .when(noun & after, "Pel").when(F.col("_free") & (F.col("kelas") == "Adj"), "Mod").otherwise("?"))
    return d.withColumn("peran", role).drop("_v", "_open", "_behind", "_free", "_noun", "_after", "_first")


FIELDS = ["idx", "teks", "root", "kelas", "peran", "afiks", "redup", "serapan", "proper", "ada", "domain", "pos"]


#: Up to so many analysed words (some hundred bytes each) are broadcast.
FEW = 200_000
PIECES = 64


def with_analyses(t: DataFrame, words: DataFrame, key: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Tokens (key..., idx, teks, lanjut) with their words' analyses. counts: (teks, lanjut, n), if they are known.

    Where they meet by a shuffle, tokens are dealt by their number: by packed bytes a task's tokens would grow with the input."""
    on = ["teks", "lanjut"]
    if words.limit(FEW + 1).count() <= FEW:
        return t.join(F.broadcast(words), on)
    # a word with more than a thousandth of the tokens is dealt in pieces: there are not more than a thousand of them
    n = counts if counts is not None else stored(t.groupBy(*on).agg(F.count(F.lit(1)).alias("n")))
    total = n.agg(F.sum("n")).first()[0] or 0
    often = stored(n.where(F.col("n") > max(total / 1000, 1)).select(*on, F.lit(PIECES).alias("_pieces")))
    dealt = t.join(F.broadcast(often), on, "left").withColumn("_piece", F.pmod(F.xxhash64(*key, "idx"), F.coalesce("_pieces", F.lit(1))).cast("int")).drop("_pieces")
    copies = words.join(F.broadcast(often), on, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    # a join takes no fewer tasks than shuffles have: with fewer, tokens would be dealt once more
    parts = max(_tasks(t.sparkSession, total, 5 * TOKENS), int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(parts, *on, "_piece").join(copies.repartition(parts, *on, "_piece"), [*on, "_piece"]).drop("_piece")


#: Tokens and distinct words that a task takes. Adaptive execution would merge partitions by their packed bytes, and a
#: task's memory would grow with the input: texts of few kinds of words pack well, their analyses are wide.
TOKENS, WORDS = 100_000, 20_000


def _tasks(spark, rows: int, each: int) -> int:
    """How many tasks take rows, `each` at most on average; as many as there are cores, if each of them gets some."""
    return max(-(-rows // each), min(spark.sparkContext.defaultParallelism, -(-rows // (each // 20))), 1)


def tokens_of(sentences: DataFrame, lexicon: DataFrame, key: tuple = ("doc_id", "sent_idx"), fields: tuple = tuple(FIELDS)) -> DataFrame:
    """sentences (key..., text) -> key..., tokens of those that have words: an array of fields (of FIELDS, idx among them) in order.

    Each distinct word is analysed once and stored. The analyses are broadcast where a count shows that they are few;
    else tokens meet them by a shuffle in which frequent words are dealt in pieces. Then a sentence's tokens meet. Only the
    fields travel, and roles are worked out only where they are asked for.
    """
    key, fields, on = list(key), list(fields), ["teks", "lanjut"]
    t = words_of(sentences, key).withColumn("lanjut", F.col("idx") > 0)
    # texts are cut into words twice: to count these, and to meet their analyses
    counts = stored(t.groupBy(*on).agg(F.count(F.lit(1)).alias("n")))
    size, spark = counts.agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first(), sentences.sparkSession
    words = stored(analyse_words(counts, lexicon, _tasks(spark, size.words, WORDS)))
    need = {*fields, *(("kelas", "peran") if "peran" in fields else ())}
    met = with_analyses(t, words.select(*on, *[c for c in words.columns if c in need and c not in on]), key, counts)
    done = met.repartition(_tasks(spark, size.tokens, TOKENS), *key)
    if "peran" in fields:
        done = with_roles(done, key)
    return done.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("tokens"))


def parse(sentences: DataFrame, lexicon: DataFrame, key: tuple = ("doc_id", "sent_idx")) -> DataFrame:
    """sentences (key..., text) -> key..., text, tokens: an array of FIELDS in order; empty where there are no words."""
    key = list(key)
    wide = tokens_of(sentences, lexicon, key)
    empty = F.array().cast(wide.schema["tokens"].dataType)
    return sentences.select(*key, "text").join(wide, key, "left").withColumn("tokens", F.coalesce("tokens", empty))


# ---- the second analyser: scored candidates ----------------------------------------------------------------------
def candidates(words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """words (word) -> (word, ord, root, affix, conf): whole, prefixes and suffixes (longest first), confixes."""
    w = words.select(F.trim(F.lower("word")).alias("word")).distinct()
    word = F.col("word")
    long = lambda r: F.char_length(r) >= 3
    longest = lambda xs: sorted(xs, key=len, reverse=True)
    row = lambda i, root, affix, conf: F.struct(F.lit(i).alias("ord"), root.alias("root"), F.lit(affix).alias("affix"), F.lit(conf).alias("conf"))
    tail = lambda n: F.substr(word, F.lit(n + 1))
    if known is not None:
        roots = F.filter(F.array(word, *[F.when(word.startswith(p) & long(tail(len(p))), tail(len(p))) for p in R.PREFIXES2]), lambda x: x.isNotNull())
        hit = w.select("word", F.explode(F.array_distinct(roots)).alias("r")).join(L.small(known.select(F.col("kata").alias("r")).distinct()), "r")
        hit = hit.groupBy("word").agg(F.max(F.col("r") == F.col("word")).alias("self"), F.max(F.col("r") != F.col("word")).alias("other"))
        w = w.join(hit, "word", "left")
        sure = F.coalesce(F.col("self") & ~F.col("other"), F.lit(False))
    else:
        sure = F.lit(False)
    rows = [F.struct(F.lit(0).alias("ord"), word.alias("root"), F.lit("<NONE>").alias("affix"), F.when(sure, 0.97).otherwise(0.5).alias("conf"))]
    for p in longest(R.PREFIXES2):
        rows.append(F.when(word.startswith(p) & long(tail(len(p))), row(len(rows), tail(len(p)), p, min(0.6 + 0.05 * len(p), 0.95))))
    for s in longest(R.SUFFIXES2):
        root = F.substr(word, F.lit(1), F.char_length(word) - len(s))
        rows.append(F.when(word.endswith(s) & long(root), row(len(rows), root, s, min(0.5 + 0.05 * len(s), 0.85))))
    for p, s in R.CONFIXES2:
        root = F.substr(word, F.lit(len(p) + 1), F.char_length(word) - len(p) - len(s))
        rows.append(F.when(word.startswith(p) & word.endswith(s) & (F.char_length(word) >= len(p) + len(s) + 3), row(len(rows), root, f"{p}+{s}", min(0.6 + 0.05 * len(p) - 0.1, 0.80))))
    return w.select("word", F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("c")).select("word", "c.*")


def best(words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(word, root, affix): the candidate of highest confidence, the first of equals."""
    c = candidates(words, known).groupBy("word").agg(F.max_by(F.struct("root", "affix"), F.struct("conf", -F.col("ord"))).alias("b"))
    return c.select("word", "b.root", "b.affix")


def tag_of(word, entry=None):
    """The tag of a lower-cased word: closed list, digits, dictionary, prefix hint, suffix hints, N.

    entry: what gives the dictionary class of a word or root (null: not there); without it prefixes need no known root.
    """
    number = F.regexp_replace(word, "[.,]", "").rlike("^[0-9]+$")
    n = F.char_length(word)
    hint = [(p, F.substr(word, F.lit(len(p) + 1))) for p in R.PREFIXES2]
    known = lambda r: entry(r).isNotNull() if entry else F.lit(True)
    prefixed = F.coalesce(*[F.when(word.startswith(p) & (F.char_length(r) >= 3) & known(r), R.PREFIX_POS[p]) for p, r in hint])
    listed = chosen(entry(word), R.DICTIONARY_POS) if entry else F.lit(None).cast("string")
    ending = F.when(word.endswith("an") & (n > 4), "N").when(word.endswith("kan") & (n > 5), "V").when(word.endswith("i") & (n > 4), "V").when(word.endswith("nya") & (n > 5), "N").otherwise("N")
    return F.coalesce(chosen(word, R.FUNCTION_WORDS), F.when(number, "NUM"), listed, prefixed, ending)


def plain_tag(word: str) -> str:
    """tag_of without a dictionary, in plain Python: for the distinct words of a batch."""
    if word in R.FUNCTION_WORDS:
        return R.FUNCTION_WORDS[word]
    digits = word.replace(".", "").replace(",", "")
    if digits.isascii() and digits.isdigit():
        return "NUM"
    for p in R.PREFIXES2:
        if word.startswith(p) and len(word) >= len(p) + 3:
            return R.PREFIX_POS[p]
    return "V" if word.endswith("i") and len(word) > 4 else "N"  # what ends in -kan ends in -an


def pos_tags(words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(word, tag) of each distinct word; known: (kata, kelas) of a dictionary."""
    w = words.select(F.trim(F.lower("word")).alias("word")).distinct()
    word = F.col("word")
    if known is None:
        return w.select("word", tag_of(word).alias("tag"))
    roots = F.filter(F.array(word, *[F.when(word.startswith(p) & (F.char_length(word) >= len(p) + 3), F.substr(word, F.lit(len(p) + 1))) for p in R.PREFIXES2]), lambda x: x.isNotNull())
    k = L.small(known.select(F.col("kata").alias("r"), F.col("kelas").alias("k")))
    hit = w.select("word", F.explode(F.array_distinct(roots)).alias("r")).join(k, "r").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("r", "k"))).alias("m"))
    w = w.join(hit, "word", "left")
    entry = lambda x: F.when(F.col("m").isNotNull(), F.nullif(F.try_element_at("m", x), F.lit("ref")))
    return w.select("word", tag_of(word, entry).alias("tag"))


def root_vocabulary(texts: DataFrame, min_freq: int = 2) -> DataFrame:
    """(token, id, freq): specials, then roots and words by frequency. Ties are in code point order."""
    from ..functions.text import tokens
    from .storage import ranked

    words = texts.select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    both = words.join(best(words), "word")
    freq = both.select(F.col("word").alias("token"), "n").unionByName(both.select(F.col("root").alias("token"), "n")).groupBy("token").agg(F.sum("n").alias("freq"))
    rows = ranked(freq.where(F.col("freq") >= min_freq), "id", F.desc("freq"), F.col("token"))
    spark = texts.sparkSession
    special = spark.createDataFrame([(t, i, 0) for i, t in enumerate(R.SPECIALS)], "token string, id int, freq long")
    return special.unionByName(rows.select("token", (F.col("id") + len(R.SPECIALS) - 1).cast("int").alias("id"), "freq"))


def load_vocabulary(spark, path: str) -> DataFrame:
    """(token, id) of a JSON file {token: id} or {meta, vocab: {token: id}}; missing specials get their ids."""
    raw = spark.read.text(path, wholetext=True)
    flat = F.coalesce(F.from_json(F.get_json_object("value", "$.vocab"), "map<string,int>"), F.from_json("value", "map<string,int>"))
    v = raw.select(F.explode(flat).alias("token", "id")).where("id IS NOT NULL")
    special = spark.createDataFrame([(t, i) for i, t in enumerate(R.SPECIALS)], "token string, id int")
    return v.unionByName(special.join(v, "token", "left_anti"))
