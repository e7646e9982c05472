"""Corpus cleaning, normalising, deduplication, validation and quality scores."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import composed
from .storage import held

URL = r"(https?://|www\.)[^ \t\r\n]+"
HTML = r"<[^<>]+>"
WIKI = r"\[\[|\]\]|\{\{[^{}]*\}\}"
NOTE = r"\[[0-9]+\]"
WORD_GAP = r"[ \t\r\n]+"
#: Of the gaps, those that are not one space already.
WIDE_GAP = r"[\t\r\n][ \t\r\n]*| [ \t\r\n]+"


@dataclass(frozen=True)
class Settings:
    min_tokens: int = 3
    max_tokens: int = 40
    max_digit_ratio: float = 0.3
    max_garbage_ratio: float = 0.1
    near_threshold: float = 0.8
    key_length: int = 60
    strict: bool = False

    def __post_init__(self):
        if not (0 < self.min_tokens < self.max_tokens and 0 < self.max_digit_ratio <= 1 and 0 < self.max_garbage_ratio <= 1 and 0 < self.near_threshold <= 1):
            raise ValueError(f"settings out of range: {self}")


def word_list(c):
    return F.filter(F.split(c, WORD_GAP), lambda w: w != "")


def once(c, f):
    """f(c), with c worked out once, however often f uses it: as a lambda's variable."""
    return F.get(F.transform(F.array(c), f), 0)


def replaced(c, pattern: str, to: str, signs: tuple):
    """regexp_replace, tried only on texts with one of the signs, one of which is in each match: most texts have none."""
    return once(c, lambda t: F.when(reduce(or_, (F.contains(t, F.lit(x)) for x in signs)), F.regexp_replace(t, pattern, to)).otherwise(t))


#: What of a text goes, and signs without which there is none of it.
MARKUP = [(URL, ("://", "www.")), (HTML, ("<",)), (WIKI, ("[[", "]]", "{{")), (NOTE, ("[",)), (r"\x00", ("\x00",))]
WIDE = ("  ", "\t", "\r", "\n")


def strip_markup(c):
    """Text without addresses, tags, wiki marks, [n] notes and NUL."""
    t = F.coalesce(c, F.lit(""))
    for pattern, signs in MARKUP:
        t = replaced(t, pattern, " ", signs)
    return F.trim(replaced(t, WIDE_GAP, " ", WIDE))


def share(c, pattern: str):
    """Share of a text's characters that match a one-character pattern; 0 for an empty text."""
    n = F.char_length(c)
    return F.when(n > 0, (n - F.char_length(F.regexp_replace(c, pattern, ""))) / n).otherwise(0.0)


def passes(t, s: Settings = Settings()):
    """Whether a stripped text has enough words, not too many digits and not too many odd signs."""
    words = (t != "") & (F.size(F.split(t, " ", s.min_tokens)) >= s.min_tokens)  # words beyond the least number are not told apart
    return words & (share(t, "[0-9]") <= s.max_digit_ratio) & (share(t, r"[{}\[\]|<>\\^~*_=#@]") <= s.max_garbage_ratio)


def clean(c, s: Settings = Settings()):
    """The stripped text, or null: too few words, too many digits, too many odd signs."""
    return once(strip_markup(c), lambda t: F.when(passes(t, s), t))


def normalise(c):
    """White space to single spaces; repeated ! and ? to one; longer rows of dots to three."""
    t = replaced(replaced(c, WIDE_GAP, " ", WIDE), "!{2,}", "!", ("!!",))
    return F.trim(replaced(replaced(t, r"\?{2,}", "?", ("??",)), r"\.{4,}", "...", ("....",)))


def numbered(df: DataFrame, text: str, order: str) -> tuple[DataFrame, bool]:
    """(df with _id, whether rows share one): a number in the order of rows: by `order`, null last, then by the text's hash.

    Fully equal rows share a number. Where `order` is whole numbers that are neither null nor repeated, it is the number.
    """
    from .storage import ranked

    whole = df.schema[order].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    twice = df.groupBy(order).agg(F.count(F.lit(1)).alias("n")).where(F.col(order).isNull() | (F.col("n") > 1))
    if whole and twice.isEmpty():
        return df.withColumn("_id", F.col(order).cast("long")), False
    th = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_th")
    keys = ranked(df.select(F.col(order).alias("_o"), th).distinct(), "_id", F.col("_o").asc_nulls_last(), F.col("_th"))
    d = df.withColumn("_h", th)
    return d.join(keys, F.col(order).eqNullSafe(F.col("_o")) & (F.col("_h") == F.col("_th"))).drop("_o", "_th", "_h"), True


def exact_dedup(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """The first row of each text: by `order`, rows without it last. Keys are digests, so texts do not travel for the
    comparison. Null texts are one text; of fully equal rows one is kept."""
    d, shared = numbered(df, text, order)
    first = d.groupBy(F.coalesce(F.sha2(F.col(text).cast("binary"), 256), F.lit("null")).alias("_d")).agg(F.min("_id").alias("_id"))
    out = d.join(first.select("_id"), "_id", "left_semi")
    return (out.dropDuplicates(["_id"]) if shared else out).drop("_id")


def near_key(c, length: int):
    return F.substr(F.lower(F.trim(c)), F.lit(1), F.lit(length))


def likeness(a, b):
    """Jaccard similarity of two columns of distinct words; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(1.0)


#: Up to so many rows of a key are settled in one task, in order.
TASK_ROWS = 2000
#: Numbers of 64 bits in a row's signs.
SIGNS = 16


def in_order(sets, least: float) -> list[int]:
    """Places of the sets (arrays of distinct numbers, in order) that are kept: those similar to no kept one before."""
    import numpy as np

    if not len(sets):
        return []
    size = np.array([len(x) for x in sets])
    _, back = np.unique(np.concatenate(sets), return_inverse=True)
    words = np.split(back, np.cumsum(size)[:-1])
    holders: dict = {}  # of each word, the kept sets that have it
    kept, empty = [], False
    for i, w in enumerate(words):
        if not len(w):
            if not empty:
                kept.append(i)
            empty = True
            continue
        met = [holders[x] for x in w.tolist() if x in holders]
        if met:
            n = np.bincount(np.concatenate(met), minlength=len(kept))
            both = size[kept]
            if (n >= least * (size[i] + both - n) - 1e-12)[n > 0].any():
                continue
        for x in w.tolist():
            holders.setdefault(x, []).append(len(kept))
        kept.append(i)
    return kept


def _by_task(rest: DataFrame, least: float) -> DataFrame:
    """(id) kept of (id, key, words): each key's rows in one task, in order of id."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        key, ids, sets = None, [], []
        for b in batches:
            words = b.column("words")
            flat, ends = words.values.to_numpy(), words.offsets.to_numpy()
            for j, (k, i) in enumerate(zip(b.column("key").to_pylist(), b.column("id").to_pylist())):
                if k != key and ids:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in in_order(sets, least)], pa.int64())], ["id"])
                    ids, sets = [], []
                key = k
                ids.append(i)
                sets.append(np.array(flat[ends[j] : ends[j + 1]]))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in in_order(sets, least)], pa.int64())], ["id"])

    return rest.select("id", "key", "words").repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "id long")


def near_dedup(df: DataFrame, s: Settings = Settings(), text: str = "text", order: str = "doc_id") -> DataFrame:
    """Rows kept when, in order, a row goes if its word set is similar (Jaccard) to a kept one with the same key.

    A key of up to TASK_ROWS rows is settled in one task, row by row. Of larger keys the first row is kept and all others are
    held against it alone, dealt in pieces; that goes on while each such round settles half of the rows left, as it does
    with groups of copies. What is left then has many kept rows in a key, and settled() finds its similar pairs by rare words.
    Rows without `order` come last, those that share it are in the order of their texts' hashes, and of fully equal rows one
    is kept. Null texts are similar to each other, not to empty ones; rows without words are similar to each other.
    """
    from .storage import looked_up, release, stored

    whole, shared_ids = numbered(df, text, order)
    df, order = whole, "_id"
    t = F.coalesce(F.col(text), F.lit(""))
    key = F.xxhash64(near_key(F.col(text), s.key_length)).alias("key")  # null texts have a key of their own
    keys = stored(df.select(F.col(order).alias("id"), key).groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    # a row that is alone with its key is kept, and its words do not travel
    kept = [keys.where("n = 1").select("id")]
    words = F.array_distinct(F.transform(word_list(F.lower("t")), lambda w: F.xxhash64(w))).alias("words")
    shared = looked_up(df.select(F.col(order).alias("id"), key, t.alias("t")), "key", keys.where("n > 1").select("key", "n")).where("n IS NOT NULL")
    shared = shared.select("id", "key", "n", words)
    kept.append(stored(_by_task(shared.where(F.col("n") <= TASK_ROWS), s.near_threshold)))
    if not keys.where(F.col("n") > TASK_ROWS).isEmpty():
        rest = stored(shared.where(F.col("n") > TASK_ROWS).select("id", "key", "words"))
        n, before = rest.count(), None
        while n and (before is None or n <= before / 2):
            lead = rest.groupBy("key").agg(F.min("id").alias("fid"))
            lead = stored(looked_up(rest, "key", lead).where("id = fid").select("key", "fid", F.col("words").alias("lw")))
            kept.append(lead.select(F.col("fid").alias("id")))
            last, rest = rest, stored(looked_up(rest, "key", lead).where((F.col("id") > F.col("fid")) & (likeness("words", "lw") < s.near_threshold)).select("id", "key", "words"))
            release(last)
            before, n = n, rest.count()
        if n:
            kept += settled(rest, s.near_threshold)
    ids = kept[0]
    for k in kept[1:]:
        ids = ids.unionByName(k)
    out = df.join(ids.withColumnRenamed("id", order), order, "left_semi")
    return (out.dropDuplicates(["_id"]) if shared_ids else out).drop("_id")


def settled(rest: DataFrame, least: float) -> list[DataFrame]:
    """Tables of the ids kept of (id, key, words) by near_dedup's rule, for any number of kept rows in a key.

    Of equal word sets the first counts. Two similar sets share one of their rarest words (prefix filter: as many as may
    differ, and one more). A row that is the first at each of its rare words has no similar row before it: it is kept, and
    the rows that meet it there and are similar go, so large groups of copies go without pairs. When that settles less
    than a tenth, the similar pairs among the rows left are formed, and their ids are settled in order: a row is
    kept when none before it that is similar is left, and those similar to it go.
    """
    from .storage import stored

    rows = stored(rest.groupBy("key", F.array_sort("words").alias("words")).agg(F.min("id").alias("id")))
    each = rows.select("id", "key", F.explode("words").alias("w"))
    order = each.join(each.groupBy("w").agg(F.count(F.lit(1)).alias("f")), "w").groupBy("id", "key").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("o"))
    size = F.size("o")
    rare = order.select("id", "key", size.alias("size"), F.explode(F.slice("o", F.lit(1), (size - F.ceil(size * least - 1e-9) + 1).cast("int"))).alias("x"))
    rare = stored(rare.select("id", "key", "size", F.col("x.w").alias("w")))

    # a bit of 1,024 for each word: words whose bit the other set lacks are not in it, which bounds what both share
    one = lambda k: F.aggregate(F.filter("words", lambda w: F.pmod(w, F.lit(SIGNS)) == k), F.lit(0).cast("long"), lambda a, w: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(w / SIGNS), F.lit(64)).cast("int"))))
    signs = stored(rows.select("id", F.size("words").alias("n"), F.transform(F.sequence(F.lit(0), F.lit(SIGNS - 1)), lambda k: one(k)).alias("s")))

    def similar(pairs):
        """(a, b) of the pairs that are similar; their words meet only where signs and sizes allow it."""
        a, b = (signs.select(F.col("id").alias(c), F.col("n").alias(f"{c}n"), F.col("s").alias(f"{c}s")) for c in "ab")
        lacks = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda t, n: t + n)
        both = F.least(F.col("an") - lacks("as", "bs"), F.col("bn") - lacks("bs", "as"))
        near = pairs.distinct().join(a, "a").join(b, "b").where(both >= (F.col("an") + F.col("bn") - both) * least - 1e-9).select("a", "b")
        a, b = (rows.select(F.col("id").alias(c), F.col("words").alias(f"{c}w")) for c in "ab")
        return near.join(a, "a").join(b, "b").where(likeness("aw", "bw") >= least).select("a", "b")

    kept, n = [], rows.count()
    ids = rows.select("id")
    while True:
        head = stored(rare.groupBy("key", "w").agg(F.min("id").alias("a")))
        met = rare.join(head, ["key", "w"])
        lead = stored(met.groupBy("id").agg(F.max("a").alias("last"), F.min("a").alias("first")).where("last = id AND first = id").select("id"))
        gone = similar(met.where("a < id").join(lead.select(F.col("id").alias("a")), "a").select("a", F.col("id").alias("b"))).select(F.col("b").alias("id"))
        # rows without words share none
        lead = stored(lead.unionByName(ids.join(rare.select("id").distinct(), "id", "left_anti")))
        kept.append(lead)
        ids = stored(ids.join(gone.unionByName(lead).distinct(), "id", "left_anti"))
        rare = stored(rare.join(ids, "id", "left_semi"))
        before, n = n, ids.count()
        if not n:
            return kept
        if n > 0.9 * before:
            break
    x, y = rare.select("key", "w", F.col("id").alias("a"), F.col("size").alias("m")), rare.select("key", "w", F.col("id").alias("b"), F.col("size").alias("n"))
    links = stored(similar(x.join(y, ["key", "w"]).where((F.col("a") < F.col("b")) & (F.least("m", "n") >= F.greatest("m", "n") * least - 1e-9)).select("a", "b")))
    while not links.isEmpty():
        top = stored(ids.join(links.select(F.col("b").alias("id")), "id", "left_anti"))
        kept.append(top)
        gone = links.join(top.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))
        ids = stored(ids.join(gone.unionByName(top).distinct(), "id", "left_anti"))
        links = stored(links.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"))
    return [*kept, ids]


def stage_counts(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row: rows that came in, were cleaned, were distinct; the rejection rate (0 for no rows)."""
    c = cleaned(df.select("text"), s).select(F.col("text").alias("t"))
    out = c.agg(F.count(F.lit(1)).alias("n_input"), F.count("t").alias("n_clean"), F.count_distinct("t").alias("n_final"))
    return out.withColumn("rejection_rate", F.when(F.col("n_input") > 0, 1 - F.col("n_final") / F.col("n_input")).otherwise(0.0))


def structured(df: DataFrame, source) -> DataFrame:
    """{text, meta: {source}} rows, as the corpus files hold them."""
    return df.select("text", F.struct(source.alias("source")).alias("meta"))


def run(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, text: cleaned, normalised, without exact and near copies."""
    return near_dedup(exact_dedup(cleaned(df, s).select("doc_id", "text").where("text IS NOT NULL")), s)


def cleaned(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """df with text in compatible composition (NFKC), cleaned and normalised; null where it does not pass.

    Each step is held: a text is stripped once, however often it is tested, and a filter on the result does not work it out again.
    """
    stripped = held(composed(df, form="NFKC"), "text", strip_markup(F.col("text")))
    return held(stripped, "text", F.when(passes(F.col("text"), s), normalise(F.col("text")))).select(*df.columns)


def run_file(spark: SparkSession, path: str, out: str, s: Settings = Settings(), source: str = "corpus") -> DataFrame:
    """Runs over a text file of one sentence a line, writes {text, meta: {source}} lines of JSON to `out`, and gives the
    counts. Lines are numbered as they are read."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))
    from .storage import stored

    lines = stored(lines)
    structured(run(lines, s).orderBy("doc_id"), F.lit(source)).write.json(out)
    return stage_counts(lines, s)


# ---- validation -------------------------------------------------------------------------------------------------------
def line_codes(line, s: Settings = Settings()):
    """Codes of one JSON line: errors first. Blank lines give null."""
    parsed = F.try_parse_json(line)
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.text", "variant"))
    text = F.get_json_object(line, "$.text")
    return F.when(F.trim(line) == "", F.lit(None).cast("array<string>")).when(parsed.isNull(), F.array(F.lit("INVALID_JSON"))).when(kind.isNull() | (kind == "VOID"), F.array(F.lit("MISSING_TEXT"))).when(kind != "STRING", F.array(F.lit("WRONG_TYPE"))).otherwise(text_codes(text, s))


def text_codes(text, s: Settings = Settings()):
    """Codes of a text: EMPTY_TEXT, NULL_BYTE, TOO_SHORT, TOO_LONG, CONTAINS_URL, CONTAINS_MARKUP, CONTAINS_TABLE, OUT_OF_BMP."""
    n = F.size(word_list(text))
    cases = [(F.contains(text, F.lit("\x00")), "NULL_BYTE"), (n < s.min_tokens, "TOO_SHORT"), (n > s.max_tokens, "TOO_LONG"), (text.rlike(URL), "CONTAINS_URL"),
             (text.rlike(r"<[A-Za-z/][^<>]*>|\[\[|\{\{"), "CONTAINS_MARKUP"), (text.rlike(r"\|[^|\n]*\|"), "CONTAINS_TABLE"), (text.rlike(r"[\x{10000}-\x{10FFFF}]"), "OUT_OF_BMP")]
    found = F.filter(F.array(*[F.when(c, k) for c, k in cases]), lambda x: x.isNotNull())
    return F.when(F.trim(text) == "", F.array(F.lit("EMPTY_TEXT"))).otherwise(found)


ERRORS = ["INVALID_JSON", "MISSING_TEXT", "WRONG_TYPE", "EMPTY_TEXT", "NULL_BYTE"]
NOISE = ["CONTAINS_URL", "CONTAINS_MARKUP", "CONTAINS_TABLE", "OUT_OF_BMP"]


def quality(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row from (text, codes): structure, noise, diversity, length and total from 0 to 100, grade and readiness.

    structure: share without errors; noise: share without noise codes; diversity: share of distinct texts; length:
    share without length codes; total weighs them 0.3, 0.25, 0.25, 0.2. Grades: 90, 75 and 60 up.
    """
    errors = ERRORS + (["TOO_SHORT", "TOO_LONG"] if s.strict else [])
    hit = lambda names: F.arrays_overlap("codes", F.array(*[F.lit(x) for x in names]))
    r = rows.where(F.col("codes").isNotNull())
    a = r.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit(errors)).alias("bad"), F.count_if(hit(NOISE)).alias("noisy"), F.count_if(hit(["TOO_SHORT", "TOO_LONG"])).alias("off"), F.count_distinct(F.lower(F.trim("text"))).alias("different"), F.count("text").alias("texts"))
    part = lambda bad: F.when(F.col("n") > 0, 100.0 * (1 - bad / F.col("n"))).otherwise(100.0)
    a = a.select("n", part(F.col("bad")).alias("structure"), part(F.col("noisy")).alias("noise"), F.when(F.col("texts") > 0, 100.0 * F.col("different") / F.col("texts")).otherwise(100.0).alias("diversity"), part(F.col("off")).alias("length"))
    a = a.withColumn("total", 0.3 * F.col("structure") + 0.25 * F.col("noise") + 0.25 * F.col("diversity") + 0.2 * F.col("length"))
    return a.withColumn("grade", grade(F.col("total"))).withColumn("ready", (F.col("total") >= 60) & (F.col("structure") >= 70))


def grade(total):
    return F.when(total >= 90, "Excellent").when(total >= 75, "Good").when(total >= 60, "Fair").otherwise("Poor")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of a text file."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def validate_lines(lines: DataFrame, s: Settings = Settings()) -> DataFrame:
    return lines.select(F.get_json_object("line", "$.text").alias("text"), line_codes(F.col("line"), s).alias("codes")).where(F.col("codes").isNotNull())


def dataset_codes(rows: DataFrame, max_dup_rate: float = 0.20, max_dom_rate: float = 0.50) -> DataFrame:
    """One row with the codes of the whole: HIGH_DUPLICATE_RATE, LOW_DIVERSITY (one first word in too many texts)."""
    t = rows.where(F.col("text").isNotNull()).select(F.lower(F.trim("text")).alias("t"))
    dup = t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("d"))
    top = t.groupBy(F.split_part("t", F.lit(" "), F.lit(1)).alias("w")).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("top"))
    j = dup.crossJoin(top)  # one row each
    rate, dom = F.when(F.col("n") > 0, 1 - F.col("d") / F.col("n")).otherwise(0.0), F.when(F.col("n") > 0, F.col("top") / F.col("n")).otherwise(0.0)
    codes = F.filter(F.array(F.when(rate > max_dup_rate, "HIGH_DUPLICATE_RATE"), F.when(dom > max_dom_rate, "LOW_DIVERSITY")), lambda x: x.isNotNull())
    return j.select(rate.alias("dup_rate"), dom.alias("dom_rate"), codes.alias("codes"))
