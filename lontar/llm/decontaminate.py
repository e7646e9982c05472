"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. Of each WINDOW = 10 consecutive words
the 5-word gram with the least hash (the first, if equal) is kept, for documents and benchmark items alike; a window
that both share keeps the same gram at the same place in both, so the join on kept grams finds every shared window.
Each match is extended: the document's words around the gram are held against the window's, and a window that is
equal marks its ten words as hit. An item of 1 to 9 words is a window of its own, matched whole.

Words are compared by 64-bit hashes of them. Null text has no words. Rows that repeat a doc_id or an item_id count
each for itself (an item_id is listed once). With no items nothing is hit. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Up to so many windows of items (about 150 bytes each), and as many names of items with them, are broadcast; more are joined by
#: a shuffle in which grams that many documents have are dealt in pieces.
SMALL = 1_000_000


def words_of(text):
    t = F.coalesce(text, F.lit(""))
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    # lower() has a fast way for ASCII, but also changes other letters
    t = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, upper, low))
    return F.array_remove(F.split(t, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _at(a, i):
    return F.get(a, i)


def _with_grams(df: DataFrame) -> DataFrame:
    """Adds h (word hashes), n, and g (hash of each gram of 5 words)."""
    df = df.withColumn("h", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))).withColumn("n", F.size("h"))
    g = F.transform(F.sequence(F.lit(0), F.col("n") - GRAM), lambda i: F.xxhash64(*[_at(F.col("h"), i + j) for j in range(GRAM)]))
    return df.withColumn("g", F.when(F.col("n") >= WINDOW, g).otherwise(F.array().cast("array<bigint>")))


def _kept():
    """Of each window: its start, the place of its kept gram."""
    def pick(i):
        at = [_at(F.col("g"), i + j) for j in range(SPAN)]
        return F.array_position(F.array(*at), F.array_min(F.array(*at))).cast("int") - 1 + i

    return F.when(F.col("n") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), pick)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame) -> DataFrame:
    """(hash, off, len, words, items): each distinct window of items, its kept gram and the items that have it."""
    from .common import stored

    base = _with_grams(items.select(F.col("item_id").cast("string").alias("item"), "text")).withColumn("p", _kept()).drop("text")
    base = stored(base)  # else filters on n repeat all of its expressions
    long = base.where(F.col("n") >= WINDOW).select("item", "h", "g", F.posexplode("p").alias("i", "p"))
    long = long.select("item", _at(F.col("g"), F.col("p")).alias("hash"), (F.col("p") - F.col("i")).alias("off"), F.lit(WINDOW).alias("len"), F.slice("h", F.col("i") + 1, WINDOW).alias("words"))
    short = base.where((F.col("n") >= 1) & (F.col("n") < WINDOW))
    short = short.select("item", F.xxhash64(F.concat(F.array(F.col("n").cast("bigint")), "h")).alias("hash"), F.lit(0).alias("off"), F.col("n").alias("len"), F.col("h").alias("words"))
    return long.unionByName(short).groupBy("hash", "off", "len", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each row of docs: rid, doc_id, n_words, spans (array of start and length of hit windows), items."""
    from .common import split_join, stored

    wins = stored(item_windows(items))
    size = wins.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("k")).first()
    small = size.n <= SMALL and size.k <= SMALL
    lens = sorted(r[0] for r in wins.where(F.col("len") < WINDOW).select("len").distinct().collect())  # nine at most
    d = _with_grams(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")).drop("text")
    near = lambda p, size: F.slice(F.col("h"), F.greatest(p - SPAN + 1, F.lit(0)) + 1, size)
    row = lambda hash, p, n, words: F.struct(hash.alias("hash"), p.alias("p"), n.alias("len"), words.alias("near"))
    found = F.transform(F.array_distinct(_kept()), lambda p: row(_at(F.col("g"), p), p, F.lit(WINDOW), near(p, SPAN - 1 + WINDOW)))
    parts = [F.array(row(F.lit(None).cast("bigint"), F.lit(-1), F.col("n"), F.array().cast("array<bigint>"))), found]
    def short(k):
        whole = lambda p: F.slice("h", p + 1, k)
        places = F.transform(F.sequence(F.lit(0), F.col("n") - k), lambda p: row(F.xxhash64(F.concat(F.array(F.lit(k).cast("bigint")), whole(p))), p, F.lit(k), whole(p)))
        return F.coalesce(F.when(F.col("n") >= k, places), F.slice(found, 1, 0))

    parts += [short(k) for k in lens]
    e = d.select("rid", "doc_id", F.explode(F.concat(*parts)).alias("e")).select("rid", "doc_id", "e.*")
    w = wins.select(F.col("hash").alias("w_hash"), "off", F.col("len").alias("w_len"), "words", "items")
    start = F.col("p") - F.col("off")
    base = F.when(F.col("w_len") < WINDOW, F.col("p")).otherwise(F.greatest(F.col("p") - SPAN + 1, F.lit(0)))
    same = (F.col("hash") == F.col("w_hash")) & (F.col("len") == F.col("w_len"))
    if small:
        m = e.join(F.broadcast(w), same, "left").where(F.col("p").eqNullSafe(-1) | F.col("w_hash").isNotNull())
    else:
        e = stored(e)
        counted = e.where(F.col("p") >= 0).groupBy("hash").agg(F.count(F.lit(1)).alias("met"))
        of_hash = w.groupBy(F.col("w_hash").alias("hash")).agg(F.collect_list(F.struct("w_hash", "off", "w_len", "words", "items")).alias("w")).join(counted, "hash")
        met = split_join(e.where(F.col("p") >= 0), of_hash, "hash", "met", ("rid", "p")).withColumn("w", F.explode("w")).select(*e.columns, "w.*").where(same)
        m = met.unionByName(e.where(F.col("p") == -1), allowMissingColumns=True)
    equal = F.when(start >= 0, F.slice("near", F.greatest(start - base, F.lit(0)) + 1, F.col("w_len")) == F.col("words"))
    m = m.where((F.col("p") == -1) | equal)
    mark = F.when(F.col("p") >= 0, F.struct(start.alias("start"), F.col("w_len").alias("len")))
    out = m.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max(F.when(F.col("p") == -1, F.col("len"))).alias("n_words"),
                               F.collect_set(mark).alias("spans"), F.collect_set(F.when(F.col("p") >= 0, F.col("items"))).alias("items"))
    return out.withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    h = hits(docs, items)
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    return h.select("doc_id", F.col("n_words").cast("long").alias("n_words"), hit.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that share a window with an item: all columns of the rows kept."""
    from .common import row_keys

    whole = row_keys(docs.select("doc_id", "text", F.struct("*").alias("_row")), "doc_id", "text", "_row")
    bad = hits(whole.select(F.col("_key").alias("doc_id"), "text"), items).where(F.size("spans") > 0).select(F.col("doc_id").alias("_key")).distinct()
    return whole.join(bad, "_key", "left_anti").select("_row.*")


SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SQL_PARTS = """
iw AS (SELECT item_id, """ + SQL_WORDS + """ AS w FROM benchmark),
il AS (SELECT item_id, w, least(10, len(w)) AS k FROM iw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, list_slice(w, i, i + k - 1) AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM il)),
dw AS (SELECT row_number() OVER () AS rid, doc_id, """ + SQL_WORDS + """ AS w FROM {docs}),
ks AS (SELECT DISTINCT k FROM wins),
dwin AS (SELECT rid, i, k, list_slice(w, i, i + k - 1) AS win FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
found AS (SELECT rid, i, d.k, item_id FROM dwin d JOIN wins USING (k, win)),
marks AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM found) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid)
"""
SQL = f"""WITH {SQL_PARTS.format(docs='documents')}
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN marks USING (rid) LEFT JOIN its USING (rid)"""
