"""Importance resampling to a target distribution by hashed n-grams, in DataFrame operations only.

A position table holds a row for each word of each document; lead() over a document's positions adds the words that
follow, so each position gives one feature for each order. Features hash to buckets (crc32), buckets are counted in the
corpus and in the target, and a bucket's gain is the logarithm of how much likelier the target is to have it. A
document's weight is the mean gain of its features; a seeded Gumbel deviate added to it makes the highest scores a
sample without replacement in which likelier documents are likelier.

Bucket tables have BUCKETS rows whatever the input's size, so they are broadcast. Words are counted in each task before
they are shuffled; a document's features are summed where it is read when the order is 1, and its positions are
shuffled by document (one row's text at most) when it is more. Ranks come from sorted ranges.

Null text has no words: weight 0, never drawn. A null doc_id draws with the text "null". Rows that repeat a doc_id count
each for itself; rows of equal score and doc_id are ranked by their number of features. Where documents or target are empty
all counts of that side are 0. Extra columns are ignored (report) or kept (sample). Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lontar.operators.storage import ranked

from .common import same_scan, stored
from .decontaminate import SQL_WORDS, words_of

BUCKETS, ORDERS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"


def positions(docs: DataFrame, *carry: str) -> DataFrame:
    """(carry..., pos, w): a row for each word of text; a row without words keeps one row with nulls."""
    return docs.select(*carry, F.posexplode_outer(words_of(F.col("text"))).alias("pos", "w"))


def features(docs: DataFrame, rid: str, orders: int = ORDERS) -> DataFrame:
    """(rid, doc_id, pos, bucket): the bucket of each run of 1 to `orders` consecutive words; null for a row without words."""
    p = positions(docs, rid, "doc_id")
    if orders == 1:
        runs = p.withColumn("run", F.col("w"))
    else:
        w = Window.partitionBy(rid).orderBy("pos")
        p = p.select("*", *[F.lead("w", k).over(w).alias(f"w{k}") for k in range(1, orders)])
        each = [F.col("w")]
        for k in range(1, orders):  # null once the document ends
            each.append(F.when(F.col(f"w{k}").isNotNull(), F.concat(each[-1], F.lit(" "), F.col(f"w{k}"))))
        p = p.withColumn("run", F.explode(F.array(*each)))
        runs = p.where(F.col("run").isNotNull() | F.col("w").isNull())
    return runs.select(rid, "doc_id", "pos", (F.crc32(F.col("run").cast("binary")) % BUCKETS).cast("int").alias("bucket"))


def counts(docs: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, n) of all features; BUCKETS rows at most."""
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.lit(0).alias("doc_id"), "text")
    return features(rows, "_rid", orders).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(bucket, gain) of each bucket that documents have."""
    s = stored(counts(docs, orders))
    t = counts(target, orders).select(F.col("bucket").alias("b"), F.col("n").alias("t"))
    sums = s.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_s")), t.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    j = s.join(F.broadcast(t), F.col("bucket") == F.col("b"), "left").crossJoin(F.broadcast(sums[0])).crossJoin(F.broadcast(sums[1]))  # one row each
    d = lambda c: c.cast("double")
    ratio = (d(F.coalesce("t", F.lit(0)) + 1) * d(F.col("all_s") + BUCKETS)) / (d(F.col("n") + 1) * d(F.col("all_t") + BUCKETS))
    return j.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain"))


def gumbel(seed: str = SEED):
    """floor(-1000 ln(-ln u)), u in (0, 1) from a digest of the seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def weigh(docs: DataFrame, target: DataFrame, orders: int = ORDERS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row of docs."""
    docs = same_scan(docs.select("doc_id", "text"))
    f = features(docs.withColumn("_rid", F.monotonically_increasing_id()), "_rid", orders)
    g = gains(docs, target, orders).withColumnRenamed("bucket", "_b")
    j = f.join(F.broadcast(g), F.col("bucket") == F.col("_b"), "left")
    # a run of one word begins at each position: positions are words
    sums = j.groupBy("_rid").agg(F.max("doc_id").alias("doc_id"), F.coalesce(F.max("pos") + 1, F.lit(0)).cast("long").alias("n_words"),
                                 F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"))
    n = F.greatest("n_features", F.lit(1))
    sums = sums.withColumn("_n", n).withColumn("weight", F.expr("(_sum - pmod(_sum, _n)) div _n"))
    return sums.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(seed)).alias("score"))


def draw(weighed: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """weighed with rank: 1, 2, 3... of the floor(percent * N / 100) highest scores among the N rows of `least` words, else null."""
    weighed = stored(weighed)
    fit = weighed.where(F.col("n_words") >= least)
    many = fit.count() * percent // 100
    r = ranked(fit, "rank", F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc())
    r = r.withColumn("rank", F.when(F.col("rank") <= many, F.col("rank")))
    return r.unionByName(weighed.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank."""
    return draw(weigh(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, orders: int = ORDERS, least: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """The rows of docs that are drawn, all their columns. Rows are told apart by doc_id and text; of equal rows all go with the first."""
    from .common import row_keys

    whole = row_keys(docs.select("doc_id", "text", F.struct("*").alias("_row")), "doc_id", "text", "_row")
    drawn = draw(weigh(whole.select(F.col("_key").alias("doc_id"), "text"), target, orders, seed), percent, least)
    return whole.join(drawn.where("rank IS NOT NULL").select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_semi").select("_row.*")


#: The same in SQL; crc32 is worked out byte by byte from its table, which the polynomial 0xEDB88320 gives.
SQL = """WITH RECURSIVE
step AS (
  SELECT b, CAST(b AS BIGINT) AS c, 0 AS i FROM range(256) t(b) UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM step WHERE i = 8),
dw AS (SELECT row_number() OVER () AS rid, doc_id, """ + SQL_WORDS + """ AS w FROM documents),
feats AS (SELECT rid, unnest(w) AS f FROM dw),
targets AS (SELECT unnest(""" + SQL_WORDS + """) AS f FROM benchmark),
chars AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM feats UNION SELECT f FROM targets)),
codes AS (SELECT f, list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)) AS bs FROM chars),
buckets AS (SELECT f, xor(list_reduce(bs, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM codes, crc),
s AS (SELECT bucket, count(*) AS s FROM feats JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM targets JOIN buckets USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM feats) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM targets) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT rid, sum(gain) AS total FROM feats JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY rid),
weighed AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, CASE WHEN len(w) > 0 THEN CAST(floor(total::DOUBLE / len(w)) AS BIGINT) ELSE 0 END AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8))::BIGINT AS h FROM dw LEFT JOIN sums USING (rid)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= (SELECT count(*) FROM placed) * 10 // 100 THEN k END AS rank
FROM scored LEFT JOIN placed USING (rid)"""
