"""Connected components of a graph given as an edge table, by alternating large and small stars.

Each round relinks every node to the least node it knows (large star: its larger neighbours; small star: its smaller
ones and itself) until nothing changes; then each node's one neighbour is its component's least node. Least neighbours are
partial minima before their shuffle; where edges meet them, a node of very high degree relies on adaptive execution's split
of skewed joins (spark.sql.adaptive.skewJoin). Each round's edges are written to the shared checkpoint folder, which cuts
the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _star(e: DataFrame, large: bool) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else \
        e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    j = both.join(low, "u")
    if large:
        out = j.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = j.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of its component for each node that has an edge (a, b) and is not the least itself.

    Rounds go on until one changes nothing; each makes edges go to lesser nodes, so they end. A round's table is
    deleted once the next is written.
    """
    spark = edges.sparkSession
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        before, e = e, stored(_star(_star(e, True), False))
        release(spark, before)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
