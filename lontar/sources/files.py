"""Files of labelled lines and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_labelled(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(text, label, source) of lines of JSON {text, label, source}; lines that are no such object are left out; most: so many at most."""
    lines = spark.read.text(path)
    e = F.from_json("value", "struct<text:string,label:string,source:string>")
    rows = lines.select(e.alias("e")).select("e.text", F.expr("try_cast(e.label AS int)").alias("label"), F.coalesce("e.source", F.lit("")).alias("source"))
    rows = rows.where("text IS NOT NULL AND label IS NOT NULL")
    return rows.limit(most) if most else rows


def write_json(df: DataFrame, path: str) -> None:
    """A line of JSON for each row; nested columns stay nested."""
    df.write.option("ignoreNullFields", "false").json(path)
