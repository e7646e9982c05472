"""Column expressions on text: normalising, segmenting, sentence splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUNCTUATION = r'[.,!?;:"()\[\]{}]'


def normalise(c: Column) -> Column:
    """Typographic quotes to ASCII, white space runs to one space, trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.translate(c, "’‘“”", "''\"\""), r"(?U)\s+", " "))


def composed(df: DataFrame, name: str = "text", form: str = "NFC") -> DataFrame:
    """A normal form (NFC, NFKC) of a column, in one pass; only texts with other than ASCII leave the JVM, and only those that change come back. Null stays null."""
    import unicodedata

    import pandas as pd

    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None or unicodedata.is_normalized(form, x) else unicodedata.normalize(form, x))

    normal.__annotations__ = {"s": pd.Series, "return": pd.Series}
    t = F.col(name)
    return df.withColumn(name, F.coalesce(F.pandas_udf(normal, "string")(F.when(F.octet_length(t) > F.char_length(t), t)), t))


def segments(c: Column) -> Column:
    """Words of a normalised text: punctuation is space; a-b stays whole; else letters beyond ASCII and signs go."""
    words = F.split(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), PUNCTUATION, " ")), " +")
    kept = F.transform(words, lambda w: F.when(w.rlike(r"(?U)^\w+-\w+$"), w).otherwise(F.regexp_replace(w, r"[^a-zA-Z0-9\-']", "")))
    return F.filter(kept, lambda w: w != "")


def sentences(c: Column) -> Column:
    """Sentences of a text: split behind . ! ? and at line ends; none is empty."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?]+[ \t\r]+|\n+"), lambda s: F.trim(s)), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Lower-cased words of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)


def in_list(c: Column, words) -> Column:
    return F.coalesce(c.isin(list(words)), F.lit(False))


def chosen(c: Column, pairs: dict, default=None) -> Column:
    """A look-up in a small fixed table."""
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(m, c), F.lit(default)) if default is not None else F.try_element_at(m, c)
