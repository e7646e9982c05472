"""What an analysis says, in the forms that callers ask for: by dimension, by token, as text, as JSON, and a hook for more.

Input columns are those of checks.analyse, checks.spans and semantics.understand. All of it stays in the row.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..plans import rules as R
from . import checks
from .storage import held

#: The energies of a sentence do not change between rounds, so three rounds show that they are settled.
ROUNDS = 3


def metadata(df: DataFrame) -> DataFrame:
    """Adds n_morfem, n_edge, avg_degree, n_iterasi."""
    n, e = F.size("tokens"), F.size("edges")
    return df.withColumn("n_morfem", n).withColumn("n_edge", e).withColumn("avg_degree", F.when(n > 0, 2.0 * e / n).otherwise(0.0)).withColumn("n_iterasi", F.when(n > 0, F.lit(ROUNDS)).otherwise(0))


def weighted(df: DataFrame) -> DataFrame:
    """Adds tegangan: for each edge's check the weighted sum of its five tensions, 1 at most."""
    one = lambda c: F.least(F.lit(1.0), sum((c[d] * w for d, w in R.WEIGHTS.items()), F.lit(0.0)))
    return df.withColumn("tegangan", F.transform("checks", lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"), c["rel"].alias("rel"), one(c).alias("bobot"))))


def of_dimension(df: DataFrame, name: str, source: str = "pelanggaran") -> DataFrame:
    """df with the violations (or spans) of one dimension."""
    if name not in R.DIMENSIONS:
        raise ValueError(name)
    return df.withColumn(source, F.filter(source, lambda v: v["dimensi"] == name))


def problem_tokens(df: DataFrame) -> DataFrame:
    """Adds token_bermasalah: the words of the spans, each once, in order."""
    return df.withColumn("token_bermasalah", F.array_distinct(F.transform("spans", lambda s: s["token"])))


def weakest(df: DataFrame) -> DataFrame:
    """Adds terlemah (dimension) and nilai_terlemah: the least satisfaction, the first of equals."""
    low = F.array_min(F.array(*[F.struct(F.col(f"kepuasan.{d}").alias("v"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(R.DIMENSIONS)]))
    df = held(df, "_low", low)
    return df.withColumn("terlemah", F.col("_low.d")).withColumn("nilai_terlemah", F.col("_low.v")).drop("_low")


def token_states(df: DataFrame) -> DataFrame:
    """Adds keadaan: each token with the violations that name its root, in order."""
    hits = lambda t: F.filter("pelanggaran", lambda v: F.array_contains(v["tokens"], t["root"]))
    return df.withColumn("keadaan", F.transform("tokens", lambda t: F.struct(t["idx"].alias("idx"), t["teks"].alias("teks"), t["root"].alias("root"), t["kelas"].alias("kelas"), t["peran"].alias("peran"), hits(t).alias("pelanggaran"))))


def explained(df: DataFrame) -> DataFrame:
    """Adds penjelasan: the result as lines of text."""
    df = weakest(df)
    told = F.transform("pelanggaran", lambda v: F.format_string("  [%s] %.2f: %s", v["dimensi"], v["severitas"], F.array_join(v["tokens"], " ")))
    places = F.transform("spans", lambda s: F.format_string("  %d-%d '%s' (%s, %.2f)", s["mulai"], s["akhir"], s["token"], s["dimensi"], s["severitas"]))
    rows = [F.concat(F.lit("Kalimat: "), F.coalesce("text", F.lit(""))), F.col("ringkasan"), F.concat(F.lit("Register: "), F.col("register")),
            F.format_string("Kelengkapan: %.0f%%", F.col("lengkap") * 100), F.when(F.col("nilai_terlemah") < 0.8, F.format_string("Terlemah: %s (%.2f)", "terlemah", "nilai_terlemah")),
            F.when(F.size("pelanggaran") > 0, F.concat(F.lit("Pelanggaran:\n"), F.array_join(told, "\n"))), F.when(F.size("spans") > 0, F.concat(F.lit("Tempat:\n"), F.array_join(places, "\n"))),
            F.when(F.col("anomali"), F.lit("Struktur relasi tidak koheren"))]
    return df.withColumn("penjelasan", F.concat_ws("\n", *rows))


def knowledge(df: DataFrame) -> DataFrame:
    """Adds the parts of an understood sentence: frame_nama, frame_skor, agen, aksi, pasien, slot_kosong, n_inferensi, relasi (counts)."""
    f = F.get("frames", 0)
    counts = F.map_from_entries(F.transform(F.array_distinct(F.transform("inferensi", lambda x: x["relasi"])), lambda r: F.struct(r.alias("r"), F.size(F.filter("inferensi", lambda x: x["relasi"] == r)).alias("n"))))
    return (df.withColumn("frame_nama", f["nama"]).withColumn("frame_skor", F.coalesce(f["skor"], F.lit(0.0))).withColumn("agen", F.col("prop.AGEN.nilai")).withColumn("aksi", F.col("prop.aksi"))
            .withColumn("pasien", F.col("prop.PASIEN.nilai")).withColumn("slot_kosong", F.coalesce(f["kosong"], F.array().cast("array<string>"))).withColumn("n_inferensi", F.size("inferensi")).withColumn("relasi", counts))


def as_json(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """Adds a column with the given ones as a JSON object."""
    return df.withColumn(name, F.to_json(F.struct(*columns)))


def knowledge_json(df: DataFrame) -> DataFrame:
    """Adds pengetahuan: proposition, frame, open slots, inferences and understanding as JSON."""
    from .semantics import rendered

    d = knowledge(df).withColumn("proposisi", rendered(F.col("prop")))
    return as_json(d, "pengetahuan", ["proposisi", "frame_nama", "frame_skor", "slot_kosong", "pemahaman", "inferensi"])


# ---- objects and morphisms -----------------------------------------------------------------------------------------------
def objects(df: DataFrame, key: list[str]) -> DataFrame:
    """(key..., idx, root, kelas, domain): a sentence's typed objects."""
    return df.select(*key, F.explode("tokens").alias("t")).select(*key, "t.idx", "t.root", "t.kelas", "t.domain")


def morphisms(df: DataFrame, key: list[str]) -> DataFrame:
    """(key..., jenis, i, j, dari, ke, valid): identities, and within two words adjective to noun, subject to verb, verb to object.

    dari and ke are (kelas, domain); a verb's morphism ends in a clause, and an adjective's is invalid where the domains differ.
    """
    pair = F.transform(checks._pairs(F.size("tokens"), 2), lambda p: F.struct(F.get("tokens", p["i"]).alias("a"), F.get("tokens", p["j"]).alias("b")))
    kind = lambda p: F.when((p["a"]["kelas"] == "Adj") & p["b"]["kelas"].isin(checks.NOUNS), "modifikasi").when((p["a"]["peran"] == "S") & (p["b"]["peran"] == "P"), "subjek").when((p["a"]["peran"] == "P") & (p["b"]["peran"] == "O"), "objek")
    ends = lambda t: F.struct(t["kelas"].alias("kelas"), t["domain"].alias("domain"))
    clause = F.struct(F.lit("klausa").alias("kelas"), F.lit(None).cast("string").alias("domain"))
    same = F.transform("tokens", lambda t: F.struct(F.lit("identitas").alias("jenis"), t["idx"].alias("i"), t["idx"].alias("j"), ends(t).alias("dari"), ends(t).alias("ke"), F.lit(True).alias("valid")))
    differ = lambda p: F.coalesce(p["a"]["domain"] != p["b"]["domain"], F.lit(False))
    made = F.transform(F.filter(pair, lambda p: kind(p).isNotNull()), lambda p: F.struct(kind(p).alias("jenis"), p["a"]["idx"].alias("i"), p["b"]["idx"].alias("j"), ends(p["a"]).alias("dari"),
                       F.when(kind(p) == "modifikasi", ends(p["b"])).otherwise(clause).alias("ke"), ((kind(p) != "modifikasi") | ~differ(p)).alias("valid")))
    return df.select(*key, F.explode(F.concat(same, made)).alias("m")).select(*key, "m.*")


def composed(m: DataFrame, key: list[str]) -> DataFrame:
    """(key..., f_i, f_j, g_i, g_j, dari, ke, valid): g after f, where f's end and g's start are one (class, domain)."""
    f = m.where("jenis <> 'identitas'").select(*key, F.col("i").alias("f_i"), F.col("j").alias("f_j"), "dari", F.col("ke").alias("_m"), F.col("valid").alias("_f"))
    g = m.where("jenis <> 'identitas'").select(*[F.col(k).alias(f"_{k}") for k in key], F.col("i").alias("g_i"), F.col("j").alias("g_j"), F.col("dari").alias("_d"), "ke", F.col("valid").alias("_g"))
    on = F.col("_m.kelas").eqNullSafe(F.col("_d.kelas")) & F.col("_m.domain").eqNullSafe(F.col("_d.domain"))
    for k in key:
        on = on & (F.col(k) == F.col(f"_{k}"))
    return f.join(g, on).select(*key, "f_i", "f_j", "g_i", "g_j", "dari", "ke", (F.col("_f") & F.col("_g")).alias("valid"))


# ---- topology -----------------------------------------------------------------------------------------------------------
def adjacency(df: DataFrame, key: list[str], config: Config | None = None) -> DataFrame:
    """(key..., i, j, bobot): pairs of tokens within the threshold, and how near they are (1 - distance / threshold)."""
    from .homology import distances

    thr = float((config or Config()).threshold)
    g = distances(df).select(*key, F.explode(F.filter("gaps", lambda x: x["d"] <= thr)).alias("g"))
    return g.select(*key, "g.i", "g.j", (1 - F.col("g.d") / thr).alias("bobot"))


def barcode_summary(df: DataFrame) -> DataFrame:
    """Adds n_batang, n_abadi, terlama (the longest that ends), rata_rata (of those that end) of a sentence's bars."""
    over = F.filter("bars", lambda b: b["death"] < float("inf"))
    life = F.transform(over, lambda b: b["death"] - b["birth"])
    return df.withColumn("n_batang", F.size("bars")).withColumn("n_abadi", F.size("bars") - F.size(over)).withColumn("terlama", F.coalesce(F.array_max(life), F.lit(0.0))).withColumn(
        "rata_rata", F.when(F.size(over) > 0, F.aggregate(life, F.lit(0.0), lambda a, x: a + x) / F.size(over)).otherwise(0.0))


# ---- settings and hooks ---------------------------------------------------------------------------------------------------
def info(lexicon: DataFrame, config: Config | None = None) -> DataFrame:
    """One row: the settings in use and the lexicon's size."""
    c = config or Config()
    return lexicon.agg(F.count(F.lit(1)).alias("n_kata"), F.count_distinct("domain").alias("n_domain")).select(
        F.lit(c.name).alias("nama"), F.lit(float(c.threshold)).alias("threshold"), F.lit(len(c.neutral)).alias("n_netral"), F.lit(len(c.incompatible)).alias("n_pengecualian"), "n_kata", "n_domain")


def head(df: DataFrame, name: str, make: Callable, schema: str | None = None) -> DataFrame:
    """df with a user's column. Without schema, make(df) gives an expression; with it, make takes a pandas frame of the
    rows' columns (an Arrow batch at a time) and gives a series of that type."""
    if schema is None:
        return df.withColumn(name, make(df))

    def run(rows: pd.DataFrame) -> pd.Series:
        return make(rows)

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    return df.withColumn(name, F.pandas_udf(run, schema)(F.struct(*df.columns)))
