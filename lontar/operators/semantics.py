"""Propositions, frames, inferences and references of parsed sentences.

A proposition is a struct column: aksi, domain, one field for each slot, polaritas, modalitas, kelengkapan. Frames and
world rules are small fixed tables, so matching them is a row-local expression over 12 frames and 9 rules.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chosen, in_list
from ..plans import rules as R
from .storage import held

NOMINAL = ["N", "Pron", "N_proper", "N_serapan", "Num"]
SLOT = "struct<nilai:string,root:string,domain:string,idx:int>"


def _slot(t):
    return F.when(t.isNotNull(), F.struct(t["teks"].alias("nilai"), F.lower(t["root"]).alias("root"), t["domain"].alias("domain"), t["idx"].alias("idx")))


def proposition(df: DataFrame) -> DataFrame:
    """Adds prop (null where a sentence has neither a verb nor a nominal)."""
    t = F.col("tokens")
    root = lambda x: F.lower(x["root"])
    text = lambda x: F.lower(x["teks"])
    like_verb = lambda x: F.exists(F.array(*[F.lit(p) for p in R.VERB_PREFIXES]), lambda p: text(x).startswith(p) & (F.char_length(text(x)) > F.char_length(p) + 3))
    verbs = F.filter(t, lambda x: (x["kelas"].isin("V", "V_serapan") | ((x["kelas"] == "?") & like_verb(x))) & ~in_list(root(x), R.MODALS))
    df = held(held(df, "_c", verbs), "_v", F.coalesce(F.get(F.filter("_c", lambda x: x["peran"] == "P"), 0), F.get("_c", 0))).drop("_c")
    v = F.col("_v")
    modal = F.get(F.reverse(F.filter(F.transform(t, lambda x: chosen(root(x), R.MODALS)), lambda m: m.isNotNull())), 0)
    polar = ~F.exists(t, lambda x: in_list(root(x), R.NEGATIONS))
    passive = root(v).startswith("di") | F.exists(v["afiks"], lambda a: a["bentuk"].startswith("di"))
    role = lambda r: F.get(F.filter(t, lambda x: x["peran"] == r), 0)
    agent, patient = F.when(passive, role("O")).otherwise(role("S")), F.when(passive, role("S")).otherwise(role("O"))
    left = F.get(F.reverse(F.filter(t, lambda x: (x["idx"] < v["idx"]) & x["kelas"].isin(NOMINAL))), 0)
    right = F.get(F.filter(t, lambda x: (x["idx"] > v["idx"]) & x["kelas"].isin(NOMINAL) & ~in_list(root(x), R.NEGATIONS)), 0)
    behind = F.filter(F.transform(t, lambda x, i: F.struct(F.when(x["kelas"] == "Prep", chosen(root(x), R.PREPOSITION_SLOTS)).alias("s"), F.get(t, i + 1).alias("t"))), lambda p: p["s"].isNotNull() & p["t"]["kelas"].isin(NOMINAL))
    by_prep = lambda s: F.get(F.filter(F.col("_b"), lambda p: p["s"] == s), 0)["t"]
    df = held(df, "_b", behind)
    slots = {"AGEN": F.coalesce(agent, left), "PASIEN": F.coalesce(patient, right), "TEMA": role("Pel")}
    slots |= {s: by_prep(s) for s in dict.fromkeys(R.PREPOSITION_SLOTS.values())}
    nouns = F.filter(t, lambda x: x["kelas"].isin(NOMINAL))
    adj = F.get(F.filter(t, lambda x: x["kelas"] == "Adj"), 0)
    nominal = {"ATRIBUT": F.get(nouns, 0), "TEMA": F.coalesce(F.get(nouns, 1), adj)}
    empty = F.lit(None).cast(SLOT)
    field = lambda s: F.when(v.isNotNull(), _slot(slots[s]) if s in slots else empty).otherwise(_slot(nominal[s]) if s in nominal else empty).alias(s)
    names = R.SLOTS
    p = F.struct(F.when(v.isNotNull(), root(v)).otherwise("adalah").alias("aksi"), F.when(v.isNotNull(), v["domain"]).otherwise("deskriptif").alias("domain"), *[field(s) for s in names], polar.alias("polaritas"), modal.alias("modalitas"))
    df = held(df, "prop", F.when(v.isNotNull() | (F.size(nouns) > 0), p)).drop("_v", "_b")
    has = lambda *s: F.when(F.coalesce(*[F.col(f"prop.{x}") for x in s]).isNotNull(), 0.25).otherwise(0.0)
    full = 0.25 + has("AGEN") + has("PASIEN", "TEMA") + has("LOKASI", "WAKTU", "TUJUAN", "CARA", "SEBAB")
    return held(df, "prop", F.when(F.col("prop").isNotNull(), F.col("prop").withField("kelengkapan", full)))


def rendered(p):
    """A proposition as text: [modal] TIDAK_AKSI(slot=value, ...)."""
    parts = F.filter(F.array(*[F.when(p[s].isNotNull(), F.concat(F.lit(s.lower() + "="), p[s]["nilai"])) for s in R.SLOTS]), lambda x: x.isNotNull())
    head = F.concat(F.when(p["modalitas"].isNotNull(), F.concat(F.lit("["), p["modalitas"], F.lit("] "))).otherwise(""), F.when(p["polaritas"], "").otherwise("TIDAK_"), F.upper(p["aksi"]))
    return F.when(p.isNotNull(), F.concat(head, F.lit("("), F.concat_ws(", ", parts), F.lit(")")))


def bare(v, prefixes):
    out = v
    for p in reversed(prefixes):
        out = F.when(v.startswith(p) & (F.char_length(v) > len(p) + 2), F.substr(v, F.lit(len(p) + 1))).otherwise(out)
    return out


def frames(df: DataFrame) -> DataFrame:
    """Adds frames: those that score 0.25 or more, best first, three at most: nama, skor, pemicu, cakupan, kosong."""
    df = held(held(df, "_a", F.col("prop.aksi")), "_b", bare(F.col("prop.aksi"), R.FRAME_PREFIXES))
    a, b = F.col("_a"), F.col("_b")
    rows = []
    for i, (name, triggers, slots, domain) in enumerate(R.FRAMES):
        words = F.array(*[F.lit(w) for w in triggers.split()])
        fits = F.exists(words, lambda w: (a == w) | (b == w) | (a.endswith(w) & (F.char_length(a) > F.char_length(w))) | (b.endswith(w) & (F.char_length(b) > F.char_length(w))))
        there = [s.rstrip("*") for s in slots.split()]
        filled = {}
        for kind, options in R.SLOT_TO_FRAME:
            slot = next((o for o in options.split() if o in there), None)
            if slot and slot not in filled:
                filled[slot] = F.col(f"prop.{kind}").isNotNull()
        must = sorted(s[:-1] for s in slots.split() if s.endswith("*"))
        ok = [F.when(filled.get(s, F.lit(False)), F.lit(None).cast("string")).otherwise(s) for s in must]
        open_ = F.filter(F.array(*ok), lambda x: x.isNotNull())
        cover = (len(must) - F.size(open_)) / F.lit(float(len(must)))
        score = F.least(F.lit(1.0), 0.6 * F.when(fits, 1.0).otherwise(0.0) + 0.4 * cover + F.when(F.coalesce(F.col("prop.domain") == domain, F.lit(False)), 0.1).otherwise(0.0))
        rows.append(F.struct(score.alias("skor"), fits.alias("pemicu"), F.lit(-i).alias("urut"), F.lit(name).alias("nama"), cover.alias("cakupan"), open_.alias("kosong")))
    best = F.slice(F.filter(F.reverse(F.array_sort(F.array(*rows))), lambda r: (r["skor"] >= 0.25) & F.col("prop").isNotNull()), 1, 3)
    return held(df, "frames", best).drop("_a", "_b")


def entity_type(value):
    """A known word's type; else PERSONA for a capital letter, ENTITAS for the rest."""
    return F.when(value.isNotNull(), F.coalesce(chosen(F.lower(value), R.ENTITY_TYPES), F.when(value.rlike(r"^\p{Lu}"), "PERSONA"), F.lit("ENTITAS")))


def action_type(verb):
    return F.coalesce(chosen(F.lower(verb), R.ACTION_TYPES), chosen(bare(F.lower(verb), R.ACTION_PREFIXES), R.ACTION_TYPES))


def subtypes(kind: str) -> list[str]:
    """A type and all below it."""
    out, more = [], [kind]
    while more:
        out += more
        more = [t for t, p in R.SUPERTYPES.items() if p in more]
    return out


def subtype_closure(spark) -> DataFrame:
    rows = [(t, k) for k in dict.fromkeys([*R.SUPERTYPES.values(), *R.SUPERTYPES]) for t in subtypes(k)]
    return spark.createDataFrame(rows, "tipe string, supertipe string")


def inferences(df: DataFrame) -> DataFrame:
    """Adds tipe_agen, tipe_pasien, tipe_aksi, inferensi: what the world rules conclude, by priority."""
    df = held(held(held(df, "tipe_agen", entity_type(F.col("prop.AGEN.nilai"))), "tipe_pasien", entity_type(F.col("prop.PASIEN.nilai"))), "tipe_aksi", action_type(F.col("prop.aksi")))
    agent, patient = F.coalesce("prop.AGEN.root", F.lit("agen_tidak_diketahui")), F.coalesce("prop.PASIEN.root", F.lit("pasien_tidak_diketahui"))
    to = F.coalesce("prop.PENERIMA.root", "prop.PASIEN.root", F.lit("penerima_tidak_diketahui"))
    rows = []
    for name, act, ag, pa, says, domain, _ in sorted(R.WORLD_RULES, key=lambda r: -r[6]):
        fits = F.col("prop.polaritas") & (F.col("tipe_aksi") == act)
        fits = fits & F.col("tipe_agen").isin(subtypes(ag)) if ag else fits
        fits = fits & F.col("tipe_pasien").isin(subtypes(pa)) if pa else fits
        sure = F.round(F.col("prop.kelengkapan") * (1.0 if ag else 0.9), 3)
        for s in says:
            text = F.replace(F.replace(F.replace(F.lit(s), F.lit("agen"), agent), F.lit("pasien"), patient), F.lit("penerima"), to)
            part = F.split(text, " ", 3)
            good = fits & (F.size(part) >= 3) & ~F.contains(F.get(part, 0), F.lit("tidak_diketahui")) & ~F.contains(F.get(part, 2), F.lit("tidak_diketahui"))
            rows.append(F.when(good, F.struct(text.alias("pernyataan"), F.get(part, 0).alias("subjek"), F.get(part, 1).alias("relasi"), F.get(part, 2).alias("objek"), F.lit(name).alias("aturan"), sure.alias("keyakinan"), F.lit(domain).alias("domain"))))
    return held(df, "inferensi", F.filter(F.array(*rows), lambda x: x.isNotNull()))


def ask(df: DataFrame, relation: str, subject: str | None = None) -> DataFrame:
    """Inferences with a relation, and of a subject."""
    keys = [c for c in ("doc_id", "sent_idx") if c in df.columns]
    out = df.select(*keys, F.explode("inferensi").alias("x")).select(*keys, "x.*").where(F.col("relasi") == relation)
    return out.where(F.lower("subjek") == subject.lower()) if subject else out


def understanding(df: DataFrame) -> DataFrame:
    """Adds pemahaman, from proposition, frame and inferences."""
    p, f = F.col("prop"), F.get("frames", 0)
    s = F.when(p.isNotNull(), 0.35).otherwise(0.0) + F.when(F.coalesce(F.col("prop.kelengkapan") >= 0.75, F.lit(False)), 0.15).otherwise(0.0)
    s = s + F.when(f.isNotNull(), 0.25).otherwise(0.0) + F.when(F.coalesce(f["cakupan"] >= 1.0, F.lit(False)), 0.10).otherwise(0.0) + F.when(F.size("inferensi") > 0, 0.15).otherwise(0.0)
    return df.withColumn("pemahaman", F.least(F.lit(1.0), s))


def understand(parsed: DataFrame) -> DataFrame:
    return understanding(inferences(frames(proposition(parsed))))


# ---- references between the sentences of a document -----------------------------------------------------------------
WINDOW = 5
REFERENCE = "doc_id long, sent_idx int, anafor string, anteseden string, root string, domain string, keyakinan double"


def entities(understood: DataFrame) -> DataFrame:
    """doc_id, sent_idx, anafor (pronouns and demonstratives of a sentence, in order), entitas (slots, in order)."""
    t = F.col("tokens")
    person = lambda x: in_list(F.lower(x["root"]), [*R.PERSONAL_ONE, *R.PERSONAL_MANY]) | (x["kelas"] == "Pron")
    refs = F.filter(F.transform(t, lambda x: F.when(person(x), F.struct(x["teks"].alias("teks"), F.lit(True).alias("orang"), F.when(in_list(F.lower(x["root"]), R.PERSONAL_ONE), 0.85).otherwise(0.70).alias("yakin")))
                                    .when(in_list(F.lower(x["root"]), R.DEMONSTRATIVES), F.struct(x["teks"].alias("teks"), F.lit(False).alias("orang"), F.lit(0.80).alias("yakin")))), lambda r: r.isNotNull())
    order = ["AGEN", "PASIEN", "TEMA", *[s for s in R.SLOTS if s not in ("AGEN", "PASIEN", "TEMA")]]
    ents = F.filter(F.array(*[F.when(F.col(f"prop.{s}").isNotNull(), F.col(f"prop.{s}").withField("agen", F.lit(s == "AGEN"))) for s in order]), lambda x: x.isNotNull())
    return understood.select("doc_id", "sent_idx", F.col("prop").isNotNull().alias("ada"), refs.alias("anafor"), ents.alias("entitas"))


def resolve_step(context: list, refs: list, ents: list, has: bool) -> list:
    """One sentence: its references against the context, then the context moves on. context: [entities, propositions]."""
    stack, past = context
    out = []
    for r in refs:
        found = next((e for e in reversed(stack) if not r["orang"] or e["domain"] in ("sosial", "hukum") or e["agen"]), None)
        if found:
            out.append((r["teks"], found["nilai"], found["root"], found["domain"], r["yakin"]))
    if has:
        past.append([e["root"] for e in ents])
        stack.extend(ents)
        if len(past) > WINDOW:
            gone = set(past.pop(0))
            stack[:] = [e for e in stack if e["root"] not in gone]
    return out


def references(understood: DataFrame) -> DataFrame:
    """References resolved to the latest fitting entity of the five propositions before, document by document.

    The context's eviction by root is a fold, so it runs on each document's sentences in order; a partition holds
    whole documents and streams them, keeping one document's five-sentence context.
    """
    e = entities(understood).repartition("doc_id").sortWithinPartitions("doc_id", "sent_idx")

    def run(it):
        doc, context = None, [[], []]
        for p in it:
            rows = []
            for d, i, has, refs, ents in zip(p.doc_id, p.sent_idx, p.ada, p.anafor, p.entitas):
                if d != doc:
                    doc, context = d, [[], []]
                rows += [(d, i, *r) for r in resolve_step(context, list(refs), list(ents), has)]
            yield pd.DataFrame(rows, columns=["doc_id", "sent_idx", "anafor", "anteseden", "root", "domain", "keyakinan"])

    return e.mapInPandas(run, REFERENCE)


def latest_before(df: DataFrame, value, keys: list[str], order: list[str], window: int = WINDOW):
    """The last non-null value of the rows before, within a window: references where nothing is evicted."""
    return F.last(value, True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-window, -1))
