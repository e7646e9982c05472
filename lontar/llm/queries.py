"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import collocations, decontaminate, lm, mixing, quality, resampling, setjoin, simhash, substrings, syncmers, tokens, toxicity, warc
from .common import table, tune


def _over(make, *names):
    def query(spark, sf_dir):
        tune(spark)
        return make(*[table(spark, sf_dir, n) for n in names])

    return query


def queries() -> dict:
    return {
        "op1_syncmers": _over(syncmers.edit_likeness, "documents"),
        "op2_toxicity": _over(toxicity.report, "documents", "labels"),
        "op3_decontamination": _over(decontaminate.report, "documents", "benchmark"),
        "op4_mixing": _over(mixing.report, "documents"),
        "op5_quality": _over(quality.report, "documents", "labels"),
        "op6_token_counts": _over(tokens.count, "documents"),
        "op7_warc": _over(warc.report, "pages"),
        "op8_lm_scoring": _over(lm.report, "documents"),
        "op9_simhash": _over(simhash.report, "documents"),
        "op10_substring_dedup": _over(substrings.report, "documents"),
        "op11_resampling": _over(resampling.report, "documents", "benchmark"),
        "op12_jaccard_join": _over(setjoin.report, "documents"),
        "op13_collocations": _over(collocations.report, "documents"),
    }


def oracle_sql() -> dict:
    return {"op3_decontamination": decontaminate.SQL, "op4_mixing": mixing.SQL, "op7_warc": warc.SQL, "op10_substring_dedup": substrings.SQL,
            "op11_resampling": resampling.SQL, "op13_collocations": collocations.SQL}
