"""References and loss curves over streams: the batch rules with keyed state.

A document's state is its context of at most five propositions, so it does not grow with the stream; idle documents
are dropped after a timeout. Loss curves keep an average and the last values of each key.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

from ..operators import semantics


def references(understood: DataFrame, idle: str | None = None) -> DataFrame:
    """A stream of understood sentences (doc_id, sent_idx, ...) -> references, as they arrive.

    Sentences of a micro-batch are taken in order of sent_idx. idle: processing time, in milliseconds, after which a
    document's context is dropped.
    """
    e = semantics.entities(understood)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        context = json.loads(state.get[0]) if state.exists else [[], []]
        rows = []
        p = pd.concat(list(frames)).sort_values("sent_idx")
        for i, has, refs, ents in zip(p.sent_idx, p.ada, p.anafor, p.entitas):
            plain = lambda xs: [x.asDict() if hasattr(x, "asDict") else dict(x) for x in xs]
            rows += [(key[0], i, *r) for r in semantics.resolve_step(context, plain(refs), plain(ents), has)]
        state.update((json.dumps(context, default=lambda v: v.item()),))
        if idle:
            state.setTimeoutDuration(int(idle))
        yield pd.DataFrame(rows, columns=["doc_id", "sent_idx", "anafor", "anteseden", "root", "domain", "keyakinan"])

    return e.groupBy("doc_id").applyInPandasWithState(step, semantics.REFERENCE, "konteks string", "append", "ProcessingTimeTimeout" if idle else "NoTimeout")


def controller(losses: DataFrame, key: str, step: str, loss: str, alpha: float = 0.9, recent: int = 10) -> DataFrame:
    """A stream of losses -> key, step, ema and the mean of the last values, with state of `recent` + 1 numbers."""

    def run(k, frames, state):
        ema, last = json.loads(state.get[0]) if state.exists else (None, [])
        rows = []
        p = pd.concat(list(frames)).sort_values(step)
        for s, v in zip(p[step], p[loss]):
            ema = v if ema is None else alpha * ema + (1 - alpha) * v
            last = [*last, float(v)][-recent:]
            rows.append((k[0], s, ema, sum(last) / len(last)))
        state.update((json.dumps([ema, last]),))
        yield pd.DataFrame(rows, columns=[key, step, "ema", "recent"])

    kinds = {f.name: f.dataType.simpleString() for f in losses.schema}
    return losses.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {step} {kinds[step]}, ema double, recent double", "state string", "append", "NoTimeout")


# ---- typed state ---------------------------------------------------------------------------------------------------------
def weights(losses: DataFrame, key: str, step: str) -> DataFrame:
    """A stream of runs' losses (l_<loss>) -> key, step, w_<loss>: training.controlled's rule, with the state of one run.

    The state is five weights, the count of steps and the last ten values of each loss. Steps of a micro-batch are taken in
    order. Needs a state store with column families (RocksDB).
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    from ..operators import training

    names = list(training.LOSS_WEIGHTS)

    class Run(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("run", "n long, weights array<double>, last array<array<double>>")

        def handleInputRows(self, key, rows, timerValues):
            if self.state.exists():
                n, now, last = self.state.get()
                now, last = list(now), [list(x) for x in last]
            else:
                n, now, last = 0, [x[0] for x in training.LOSS_WEIGHTS.values()], [[] for _ in names]
            p = pd.concat(list(rows)).sort_values(step)
            out = []
            for s, *values in p[[step, *[f"l_{x}" for x in names]]].itertuples(index=False):
                n += 1
                last = [[*x, None if pd.isna(v) else float(v)][-training.ADAPT_EVERY :] for x, v in zip(last, values)]
                if n % training.ADAPT_EVERY == 0:
                    seen = [[v for v in x if v is not None] for x in last]
                    now = training.next_weights(now, [sum(x) / len(x) if x else 0.0 for x in seen])
                out.append((key[0], s, *now))
            self.state.update((n, now, last))
            yield pd.DataFrame(out, columns=[kind_key, step, *[f"w_{x}" for x in names]])

        def close(self) -> None:
            pass

    kind_key, kinds = key, {f.name: f.dataType.simpleString() for f in losses.schema}
    schema = f"{key} {kinds[key]}, {step} {kinds[step]}, " + ", ".join(f"w_{x} double" for x in names)
    return losses.groupBy(key).transformWithStateInPandas(Run(), schema, "Append", "None")


def duplicates(texts: DataFrame, order: str, text: str = "text", settings=None, generation: str | None = None, expire_ms: int | None = None) -> DataFrame:
    """A stream of texts -> order, duplicate: whether a kept text of the same beginning that came before is similar.

    The rule is corpus.near_dedup's, row by row: what it keeps is what is no duplicate here, if rows come in order. State is by
    beginning: the word sets kept. generation: a column of the stream; each of its values starts from nothing, so a new value
    is a reset. expire_ms: how long a kept text is remembered (the query then needs processing time). Rows of a micro-batch
    are taken in order; null texts are empty ones. Needs a state store with column families (RocksDB).
    """
    from pyspark.sql import functions as F
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    from ..operators import corpus

    s = settings or corpus.Settings()
    least = s.near_threshold

    class Kept(StatefulProcessor):
        def init(self, handle) -> None:
            self.kept = handle.getListState("kept", "words array<long>", expire_ms)

        def handleInputRows(self, key, rows, timerValues):
            sets, new, out = [set(x[0] if x[0] is not None else []) for x in self.kept.get()], [], []
            p = pd.concat(list(rows)).sort_values("urut")
            for i, words in zip(p["urut"], p["kata"]):
                w = set(int(x) for x in words)
                found = any(1.0 >= least if not (w | k) else len(w & k) / len(w | k) >= least for k in sets)
                if not found:
                    sets.append(w)
                    new.append(([*w],))
                out.append((i, found))
            if new:
                self.kept.appendList(new)
            yield pd.DataFrame(out, columns=[order, "duplicate"])

        def close(self) -> None:
            pass

    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_distinct(F.transform(corpus.word_list(F.lower(t)), lambda w: F.xxhash64(w)))
    born = F.col(generation).cast("string") if generation else F.lit("")
    d = texts.select(F.col(order).alias("urut"), F.xxhash64(born, corpus.near_key(t, s.key_length)).alias("awal"), words.alias("kata"))
    kind = texts.schema[order].dataType.simpleString()
    return d.groupBy("awal").transformWithStateInPandas(Kept(), f"{order} {kind}, duplicate boolean", "Append", "ProcessingTime" if expire_ms else "None")
