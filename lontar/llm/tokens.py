"""Exact token counts of every prefix, by dynamic programming over byte-pair encodings.

A sequence of tokens is the encoding of its text if and only if each two neighbours encode to themselves, and a
prefix of a text has one encoding. So the last token of the encoding of each prefix of a word is the one token that
ends there and is compatible with the last token of what stands before it; its count is one more. Words (the
pre-tokenizer's pieces) are independent, so a text's counts at its words' ends are running sums, and truncation or
budget questions are look-ups: nothing is encoded again.

Made for tokenizers whose last symbol of a word carries an end mark, lower case and NFC, as word_bpe_49k.json; its path
is a parameter. Strings of special tokens inside a text count as one token each, as the library's default. Null is
the empty text: no bytes, no tokens. Repeated rows are counted each for itself; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

LIMIT = 2048
#: Words whose counts a worker keeps.
KEPT = 1_000_000
_SPACES = "\t-\r \x85\xa0  -     　"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Counter(dict):
    """piece -> its number of tokens, worked out on first use."""

    def __init__(self, path: str):
        super().__init__()
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = set(model["vocab"])
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.longest = max(map(len, self.vocab))
        self.letters = byte_letters()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        short = "'s|'t|'re|'ve|'m|'ll|'d|"
        self.ascii = re.compile(short + r"[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall
        self.any = regex.compile(short + rf"[\p{{L}}]+|[\p{{N}}]|[^{_SPACES}\p{{L}}\p{{N}}]+").findall

    def pieces(self, text: str) -> list[str]:
        """The pre-tokenizer's pieces of a text without special strings."""
        if text.isascii():
            return self.ascii(text.lower())
        return self.any(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def symbols(self, piece: str) -> list[str]:
        return list(piece) if piece.isascii() and piece.isprintable() else [self.letters[b] for b in piece.encode()]

    def merge(self, parts: list[str]) -> list[str]:
        """The encoding of a sequence of symbols by merges in order of rank."""
        parts = list(parts)
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 30:
                break
            a, b = parts[at], parts[at + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def split(self, token: str) -> list[str]:
        body = token.removesuffix(self.end) if self.end else token
        s = list(body)
        if body != token:
            s[-1] += self.end
        return s

    def fits(self, a: str, b: str) -> bool:
        """Whether tokens a, b (a may be empty) are the encoding of what they spell."""
        if (r := self.pairs.get((a, b))) is None:
            r = self.merge((self.split(a) if a else []) + self.split(b)) == ([a, b] if a else [b])
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            self.pairs[a, b] = r
        return r

    def prefixes(self, piece: str) -> tuple[list[int], list[int]]:
        """(inner, ended): tokens of each prefix of the piece's symbols, as part of a longer piece and as a whole one."""
        s = self.symbols(piece)
        last, inner, ended = [""], [0], [0]
        for i in range(1, len(s) + 1):
            for mark, counts in (("", inner), (self.end, ended)):
                for j in range(max(0, i - self.longest), i):
                    t = "".join(s[j:i]) + mark
                    if t in self.vocab and self.fits(last[j], t):
                        counts.append(inner[j] + 1)
                        if not mark or not self.end:
                            last.append(t)
                        break
                else:
                    raise ValueError(f"no encoding of {piece[:40]!r}")
        return inner, ended

    def whole(self, piece: str) -> int:
        """The last entry of `ended`, without those before it."""
        s = self.symbols(piece)
        if len(s) > 2000:
            return self.prefixes(piece)[1][-1]
        last, inner, vocab = [""], [0], self.vocab
        n, w = len(s), "".join(s)
        for i in range(1, n + 1):
            mark = self.end if i == n else ""
            for j in range(max(0, i - self.longest), i):
                t = w[j:i] + mark
                if t in vocab and self.fits(last[j], t):
                    last.append(t)
                    inner.append(inner[j] + 1)
                    break
            else:
                raise ValueError(f"no encoding of {piece[:40]!r}")
        return inner[n]

    def __missing__(self, piece: str) -> int:
        n = self.whole(piece)
        if len(self) >= KEPT:
            self.clear()
        self[piece] = n
        return n

    def each(self, text: str) -> list[int]:
        """Tokens of each piece (a special string is a piece of one)."""
        if "<|" not in text:
            return list(map(self.__getitem__, self.pieces(text)))
        out, at = [], 0
        for m in [*self.special.finditer(text), None]:
            out += map(self.__getitem__, self.pieces(text[at : m.start() if m else len(text)]))
            if m:
                out.append(1)
                at = m.end()
        return out


def counter(path: str) -> Counter:
    return K.kept(f"tokens {path}", lambda: Counter(path))


def prefixes(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, running: exact tokens of the text up to the end of each of its pieces.

    What a text's prefix costs, and where a budget ends, are look-ups in running."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        c = counter(path)
        for b in batches:
            each = [np.cumsum(c.each(x), dtype=np.int64) if x else np.zeros(0, np.int64) for x in b.column("text").to_pylist()]
            ends = np.zeros(len(each) + 1, np.int32)
            np.cumsum([len(x) for x in each], out=ends[1:])
            running = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *each])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), running], ["doc_id", "n_bytes", "running"])

    base = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return base.mapInArrow(run, f"doc_id {kind}, n_bytes long, running array<long>")


def within(table: DataFrame, budget: int) -> DataFrame:
    """A table of prefixes with n_fit, the pieces that fit in the budget, and fit_tokens, what they cost."""
    fit = F.size(F.filter("running", lambda n: n <= budget))
    return table.withColumn("n_fit", fit.cast("long")).withColumn("fit_tokens", F.coalesce(F.get("running", fit - 1), F.lit(0)).cast("long"))


def count(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; n_fit, fit_tokens: the pieces that a truncation to the limit keeps, and their tokens."""
    t = within(prefixes(docs, path), limit)
    n = F.coalesce(F.try_element_at("running", F.lit(-1)), F.lit(0)).cast("long")
    return t.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), "n_fit", "fit_tokens")
