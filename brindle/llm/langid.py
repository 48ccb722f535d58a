"""Language identification by words first, then ever shorter character n-grams.

A model holds, per language, log frequencies of its words and of character n-grams of each length.  A
text's words are runs of letters, lower-cased.  A known word adds its log frequencies; an unseen word
is covered by the longest known n-grams (with the word's edges marked), falling back length by length.
The language with the largest sum wins (ties: the first in alphabetical order).

The model is fitted on labelled rows and holds every word and n-gram of them.  ``fit_rows`` bounds the
labelled sample and with it the model, the only thing the driver holds; the sample is dealt evenly to the
languages and drawn by a hash of the id; a language with fewer rows is taken whole.

Null texts and texts without letters are ``und`` with score 0, and so is everything when nothing is
labelled.  An empty table gives an empty result; null and repeated ids are rows like others.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import text_chunks

LENGTHS = (4, 3, 2, 1)
WORD = regex.compile(r"[\p{L}\p{M}]+")
CACHE = 500_000
#: How many words a score counts for at most: beyond, the mean decides.
CONFIDENT = 20


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, n, unit, count) of a batch: words as n = 0."""
    for batch in batches:
        tally: dict = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words: dict = {}
            for w in WORD.findall((text or "").lower()):
                words[w] = words.get(w, 0) + 1
            for w, c in words.items():
                k = (lang, 0, w)
                tally[k] = tally.get(k, 0) + c
        grams: dict = {}
        for (lang, _, w), c in tally.items():
            edged = f"<{w}>"
            for n in LENGTHS:
                for i in range(len(edged) - n + 1):
                    k = (lang, n, edged[i : i + n])
                    grams[k] = grams.get(k, 0) + c
        tally |= grams
        if tally:
            langs, ns, units = zip(*tally)
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(ns, pa.int32()), pa.array(units), pa.array(list(tally.values()), pa.int64())], names=["lang", "n", "unit", "c"])


class Model:
    """Log frequencies: ``table[n][unit]`` is an array over ``langs``."""

    def __init__(self, langs: list[str], rows: list[tuple[str, int, str, int]]):
        self.langs = langs
        at = {x: i for i, x in enumerate(langs)}
        counts: dict[int, dict[str, np.ndarray]] = {n: {} for n in (0, *LENGTHS)}
        for lang, n, unit, c in rows:
            counts[n].setdefault(unit, np.zeros(len(langs)))[at[lang]] += c
        self.table = {}
        for n, units in counts.items():
            total = sum(units.values(), np.zeros(len(langs))) + 0.5 * (len(units) + 1)
            self.table[n] = {u: tuple(np.log((c + 0.5) / total)) for u, c in units.items()}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sums = array("d")

    def word(self, w: str) -> tuple[float, ...]:
        """Per language the log frequency of a word, or of the n-grams that cover it."""
        got = self.table[0].get(w)
        if got is not None:
            return got
        edged, out, i, tables = f"<{w}>", (0.0,) * len(self.langs), 0, [(n, self.table[n]) for n in LENGTHS]
        while i < len(edged):
            for n, table in tables:
                got = table.get(edged[i : i + n]) if i + n <= len(edged) else None
                if got is not None:
                    out = tuple(map(add, out, got))
                    i += n
                    break
            else:
                i += 1
        return out

    def predict(self, texts: list[list[str]]) -> list[tuple[str, float]]:
        """Language and score of each text, given as its words."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        missing = set().union(*texts) - self.known.keys()
        if len(self.known) + len(missing) > CACHE:
            self.clear()
            missing = set().union(*texts)
        for w in missing:
            self.known[w] = len(self.known)
            self.sums.extend(self.word(w))
        counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        index = np.fromiter((self.known[w] for words in texts for w in words), dtype=np.int64, count=int(counts.sum()))
        table = np.frombuffer(self.sums, dtype=np.float64).reshape(-1, len(self.langs)) if self.sums else np.zeros((0, len(self.langs)))
        running = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(table[index], axis=0)])
        ends = np.cumsum(counts)
        total = running[ends] - running[ends - counts]
        best = total.argmax(axis=1)
        per = np.minimum(counts, CONFIDENT) / np.maximum(counts, 1)
        score = 1.0 / np.exp((total - total.max(axis=1, keepdims=True)) * per[:, None]).sum(axis=1)
        return [(self.langs[b], float(p)) if n else ("und", 0.0) for b, p, n in zip(best.tolist(), score.tolist(), counts.tolist())]


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = 4000) -> Model:
    """Fit on about ``fit_rows`` rows with a language and a text, as many of each language (50 at least), drawn by hash; all rows of a language that has fewer."""
    some = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = labelled.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("rows"))
    each = counts.agg(F.count("*"), F.sum("rows")).head()
    if (each[1] or 0) > fit_rows:
        most = max(50, math.ceil(fit_rows / each[0]))
        some = some.join(F.broadcast(counts), "lang").where(F.expr(f"pmod(xxhash64(id, 23), 1000000) < {most} * 1000000 / rows"))
    units = some.select("text", "lang").mapInArrow(_counts, "lang string, n int, unit string, c bigint").groupBy("lang", "n", "unit").agg(F.sum("c").alias("c"))
    kept = units.toArrow()
    rows = list(zip(*(kept.column(i).to_pylist() for i in range(4))))
    return Model(sorted({r[0] for r in rows}), rows)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` per row; no shuffle.  The model is broadcast: its size is bounded by ``fit``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, _, _ in text_chunks(texts):
                got = m.predict([WORD.findall((t or "").lower()) for t in texts.slice(lo, hi - lo).to_pylist()])
                langs, scores = zip(*got)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
