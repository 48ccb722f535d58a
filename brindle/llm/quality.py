"""Quality rules: base counts of a text, and tokeniser fertility with rejection bands per script.

Fertility is measured with public vocabularies, the first of which has byte fallback: every
white-space-delimited word is encoded on its own (a worker remembers words by 64-bit hash) and the
doc's figures are sums over its words.

* ``chars_per_token``: code points in words over tokens.
* ``byte_share``: tokens that are raw bytes over tokens.
* ``entropy``: Shannon entropy in bits of the doc's token distribution, over that of as many
  different tokens (or of the whole vocabulary, where that is less).

A document is rejected when its base rules fail or when a figure leaves the band of its script, or that of
its language where ``fit_bands`` found one: fitted on a bounded sample of labelled documents, drawn by a
hash of the id per language and label, so that bad ones leave it and at most ``loss`` of the clean ones do.
Null and empty texts have no words and fail the base rule; an empty table gives an empty result, null ids
stay null.  Nothing is shared between rows: ties, repeated rows and the order of rows do not matter, and
every text is read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._text import WS, U, Words, mix, ragged, text_chunks

#: Script of a document -> (lowest, highest) chars per token, highest byte share, (lowest, highest) relative entropy.
BANDS = {
    "latin": ((1.5, 8.0), 0.20, (0.40, 0.97)),
    "cyrillic": ((0.9, 8.0), 0.25, (0.30, 1.0)),
    "greek": ((0.7, 8.0), 0.40, (0.30, 1.0)),
    "cjk": ((0.3, 3.0), 0.80, (0.30, 1.0)),
    "other": ((0.25, 8.0), 0.95, (0.20, 1.0)),
    "none": ((0.3, 8.0), 0.50, (0.20, 1.0)),
}
#: How many words a worker remembers, as hashes and token ids: about 30 MB for a vocabulary.
STORE = 1 << 20
SYMBOLS = b"#*$%&|<>"


@lru_cache(4)
def _vocabulary(path: str) -> _Tokens:
    return _Tokens(path)


class _Tokens:
    """Token ids of words in one public vocabulary, by word hash, for a bounded number of words.

    ``*.model`` files are SentencePiece, ``*.tiktoken`` files ranks of a byte-level BPE.  Byte fallback is the
    vocabulary's raw byte tokens; of a byte-level vocabulary, tokens that are no whole UTF-8 characters.
    """

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            # words hold no white space, so every word is one piece
            model = tiktoken.Encoding("words", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
            self.size = max(ranks.values()) + 1
            self.is_byte = np.zeros(self.size, dtype=bool)
            for token, i in ranks.items():
                try:
                    token.decode()
                except UnicodeDecodeError:
                    self.is_byte[i] = True
            self.encode = lambda words: list(map(model.encode_ordinary, words))
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = sp.get_piece_size()
            self.is_byte = np.array([sp.is_byte(i) for i in range(self.size)])
            self.encode = lambda words: sp.encode(words, num_threads=1)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)  # sorted hashes
        self.at = np.zeros(0, dtype=np.int64)  # the words' numbers
        self.offs = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint16 if self.size <= 1 << 16 else np.int32)

    def index(self, hashes: np.ndarray, word: Callable[[int], bytes], firsts: np.ndarray) -> np.ndarray:
        """Numbers of the words with these distinct sorted hashes; ``word`` gives the bytes of the one at a place."""
        pos = np.searchsorted(self.known, hashes)
        have = np.zeros(len(hashes), dtype=bool)
        inside = pos < len(self.known)
        have[inside] = self.known[pos[inside]] == hashes[inside]
        if not have.all():
            if len(self.known) + int((~have).sum()) > STORE and len(self.known):
                self.clear()
                return self.index(hashes, word, firsts)
            new = np.flatnonzero(~have)
            for lo in range(0, len(new), 16384):
                part = new[lo : lo + 16384]
                got = self.encode([word(i).decode("utf-8", "replace") for i in firsts[part].tolist()])
                counts = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
                self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), dtype=self.ids.dtype, count=int(counts.sum()))])
                self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(counts)])
            self.at = np.insert(self.at, pos[new], np.arange(len(self.known), len(self.known) + len(new)))
            self.known = np.insert(self.known, pos[new], hashes[new])
            pos = np.searchsorted(self.known, hashes)
        return self.at[pos]


def gather(offs: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ragged rows ``index``, one after the other, and their lengths."""
    n = offs[index + 1] - offs[index]
    ends = np.cumsum(n)
    at = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(offs[index], n)
    return at, n


def script_of(counts: tuple[int, int, int, int, int]) -> str:
    """The script with most letters; ``none`` without letters."""
    names = ("latin", "cyrillic", "greek", "cjk", "other")
    return names[counts.index(max(counts))] if max(counts) else "none"


def _scripts(seg: np.ndarray, offs: np.ndarray) -> list[str]:
    """By lead bytes: ASCII letters and U+00C0-024F; U+0400-052F; U+0370-03FF; U+3000-D7FF; all others from U+0530, four-byte ones included."""
    low = seg | 32
    kinds = [((low >= 97) & (low <= 122)) | ((seg >= 0xC3) & (seg <= 0xC9)), (seg >= 0xD0) & (seg <= 0xD4), (seg >= 0xCD) & (seg <= 0xCF), (seg >= 0xE3) & (seg <= 0xED), ((seg >= 0xD5) & (seg <= 0xE1)) | ((seg >= 0xF0) & (seg <= 0xF4))]
    sums = []
    for kind in kinds:
        acc = np.zeros(len(seg) + 1, dtype=np.int64)
        np.cumsum(kind, out=acc[1:])
        sums.append(acc[offs[1:]] - acc[offs[:-1]])
    return [script_of(x) for x in zip(*(s.tolist() for s in sums))]


def repeat_words(w: Words) -> np.ndarray:
    """Words of each text inside 3-word windows that the text holds twice or more."""
    n, h = len(w.start), w.hashes()
    out = np.zeros(len(w.count), dtype=np.int64)
    if n < 3:
        return out
    a, b, c = (U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
    doc = w.doc
    key = mix(h[:-2] * a + mix(h[1:-1] * b + mix(h[2:] * c)) + mix(doc[:-2].astype(np.uint64) + U(1)))
    inside = np.flatnonzero(doc[:-2] == doc[2:])
    key = key[inside]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:].copy()
    at = inside[order[same]]
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[at + k] = True
    return np.bincount(doc[hit], minlength=len(w.count)).astype(np.int64)


def measure(batches: Iterator[pa.RecordBatch], paths: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Columns of ``SCHEMA`` from an id and a text; further columns pass through.  Fertility figures hold one value per vocabulary."""
    vocabularies = [_vocabulary(p) for p in paths]
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, offs in text_chunks(batch.column(1)):
            w = Words(data, offs)
            n_docs, raw, doc = hi - lo, w.bytes.tobytes(), w.doc
            texts = [raw[a:b] for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist())]
            kinds, firsts, which = np.unique(w.hashes(), return_index=True, return_inverse=True)
            # every distinct word of a document once, with its count
            pairs, times = np.unique(doc * np.int64(len(kinds) or 1) + which, return_counts=True)
            pair_doc, pair_word = np.divmod(pairs, len(kinds) or 1)
            continued = np.zeros(len(w.bytes) + 1, dtype=np.int64)
            np.cumsum((w.bytes & 0xC0) != 0x80, out=continued[1:])
            chars = np.bincount(doc, weights=continued[w.end] - continued[w.start], minlength=n_docs).astype(np.int64)
            figures = [_fertility(v, v.index(kinds, lambda i: raw[w.start[i] : w.end[i]], firsts), pair_doc, pair_word, times, chars, n_docs) for v in vocabularies]
            columns = [np.stack(x, axis=1) if x else np.zeros((n_docs, 0)) for x in zip(*figures)] or [np.zeros((n_docs, 0))] * 4
            lines = [[x for x in t.split(b"\n") if x.strip(WS)] for t in texts]
            extra = [batch.column(k).slice(lo, n_docs) for k in range(2, batch.num_columns)]
            each = np.full(n_docs, len(paths))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, n_docs),
                    pa.array(w.count.astype(np.int64)),
                    pa.array(chars),
                    pa.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], pa.int64()),
                    pa.array([len(x) - len(set(x)) for x in lines], pa.int64()),
                    pa.array(repeat_words(w)),
                    ragged(columns[0].ravel().astype(np.int64), each, pa.int64()),
                    *(ragged(x.ravel(), each, pa.float64()) for x in columns[1:]),
                    pa.array(_scripts(w.bytes, w.offs), pa.string()),
                    *extra,
                ],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "entropy", "script", *batch.schema.names[2:]],
            )


def _fertility(v: _Tokens, number: np.ndarray, doc: np.ndarray, word: np.ndarray, times: np.ndarray, chars: np.ndarray, n_docs: int) -> tuple[np.ndarray, ...]:
    """Tokens, chars per token, byte share and relative entropy of each document; (doc, word, times): its distinct words."""
    at, per_word = gather(v.offs, number[word])
    tokens = v.ids[at].astype(np.int64)
    of, weight = np.repeat(doc, per_word), np.repeat(times, per_word)
    n = np.bincount(of, weights=weight, minlength=n_docs)
    raw = np.bincount(of, weights=weight * v.is_byte[tokens], minlength=n_docs)
    pairs, back = np.unique(of * np.int64(v.size) + tokens, return_inverse=True)
    count, of = np.bincount(back, weights=weight, minlength=len(pairs)), pairs // v.size
    p = count / n[of]
    entropy = np.bincount(of, weights=-p * np.log2(p), minlength=n_docs)
    some = np.maximum(n, 1)
    return n, chars / some, raw / some, entropy / np.log2(np.clip(np.minimum(n, v.size), 2, None))


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens array<bigint>, chars_per_token array<double>, byte_share array<double>, entropy array<double>, script string"


def _failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _inside(band: tuple, k: int = 0) -> Column:
    """Whether the figures in vocabulary ``k`` lie in a band."""
    (least, most), byte, (low, high) = band
    return F.col("chars_per_token")[k].between(least, most) & (F.col("byte_share")[k] <= byte) & F.col("entropy")[k].between(low, high)


def band_of(clean: np.ndarray, bad: np.ndarray, loss: float) -> tuple | None:
    """The band that most rows of ``bad`` leave and at most the share ``loss`` of ``clean``; rows are (chars per token, byte share, relative entropy)."""
    if min(len(clean), len(bad)) < 20:
        return None
    ends = [[-np.inf, np.inf] for _ in range(3)]
    left, clean, bad = int(loss * len(clean)), clean.copy(), bad.copy()
    while True:
        best = (0, 0)
        for k in range(3):
            for side in (0, 1) if k != 1 else (1,):
                sign = 1 if side == 0 else -1
                c, b = np.sort(sign * clean[:, k]), np.sort(sign * bad[:, k])
                if not len(b) or left >= len(c):
                    continue
                gone = np.arange(left + 1)  # clean rows given up
                net = np.searchsorted(b, c[gone]) / len(b) - gone / len(c)
                at = int(net.argmax())
                # at least a twentieth of the bad ones left, and more than of the clean ones
                if net[at] > 0.05 and net[at] > best[0]:
                    best = (net[at], k, side, sign * c[at])
        if not best[0]:
            return tuple(ends[0]), ends[1][1], tuple(ends[2])
        _, k, side, edge = best
        ends[k][side] = float(edge)
        ok = lambda x: (x[:, k] >= edge) if side == 0 else (x[:, k] <= edge)  # noqa: B023, E731
        left -= int((~ok(clean)).sum())
        clean, bad = clean[ok(clean)], bad[ok(bad)]


def fit_bands(docs: DataFrame, labels: DataFrame, vocabularies: Sequence[str], *, per_label: int = 500, loss: float = 0.02) -> dict[str, list[tuple | None]]:
    """Language -> a band for each vocabulary, from about ``per_label`` documents of each language and ``quality`` (0 or 1) that pass the base rules.

    All vocabularies together may reject the share ``loss`` of the clean ones; each is fitted on what the one before it leaves.
    """
    lab = labels.where(F.col("quality").isin(0, 1)).select("doc_id", "quality").join(docs.where(F.col("lang").isNotNull()).select("doc_id", "lang"), "doc_id")
    counts = lab.groupBy("lang", "quality").count()
    some = lab.join(F.broadcast(counts), ["lang", "quality"]).where(F.expr(f"pmod(xxhash64(doc_id, 29), 1000000) < {per_label} * 1000000 / count"))
    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(some.select("doc_id", "lang", "quality")), "doc_id")
    rows = some.select("doc_id", "text", "lang", F.col("quality").cast("int").alias("quality")).mapInArrow(lambda it: measure(it, vocabularies), SCHEMA + ", lang string, quality int")
    got = rows.where(~_failed()).select("lang", "quality", "chars_per_token", "byte_share", "entropy").toArrow()
    lang, label = np.array(got.column(0).to_pylist(), dtype=object), np.array(got.column(1).to_pylist())
    x = np.array([got.column(k).to_pylist() for k in (2, 3, 4)], dtype=np.float64).reshape(3, got.num_rows, len(vocabularies))
    found = {}
    for one in sorted(set(lang.tolist())):
        clean, bad = (x[:, (lang == one) & (label == q)] for q in (1, 0))
        bands, share, all_clean = [], loss, clean.shape[1]
        for k in range(len(vocabularies)):
            bands.append(band_of(clean[:, :, k].T, bad[:, :, k].T, share))
            if bands[-1]:
                clean, bad = (y[:, _stays(y[:, :, k].T, bands[-1])] for y in (clean, bad))
                share = max(0.0, (loss * all_clean - (all_clean - clean.shape[1])) / max(1, clean.shape[1]))
        if any(bands):
            found[one] = bands
    return found


def _stays(rows: np.ndarray, band: tuple) -> np.ndarray:
    (least, most), byte, (low, high) = band
    return (rows[:, 0] >= least) & (rows[:, 0] <= most) & (rows[:, 1] <= byte) & (rows[:, 2] >= low) & (rows[:, 2] <= high)


def quality(
    docs: DataFrame, vocabularies: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text", bands: dict | None = None, by_lang: dict | None = None, lang_col: str = "lang", carry: Sequence[str] = ()
) -> DataFrame:
    """One row per input row: counts, fertility figures (arrays: one value per vocabulary), ``base_failed`` and ``kept``.  No shuffle.

    ``by_lang``: bands of ``fit_bands``.  ``bands``: by script, for the first vocabulary.  ``carry``: further columns to hand
    on unchanged, as ``carried`` (a struct, so that no name clashes).
    """
    more = [F.col(lang_col).cast("string").alias("lang")] if by_lang else []
    struct = F.struct(*(F.col(c) for c in carry)).alias("carried") if carry else None
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *more, *([struct] if carry else []))
    schema = SCHEMA + (", lang string" if by_lang else "") + (f", carried {picked.schema['carried'].dataType.simpleString()}" if carry else "")
    out = picked.mapInArrow(lambda it: measure(it, vocabularies), schema)
    inside = F.lit(False)
    for script, band in (bands or BANDS).items():
        inside = inside | ((F.col("script") == script) & _inside(band))
    for lang, of in (by_lang or {}).items():
        for k, band in enumerate(of):
            if band:
                inside = inside & (~F.col("lang").eqNullSafe(lang) | _inside(band, k))
    return out.withColumn("base_failed", _failed()).withColumn("kept", ~F.col("base_failed") & inside).drop("lang")
