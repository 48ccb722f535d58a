"""BPE encoding by a prefix-sharing trie walk, and decoding.

The distinct words of a batch are walked as a trie, depth first (in sorted order, with the path from
the root on a stack).  A node's state is the last token of the encoding of its prefix; the rest of the
encoding is the state of the shorter prefix that token leaves.  Prefixes that words share are thus
encoded once.  A token may follow another only if merging the two pieces by rank yields exactly the
two; that test undoes the merges of both sides from the highest rank down.

Reads tokenizer JSON files with a BPE model, ``</w>`` as word end, byte-level symbols and a
``Split`` pattern whose matches are the words; texts are normalised (NFC, white space, lower case) first,
and a file that asks for other steps is refused.  Null and empty texts have no tokens, an empty table gives
an empty result.  Rows are independent of each other, so repeated ones and null ids are rows like others;
whole texts are read.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE = 600_000
BATCH = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character of each byte, by the usual byte-level rule: printable Latin-1 as itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Strings:
    """Strings end to end, each with a space after it, to be joined in numpy."""

    def __init__(self):
        self.data, self.ends = bytearray(), array("q", [0])

    def add(self, text: str) -> None:
        self.data += text.encode()
        self.data += b" "
        self.ends.append(len(self.data))

    def joined(self, index: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """One string per group: those numbered index[bounds[g]:bounds[g + 1]], joined by one space."""
        offs = np.frombuffer(self.ends, dtype=np.int64)
        n = offs[index + 1] - offs[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(ends[-1]) + np.repeat(offs[index] - ends[:-1], n)
        flat = np.frombuffer(self.data, dtype=np.uint8)[at]
        stops = ends[bounds]
        full = np.diff(stops) > 0
        flat = np.delete(flat, stops[1:][full] - 1)
        stops = stops - np.concatenate([[0], np.cumsum(full)])
        return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


class TrieBPE:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = lambda part, many: [x["type"] for x in (spec[part] or {}).get(many, [])]
        if (kinds("normalizer", "normalizers"), kinds("pre_tokenizer", "pretokenizers"), spec["decoder"]) != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None):
            raise ValueError(f"{path} normalises, splits or decodes otherwise than this module")
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.vocab.items()}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.split: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            pair = (self.vocab[a], self.vocab[b])
            made = self.vocab[a + b]
            self.rank.setdefault(pair, r)
            self.split.setdefault(made, (r, *pair))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        self.mark = os.path.commonprefix(list(self.special))  # a text without it holds no added token
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget the words; the next batch teaches them anew."""
        self.at: dict[str, int] = {}
        self.n = array("q")
        self.ids, self.tokens = _Strings(), _Strings()
        self.pairs.clear()

    def follows(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` is what their joint text is encoded as."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self.pairs[a, b] = self._follows(a, b)
        return known

    def _follows(self, a: int, b: int) -> bool:
        limit = len(self.rank) + 1
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            ra = self.split[a][0] if a in self.split else -1
            rb = self.split[b][0] if b in self.split else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the later merge is undone first; an equal rank on the left was made first
                limit, a = ra, self.split[a][2]
            else:
                limit, b = rb + 1, self.split[b][1]

    def plain(self, symbols: list[str]) -> list[int]:
        """Merging by rank, lowest first; the definition."""
        ids = [self.vocab[s] for s in symbols if s in self.vocab]
        while len(ids) > 1:
            r, i = min((self.rank.get((ids[i], ids[i + 1]), 1 << 60), i) for i in range(len(ids) - 1))
            if r == 1 << 60:
                break
            ids[i : i + 2] = [self.vocab[self.text[ids[i]] + self.text[ids[i + 1]]]]
        return ids

    def reachable(self, t: int) -> bool:
        known = self.whole.get(t)
        if known is None:
            s = self.text[t]
            ends = bool(self.end) and s.endswith(self.end)
            chars = list(s.removesuffix(self.end) if ends else s)
            if ends:
                chars[-1] += self.end
            known = self.whole[t] = self.plain(chars) == [t]
        return known

    def _state(self, text: str, i: int, states: list[int], suffix: str) -> int:
        """Last token of the encoding of text[:i] (with the word end if ``suffix``); -1 if none fits."""
        vocab = self.vocab
        for k in range(max(0, i - self.longest), i):
            t = vocab.get(text[k:i] + suffix)
            if t is not None and (self.reachable(t) if k == 0 else states[k] >= 0 and self.follows(states[k], t) and self.reachable(t)):
                return t
        return -1

    def learn(self, words: set[str]) -> None:
        """Walk the trie of ``words`` and keep their encodings."""
        table = self.symbols
        keyed = sorted((w.encode("utf-8", "surrogatepass").decode("latin-1").translate(table), w) for w in words)
        states, path = [-1], ""
        for s, w in keyed:
            shared = 0
            for x, y in zip(path, s[:-1]):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :]
            for i in range(shared + 1, len(s)):
                states.append(self._state(s, i, states, ""))
            path = s[:-1]
            ids, at, last = [], len(s), self._state(s, len(s), states, self.end)
            while last >= 0:
                ids.append(last)
                at -= len(self.text[last]) - (len(self.end) if len(ids) == 1 else 0)
                if at == 0:
                    break
                last = states[at]
            if last < 0:
                ids = self.plain([*s[:-1], s[-1] + self.end])[::-1]
            ids.reverse()
            self._keep(w, ids)

    def _keep(self, word: str, ids: list[int]) -> None:
        self.at[word] = len(self.n)
        self.n.append(len(ids))
        self.ids.add(" ".join(map(str, ids)))
        self.tokens.add(" ".join([self.text[i] for i in ids]))

    def split_words(self, text: str) -> list[str]:
        """The words of a text; added tokens stand as their content with a leading NUL."""
        if self.cut is None or self.mark not in text:
            return self._plain_words(text)
        out: list[str] = []
        for piece in self.cut.split(text):
            if piece in self.special:
                out.append("\0" + piece)
            else:
                out += self._plain_words(piece)
        return out

    def _plain_words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        else:
            text = text.lower()
        return self.word.findall(text)

    def encode_batch(self, texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Token count, ids as decimals joined by a space, and the decoded text, of each text."""
        split = [self.split_words(t) for t in texts]
        new = set().union(*split) - self.at.keys()
        if len(self.at) + len(new) > CACHE:
            self.clear()
            new = set().union(*split)
        for w in [w for w in new if w[0] == "\0" and w[1:] in self.special]:
            self._keep(w, [self.special[w[1:]]])
            new.discard(w)
        self.learn(new)
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        index = np.fromiter((self.at[w] for words in split for w in words), dtype=np.int64, count=int(counts.sum()))
        per_word = np.frombuffer(self.n, dtype=np.int64)[index] if len(index) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(per_word)]).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return pa.array(np.diff(ends[bounds])), self.ids.joined(index, bounds), self.tokens.joined(index, bounds)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their tokens joined by a space (the file names no decoder); unknown ids are left out."""
        return " ".join(self.text[i] for i in ids if i in self.text)


@lru_cache(2)
def _tokenizer(path: str) -> TrieBPE:
    return TrieBPE(path)


def _pieces(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in groups of bounded size, so that a batch's Python strings never add up."""
    start, size, held = 0, 0, []
    for i, x in enumerate(column):
        t = x.as_py() or ""
        held.append(t)
        size += len(t)
        if size >= BATCH:
            yield start, held
            start, size, held = i + 1, 0, []
    if held:
        yield start, held


def encode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` per input row: ids as decimals joined by one space, and the decoded text.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizer(tokenizer)
        for batch in batches:
            for start, texts in _pieces(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *t.encode_batch(texts)], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids string, decoded string")

