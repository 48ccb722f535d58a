"""Removal of repeated word spans by compaction of a sparse de Bruijn graph of token k-mers.

1. Every window of ``window`` words selects its smallest k-mer (a minimiser), which depends on the
   window's words alone: repeated windows select the same k-mer.  Selected k-mers of a text, in order,
   are the graph's nodes; the words between two of them make the edge.
2. Spark joins the occurrences with node statistics: how often a node occurs and whether all its
   occurrences enter and leave by the same edge.  Edges that never branch on either side compact into
   paths; around any occurrence of a path's node stands the whole path, so windows inside a path whose
   nodes repeat are repeated, and match only windows inside the same path.
3. Windows that select a repeated node outside a path (at its ends, next to an edit) are verified by
   their own 128-bit hashes with their source coordinates.

Removed are the words of all windows found repeated, judged on the input.  Null and empty texts have no
words, an empty table gives an empty result, copies of a text lose all windows.  Rows that share an id
or have none are documents of their own.  Documents are never gathered; per document only its own repeated nodes and windows are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch
from ._text import BASES, U, Words, ragged, signed, span_hash, text_chunks


def _kmers(h: np.ndarray, k: int, base: int) -> np.ndarray:
    at = np.arange(len(h) - k + 1)
    return span_hash(h, at, at + k, base)


def _selected(h: np.ndarray, w: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, for each the start of its selected k-mer, the selected starts, and all k-mer hashes."""
    n, width = len(h), window - k + 1
    if n < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=np.uint64)
    key = _kmers(h, k, BASES[1])
    doc = w.doc
    starts = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    # leftmost smallest of each run of ``width`` k-mers, by doubling: arrays of (value, position)
    best, at, span = key, np.arange(len(key)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:-step] if step else best, best[step:]
        left = a <= b
        at = np.where(left, at[: len(a)], at[step:])
        best = np.where(left, a, b)
        span += step
    chosen = at[starts]
    return starts, chosen, np.unique(chosen), key


GRAPH = "doc_id bigint, n_words bigint, whole string, nodes array<bigint>, places array<int>, edges array<bigint>"


def graph(docs: DataFrame, window: int, k: int) -> DataFrame:
    """Per row: word count, digest of all words, and its nodes with first word and the edge that follows (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in text_chunks(batch.column(1)):
                w = Words(data, offs)
                h = w.hashes()
                _, _, chosen, key = _selected(h, w, window, k)
                edges = np.zeros(len(chosen), dtype=np.uint64)
                doc = w.doc[chosen] if len(chosen) else np.zeros(0, np.int64)
                if len(chosen) > 1:
                    inner = np.flatnonzero(doc[:-1] == doc[1:])
                    edges[inner] = span_hash(h, chosen[inner], chosen[inner + 1] + k) | U(1)
                raw = w.bytes.tobytes()
                whole = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist())]
                counts = np.bincount(doc, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(w.count.astype(np.int64)), pa.array(whole), ragged(signed(key[chosen]) if len(chosen) else np.zeros(0, np.int64), counts, pa.int64()), ragged((chosen - w.first[doc]).astype(np.int32) if len(chosen) else np.zeros(0, np.int32), counts, pa.int32()), ragged(signed(edges), counts, pa.int64())],
                    names=["doc_id", "n_words", "whole", "nodes", "places", "edges"],
                )

    return docs.mapInArrow(run, GRAPH)


def _windows(w: Words, marks: list[np.ndarray], window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows inside compacted paths, windows to verify, and word hashes.  ``marks``: per text 2 * first word of a repeated node + (1 if the edge after it compacts)."""
    h = w.hashes()
    starts, chosen, selected, _ = _selected(h, w, window, k)
    if not len(starts):
        return starts, starts, h
    flat = np.concatenate([2 * w.first[d] + m for d, m in enumerate(marks)]) if marks else np.zeros(0, np.int64)
    flat.sort()
    place, joined = flat >> 1, (flat & 1).astype(bool)
    repeated = np.isin(chosen, place)
    # paths: runs of consecutive selected nodes whose edges compact
    go = np.zeros(len(selected), dtype=bool)
    go[np.searchsorted(selected, place[joined])] = True
    head = go & ~np.concatenate([[False], go[:-1]])
    first = selected[head]
    last_at = np.flatnonzero(np.concatenate([[False], go[:-1]]) & ~go)
    if len(last_at) < len(first):
        raise AssertionError("a compacted edge leads nowhere")
    last = selected[last_at] + k
    run = np.searchsorted(first, starts, side="right") - 1
    inside = np.zeros(len(starts), dtype=bool)
    ok = run >= 0
    inside[ok] = starts[ok] + window <= last[run[ok]]
    return starts[inside], starts[repeated & ~inside], h


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35, k: int = 12) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` per row.

    ``kept`` is the text of the remaining words joined by one space, null where nothing was removed
    (the words are then the input's own).
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").head(1):  # number the rows; written, so that numbers last
        numbered = scratch.table(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        out = repeated_spans(numbered, id_col="row", window=window, k=k).withColumnRenamed("doc_id", "row")
        return numbered.select("row", "doc_id").join(out, "row").drop("row")
    each = scratch.table(graph(docs, window, k), "graph")
    rows = F.arrays_zip("nodes", "places", "edges", F.expr("array_insert(slice(edges, 1, greatest(size(edges) - 1, 0)), 1, 0L)").alias("before"))
    occ = each.where("size(nodes) > 0").select("doc_id", F.explode(rows).alias("r")).select("doc_id", F.col("r.nodes").alias("node"), F.col("r.places").alias("place"), F.col("r.edges").alias("after"), F.col("r.before").alias("before"))
    nodes = occ.groupBy("node").agg(F.count("*").alias("c"), F.min("after").alias("a0"), F.max("after").alias("a1"), F.min("before").alias("b0"), F.max("before").alias("b1")).where("c > 1")
    nodes = scratch.table(nodes.select("node", F.expr("a0 = a1 and a0 <> 0").alias("leaves"), F.expr("b0 = b1 and b0 <> 0").alias("enters")), "nodes")
    hits = scratch.table(occ.select("doc_id", "node", "place", "after").join(nodes, "node").select("doc_id", "place", "leaves", "enters", "after"), "hits")
    # an edge compacts if its source always leaves by it and its target is always entered by it
    hits = hits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "leaves", "enters"))).alias("h"))
    # the next selected node of a text is repeated whenever the edge to it is, so neighbours in ``h`` are the edge's ends
    marks = hits.select("doc_id", F.expr("transform(h, (x, i) -> 2 * x.place + if(x.leaves and i + 1 < size(h) and h[i + 1].enters, 1, 0))").alias("marks"))
    cand = scratch.table(docs.join(marks.hint("merge"), "doc_id"), "candidates")
    summary = scratch.table(each.select("doc_id", "n_words", "whole"), "summary")
    scratch.drop(each, nodes)

    def chunks(batch: pa.RecordBatch):
        for lo, hi, data, offs in text_chunks(batch.column(1)):
            part = batch.column(2).slice(lo, hi - lo)
            marks = [np.asarray(x.values, dtype=np.int64) for x in part]
            yield lo, hi, Words(data, offs), marks

    def unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, marks in chunks(batch):
                _, ask, h = _windows(w, marks, window, k)
                if len(ask):
                    doc = w.doc[ask]
                    ids = np.asarray(batch.column(0).slice(lo, hi - lo))[doc]
                    two = (signed(span_hash(h, ask, ask + window, b)) for b in BASES)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((ask - w.first[doc]).astype(np.int32)), *map(pa.array, two)], names=["doc_id", "place", "ha", "hb"])

    asked = scratch.table(cand.mapInArrow(unsure, "doc_id bigint, place int, ha bigint, hb bigint"), "windows")
    # as a table of its own, so that the join below can split the partition of a passage that very many documents share
    again = scratch.table(asked.groupBy("ha", "hb").agg(F.count("*").alias("c")).where("c > 1").select("ha", "hb"), "again")
    found = asked.join(again, ["ha", "hb"]).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    found = scratch.table(found, "found")
    scratch.drop(asked, again)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, marks in chunks(batch):
                sure, _, _ = _windows(w, marks, window, k)
                more = [np.asarray(x.values, dtype=np.int64) + w.first[d] for d, x in enumerate(batch.column(3).slice(lo, hi - lo)) if x.is_valid]
                starts = np.concatenate([sure, *more]).astype(np.int64)
                edge = np.bincount(starts, minlength=len(w.start) + 1) - np.bincount(starts + window, minlength=len(w.start) + 1)[: len(w.start) + 1]
                gone = np.cumsum(edge)[: len(w.start)] > 0
                raw = w.bytes.tobytes()
                removed, kept = [], []
                for d in range(hi - lo):
                    a, b = w.first[d], w.first[d + 1]
                    n = int(gone[a:b].sum())
                    removed.append(n)
                    words = raw[w.offs[d] : w.offs[d + 1]].split() if n else ()
                    kept.append(b" ".join([x for x, g in zip(words, gone[a:b].tolist()) if not g]).decode() if n else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_removed", "kept"])

    results = cand.join(found.hint("merge"), "doc_id", "left").select("doc_id", "text", "marks", "places").mapInArrow(cut, "doc_id bigint, n_removed bigint, kept string").where("n_removed > 0")
    results = results.withColumn("digest", F.sha2("kept", 256))
    return summary.join(results, "doc_id", "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce("digest", "whole").alias("kept_sha256"), "kept")
