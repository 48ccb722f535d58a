"""Conflict-constrained best-fit packing of documents into bins of ``capacity`` words.

Documents are cut into pieces of at most ``capacity`` words; pieces go, longest first, into the open bin
with the smallest sufficient residual that is compatible: it holds no other document of the piece's
duplicate cluster and fewer than ``per_source`` documents of its source.  Bins are ordered by residual
and carry bitmaps of clusters and of sources (one bitmap plane per document of a source).  The successor
search walks the residuals upward and takes, of compatible bins of one residual, the one opened first; the bits that all bins of one residual share let it pass over the
whole residual at once.  If no bin is compatible a new one opens.

Shards of about ``shard`` rows, dealt by a hash of the row, are packed independently, so a hot source or
cluster is spread evenly and no task grows with the input; each shard leaves at most its last bins open.
Their number follows the rows alone, never a session setting.  Null and empty texts have no words and form
no piece; an empty table gives no bins.  Pieces of one length go in the order of their ids; rows of one id
or without one are documents of their own.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "doc_id bigint, piece int, start bigint, n_words bigint, bin_id string, residual bigint"


class Bins:
    """Open bins by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.used = 0  # bit r: some bin has residual r
        self.at: dict[int, list[int]] = {}
        self.common: dict[int, int] = {}  # residual -> bits that all its bins have
        self.mask: list[int] = []
        self.planes: list[list[int]] = []
        self.left: list[int] = []

    def find(self, size: int, bits: int) -> int:
        """The tightest compatible bin, or -1.  ``bits``: cluster and full-source bits that must be clear."""
        rest = self.used >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            if not self.common[r] & bits:
                for b in self.at[r]:
                    if not self.mask[b] & bits:
                        return b
            rest >>= step + 1
            r += 1
        return -1

    def open(self, per_source: int) -> int:
        self.mask.append(0)
        self.planes.append([0] * per_source)
        self.left.append(self.capacity)
        return len(self.left) - 1

    def _out(self, b: int) -> None:
        r = self.left[b]
        if b in (have := self.at.get(r, [])):
            have.remove(b)
            if have:
                both = self.mask[have[0]]
                for x in have[1:]:
                    both &= self.mask[x]
                    if not both:
                        break
                self.common[r] = both
            else:
                del self.at[r], self.common[r]
                self.used &= ~(1 << r)

    def put(self, b: int, size: int, cluster: int, source: int) -> None:
        """``cluster`` and ``source`` are single bits; a source's bit enters the mask when its last plane is taken."""
        self._out(b)
        self.mask[b] |= cluster
        planes = self.planes[b]
        for k, plane in enumerate(planes):
            if not plane & source:
                planes[k] |= source
                if k == len(planes) - 1:
                    self.mask[b] |= source
                break
        self.left[b] -= size
        r = self.left[b]
        if r > 0:
            self.common[r] = self.common[r] & self.mask[b] if r in self.common else self.mask[b]
            insort(self.at.setdefault(r, []), b)
            self.used |= 1 << r


def pack_shard(shard: str, items: list[tuple], capacity: int, per_source: int) -> list[tuple]:
    """``items``: (words, doc_id, piece, start, source, cluster).  Returns rows of ``PACKED``."""
    items.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2], x[4] or "", x[5]))
    seen: dict = {}
    for x in items:
        seen[x[5]] = seen.get(x[5], 0) + 1
    bit: dict = {}
    bins, out = Bins(capacity), []
    for size, doc, piece, start, source, cluster in items:
        s = 1 << bit.setdefault(("s", source), len(bit))
        c = 1 << bit.setdefault(("c", cluster), len(bit)) if seen[cluster] > 1 else 0
        b = -1 if size == capacity else bins.find(size, s | c)
        if b < 0:
            b = bins.open(per_source)
        bins.put(b, size, c, s)
        out.append((doc, piece, start, size, b))
    return [(doc, piece, start, size, f"{shard}-{b}", bins.left[b]) for doc, piece, start, size, b in out]


def pack(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = 2048, per_source: int = 4, shard: int = 8192
) -> DataFrame:
    """``doc_id, piece, start, n_words, bin_id, residual``: one row per piece; ``start`` counts words from 0.

    Without ``cluster_col`` documents with the same words (ASCII case aside) are a cluster.  A null source
    is a source of its own.
    """
    cluster = F.col(cluster_col).cast("string") if cluster_col else F.xxhash64("words").cast("string")
    lowered = F.when(F.octet_length("text") == F.char_length("text"), F.lower("text")).otherwise(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = F.array_compact(F.transform(F.split(lowered, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: F.when(w != "", w)))
    sized = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), *([F.col(cluster_col)] if cluster_col else []))
    sized = sized.withColumn("words", words).where("size(words) > 0").select("doc_id", "source", cluster.alias("cluster"), F.size("words").cast("bigint").alias("n"))
    # the count reads no text
    shards = max(1, -(-docs.select(F.col(id_col)).count() // shard))
    dealt = sized.withColumn("shard", F.expr(f"pmod(xxhash64(doc_id, source, cluster, n, 17), {shards})")).repartition(shards, "shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items = None, []

        def done() -> pa.RecordBatch:
            rows = pack_shard(str(key), items, capacity, per_source)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "piece", "start", "n_words", "bin_id", "residual"])

        for batch in batches:
            for doc, source, cl, size, s in zip(*(c.to_pylist() for c in batch.columns)):
                if s != key:
                    if items:
                        yield done()
                    key, items = s, []
                for piece, start in enumerate(range(0, size, capacity)):
                    items.append((min(capacity, size - start), doc, piece, start, source, cl))
        if items:
            yield done()

    return dealt.select("doc_id", "source", "cluster", "n", "shard").mapInArrow(run, PACKED)
