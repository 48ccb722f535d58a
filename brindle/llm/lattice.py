"""Near-duplicate vectors by lattice hashing, links confirmed by cosine in double precision.

Each table projects the unit vector to ``blocks`` times eight dimensions with Gaussian directions and
decodes every eight to the nearest point of the E8 lattice; the points are the cell.  A vector is
stored in its cell and also looks into the neighbouring cells its residual points to.  Cells are cut
into blocks of bounded size and compared block by block with one matrix product; a pair that several
tables bring together counts once, in the first of them.  Only counts, and one forest edge per vector
and block, leave a comparison - never the pairs.

The lattice follows the number of vectors (``lattice_for``): the more there are, the finer the cells, so that a
vector meets about as many unrelated ones at every size, and the more tables, so that a pair at the
threshold is missed by all of them with the same probability.  Work thus grows as rows times tables,
not with the square of the rows.

Equal vectors form a class with one representative that stands for all of them, so copies are never
compared.  A cell of m different vectors costs m * m / 2 comparisons, spread over (m / block)**2 tasks of
bounded memory: exact link counts of a large group of near vectors need that.

Vectors that are null, zero, or hold a null or non-finite component link with nothing; so do rows with a
null id.  Lengths may differ; vectors of different lengths do not link.  An empty table gives an empty
result.  Ids should be unique: rows of one id get one result, and those with equal vectors count as links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch, components, partitions
from ._text import U, mix, ragged, signed

BLOCK = 512
VECTOR = "array<double>"


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The closest E8 point of each row (8 columns), doubled so that coordinates are integers."""

    def d8(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        gap = y - r
        odd = (r.sum(axis=1).astype(np.int64) & 1).astype(bool)
        at = np.abs(gap).argmax(axis=1)
        rows = np.flatnonzero(odd)
        r[rows, at[rows]] += np.where(gap[rows, at[rows]] >= 0, 1.0, -1.0)
        return r

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return (2 * np.where(near[:, None], a, b)).astype(np.int64)


def projections(dim: int, tables: int, blocks: int, scale: float, seed: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([seed, dim]))
    return rng.standard_normal((tables, dim, 8 * blocks)) * scale


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (1, -1):
                for b in (1, -1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bin(bits).count("1") % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


_SHORT = minimal_vectors()


def codes(y: np.ndarray, t: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each projected row's cell in table ``t``, and those of the ``probes`` neighbouring cells closest to it."""
    mult, width = U(0x9E3779B97F4A7C15), y.shape[1]

    def code(points: np.ndarray) -> np.ndarray:
        h = np.full(len(points), t + 1, dtype=np.uint64)
        for k in range(points.shape[1]):
            h = mix(h * mult + points[:, k].view(np.uint64))
        return h

    points = np.concatenate([nearest_e8(y[:, k : k + 8]) for k in range(0, width, 8)], axis=1)
    near = np.zeros((len(y), probes), dtype=np.uint64)
    if probes:
        gain = np.concatenate([(y[:, k : k + 8] - points[:, k : k + 8] / 2) @ _SHORT.T for k in range(0, width, 8)], axis=1)
        best = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
        for j in range(probes):
            moved = points.copy()
            block, v = best[:, j] // 240, best[:, j] % 240
            step = (2 * _SHORT).astype(np.int64)[v]
            for k in range(width // 8):
                moved[:, 8 * k : 8 * k + 8] += step * (block == k)[:, None]
            near[:, j] = code(moved)
    return code(points), near


def cells(x: np.ndarray, planes: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """``codes`` of unit vectors for every table."""
    own, near = zip(*(codes(x @ plane, t, probes) for t, plane in enumerate(planes)))
    return np.stack(own), np.stack(near)


def met(cosine: float, blocks: int, scale: float, probes: int, pairs: int = 4000) -> float:
    """The share of pairs at ``cosine`` that one table brings together, by simulation with a fixed seed."""
    rng = np.random.Generator(np.random.PCG64(23))
    a, b = rng.standard_normal((2, pairs, 8 * blocks))
    b = cosine * a + (1 - cosine * cosine) ** 0.5 * b
    (own_a, near_a), (own_b, near_b) = (codes(y * scale, 0, probes) for y in (a, b))
    return float(((own_a == own_b) | (near_a == own_b[:, None]).any(axis=1) | (near_b == own_a[:, None]).any(axis=1)).mean())


def lattice_for(rows: int, cosine: float, probes: int, dense: int = 10_000, miss: float = 2e-4) -> tuple[int, int, float]:
    """Tables, E8 blocks per table and scale for so many vectors.

    Unrelated vectors share a cell of one block at scale s with probability (4 pi s * s)**-4.  Up to ``dense``
    rows one block at scale 1 does; beyond, cells get finer in proportion to the rows.  Of the numbers of blocks that
    give such cells the one that needs fewest tables is taken, so many that a pair at the threshold is missed by
    all of them with probability ``miss``.
    """
    far = (4 * np.pi) ** -4 * min(1.0, dense / max(rows, 1))
    options = []
    for blocks in range(1, 6):
        scale = float((far ** (-1 / (4 * blocks)) / (4 * np.pi)) ** 0.5)
        if blocks > 1 and scale < 0.55:  # cells as wide as the data: the rule no longer holds
            break
        hit = met(cosine, blocks, scale, probes)
        if hit > 0:
            options.append((1 if hit >= 1 else int(np.ceil(np.log(miss) / np.log1p(-hit))), blocks, scale))
    return min(options)


def link_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, lattice: tuple[int, int, float] | None = None, probes: int = 5, seed: int = 5
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.  ``lattice``: tables, blocks and scale in place of ``lattice_for``'s."""
    scratch = Scratch(vectors.sparkSession)
    vectors = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast(VECTOR).alias("v"))
    good = vectors.where("vec_id is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")

    ids = good.select("vec_id", F.xxhash64("v").alias("ha"), F.xxhash64(F.lit("second"), "v").alias("hb"))
    # tables of their own, so that the joins below can split the partition of a large class
    classes = scratch.table(ids.groupBy("ha", "hb").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")).where("w > 1"), "classes")
    copies = scratch.table(ids.join(classes, ["ha", "hb"]).where("vec_id <> rep").groupBy("vec_id").agg(F.min("rep").alias("rep")), "copies")
    weights = classes.groupBy(F.col("rep").alias("vec_id")).agg(F.max("w").alias("w"))
    good = good.join(copies.select("vec_id"), "vec_id", "left_anti").join(weights, "vec_id", "left").select("vec_id", "v", F.coalesce("w", F.lit(1)).alias("w"))
    tables, blocks, scale = lattice or lattice_for(good.count(), cosine, probes)

    def matrix(column: pa.Array) -> np.ndarray:
        x = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                for lo in range(0, len(rows), 2048):
                    part = batch.take(pa.array(rows[lo : lo + 2048]))
                    own, near = cells(matrix(part.column(1)), projections(int(dim), tables, blocks, scale, seed), probes)
                    every = np.concatenate([own.T[:, :, None], near.transpose(1, 0, 2)], axis=2).reshape(part.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), ragged(signed(every.ravel()), np.full(part.num_rows, every.shape[1]), pa.int64())], names=["vec_id", "v", "w", "cells"])

    each = scratch.table(good.mapInArrow(hashed, f"vec_id bigint, v {VECTOR}, w bigint, cells array<bigint>"), "cells")
    slots = each.select("vec_id", F.posexplode("cells").alias("at", "cell")).select("vec_id", "cell", (F.col("at") % (probes + 1) == 0).alias("home"))
    sizes = slots.groupBy("cell").agg(F.count("*").alias("c"), F.count_if("home").alias("homes")).where("c > 1 and homes > 0").select("cell", "c")
    # block b of a cell meets the blocks from b on, itself included
    dealt = slots.join(sizes, "cell").withColumn("n", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("b", F.expr("int(pmod(xxhash64(vec_id, 3), n))"))
    meets = dealt.select("vec_id", "home", "cell", "b", F.explode(F.expr("transform(sequence(0, n - 1), o -> struct(least(b, o) as lo, greatest(b, o) as hi))")).alias("m"))
    meets = scratch.table(meets.select("cell", "m.lo", "m.hi", "b", "home", "vec_id"), "meets")
    n = partitions(vectors.sparkSession)
    stream = meets.join(each.select("vec_id", "v", "w"), "vec_id").repartition(n, "cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").select("cell", "lo", "hi", "b", "home", "vec_id", "v", "w")

    def pairs(cell: int, apart: bool, b: np.ndarray, home: np.ndarray, ids: np.ndarray, w: np.ndarray, x: np.ndarray):
        """The near pairs of one group: the vectors in them, and the pairs as places among those."""
        g = x @ x.T >= cosine
        np.fill_diagonal(g, False)
        g &= home[:, None] | home[None, :]
        if apart:
            g &= b[:, None] != b[None, :]
        i, j = np.nonzero(np.triu(g))
        if len(i) == 0:
            return None
        used = np.unique(np.concatenate([i, j]))
        return ids[used], w[used], x[used], np.searchsorted(used, i), np.searchsorted(used, j), np.full(len(i), cell)

    def settled(held: list[tuple]) -> pa.RecordBatch | None:
        """Links and roots from the pairs of many groups, each pair only where it first meets: in no earlier table, and there once."""
        starts = np.cumsum([0, *(len(h[0]) for h in held)])
        ids, w, x = (np.concatenate([h[k] for h in held]) for k in range(3))
        i, j = (np.concatenate([h[k] + start for h, start in zip(held, starts)]) for k in (3, 4))
        cell = np.concatenate([h[5] for h in held])
        own, near = cells(x, projections(x.shape[1], tables, blocks, scale, seed), probes)
        hit = np.zeros(len(i), dtype=bool)
        first = np.zeros(len(i), dtype=np.uint64)
        for t in range(tables):
            both = own[t, i] == own[t, j]
            cand = np.where(both, own[t, i], U(0))
            for q in range(probes):
                m = (near[t, i, q] == own[t, j]) & ~both
                cand = np.where(m, np.where(cand == 0, own[t, j], np.minimum(cand, own[t, j])), cand)
                m = (near[t, j, q] == own[t, i]) & ~both
                cand = np.where(m, np.where(cand == 0, own[t, i], np.minimum(cand, own[t, i])), cand)
            first = np.where(hit, first, cand)
            hit |= cand != 0
        mine = first.view(np.int64) == cell
        i, j = i[mine], j[mine]
        if len(i) == 0:
            return None
        links = (np.bincount(i, weights=w[j], minlength=len(ids)) + np.bincount(j, weights=w[i], minlength=len(ids))).astype(np.int64)  # exact below 2**53
        root = np.arange(len(ids))
        while True:  # labels fall to the smallest row of the local component
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(y, pa.int64()) for y in (ids[some], links[some], ids[root[some]])], names=["vec_id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_group: dict[int, list[np.ndarray]] = {}  # by length of the vectors: the rows of the group that may go on
        held: dict[int, list[tuple]] = {}
        size: dict[int, int] = {}

        def groups(dim: int, rows: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            if dim in open_group:
                rows = [np.concatenate(two) for two in zip(open_group.pop(dim), rows)]
            key = rows[0]
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            if not last:
                open_group[dim] = [r[cuts[-2] :] for r in rows]
                cuts.pop()
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo > 1 and (got := pairs(key[lo, 0], key[lo, 1] != key[lo, 2], *(r[lo:hi] for r in rows[1:]))):
                    held.setdefault(dim, []).append(got)
                    size[dim] = size.get(dim, 0) + len(got[0]) + len(got[3]) // 16
                    if size[dim] >= 8 * BLOCK:
                        size[dim] = 0
                        if (batch := settled(held.pop(dim))) is not None:
                            yield batch

        for batch in batches:
            lengths = np.asarray(batch.column(6).value_lengths())
            for dim in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                key = np.stack([np.asarray(part.column(c)).astype(np.int64) for c in range(3)], axis=1)
                b, ids, w = (np.asarray(part.column(c)) for c in (3, 5, 7))
                yield from groups(dim, [key, b, part.column(4).to_numpy(zero_copy_only=False), ids, w, matrix(part.column(6))], False)
        for dim in list(open_group):
            yield from groups(dim, [r[:0] for r in open_group[dim]], True)
        for dim in held:
            if (batch := settled(held[dim])) is not None:
                yield batch

    found = scratch.table(stream.mapInArrow(run, "vec_id bigint, links bigint, root bigint"), "links")
    scratch.drop(meets, each)
    heads = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), scratch)
    of_class = classes.select(F.col("rep").alias("vec_id"), (F.col("w") - 1).alias("links"))
    counts = found.select("vec_id", "links").unionByName(of_class).groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    per = counts.join(heads.withColumnRenamed("id", "vec_id"), "vec_id", "left").select("vec_id", "n_links", F.coalesce("component", "vec_id").alias("component_id"))
    per = scratch.table(per, "linked")
    every = per.unionByName(copies.join(per.withColumnRenamed("vec_id", "rep"), "rep").drop("rep")).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("vec_id").join(every, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
