"""MinHash near-duplicates of documents, with exact confirmation.

1. Every text becomes the set of its distinct word shingles (hashed to 64 bits), a fingerprint of the
   set, ``bands * rows`` universal hash minima and one key per band.
2. Equal sets form a class with one representative, so copies are never compared.
3. Members of a band bucket are paired with one member of the bucket (a star, not all pairs): in a fifth of
   the bands first, then in the others where the two are not yet in one component.  A pair is dropped when
   set sizes or the minima rule it out, else confirmed on the full sets.
4. Components by large-star / small-star.  Only buckets whose members still lie in different components
   are looked at again, and there only pairs across components: all of them, so no link is lost that the
   bands bring together (a pair at the threshold is missed with probability (1 - t**rows)**bands, 4e-7
   for the defaults at 0.85).

Null, empty and word-less texts have an empty set and link with nothing.  Extra columns are ignored; an
empty table gives an empty result.  Copies and ties fall to the smallest id.  Rows of one id are one document that
links with whatever any of them links with; rows with a null id link with nothing and are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, components, partitions
from ._text import U, Words, mix, ragged, signed, text_chunks

BLOCK = 512  # documents of a block in a large bucket
CHUNKS = 64  # partners of one document that are compared in one run


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sorted distinct shingle hashes of each text; fewer words than ``width`` make one shingle."""
    mult = [U(int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") | 1) for i in range(width)]
    for lo, _, data, offs in text_chunks(column):
        w = Words(data, offs, lower=True)
        h = w.hashes()
        n = len(h)
        if n >= width:
            key = np.zeros(n - width + 1, dtype=np.uint64)
            for i in range(width):
                key = mix(key + h[i : n - width + 1 + i] * mult[i])
        sets = []
        for first, count in zip(w.first[:-1].tolist(), w.count.tolist()):
            if count >= width:
                sets.append(np.unique(key[first : first + count - width + 1]))
            elif count:
                x = np.full(1, count, dtype=np.uint64)
                for v in h[first : first + count]:
                    x = mix(x * mult[0] + v)
                sets.append(x)
            else:
                sets.append(np.zeros(0, dtype=np.uint64))
        yield lo, sets


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | U(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each hash (a * x + b) mod 2**64 its least value, of which the upper half is kept."""
    out = np.full(len(a), ~U(0), dtype=np.uint64)
    for i in range(0, len(values), 1024):
        part = values[i : i + 1024]
        np.minimum(out, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return (out >> U(32)).astype(np.uint32)


SIGNATURES = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, signature array<bigint>, keys array<bigint>"


def signatures(docs: DataFrame, width: int, bands: int, rows: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(bands * rows, seed)
        longs = -(-bands * rows // 8)
        pad = np.zeros(8 * longs - bands * rows, np.uint8)
        for batch in batches:
            for lo, sets in shingle_sets(batch.column(1), width):
                marks = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets])
                sigs, keys, counts = [], [], []
                for s in sets:
                    counts.append(bands if len(s) else 0)
                    if not len(s):
                        sigs.append(np.zeros(longs, np.int64))
                        continue
                    m = minima(s, a, b)
                    sigs.append(np.concatenate([m.astype(np.uint8), pad]).view(np.int64))
                    k = np.arange(bands, dtype=np.uint64)
                    for col in m.reshape(bands, rows).T:
                        k = mix(k * U(0x9E3779B97F4A7C15) + col)
                    keys.append(k)
                flat = signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), ragged(np.concatenate(sigs), np.full(len(sets), longs), pa.int64()), ragged(flat, np.array(counts), pa.int64())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "keys"],
                )

    return docs.mapInArrow(run, SIGNATURES)


def least_equal(percent: int, bands: int, rows: int) -> int:
    """Equal minima that a pair at the threshold has but for 4.5 standard deviations; the padding bytes count as equal."""
    t, n = percent / 100, bands * rows
    return int((t - 4.5 * (t * (1 - t) / n) ** 0.5) * n) + 8 * (-(-n // 8)) - n


def equal_minima(x: str, y: str, n: int) -> str:
    """SQL: how many of the bytes of two signatures (arrays of longs) are equal."""
    out = []
    for i in range(-(-n // 8)):
        v = f"({x}[{i}] ^ {y}[{i}])"
        a = f"({v} | (shiftrightunsigned({v}, 4) & {0x0F0F0F0F0F0F0F0F}L))"
        b = f"({a} | (shiftrightunsigned({a}, 2) & {0x0303030303030303}L))"
        out.append(f"bit_count(({b} | shiftrightunsigned({b}, 1)) & {0x0101010101010101}L)")
    return f"{8 * len(out)} - (" + " + ".join(out) + ")"


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Those of ``pairs`` (p, x, distinct) whose sets have 100 * intersection >= percent * union.

    The partners of one p are cut into runs; each run is p's text followed by its partners, read as a
    stream, so memory holds one set at a time however many partners there are.
    """
    n = partitions(pairs.sparkSession)
    sized = pairs.join(pairs.groupBy("p").agg(F.count("*").alias("c")), "p")
    dealt = sized.select("p", F.expr(f"pmod(xxhash64(x, 7), int((c + {CHUNKS - 1}) div {CHUNKS}))").alias("run"), "x")
    both = F.explode(F.array(F.struct(F.col("x").alias("doc_id"), F.lit(1).alias("part")), F.struct(F.col("p").alias("doc_id"), F.lit(0).alias("part")))).alias("b")
    need = dealt.select("p", "run", both).select("p", "run", "b.doc_id", "b.part").distinct()
    stream = need.join(texts, "doc_id").repartition(n, "p", "run").sortWithinPartitions("p", "run", "part", "doc_id").select("p", "text", "run", "doc_id", "part", "signature", "n_shingles")
    least = least_equal(percent, bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = own = mine = None
        for batch in batches:
            p, part, ids = batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(3).to_pylist()
            sigs, size = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            for i in range(batch.num_rows):
                if part[i] == 0:
                    (_, (own,)), = shingle_sets(batch.column(1).slice(i, 1), width)
                    mine, head = np.array(sigs[i], dtype=np.int64).view(np.uint8), p[i]
                    continue
                assert head == p[i]
                if 100 * min(len(own), size[i]) < percent * max(len(own), size[i]):
                    continue
                if np.count_nonzero(mine == np.array(sigs[i], dtype=np.int64).view(np.uint8)) < least:
                    continue
                (_, (other,)), = shingle_sets(batch.column(1).slice(i, 1), width)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    yield pa.RecordBatch.from_pydict({"a": pa.array([p[i]], pa.int64()), "b": pa.array([ids[i]], pa.int64())})

    return stream.mapInArrow(run, "a bigint, b bigint")


def across_blocks(members: DataFrame, texts: DataFrame, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Links across components in large buckets (``key, doc_id, comp, main, m, u``).

    Members outside the bucket's main component are dealt into blocks, all members too, and every block
    of the one meets every block of the other: a bounded number of texts, compared by one product of
    shingle indicators.  Of a document's links into one component the first is returned, as one joins them.
    """
    n = partitions(members.sparkSession)
    cut = members.select("key", "doc_id", "comp", (F.col("comp") != F.col("main")).alias("out"), F.expr(f"int(ceil(u / {BLOCK}))").alias("nu"), F.expr(f"int(ceil(m / {BLOCK}))").alias("nm"))
    one = cut.where("out").select("key", "doc_id", "comp", F.expr("int(pmod(xxhash64(doc_id, 5), nu))").alias("i"), F.explode(F.expr("sequence(0, nm - 1)")).alias("j"), F.lit(0).alias("side"))
    two = cut.select("key", "doc_id", "comp", F.explode(F.expr("sequence(0, nu - 1)")).alias("i"), F.expr("int(pmod(xxhash64(doc_id, 9), nm))").alias("j"), F.lit(1).alias("side"))
    stream = one.unionByName(two).join(texts.select("doc_id", "text", "signature"), "doc_id").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "doc_id", "comp", "side", "text", "signature")
    least = least_equal(percent, bands, rows)

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        ids, comp, side = (np.asarray(t.column(c)) for c in (3, 4, 5))
        sig = np.asarray(t.column(7).flatten(), dtype=np.int64).view(np.uint8).reshape(t.num_rows, -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = np.zeros((len(a), len(b)), dtype=bool)
        for k, r in enumerate(a):
            near[k] = ((sig[b] == sig[r]).sum(axis=1) >= least) & (comp[b] != comp[r])
        if not near.any():
            return None
        sets = [s for _, part in shingle_sets(t.column(6), width) for s in part]
        size = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        values, at = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        common = np.zeros((len(a), len(b)), dtype=np.float32)
        place = np.zeros(t.num_rows, dtype=np.int64)
        place[a], place[b] = np.arange(len(a)), np.arange(len(b))
        for lo in range(0, len(values), 8192):  # indicators of some shingles at a time
            inside = (at >= lo) & (at < lo + 8192)
            width_ = min(8192, len(values) - lo)
            x, y = np.zeros((len(a), width_), np.float32), np.zeros((len(b), width_), np.float32)
            left = inside & (side[row] == 0)
            right = inside & (side[row] == 1)
            x[place[row[left]], at[left] - lo] = 1
            y[place[row[right]], at[right] - lo] = 1
            common += x @ y.T
        both = np.rint(common).astype(np.int64)
        linked = near & (100 * both >= percent * (size[a][:, None] + size[b][None, :] - both))
        out = []
        for k in range(len(a)):
            ys = b[np.flatnonzero(linked[k])]
            if len(ys):
                _, first = np.unique(comp[ys], return_index=True)
                out += [(int(ids[a[k]]), int(ids[y])) for y in ys[first]]
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            k = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)], axis=1)
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)]):
                if lo == hi:
                    continue
                this = tuple(k[lo].tolist())
                if this != key:
                    if held and (got := compare(held)) is not None:
                        yield got
                    key, held = this, []
                held.append(batch.slice(lo, hi - lo))
        if held and (got := compare(held)) is not None:
            yield got

    return stream.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = 25, rows: int = 5, seed: int = 11, pairs_most: int = 2_048
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``percent`` is the least Jaccard similarity in hundredths (80 and more suit the default bands).
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = scratch.table(signatures(docs, width, bands, rows, seed), "signatures")
    some = sigs.where("n_shingles > 0 and doc_id is not null")
    # as a table of its own, so that the join below can split the partition of a large group of copies
    classes = scratch.table(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"), "classes")
    copies = scratch.table(
        some.select("doc_id", "set_a", "set_b", "n_shingles").join(classes, ["set_a", "set_b", "n_shingles"]).where("doc_id <> rep").select("doc_id", "rep"), "copies"
    )
    reps = some.join(copies.select("doc_id"), "doc_id", "left_anti")
    slots = reps.select("doc_id", "n_shingles", F.posexplode("keys").alias("band", "key"))
    # the centre of a star: smallest in an order of the ids that differs from bucket to bucket, so that a
    # member meets a different partner in each of its buckets
    shared = slots.groupBy("key").agg(F.min(F.expr("doc_id ^ key")).alias("m"), F.count("*").alias("c")).where("c > 1").select("key", F.expr("m ^ key").alias("p"))
    slots = scratch.table(slots.join(shared, "key").select("key", "band", "doc_id", "n_shingles", "p"), "slots")
    involved = slots.select("doc_id").distinct()
    texts = scratch.table(docs.join(involved.join(sigs.select("doc_id", "n_shingles", "signature"), "doc_id").hint("merge"), "doc_id"), "texts")
    # a star in every bucket of the first bands, then in those of the others where it joins two components
    first = -(-bands // 5)
    star = slots.where("doc_id <> p")
    apart = F.least("p", "doc_id").alias("p"), F.greatest("p", "doc_id").alias("x")
    early = scratch.table(star.where(F.col("band") < first).select(*apart).distinct(), "pairs")
    links = scratch.table(confirm(early, texts, width, percent, bands, rows), "links")
    heads = components(links, scratch)
    place = heads.select(F.col("id").alias("doc_id"), "component")
    centres = star.where(F.col("band") >= first).select("key", "p").distinct()
    centres = centres.join(place.select(F.col("doc_id").alias("p"), F.col("component").alias("cp")), "p", "left").select("key", F.coalesce("cp", "p").alias("cp"))
    late = star.where(F.col("band") >= first).join(place, "doc_id", "left").join(centres, "key").where("coalesce(component, doc_id) <> cp")
    late = scratch.table(late.select(*apart).distinct().join(early, ["p", "x"], "left_anti"), "pairs")
    linked = scratch.table(confirm(late, texts, width, percent, bands, rows), "links")
    if linked.head(1):
        heads = components(links.union(linked), scratch)
    pairs = early.union(late)
    # buckets that still hold several components: every pair across them
    placed = slots.join(heads, slots.doc_id == heads.id, "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("comp"))
    placed = scratch.table(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("c")).where("low <> high")
    main = placed.join(mixed.select("key"), "key").groupBy("key", "comp").agg(F.count("*").alias("c"))
    main = main.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    mixed = scratch.table(placed.join(main, "key").join(sigs.select("doc_id", "signature"), "doc_id"), "mixed")
    # small buckets: pairs; large ones: blocks, which return links only
    sizes = mixed.groupBy("key").agg(F.count("*").alias("m"), F.count_if(F.expr("comp <> main")).alias("u"))
    sized = scratch.table(mixed.join(sizes, "key"), "sized")
    few = sized.where(f"u * m <= {pairs_most}")
    one = few.where("comp <> main").select("key", F.col("doc_id").alias("x"), F.col("n_shingles").alias("nx"), F.col("comp").alias("cx"), F.col("signature").alias("sx"))
    two = few.select("key", F.col("doc_id").alias("y"), F.col("n_shingles").alias("ny"), F.col("comp").alias("cy"), F.col("signature").alias("sy"))
    alike = f"{equal_minima('sx', 'sy', bands * rows)} >= {least_equal(percent, bands, rows)}"
    across = one.join(two, (one.key == two.key) & F.expr(f"cx <> cy and 100 * least(nx, ny) >= {percent} * greatest(nx, ny) and {alike}"))
    across = across.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("x")).distinct()
    more = scratch.table(across.join(pairs, ["p", "x"], "left_anti"), "across")
    found = confirm(more, texts, width, percent, bands, rows)
    if sized.where(f"u * m > {pairs_most}").head(1):
        found = found.union(across_blocks(sized.where(f"u * m > {pairs_most}"), texts, width, percent, bands, rows))
    found = scratch.table(found, "found")
    scratch.drop(slots, texts, early, late, placed, mixed, sized, more)
    if found.head(1):
        known = heads.select("id", "component")
        lifted = (
            found.join(known.withColumnRenamed("id", "a").withColumnRenamed("component", "ca"), "a", "left")
            .join(known.withColumnRenamed("id", "b").withColumnRenamed("component", "cb"), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        )
        top = components(lifted, scratch)
        above = top.select(F.col("id").alias("component"), F.col("component").alias("up"))
        heads = heads.join(above, "component", "left").select("id", F.coalesce("up", "component").alias("component")).union(top.select("id", "component").join(heads.select("id"), "id", "left_anti"))
    of_rep = heads.select(F.col("id").alias("doc_id"), "component")
    of_copy = copies.join(heads, copies.rep == heads.id, "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    placed = scratch.table(of_rep.union(of_copy).groupBy("doc_id").agg(F.min("component").alias("component")), "components")
    scratch.drop(copies, links, linked, found)
    out = sigs.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
