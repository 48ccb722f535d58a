import random
from pathlib import Path

import pytest

from brindle.llm import near
from brindle.llm._spark import Scratch, components


def brute(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    comp = {i: i for i in texts}
    ids = sorted(texts)
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in ids}


def family(rng, n):
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("most", [16_384, 0])
def test_components_equal_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 7)
    rng = random.Random(3)
    texts = family(rng, 40) + family(rng, 25) + ["only three words", "Only THREE words", "two words", "a", "", None, "  \n ", "b " * 300] + ["same copy of a text " * 5] * 6
    docs = [(i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, component string, key int")
    got = near.near_duplicates(df, width=3, percent=85, pairs_most=most).collect()
    want = brute(dict((d[0], d[1]) for d in docs), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert near.near_duplicates(df).collect() == []


@pytest.mark.parametrize("file_rows", [100_000, 50])
def test_files_of_components_follow_their_rows(spark, file_rows, monkeypatch):
    """However many shuffle partitions there are, a small graph is written as few files; more rows have more."""
    monkeypatch.setattr("brindle.llm._spark.FILE_ROWS", file_rows)
    monkeypatch.setattr(Scratch, "drop", lambda self, *tables: None)
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    rng = random.Random(4)
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    edges = spark.createDataFrame(pairs, "a bigint, b bigint")
    scratch = Scratch(spark)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.id: r.component for r in components(edges, scratch).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {i: i for p in pairs for i in p}
    while changed := [p for p in pairs if want[p[0]] != want[p[1]]]:
        for a, b in changed:
            want[a] = want[b] = min(want[a], want[b])
    assert got == {i: c for i, c in want.items() if i != c}
    tables = [p for p in Path(scratch.root.removeprefix("file://")).iterdir() if p.name.startswith(("large", "small"))]
    most = 1 if file_rows > len(pairs) else -(-2 * len(pairs) // file_rows)
    files = [len(list(p.glob("part-*"))) for p in tables]
    assert len(files) > 2 and max(files) <= most and (most == 1 or max(files) > 1)
