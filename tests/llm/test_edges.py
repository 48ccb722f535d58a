"""Every operator on null, empty, very long and repeated rows, clashing columns, and an empty table."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, langid, lattice, lines, near, packing, pii, quality, spans, styletree
from brindle.llm.queries import tokenizer, vocabularies

CLASH = "key string, n long, c long, b int, line int, version long, t string, kept string, row long, surfaces string, kind string, place int, node long, shard int, words string, lang string, source string, n_words long, n_tokens long"
EXTRA = ("k", 1, 2, 3, 4, 5, "t", "old", 6, "s", "kind", 7, 8, 9, "w", None, None, 10, 11)


def long_text(words=60_000):
    rng = random.Random(5)
    return " ".join(f"{rng.choice('bdgkl')}{rng.choice('aeiou')}{rng.randrange(4000)}" for _ in range(words))


@pytest.fixture(scope="module")
def table(spark):
    same = "A line that is long enough to count.\\nWrite to jo@mail.example.org or 415-555-2671.\\n" + " ".join(f"word{k}" for k in range(60))
    texts = [(1, None), (2, ""), (3, " \\n\\t"), (4, long_text()), (5, same), (6, same), (6, same), (6, same + " more"), (None, same), (None, None), (7, "x" * 200_000), (8, long_text() + " tail"), (9, "\\n" * 3000)]
    return spark.createDataFrame([(i, t.replace("\\n", "\n").replace("\\t", "\t") if t else t, *EXTRA) for i, t in texts], f"doc_id bigint, text string, {CLASH}").cache()


def identify(df):
    return langid.identify(df, langid.fit(df.withColumn("lang", F.when(F.col("doc_id") < 6, F.lit("aa")))))


OPERATORS = {
    "lines": lines.dedup_lines, "packing": packing.pack, "bpe": lambda df: bpe.encode(df, tokenizer("word_bpe_49k.json")), "near": near.near_duplicates,
    "quality": lambda df: quality.quality(df, vocabularies()), "langid": identify, "spans": spans.repeated_spans, "pii": lambda df: pii.pseudonymise(df, key="k"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(table, name):
    got = OPERATORS[name](table).collect()
    if name == "packing":
        words = {}
        for r in got:
            words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
        want = {}
        for r in table.collect():
            if r.text and r.text.split():
                want[r.doc_id] = want.get(r.doc_id, 0) + len(r.text.split())
        assert words == want
    else:
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in table.select("doc_id").collect())))
    if name == "lines":
        kept = {(r.doc_id, r.text): r.kept for r in got}
        assert all(v == (k[1] or "") for k, v in kept.items() if k[0] in (None, 1, 2, 3, 5, 9))
        assert {v for k, v in kept.items() if k[0] == 6} == {"", " ".join(f"word{k}" for k in range(60)) + " more"}
    if name == "near":
        comp = {r.doc_id: (r.component_id, r.kept) for r in got}
        assert comp[6] == (5, False) and comp[8] == (4, False) and comp[None] == (None, True) and comp[1] == (1, True)
    if name == "spans":
        gone = {(r.doc_id, r.n_removed, r.n_words) for r in got}
        assert {(5, 73, 73), (6, 73, 73), (6, 73, 74), (None, 73, 73), (4, 60_000, 60_000), (8, 60_000, 60_001), (7, 0, 1), (None, 0, 0)} <= gone
    if name == "pii":
        assert all((r.text is None) == (not r.kinds and r.doc_id in (1, None)) or r.doc_id not in (1,) for r in got)
        assert sum(r.kinds == ["email", "phone"] for r in got) == 5 and not any("jo@" in (r.text or "") for r in got)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(table, name):
    some = OPERATORS[name](table.limit(1)).columns
    none = OPERATORS[name](table.where("false"))
    assert none.collect() == [] and none.columns == some


def test_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0] * 4), (6, [None, 1.0, 1.0, 1.0]), (7, [float("nan"), 1.0, 1.0, 1.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0, 6.0, 8.0]), (None, v)]
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "vec_id bigint, embedding array<double>, w long, b int, cell long, rep string")
    got = [tuple(r) for r in lattice.link_vectors(df).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r[1:] for r in got}
    assert all(by[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8)) and by[None] == (0, None, True)
    assert by[1][1:] == (1, True) and by[9][1:] == (1, False) and by[2][1:] == (1, False)
    assert lattice.link_vectors(df.where("false")).collect() == []


def test_pages(spark):
    page = "<html><body><article><h1>T</h1><p>text</p></article></body></html>"
    hostile = ["<main>" * 3000 + "x", "<a " * 20_000, "<p title=\"a>t</p>" * 3000, "<div>" * 20_000 + "deep", "<div>" * 5000 + "</span>" * 5000 + "y", "<a " + "b" * 50_000 + " c=d>z", "<!--" * 9000]
    rows = [(1, "http://h/", page), (1, "http://h/", page), (None, None, page), (2, "http://h/", None), (3, "", "")] + [(10 + i, "http://x/", h) for i, h in enumerate(hostile)]
    df = spark.createDataFrame([(*r, "h", 1, "n") for r in rows], "page_id bigint, url string, html string, host string, low int, node string")
    got = {r.page_id: r.text for r in styletree.extract(df).collect()}
    assert got[1] == got[None] == "T text" and got[2] == got[3] == ""
    assert (got[10], got[13], got[14], got[15], got[16]) == ("x", "deep", "y", "z", "")
    assert styletree.extract(df.where("false")).collect() == []
