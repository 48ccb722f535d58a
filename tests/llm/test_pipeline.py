"""Each stage against a direct reading of its rule, on the smallest data folder."""

import random

import pytest

import corpus_pipeline as P
from brindle.llm import quality
from brindle.llm.queries import vocabularies

from .test_near import brute
from .test_text_operators import brute_lines


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    texts = []
    for k in range(30):
        lines = [" ".join(f"{rng.choice('bdgklmnprst')}{rng.choice('aeiou')}{rng.choice('nrst')}{rng.randrange(90)}" for _ in range(rng.randrange(6, 14))) for _ in range(8)]
        texts.append("\n".join(lines))
    texts += [texts[3], texts[4] + " and one more", "too short", None, "", texts[5] + "\nwrite to me.too@mail.example.org"]
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), "extra") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")


def test_stages(spark, docs):
    verdict = {r.doc_id: r.kept for r in quality.quality(docs, vocabularies()).collect()}
    at = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        at[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == list(P.COLUMNS)
    assert set(at["quality_rules"]) == {i for i, k in verdict.items() if k} and len(at["quality_rules"]) >= 30
    ids = sorted(at["quality_rules"])
    want = brute_lines([at["quality_rules"][i].text for i in ids])
    assert {i: at["line_dedup"][i].text for i in ids} == {i: want[k][2] for k, i in enumerate(ids)}
    comp = brute({i: r.text for i, r in at["line_dedup"].items()}, 5, 80)
    assert set(at["near_dedup"]) == {i for i in comp if comp[i][1] == i}
    assert set(at["pii"]) == set(at["near_dedup"])
    assert not any("me.too@" in r.text for r in at["pii"].values())
    assert all(r.n_chars == len(r.text) for r in at["pii"].values())
    packed = P.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in packed} == {i for i, r in at["pii"].items() if r.text.split()}


def test_run_on_a_folder(spark, docs, tmp_path):
    docs.drop("kept").write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() > 0
