import base64
import hashlib
import math
import random
import string
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import bpe, langid, lattice, lines, packing, pii, quality, spans, styletree
from brindle.llm.queries import tokenizer, vocabularies

WS = " \t\n\x0b\f\r"
ODD = [None, "", " \n\t ", "a", "ß É Ω", "x" * 3000, "line one is long\nline one is long\n", "line one is long", "\n\n", "\x0bkey of a line\x0c\nother"]


def frame(spark, texts, **extra):
    """Texts with columns whose names operators use inside."""
    rows = [(i, t, "k", 7, "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string, n bigint, source string")


def words(text):
    return (text or "").encode().split()


# ---- line dedup ----------------------------------------------------------------------------------


def brute_lines(texts):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    holders = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in enumerate(texts):
        ls = (t or "").split("\n")
        kept = [x for x in ls if len(key(x)) < 10 or len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches,fanout", [(1, 2), (3, 2), (6, 3)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"{'A' if k % 3 else 'a'} line that repeats {k}" for k in range(12)]
    texts = ODD + ["\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(1, 90))) for _ in range(20)]
    got = lines.dedup_lines(frame(spark, texts), batches=batches, fanout=fanout).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in got} == brute_lines(texts)


def test_line_dedup_of_nothing(spark):
    assert lines.dedup_lines(frame(spark, [])).collect() == []


def test_line_index_levels(spark):
    index = lines.LineIndex(spark, fanout=2)
    for k in range(4):
        index.add(spark.createDataFrame([(k, f"shared line here\nown line number {k}")], "doc_id bigint, text string"))
    assert [len(x) for x in index.levels] == [0, 0, 1]
    assert index.runs()[0].count() == 5


# ---- spans ---------------------------------------------------------------------------------------


def brute_spans(texts, window):
    seen = Counter()
    for t in texts:
        w = words(t)
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = {}
    for d, t in enumerate(texts):
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def span_texts(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") * rng.randrange(1, 3)
    passages = [[word() for _ in range(rng.randrange(8, 60))] for _ in range(5)]
    out = list(ODD)
    for _ in range(25):
        w = []
        for _ in range(rng.randrange(1, 6)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = word() + "!"
            cut = rng.randrange(0, 4)
            w += p[cut:] + [word() for _ in range(rng.randrange(0, 12))]
        out.append(" ".join(w))
    return out + ["a b c " * 40, "z " * 100, out[-1], out[-1]]


@pytest.mark.parametrize("seed,window,k", [(1, 12, 4), (2, 20, 6), (3, 35, 12), (4, 9, 9)])
def test_repeated_spans(spark, seed, window, k):
    texts = span_texts(seed)
    got = spans.repeated_spans(frame(spark, texts), window=window, k=k).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_spans(texts, window)


# ---- BPE -----------------------------------------------------------------------------------------


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(5)
    texts = ODD + ["I'LL it's ΣΑΣ İ ½ ǅ 12345 <|endoftext|>hi<|startoftext|> 日本語 👩‍👩‍👧", "don\x1ct x\x85y"] + ["".join(rng.choice("abcdeéest!$.in g") for _ in range(200)) for _ in range(30)]
    got = {r.doc_id: (r.n_tokens, r.ids, r.decoded) for r in bpe.encode(frame(spark, texts), path).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))
    own = bpe.TrieBPE(path)
    assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


# ---- quality -------------------------------------------------------------------------------------


def test_quality_counts(spark):
    rng = random.Random(2)
    texts = ODD + ["\n".join(" ".join(rng.choice(["the", "of", "ça#", "d$|e"]) for _ in range(rng.randrange(0, 9))) for _ in range(20)) for _ in range(12)]
    got = {r.doc_id: r for r in quality.quality(frame(spark, texts), vocabularies()).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        three = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if three[tuple(w[k : k + 3])] > 1 for j in range(3)}
        ls = [x for x in (t or "").split("\n") if x.strip(WS)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(ls) - len(set(ls)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_rejects_byte_soup(spark):
    soup = " ".join(f"abcd{chr(0x12000 + (k * 37) % 900)}" for k in range(80))
    rng = random.Random(7)
    parts = "walk talk read writ sing house river field table cloud stone glass light paper over under after before".split()
    prose = " ".join(rng.choice(parts) + rng.choice(["", "ing", "ed", "s"]) for _ in range(120))
    got = {r.doc_id: r for r in quality.quality(frame(spark, [soup, prose]), vocabularies()).collect()}
    assert got[0].byte_share[0] > 0.5 and got[0].byte_share[1] > 0.5 and got[1].byte_share == [0, 0]
    assert [(got[i].base_failed, got[i].kept) for i in (0, 1)] == [(False, False), (False, True)]


def test_fertility_equals_plain_counts(spark):
    import sentencepiece
    import tiktoken

    rng = random.Random(9)
    texts = [" ".join(rng.choice(["walking", "Straße", "ещё", "x" * 30, "語", "😀", "the", "a"]) for _ in range(n)) for n in (0, 1, 7, 300)]
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabularies()[0])
    with open(vocabularies()[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    byte_level = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    raw = {i for t, i in ranks.items() if t.decode("utf-8", "ignore").encode() != t}
    for r in quality.quality(frame(spark, texts), vocabularies()).collect():
        for k, (encode, is_byte, size) in enumerate([(sp.encode, sp.is_byte, sp.get_piece_size()), (byte_level.encode_ordinary, raw.__contains__, max(ranks.values()) + 1)]):
            tokens = [i for x in texts[r.doc_id].split() for i in encode(x)]
            n = len(tokens)
            entropy = -sum(c / n * math.log2(c / n) for c in Counter(tokens).values())
            want = (n, r.word_chars / max(n, 1), sum(map(is_byte, tokens)) / max(n, 1), entropy / math.log2(max(2, min(n, size))))
            assert (r.n_tokens[k], r.chars_per_token[k], r.byte_share[k], r.entropy[k]) == pytest.approx(want)


def test_word_store_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "STORE", 50)
    v = quality._Tokens(vocabularies()[0])
    for k in range(8):
        words = [f"word{k}x{i}".encode() for i in range(30)]
        hashes = np.arange(30, dtype=np.uint64) + np.uint64(1000 * (8 - k))
        number = v.index(hashes, words.__getitem__, np.arange(30))
        at, _ = quality.gather(v.offs, number)
        assert v.ids[at].tolist() == [i for w in words for i in v.encode([w.decode()])[0]] and len(v.known) <= 60


def test_quality_bands_follow_labels(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice("walking reading houses rivers fields tables clouds stones before under".split()) + rng.choice("aeiou") for _ in range(120))
    soup = lambda: " ".join(x + rng.choice(["%%%", "&&&", "$$$"]) for x in prose().split())
    rows = [(i, soup() if i % 3 == 0 else prose(), "aa", 0 if i % 3 == 0 else 1) for i in range(150)] + [(200, soup(), "bb", 0), (201, soup(), None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int")
    path = vocabularies()
    bands = quality.fit_bands(df.where("doc_id < 100 or doc_id > 199"), df.select("doc_id", "quality"), path)
    assert list(bands) == ["aa"]
    held = {r.doc_id: r.kept for r in quality.quality(df, path, by_lang=bands).where("doc_id >= 100 and not base_failed").collect()}
    assert not any(k for i, k in held.items() if i < 200 and i % 3 == 0) and held[200] and held[201]
    assert sum(not k for i, k in held.items() if i < 200 and i % 3) <= 2


# ---- vectors -------------------------------------------------------------------------------------


def test_vectors_equal_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(lattice, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 16))
    near = np.repeat(x[:1], 60, 0) + 0.04 * rng.standard_normal((60, 16))
    rows = [v.tolist() for v in np.concatenate([x, near, x[3:5]])]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1e200] * 16, [1e-200] * 16]
    every = rows + odd
    df = spark.createDataFrame([(i, v, i, "c") for i, v in enumerate(every)], "vec_id bigint, embedding array<double>, label int, cell string")
    got = {r.vec_id: r for r in lattice.link_vectors(df).collect()}
    good = {i: np.array(v) / np.abs(v).max() for i, v in enumerate(every) if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: {j for j in good if j != i and good[i] @ good[j] >= 0.95 * np.linalg.norm(good[i]) * np.linalg.norm(good[j])} for i in good}
    comp = {i: i for i in range(len(every))}
    for _ in range(len(every)):
        for i, js in links.items():
            for j in js:
                comp[i] = comp[j] = min(comp[i], comp[j])
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (len(links.get(i, ())), comp[i]) for i in comp}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-4, 4), min_size=8, max_size=8))
def test_e8_decoding_is_nearest(v):
    import numpy as np

    x = np.array([v])
    p = lattice.nearest_e8(x)[0] / 2
    best = ((x[0] - p) ** 2).sum()
    assert all(((x[0] - p - s) ** 2).sum() >= best - 1e-9 for s in lattice.minimal_vectors())


def test_lattice_follows_the_rows():
    options = [lattice.lattice_for(n, 0.95, 5) for n in (100, 10_000, 10**6, 10**8, 10**10)]
    assert options[0] == options[1] and options[0][1:] == (1, 1.0)
    tables = [t for t, _, _ in options]
    assert tables == sorted(tables) and tables[-1] < 30 * tables[0]
    for n, (t, blocks, scale) in zip((100, 10_000, 10**6, 10**8, 10**10), options):
        assert (4 * math.pi * scale**2) ** (-4 * blocks) == pytest.approx((4 * math.pi) ** -4 * min(1, 10_000 / n))
        assert (1 - lattice.met(0.95, blocks, scale, 5)) ** t <= 2e-4


def test_classes_of_equal_vectors(spark):
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((2, 16))
    rows = [(i, [float(y) for y in x]) for i, x in enumerate([a] * 40 + [a * 2] * 30 + [b] * 20 + [a + 0.01 * b] * 10 + list(rng.standard_normal((20, 16))))]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in lattice.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    assert [got[i].n_links for i in range(len(rows))] == link.sum(axis=1).tolist()
    assert [got[i].component_id for i in (0, 69, 89, 99)] == [0, 0, 70, 0]


# ---- packing -------------------------------------------------------------------------------------


def brute_pack(items, capacity, per_source):
    """(document, bin) of every piece: all bins looked at for each."""
    seen, bins, out = Counter(x[5] for x in items), [], []
    for size, doc, _, _, source, cluster in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
        fits = [k for k, b in enumerate(bins) if b["left"] >= size and size < capacity and b["s"][source] < per_source and (seen[cluster] < 2 or cluster not in b["c"])]
        if not fits:
            bins.append({"left": capacity, "s": Counter(), "c": set()})
        k = min(fits, key=lambda k: (bins[k]["left"], k)) if fits else len(bins) - 1
        bins[k]["left"] -= size
        bins[k]["s"][source] += 1
        bins[k]["c"].add(cluster)
        out.append((doc, k))
    return out, [b["left"] for b in bins]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(0, 3), st.integers(0, 5)), max_size=60), st.integers(1, 3))
def test_packing_is_best_fit(raw, per_source):
    items = [(n, i, 0, 0, s, c) for i, (n, s, c) in enumerate(raw)]
    out = packing.pack_shard("0", list(items), 30, per_source)
    want, left = brute_pack(items, 30, per_source)
    assert [(r[0], int(r[4].split("-")[1])) for r in out] == want
    assert all(r[5] == left[k] for r, (_, k) in zip(out, want))


def test_bins_do_not_depend_on_the_session(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, "w " * rng.randrange(1, 90) + f"e{rng.randrange(40)}", f"s{i % 3}") for i in range(300)], "doc_id bigint, text string, source string")
    before = sorted(packing.pack(df, capacity=100, shard=150).collect())
    known = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sorted(packing.pack(df.repartition(9), capacity=100, shard=150).collect()) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", known)
    assert {r.bin_id.split("-")[0] for r in before} == {"0", "1"}


def test_packing_keeps_every_word(spark):
    texts = ODD + ["w " * n for n in (5, 99, 100, 101, 250)]
    got = packing.pack(frame(spark, texts), capacity=100).collect()
    for i, t in enumerate(texts):
        mine = sorted((r.start, r.n_words) for r in got if r.doc_id == i)
        assert sum(n for _, n in mine) == len(words(t))
        assert [s for s, _ in mine] == list(range(0, len(words(t)), 100))


# ---- PII -----------------------------------------------------------------------------------------


def test_surrogates(spark):
    texts = ["Mail Bob@x.example.org, bob@x.example.org; +1 (283) 555-6500 or 283-555-6500.", "Mr. John Smith and Mrs Anna Smith; Г-жа Анна Иванова", "password=e3b3ed3cc8548923d6 4777431686562174 61.131.143.218", None, "", "nothing 12.5 here 1999"]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts), key="k").collect()}
    for secret in ("Bob@", "bob@", "555-6500", "Smith", "Anna", "Анна", "e3b3ed3cc8548923d6", "4777431686562174", "61.131"):
        assert not any(secret in (r.text or "") for r in got.values())
    mails = [w.strip(",;") for w in got[0].text.split() if "@" in w]
    assert mails[0] == mails[1] and got[0].n_entities == 4
    first, second = got[0].text.split("; ")[1].rstrip(".").split(" or ")
    assert first.replace("(", "").replace(") ", "-").removeprefix("+1 ") == second
    name, other = got[1].text.split("; ")[0].split(" and ")
    assert name.split()[-1] == other.split()[-1] and name.startswith("Mr. ")
    assert (got[3].text, got[4].text, got[5].text) == (None, "", texts[5])
    again = {r.doc_id: r.text for r in pii.pseudonymise(frame(spark, texts), key="k").collect()}
    assert again == {i: r.text for i, r in got.items()}
    assert pii.pseudonymise(frame(spark, texts), key="other").collect() != list(got.values())


def test_surrogates_stay_distinct(spark):
    texts = [f"a.{i}@mail.example.com 10.{i // 200}.{i % 200}.1" for i in range(300)]
    got = [r.text.split() for r in pii.pseudonymise(frame(spark, texts), key="k").collect()]
    assert len({x[0] for x in got}) == 300 and len({x[1] for x in got}) == 300
    assert not {x[1] for x in got} & {f"10.{i // 200}.{i % 200}.1" for i in range(300)}


def test_surrogates_of_grouped_cards(spark):
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "2221 0000 0000 0009", "3782 822463 10005", "3782-822463-10005"]
    texts = [f"pay by {c}, thanks" for c in cards] + ["call 415-555-2671 415-555-2672 or 4930 1234 5678"]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts), key="k").collect()}
    digits = ["".join(filter(str.isdigit, got[i].text)) for i in range(6)]
    assert all(got[i].kinds == ["card"] for i in range(6)) and digits[0] == digits[1] == digits[2] and digits[4] == digits[5]
    assert [len(d) for d in digits] == [16, 16, 16, 16, 15, 15]
    assert digits[0][4:] != "1" * 12 and digits[0][12:] != "1111" and digits[3][12:] != "0009"
    assert [got[i].text.translate(dict.fromkeys(map(ord, "0123456789"), "#")) for i in (0, 1)] == ["pay by #### #### #### ####, thanks", "pay by ####-####-####-####, thanks"]
    assert got[6].kinds == ["phone"] * 3


def test_surrogates_of_values_without_letters_or_digits(spark):
    texts = ["Password: ________", "password=--------", "pwd=~~~~~~~~ x", "Password: ________ again", "password=a_______"]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts), key="k").collect()}
    assert all(r.kinds == ["secret"] and "___" not in r.text and "---" not in r.text or i == 4 for i, r in got.items())
    assert got[0].text + " again" == got[3].text and len({got[i].text.split()[-1] for i in (0, 1, 4)}) == 3


def test_surrogates_beyond_the_smallest_space(spark):
    texts = [f"{a}@{b}.example.org and password={a}_____" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghij"]
    got = [r.text for r in pii.pseudonymise(frame(spark, texts), key="k").collect()]
    assert len({t.split()[0] for t in got}) == 260 and len({t.split("=")[1] for t in got}) == 26


def test_coreference_within_a_text(spark):
    texts = [
        "Mr Smith met John Smith; Smith left. Smith's dog, O'Brien and Smithson stayed.",
        "Yesterday Frau Ada Weber sang. Later Weber slept, so Ada left.",
        "Smith without a title stays, as do ISBN 978-3-16-148410-0 and 12.5.",
        "call 4155552671 or 415-555-2671",
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts), key="k").collect()}
    for i, gone in ((0, ["Smith ", "Smith;", "Smith'", "John"]), (1, ["Ada", "Weber"]), (3, ["2671"])):
        assert not any(x in got[i].text for x in gone)
    w = got[0].text.split()
    assert w[1] == w[4].rstrip(";") == w[5] == w[7].removesuffix("'s") and w[0] == "Mr" and got[0].text.endswith("O'Brien and Smithson stayed.")
    v = got[1].text.replace(".", "").replace(",", "").split()
    assert v[:2] == ["Yesterday", "Frau"] and v[3] == v[6] and v[2] == v[9]
    assert got[2].text == texts[2] and got[2].n_entities == 0
    a, b = got[3].text.removeprefix("call ").split(" or ")
    assert a == b.replace("-", "") and got[3].kinds == ["phone", "phone"]


def test_surrogates_of_repeated_and_null_ids(spark):
    rows = [(1, "mail x.y@mail.example.org"), (1, "phone 415-555-2671"), (None, "ip 61.131.143.218"), (1, None), (None, "plain")]
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), key="k").collect()
    assert sorted(r.kinds for r in got) == [[], [], ["email"], ["ip"], ["phone"]]
    assert all("mail " not in (r.text or "") or "phone" not in r.text for r in got) and len(got) == 5


def test_surrogates_equal_direct_reading(spark):
    """The patterns applied one text after the other: what is around entities stays, and entities map one to one."""
    rng = random.Random(3)
    made = {
        "email": lambda: f"{rng.choice(['ann.b', 'Q', 'x_1'])}{rng.randrange(30)}@mail{rng.randrange(3)}.example.net",
        "ip": lambda: f"{rng.randrange(1, 255)}.{rng.randrange(9)}.7.{rng.randrange(9)}",
        "ssn": lambda: f"{rng.randrange(100, 999)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}",
        "phone": lambda: rng.choice(["({}) 555-{}", "{}-555-{}", "{} 555 {}"]).format(rng.randrange(200, 210), rng.randrange(1000, 1020)),
        "card": lambda: f"4{rng.randrange(10**14, 10**15)}",
        "hex": lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        "iban": lambda: f"DE{rng.randrange(10, 99)} {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)} {rng.randrange(1000, 9999)} {rng.randrange(10, 99)}",
        "keyid": lambda: "AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)),
    }
    texts, want = [], []
    for _ in range(120):
        kinds = [rng.choice(list(made)) for _ in range(rng.randrange(4))]
        values = [made[k]() for k in kinds]
        gaps = [rng.choice(["so ", "und, ", "ещё ", "", "x\n"]) for _ in range(len(kinds) + 1)]
        texts.append(gaps[0] + "".join(f"[{v}] {g}" for v, g in zip(values, gaps[1:])))
        want.append((kinds, values, gaps))
    got = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts), key="k").collect()}
    stands: dict = {}
    for i, (kinds, values, gaps) in enumerate(want):
        assert got[i].kinds == kinds and got[i].n_entities == len(kinds)
        pieces = got[i].text.split("[")
        assert pieces[0] == gaps[0]
        for kind, value, piece, gap in zip(kinds, values, pieces[1:], gaps[1:]):
            stand, rest = piece.split("]")
            assert rest == " " + gap
            norm = (lambda x: "".join(filter(str.isdigit, x))[-10:]) if kind == "phone" else str.lower
            assert stands.setdefault((kind, norm(value)), norm(stand)) == norm(stand)
            if kind not in ("email", "ip"):
                assert [c.isdigit() for c in stand] == [c.isdigit() for c in value] or kind in ("hex", "keyid")
    for kind in made:
        mine = {n: s for (k, n), s in stands.items() if k == kind}
        assert len(set(mine.values())) == len(mine) and not set(mine) & set(mine.values())


# ---- languages -----------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(1)
    stock = {"aa": ["taro", "mino", "sela"], "bb": ["krst", "vlzn", "prht"]}
    rows = [(i, " ".join(rng.choice(stock[x]) for _ in range(12)), x) for i in range(60) for x in [rng.choice(["aa", "bb"])]]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(frame(spark, ["taro mino", "vlzn krs", None, "", "12 ! 3", "minoselat"]), model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["aa", "bb", "und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].score == 0


def test_language_id_learns_rare_languages(spark):
    rows = [(i, "taro mino sela", "aa") for i in range(3000)] + [(5000, "krst vlzn prht", "bb"), (5001, "krst prht", "bb")] + [(6000 + k, f"w{x} only", x * 2) for k, x in enumerate("cdefgh")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), fit_rows=100)
    assert model.langs == ["aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh"]
    got = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, ["taro mino", "vlzn krst"]), model).collect()}
    assert got == {0: "aa", 1: "bb"}


# ---- pages ---------------------------------------------------------------------------------------

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href='/a'>home</a></ul></nav><!-- x --><div class=\"ad\">buy</div>{}<footer>&copy; me</footer></body></html>"


@pytest.mark.parametrize("article,text", [
    ("<article><h1>Head &amp; more</h1><p><b>One\n two<br><p>three</p><aside>no</aside><div id='comments'>hi</div></article>", "Head & more One two three"),
    ("<main><header><h1>H</h1></header><p>x<script>1</script>y</p><form>z</form></main>", "H xy"),
    ("<div class=content><p>only text</div>", "only text"),
    ("<article>a &lt;b&gt; &#233;<p hidden>no</p>", "a <b> é"),
])
def test_main_text(article, text):
    assert styletree.main_text(PAGE.replace("{}", article), frozenset()) == text


def test_extract_uses_the_site(spark):
    bodies = [f"<div class=top>Welcome to us</div><div class=body><p>Story number {i} {string.ascii_letters[i]}</p></div>" for i in range(20)]
    rows = [(i, "http://h.example/x", f"<html><body>{b}</body></html>", "host") for i, b in enumerate(bodies)] + [(90, None, None, "h"), (91, "http://h.example/", "", "h")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = {r.page_id: r.text for r in styletree.extract(df).collect()}
    assert got[3] == "Story number 3 d" and got[90] == "" and got[91] == "" and len(got) == 22


def site(spark, page, n=20):
    """Texts of ``n`` pages of one host; ``page`` makes the body of the i-th."""
    rows = [(i, "http://h.example/x", f"<html><body>{page(i)}</body></html>") for i in range(n)]
    return {r.page_id: r.text for r in styletree.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}


def test_extract_keeps_what_differs_among_much_that_is_alike(spark):
    got = site(spark, lambda i: f"<div class=top>Welcome to us</div><div class=body><p>Story number {i}</p></div><div class=end>Call again</div>")
    assert got == {i: f"Story number {i}" for i in range(20)}


def test_extract_keeps_text_below_many_wrappers(spark):
    wraps = [f"<div class=w{k}>" for k in range(12)]
    got = site(spark, lambda i: f"<div class=top>Welcome to us</div>{''.join(wraps)}<p>Story number {i}</p>{'</div>' * 12}")
    assert got == {i: f"Story number {i}" for i in range(20)}


def test_extract_judges_inside_articles(spark):
    got = site(spark, lambda i: f"<article><h1>Title {i}</h1><p>Story <b>Note</b> number {i}</p><div class=who><p>By our staff</p></div><div class=box><a>Send</a> <a>Print</a></div></article>")
    assert got == {i: f"Title {i} Story Note number {i}" for i in range(20)}


def test_extract_keeps_one_article_under_many_urls(spark):
    assert set(site(spark, lambda i: "<article><h1>Title</h1><p>Story</p></article>").values()) == {"Title Story"}


@pytest.mark.parametrize("body,text", [
    ("<div class='layout with-sidebar'><article><p>text</article><div class=sidebar>no</div></div>", "text"),
    ("<div class='layout no-sidebar'><p>text</p></div>", "text"),
    ("<div class='layout left-sidebar'><article><p>text</article></div>", "text"),
    ("<main><div class='sidebar-layout'><article><p>text</article></div></main>", "text"),
    ("<article><div class='article-header'><h1>Head</h1></div><p>text</article>", "Head text"),
    ("<article><div class='header'><h2>Head</h2></div><p>text<div class='related'><h2>no</h2></div></article>", "Head text"),
    ("<div class='banner-top'><h1>Head</h1></div><p>text", "Head text"),
    ("<article><p>text<div class='share-buttons'>no</div><div id=site-footer>no</div><div class='post-share x'>no</div></article>", "text"),
    ("<main><article><p>text</article><div id=comments><article><h2>no</h2></article></div></main>", "text"),
])
def test_names_of_parts(body, text):
    assert styletree.main_text(PAGE.replace("{}", body), frozenset()) == text
