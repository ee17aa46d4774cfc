"""Text operators: round trips, brute force, held-out accuracy and edge cases."""

import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from votaria.llm import leakage, mixing, personal, textform
from votaria.llm.boosting import Boosted


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- look-alike texts ----


def disguise(text, r):
    swaps = {b: a for a, b in textform.LOOKALIKES.items() if len(b) == 1}
    out = []
    for c in text:
        u = r.random()
        if u < 0.1 and c in swaps:
            c = swaps[c]
        elif u < 0.2 and "!" <= c <= "~":
            c = chr(ord(c) + 0xFEE0)
        elif u < 0.3 and c == " ":
            c = r.choice("   ")
        elif u < 0.4:
            c = unicodedata.normalize("NFD", c)
        out.append(c + (r.choice("​­⁠﻿") if r.random() < 0.1 else ""))
    return "".join(out)


def test_disguised_texts_come_back():
    r = random.Random(5)
    for text in ["Frågan är öppen, 12 345 kr på § 7.", "Första raden\nandra raden: ÅÄÖ é", "x² + ½ m³ «ja»"]:
        for _ in range(50):
            assert textform.visual_form(disguise(text, r)) == textform.visual_form(text)


@pytest.mark.parametrize("a, b", [("Ja", "ja"), ("får", "far"), ("x²", "x2"), ("½", "1/2"), ("a\nb", "a b"), ("rn", "m"), ("α", "a"), ("", "x")])
def test_different_texts_stay_apart(a, b):
    assert textform.visual_form(a) != textform.visual_form(b)


def test_comparison_form_ignores_case():
    assert textform.comparison_form("STRASSE  Ｘ²") == textform.comparison_form("straße x2")


def test_canonically_equal_texts_have_one_form():
    letters = [*textform.LOOKALIKES, *"όίѐёїӓӧйЙÅŚśﬁＡ½²"]
    for c in letters:
        for mark in ("", "\u0301", "\u0308", "\u0300", "\u0306"):
            forms = {textform.visual_form(unicodedata.normalize(f, "x" + c + mark + "y")) for f in ("NFC", "NFD")}
            assert len(forms) == 1, (c, mark, forms)
            assert textform.visual_form(forms.copy().pop()) == forms.pop()
    assert textform.visual_form("\u03cc") == textform.visual_form("\u03bf\u0301") == "ó"


def test_both_engines_give_one_form(spark):
    texts = ["abc" + end for end in ("", "\r", "\u0085", "\u2028", "\n", " \n", "  ", "\r\n", "\x0b", "\u2029", " \u00a0")] + ["a \nb ", "  a", "x\u200b"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumn("v", textform.to_visual("text")).orderBy("i").collect()]
    assert got == [textform.visual_form(t) for t in texts]


def test_equal_forms_are_in_one_block():
    r = random.Random(8)
    for text in ["Straße ﬁn ＡBC", "İstanbul ſ K", "x² ½ µ Ω"]:
        for _ in range(30):
            d = disguise(text, r)
            if textform.visual_form(d) == textform.visual_form(text):
                assert textform.comparison_form(d) == textform.comparison_form(text)


def test_a_large_class_is_spread(spark):
    data = [("f", f"{i:03d}", "hej" if i % 3 else "hеj") for i in range(60)]
    df = spark.createDataFrame(data, "field string, key string, text string")
    want = sorted((a[1], b[1]) for a in data for b in data if a[1] < b[1] and a[2] != b[2])
    for n in (1_000, 7):
        assert [r[1:] for r in rows(textform.lookalike_pairs(df, ["field"], "key", "text", n))] == want


def test_pairs_and_edge_cases(spark):
    data = [("f", "a", "hej du"), ("f", "b", "hеj du"), ("f", "c", "hej du"), ("f", "d", "annat"), ("g", "a", "hеj du"), ("f", None, "hеj du"), ("f", "e", None), ("f", "h", ""), ("f", "i", "​"), ("f", "b", "hеj du"), ("f", "l", "x" * 200_000)]
    df = spark.createDataFrame(data, "field string, key string, text string").withColumn("form_idx", F.lit(1))
    got = rows(textform.lookalike_pairs(df, ["field"], "key", "text"))
    assert got == [("f", "a", "b"), ("f", "b", "c"), ("f", "h", "i")]
    assert textform.lookalike_pairs(df.where("false"), ["field"], "key", "text").count() == 0
    assert rows(df.select(textform.to_visual("text")).where("text is null").limit(1)) in ([], [(None,)])


# ---- leaks ----


def corpus():
    r = random.Random(2)
    vocabulary = [f"ord{i}" for i in range(300)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([5, 11, 12, 13, 20, 40, 80, 200])))) for i in range(24)]
    documents = []
    for d in range(80):
        words = r.choices(vocabulary, k=r.randrange(0, 300))
        if d % 2:
            item = items[r.randrange(24)][1].split()
            n = r.choice([11, 12, 13, 30, 60, 100])
            start = r.randrange(max(1, len(item) - n + 1))
            words[len(words) // 2 : len(words) // 2] = [w.upper() + r.choice(["", ",", "."]) for w in item[start : start + n]]
        documents.append((d, "\n".join(words) if d % 5 == 0 else "  ".join(words)))
    return items, [*documents, (90, None), (91, ""), (None, items[4][1]), (1, documents[1][1])]


@pytest.mark.parametrize("share, few", [(0.0, 500_000), (0.0, 0), (0.5, 500_000), (0.9, 0)])
def test_leaks_equal_brute_force(spark, share, few):
    items, documents = corpus()
    norm = lambda t: leakage.words_of(t or "")
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    want = {}
    for d, t in documents:
        for i, x in items:
            run = leakage.run_length(len(norm(x)), share=share)
            if d is not None and grams(norm(t), run) & grams(norm(x), run):
                want[d, i] = len(grams(norm(t), 5) & grams(norm(x), 5)) / len(grams(norm(x), 5))
    df = spark.createDataFrame(documents, "doc_id long, text string").withColumn("passage", F.lit("clash")).withColumn("window", F.lit(1))
    ev = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leakage.leaks(df, ev, share=share, broadcast_rows=few).collect()}
    assert got.keys() == want.keys() and want
    assert all(got[k].containment == pytest.approx(want[k]) and 0 < got[k].estimate <= 1 and got[k].passages for k in want)
    if few:
        assert leakage.leaks(df, ev.where("false"), share=share).count() == 0
        assert leakage.leaks(df.where("false"), ev, share=share).count() == 0


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    from votaria.llm import bitfilter

    items, documents = corpus()
    df, ev = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    pairs = lambda: {(r.doc_id, r.item_id) for r in leakage.leaks(df, ev).collect()}
    want = pairs()
    monkeypatch.setattr(bitfilter, "build", lambda *a: np.full(4096, 255, dtype=np.uint8))
    assert pairs() == want and want


def test_the_filter_grows_with_the_hashes(spark):
    from votaria.llm import bitfilter

    df = spark.range(3_000).select(F.xxhash64("id").alias("h"))
    bits = bitfilter.build(df, "h", 3_000)
    assert len(bits) * 8 == bitfilter.size_for(3_000) >= 16 * 3_000
    own = np.array([r.h for r in df.collect()], dtype=np.int64)
    assert bitfilter.passes(bits, own).all() and bitfilter.passes(bits, np.random.default_rng(1).integers(0, 1 << 62, 10_000)).mean() < 0.1
    assert not bitfilter.build(df.where("false"), "h", 0).any()


def test_words_ignore_accents_and_signs():
    assert leakage.words_of("Frå­gan, ÉN gång—två\n3:e") == ["fragan", "en", "gang", "tva", "3", "e"]


# ---- mixing ----


def test_mixture_keeps_budgets_and_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 40)
    r = random.Random(1)
    docs = [(i, r.choice(["a", "A ", "b", "c", None]), " ".join(["ord"] * r.randrange(0, 60))) for i in range(900)] + [(2000, "a", None), (2001, "", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("tokens", F.lit(0))
    targets = [(1, "a", 3.0, 2, 0.5), (1, "b", 1.0, 3, 0.5), (1, "zz", 1.0, 2, 0.5), (2, "c", 1.0, 2, 5.0), (2, "b", None, 2, 5.0), (2, "a", -1.0, 2, 5.0), (3, "a", 1.0, None, 1.0)]
    t = spark.createDataFrame(targets + targets[:1], "mix_id int, source string, weight double, max_repeat int, total_factor double")
    chosen, plan = mixing.mixture(df, t)
    report = {(x.mix_id, x.source): x for x in mixing.shares(chosen, plan).collect()}
    sized = {x.doc_id: x.tokens for x in mixing.measured(df.select("doc_id", "text"), "text").collect()}
    total = sum(sized.values())
    assert abs(report[1, "a"].target_tokens - 0.6 * 0.5 * total) < 1e-6
    for x in report.values():
        assert x.actual_tokens <= x.target_tokens + 1e-6 and x.most_repeats <= (x.max_repeat or 0)
    longest = max(sized.values())
    assert report[1, "a"].actual_tokens > report[1, "a"].target_tokens - longest
    assert report[1, "zz"].actual_tokens == 0 and report[2, "c"].most_repeats == 2 and report[3, "a"].actual_tokens == 0
    picked = chosen.collect()
    assert len(picked) == len({(x.mix_id, x.doc_id) for x in picked})
    empty, plan = mixing.mixture(df.where("false"), t)
    assert empty.count() == 0 and mixing.shares(empty, plan).count() == 7
    assert mixing.mixture(df, t.where("false"))[0].count() == 0


def test_quality_counts_the_whole_text():
    from votaria.llm.mixing import _quality

    assert _quality("a1" * 400) == _quality("1a" * 400) == 0.25  # half are letters, in fixed columns
    assert _quality("a" * 300 + "1" * 100 + "a" * 2000) == pytest.approx(0.25 + 0.75 * (2300 / 2400 - 0.5) * 2)


def test_mixture_is_the_sorted_prefix(spark, monkeypatch):
    docs = [(i, "a", " ".join(["ord"] * (i % 7 + 1))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([(1, "a", 1.0, 1, 0.37)], "mix_id int, source string, weight double, max_repeat int, total_factor double")
    results = []
    for size in (10, 100_000):
        monkeypatch.setattr(mixing, "BUCKET_DOCS", size)
        results.append(rows(mixing.mixture(df, t)[0]))
    assert results[0] == results[1] and results[0]


# ---- personal information ----


def test_placeholders_and_edge_cases(spark):
    text = "Ring 031-390 06 11 eller skriv till eva.berg@post.example. Sökanden uppger 811218-9876 som identitet. Bolaget har org.nr 556677-8899. Anslag 1:575 höjs."
    data = [(1, text), (2, None), (3, ""), (4, "x" * 100_000), (None, "Ring 031-390 06 11."), (1, text)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    done = {r.doc_id: r for r in personal.redacted(df).collect()}
    assert done[1].text == "Ring [PHONE] eller skriv till [EMAIL]. Sökanden uppger [IDNR] som identitet. Bolaget har org.nr 556677-8899. Anslag 1:575 höjs."
    assert done[2].text is None and done[3].text == "" and done[4].text == "x" * 100_000 and len(done) == 5
    spots = {(r.kind, r.start_pos) for r in personal.personal_mentions(df).where("doc_id = 1").collect()}
    assert spots == {("phone", 5), ("email", text.index("eva")), ("idnr", text.index("811218"))}
    assert personal.personal_mentions(df.where("false")).count() == 0


def test_boosted_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.integers(0, 4, (2000, 4))
    y = (x[:, 0] > 1) ^ (x[:, 1] > 1)
    model = Boosted(trees=30).fit(x, y)
    assert ((model.probability(x) >= model.threshold) == y).mean() > 0.98


def test_no_pair_is_lost_by_the_filter(spark):
    # windows of items in documents, whatever their size: the minimum of a window is found wherever the window occurs
    r = random.Random(9)
    words = [f"w{r.randrange(50)}" for _ in range(200)]
    found = leakage.window_minima([words, words[30:60]])
    whole = found.whole(np.ones(len(found.low), dtype=bool))
    by = {(int(o), int(f)): (int(m), int(w)) for o, f, m, w in zip(found.owner, found.first, found.low, whole)}
    assert all(by[1, f] == by[0, f + 30] for f in range(19))
    assert len(by) == 189 + 19 and len(list(itertools.islice(by, 1)))
