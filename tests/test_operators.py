"""Operators on small, hand-computed frames, and randomised comparisons with brute force."""

import datetime as dt
import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from votaria import domain
from votaria.functions import text as tx
from votaria.operators import counterfactual as cf
from votaria.operators import decisions as dc
from votaria.operators import match, roll, shape


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


VOTE = "votering_id string, parti string, intressent_id string, namn string, rost string, rm string, beteckning string, punkt int, datum string, dok_id string, avser string, votering string"


def votes(spark, spec):
    """(division, party, votes in short) to member rows."""
    name = {"J": "Ja", "N": " nej", "A": "AVSTÅR", "F": "Frånvarande"}
    out = []
    for division, party, letters in spec:
        for i, c in enumerate(letters):
            out.append((division, party, f"{party}{i}", f"n{i}", name[c], "2023/24", "B1", 1, "2024-01-02", "d", "sakfrågan", "huvud"))
    return spark.createDataFrame(out + out[:2], VOTE)


def test_positions_and_ties(spark):
    main = roll.member_votes(votes(spark, [("x ", "A", "JJN"), ("X", "F", "JN"), ("x", "n", "NA"), ("x", "KS", "FF"), ("x", "??", "J"), ("x", "HV", "AAN")]))
    got = {r.parti: (r.n_ja, r.n_nej, r.n_avstar, r.n_franvarande, r.position, round(r.cohesion, 3), r.seats) for r in roll.positions(main).collect()}
    assert got == {"A": (2, 1, 0, 0, "Ja", 0.667, 3), "F": (1, 1, 0, 0, "Ja", 0.5, 2), "N": (0, 1, 1, 0, "Nej", 0.5, 2), "KS": (0, 0, 0, 2, "Frånvarande", 1.0, 2), "HV": (0, 1, 2, 0, "Avstår", 0.667, 3)}
    assert rows(roll.chamber(roll.positions(main)).select("ja", "nej", "outcome")) == [(3, 4, "Nej")]
    assert roll.positions(main.where("false")).count() == 0


def test_pairs_are_symmetric_with_ones(spark):
    lines = spark.createDataFrame([("1", "r", "A", "Ja"), ("1", "r", "F", "Nej"), ("2", "r", "A", "Ja"), ("2", "r", "F", "Ja"), ("3", "s", "A", "Nej")], "votering_id string, rm string, parti string, position string")
    got = {(r.party_a, r.party_b, r.rm): r.rate for r in roll.pair_rates(lines).collect()}
    assert got["A", "F", None] == got["F", "A", None] == 0.5 and got["A", "A", None] == 1.0 and got["A", "F", "r"] == 0.5 and ("A", "F", "s") not in got


def test_kappa_confusion_and_gap(spark):
    data = [("A", "Ja", "Ja"), ("A", "Ja", "Nej"), ("A", "Nej", "Nej"), ("A", "Nej", "Nej"), ("F", "Ja", "Ja"), ("F", None, "Ja")]
    facts = spark.createDataFrame(data, "parti string, rost string, position string")
    got = {r.parti: (r.n, r.kappa) for r in dc.kappa(facts, ["parti"]).collect()}
    assert got == {"A": (4, 0.5), "F": (1, 1.0)}
    dense = dc.confusion(facts, domain.parties(spark))
    assert dense.count() == 72 and dense.agg(F.sum("n")).first()[0] == 5
    gap = spark.createDataFrame([("A", "explicit", "Ja", "Nej"), ("A", "explicit", "Nej", "Nej"), ("A", "off_axis", "Ja", "Avstår"), ("F", "explicit", None, "Ja")], "parti string, tier string, implied string, position string")
    blocks = {(r.parti, r.tier): (r.n, r.n_gap, r.aligned, r.gap_rate) for r in dc.gap_blocks(gap).collect()}
    assert blocks[None, None] == blocks["A", "explicit"] == (2, 1, 1, 0.5) and len(blocks) == 4


def test_overrides_overlap(spark):
    data = [("A", "Nej", "explicit", "high", "Ja", True), ("A", "Nej", "explicit", "low", "Nej", False), ("A", "Ja", "explicit", "high", "Ja", False), ("A", None, None, None, "Ja", False)]
    facts = spark.createDataFrame(data, "parti string, rost string, coverage string, confidence string, position string, authored boolean")
    got = {(r.threshold, r.authorship): (r.den, r.num) for r in dc.override_buckets(facts).collect()}
    assert got == {("loose", "all"): (2, 1), ("loose", "authored"): (1, 1), ("loose", "not_authored"): (1, 0), ("strict", "all"): (1, 1), ("strict", "authored"): (1, 1), ("strict", "not_authored"): (0, 0)}


def test_a_flip_moves_all_who_voted(spark):
    pos = spark.createDataFrame([("1", "A", 5, 0, 1, "Ja"), ("1", "F", 0, 4, 0, "Nej"), ("2", "A", 3, 0, 0, "Ja"), ("2", "F", 0, 3, 0, "Nej")], "votering_id string, parti string, n_ja int, n_nej int, n_avstar int, position string")
    stances = spark.createDataFrame([("1", "A", "Nej", "explicit"), ("1", "F", "Nej", "explicit"), ("2", "A", "Nej", "off_axis"), ("3", "A", "Nej", "explicit")], "votering_id string, parti string, implied string, tier string")
    got = cf.flips(pos, stances).collect()
    assert [(r.votering_id, r.real_ja, r.real_nej, r.cf_ja, r.cf_nej, r.movers, r.flips) for r in got] == [("1", 5, 4, 0, 10, ["A"], True)]
    tie = cf.flips(pos.where("votering_id = '2'"), stances.where("votering_id = '2'").withColumn("tier", F.lit("explicit"))).first()
    assert tie.real_outcome is None and not tie.flips


def test_cube_totals_are_sums_of_cells(spark):
    r = random.Random(0)
    data = [(r.choice(["x", "y"]), r.choice(["A", "F"]), r.choice(["Ja", "Nej", "Avstår"]), r.choice(["Ja", "Nej", None]), r.choice(["explicit", "off_axis"]), str(i % 20)) for i in range(200)]
    facts = spark.createDataFrame(data, "policy_area string, parti string, position string, implied string, tier string, votering_id string")
    cube = cf.area_cube(facts).collect()
    total = next(x for x in cube if x.level == 3)
    for field in ("n", "follows", "abstained", "explicit_n", "explicit_gap"):
        assert getattr(total, field) == sum(getattr(x, field) for x in cube if x.level == 0) == sum(getattr(x, field) for x in cube if x.level == 1)


# ---- shapes ----


def test_latest_first_and_capped(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), ("b", None, "w"), (None, 1, "n"), ("a", 3, "y")], "k string, t int, v string")
    assert rows(shape.latest_per_key(df, ["k"], F.col("t"))) == [("a", 3, "y"), ("b", None, "w"), (None, 1, "n")]
    assert rows(shape.first_per_key(df, ["k"], F.col("t"))) == [("a", 1, "x"), ("b", None, "w"), (None, 1, "n")]
    many = spark.createDataFrame([("g", s, i) for s in "pq" for i in range(5)], "g string, s string, i int")
    assert rows(shape.capped_twice(many, ["g"], "s", [F.col("i"), F.col("s")], 2, 3)) == [("g", "p", 0), ("g", "p", 1), ("g", "q", 0)]


def test_islands_fill_chunks(spark):
    df = spark.createDataFrame([("g", i, c) for i, c in enumerate("aabba")], "g string, i int, c string")
    assert rows(shape.islands(df, ["g"], "i", ["c"])) == [("g", "a", 0, 1, 2), ("g", "a", 4, 4, 1), ("g", "b", 2, 3, 2)]
    holes = spark.createDataFrame([("g", 0, None), ("g", 1, "x"), ("g", 2, None)], "g string, i int, c string")
    assert rows(shape.forward_fill(holes, ["g"], "i", ["c"])) == [("g", 0, None), ("g", 1, "x"), ("g", 2, "x")]
    assert [r.chunk for r in shape.chunks(df, ["g"], [F.col("i")], 2).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    assert rows(shape.every_kth(df, ["g"], [F.col("i")], 2).select("i")) == [(0,), (2,)]


def test_samples(spark):
    df = spark.createDataFrame([(f"{s}{i}", s) for s, n in (("a", 90), ("b", 10), ("c", 1)) for i in range(n)], "k string, s string")
    one, two = (rows(shape.stratified(df, ["s"], "k", 20, seed)) for seed in (1, 2))
    count = lambda x: {s: sum(r[0] == s for r in x) for s in "abc"}
    assert count(one) == count(two) == {"a": 18, "b": 2, "c": 1} and one != two and one == rows(shape.stratified(df, ["s"], "k", 20, 1))
    w = spark.createDataFrame([("a", 5, 0), ("b", 3, 4), ("c", 1, 0)], "g string, w int, have int")
    assert rows(shape.apportion(w, "w", 10, "have").select("g", "share")) == [("a", 6), ("b", 4), ("c", 1)]


def test_balanced_groups(spark):
    df = spark.createDataFrame([("p", i, 10.0) for i in range(10)] + [("q", 0, 500.0)], "p string, i int, c double")
    got = [r.group_no for r in shape.balanced_groups(df, ["p"], "i", "c", 30.0).where("p = 'p'").orderBy("i").collect()]
    assert sorted(set(got)) == [0, 1, 2, 3] and got == sorted(got) and max(got.count(g) for g in set(got)) <= 4
    assert shape.balanced_groups(df.where("false"), ["p"], "i", "c", 30.0).count() == 0


# ---- matches ----


@pytest.mark.parametrize("strict, most", [(False, None), (True, None), (True, 9), (False, 9)])
def test_versions_equal_brute_force(spark, strict, most):
    r = random.Random(4)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    versions = [(r.choice("pq"), day(r.randrange(60)), i) for i in range(20)]
    probes = [(i, r.choice("pqr"), r.randrange(-5, 70)) for i in range(60)]
    v = match.versions(spark.createDataFrame(versions, "k string, start date, n int"), ["k"], "start").drop("start")
    p = spark.createDataFrame([(i, k, (day(d) - dt.date(1970, 1, 1)).days) for i, k, d in probes], "i int, k string, day int")
    want = []
    for i, k, d in probes:
        own = [(s, n) for x, s, n in versions if x == k and (s < day(d) if strict else s <= day(d))]
        if own and (most is None or (day(d) - max(own)[0]).days <= most):
            want.append((i, max(own)[1]))
    assert rows(match.asof_version(p, v, "day", ["k"], strict=strict, most_days=most).select("i", "n")) == sorted(want, key=repr)


def test_window_join_equals_brute_force(spark):
    r = random.Random(6)
    probes, events = [(i, r.randrange(100)) for i in range(40)], [(i, r.randrange(100)) for i in range(60)]
    got = match.within_window(spark.createDataFrame(probes, "p int, day int"), spark.createDataFrame(events, "e int, at int"), [], "day", "at", 7)
    assert rows(got.select("p", "e")) == sorted(((p, e) for p, d in probes for e, a in events if d - 7 <= a < d), key=repr)


def test_quotes(spark):
    blocks = spark.createDataFrame([("d", "Ett  två\ntre fyra fem sex sju"), ("e", None)], "slug string, text string")
    cites = spark.createDataFrame([(1, "d", "TVÅ tre"), (2, "d", "åtta"), (3, "e", "x"), (4, "d", ""), (5, None, "x"), (6, "d", None)], "i int, slug string, quote string")
    assert rows(match.verbatim(cites, blocks, ["slug"], "quote", "text").where("verbatim").select("i")) == [(1,)]
    assert match.closest_span("tre fyra fam sex", "Ett två tre fyra fem sex sju") == ("tre fyra fem sex", 0.9375)
    assert match.closest_span("", "x y") == ("", 0.0) == match.closest_span("a b c", "x")
    phrases = spark.createDataFrame([("d", "två tre")], "document string, phrase string")
    marked = match.phrase_match(cites, phrases, "slug", "quote", "weak")
    assert rows(marked.where("weak").select("i")) == [(1,)]


def test_overlaps_and_greedy_pairs(spark):
    left = spark.createDataFrame([("d", "r1", 1, ["A"]), ("d", "r2", 2, ["F"]), ("d", "r3", 3, None), ("e", "r4", 1, ["A"])], "k string, left_id string, left_order int, left_set array<string>")
    right = spark.createDataFrame([("d", "b1", 1, ["F", "N"]), ("d", "b2", 2, ["A"])], "k string, right_id string, right_order int, right_set array<string>")
    assert rows(match.greedy_pairs(left, right, ["k"])) == [("d", "r1", "b2"), ("d", "r2", "b1"), ("d", "r3", None), ("e", "r4", None)]
    best = match.best_overlap(left.drop("left_order"), right, ["k"], "left_set", "right_set", "right_order")
    assert {r.left_id: r.right_id for r in best.collect()} == {"r1": "b2", "r2": "b1", "r3": "b1", "r4": None}
    top = match.top_coverage(left.select("k", "left_id", "left_set").where("left_id = 'r1'"), right, ["k"], ["left_id"], "left_set", "right_id", "right_set", "right_order", 1)
    assert [(r.right_id, r.score) for r in top.collect()] == [("b2", 1.0)]


def test_pending_and_fallback(spark):
    wanted = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert rows(match.pending(wanted, wanted.where("k = 'a'"), ["k"])) == [("b",), (None,)]
    right = spark.createDataFrame([("Ab", 1), ("ab", 2), ("C", 3)], "k string, v int")
    left = spark.createDataFrame([("ab",), ("AB",), ("c",), ("d",)], "k string")
    assert rows(match.fallback_join(left, right, "k", "v").select("k", "v")) == [("AB", 1), ("ab", 2), ("c", 3), ("d", None)]


# ---- texts ----


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (tx.clean_html, "<p>Ett&nbsp;<b>två</b><br/>tre &amp;lt; f&shy;yra</p>", "Ett två\ntre &lt; fyra"),
        (tx.plain, "a<br>b &aring;\n c", "a b å c"),
        (tx.normalise_lines, "eﬃcient läro-\nmedel\n 12 \nIndex ........ 7", "efficient läromedel\nIndex   7"),
        (tx.scrub, "avslår motion 2022/23:2372 av Anna B och Carl D (båda KS). Den 2023-01-02.", "avslår motion [nr]. Den [datum]."),
        (tx.scrub_substance, "Allmogen (A) vill  det.", "partiet vill det."),
        (tx.leak_label, "Detta står i 2023/24:UbU5", "reference"),
        (tx.leak_label, "ingenting", None),
        (tx.motion_ids, "2023/24:1, 2023/24:2 och 2023/24:1", ["2023/24:1", "2023/24:2"]),
        (lambda c: tx.shorten(c, 10), "ett två tre fyra", "ett två…"),
        (lambda c: tx.first_words(c, 2), "ett två tre fyra", "ett två [+2]"),
        (tx.fragment_link, "a b", "#:~:text=a%20b"),
        (tx.fragment_link, "1 2 3 4 5 6 7 8 9 0", "#:~:text=1%202%203%204%205,7%208%209%200"),
        (tx.meanings, "Riksdagen ställer sig bakom det som anförs om att bygga och tillkännager detta. Därmed bifaller riksdagen motion 1.", "ett tillkännagivande som uppmanar regeringen att agera om bygga samt att bifalla motionsyrkanden"),
        (tx.meanings, "Något annat. Mer.", "Något annat"), (lambda c: tx.meanings(c, "en"), "Riksdagen godkänner regeringens förslag.", "approving the government's proposal and approving what the committee proposes"),
        (tx.block_kind, "• punkt", "bullet"),
        (tx.block_kind, "Inledning ...... 4", "toc"),
        (tx.party_of_slug, "avtal-gr-2024-6", "GR"),
        (lambda c: tx.proposal_kind(c, c), None, "other"), (lambda c: tx.proposal_kind(c, F.lit("FiU1")), "x", "budget"), (lambda c: tx.proposal_kind(c, c), "Riksdagen godkänner regeringens förslag och avslår motion 1", "proposition"),
    ],
)
def test_text_expressions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_flags(spark):
    df = spark.createDataFrame([(["x"], True), (None, True), (["f", "x"], False)], "flags array<string>, hit boolean")
    assert [r[0] for r in df.select(match.with_flag(F.col("flags"), "f", F.col("hit"))).collect()] == [["x", "f"], ["f"], ["x"]]


def test_proposals_in_any_characters(spark, monkeypatch):
    from votaria.plans import context

    texts = ["Avslår motion 2022/23:1 av A.", "Avslår\u00a0motion\u200d2022/23:12 av\u00a0A.", "Rad ett\nmotion ２０２２／２３：４２", "motion 20\u200b22/23:\ufeff7, 8½ m²", "den 2024‐01‐02", "аvslår inget", "", None]
    want = ["Avslår motion [nr].", "Avslår\u00a0motion\u200d[nr].", "Rad ett\nmotion [nr]", "motion [nr], 8½ m²", "den [datum]", "аvslår inget", ""]

    class Cases:
        cases = spark.createDataFrame(list(enumerate(texts)), "votering_id int, forslag_text string")

    monkeypatch.setattr(context, "Frames", lambda spark, root: Cases)
    run = lambda name: context.QUERIES[name](spark, "")
    assert [r.text for r in run("scrubbed").orderBy("votering_id").collect()] == want
    assert {r.leak: r.n for r in run("leak_labels").collect()} == {"author": 2, "reference": 2, "date": 1, None: 2}


def test_whole_documents_are_searched_for_quotes(spark, tmp_path, monkeypatch):
    from votaria.plans import context

    blocks = [(1, "d", 1, 1, "para", "Vi ska ha ett nytt kommvnen hus, om det blir nya pengar till alla i hela landet under året."), (2, "d", 1, 2, "para", "Kommunen ska bygga\nnya cykelvägar."), (3, "d", 1, 3, "para", "Det är bra.")]
    spark.createDataFrame(blocks, "block_id long, slug string, page int, seq int, kind string, text string").write.parquet(f"{tmp_path}/docblocks.parquet")
    cites = [(1, "d", "x", "kommvnen ska bygqa nya cykelvagar."), (2, "d", "x", "bygga nya cykelvägar. Det var bra."), (3, "e", "x", "finns inte")]

    class Decided:
        root = str(tmp_path)
        decisions = spark.createDataFrame([("r", "c", cites)], "run_id string, cid string, citations array<struct<cite_id: int, slug: string, document: string, quote: string>>")

    Decided.spark = spark
    monkeypatch.setattr(context, "Frames", lambda spark, root: Decided)
    got = {r.cite_id: (r.span, r.verdict) for r in context.QUERIES["repaired_citations"](spark, "").collect()}
    assert got == {1: ("Kommunen ska bygga nya cykelvägar.", "corrected"), 2: ("bygga nya cykelvägar. Det är bra.", "corrected"), 3: (None, "unverifiable")}


@pytest.mark.parametrize("seed", range(3))
def test_spans_equal_brute_force(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeå") for _ in range(r.randrange(1, 9))) for _ in range(25)]
    source = " ".join(r.choice(words) for _ in range(60))
    at = r.randrange(30)
    quote = " ".join(w[:-1] + "x" if r.random() < 0.4 else w for w in source.split()[at : at + 22])
    n, have = len(quote.split()), source.split()
    every = [" ".join(have[i : i + w]) for w in {n - 3, n, n + 3, n + 8} for i in range(len(have) - w + 1)]
    span, ratio = match.closest_span(quote, source)
    assert ratio == match._ratio(quote, span) == max(match._ratio(quote, w) for w in every)


@pytest.mark.parametrize(
    "f, value, want",
    [
        (tx.leak_label, "Riksdagen avslog motion 2023/24:1", "outcome"),
        (tx.leak_label, "enligt HA01AU10", "report"),
        (tx.leak_label, "se 0A1B2C3D-0000-4000-8000-0123456789ab", "division"),
        (tx.meanings, "Riksdagen anvisar anslagen för 2025. Mer.", "att fördela budgetanslagen enligt utskottets förslag"),
        (tx.meanings, "Riksdagen godkänner regeringens förslag till mål.", "att godkänna regeringens förslag samt att godkänna det som utskottet föreslår"),
        (tx.meanings, "Riksdagen godkänner detta.", "att godkänna det som utskottet föreslår"),
        (tx.meanings, "Riksdagen lägger regeringens skrivelse 1 till handlingarna.", "att lägga regeringens skrivelse till handlingarna"),
    ],
)
def test_all_labels_and_rules(spark, f, value, want):
    assert one(spark, value, f) == want


def test_a_quote_with_a_sign_changed_in_each_word():
    span, ratio = match.closest_span("kommvnen skal byqga nyа cykelvegar", "Ett två tre. kommunen skall bygga nya cykelvägar i år")
    assert span == "kommunen skall bygga nya cykelvägar" and ratio > 0.75


def test_the_first_of_equal_spans_stays():
    span, ratio = match.closest_span("a a aa b aa a aa", "b b b a a b")
    assert span == "b b b a" and ratio == match._ratio("a a aa b aa a aa", "b a a b")


@pytest.mark.parametrize("seed", range(4))
def test_matching_blocks_equal_difflib(seed):
    r = random.Random(seed)
    for _ in range(200):
        a, b = ("".join(r.choice("abå ") for _ in range(r.randrange(30))) for _ in range(2))
        assert match._ratio(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_a_quote_costs_few_comparisons():
    """Against the time of ``difflib`` for one pair of texts, so that the machine does not matter; whole windows took over 30 of them."""
    r = random.Random(3)
    words = ["".join(r.choice("aeiourstnlkdmgvåäö") for _ in range(r.randrange(2, 12))) for _ in range(900)]
    source = " ".join(r.choice(words) for _ in range(1_800))
    have = source.split()
    near = [" ".join(w[:-1] + "x" if r.random() < 0.15 else w for w in have[i : i + 30]) for i in range(0, 1_200, 100)]
    far = [" ".join(r.choice(words) for _ in range(30)) for _ in range(4)]
    spans = match.Spans(source)
    began = time.process_time()
    found = [spans.closest(q, 0.75) for q in near + far]
    mine, began = time.process_time() - began, time.process_time()
    for q in near + far:
        difflib.SequenceMatcher(None, q, " ".join(have[:30]), autojunk=False).ratio()
    assert all(ratio > 0.9 for _, ratio in found[: len(near)]) and not any(ratio for _, ratio in found[len(near) :])
    assert mine < 12 * (time.process_time() - began)
