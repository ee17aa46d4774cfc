"""Documents in force, nested documents, citations mended in place, work dealt in order, and pruned scans."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from votaria.functions import text as tx
from votaria.operators import match, nested, repair, served, shape


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- documents in force ----


def test_versions_are_compared_as_numbers(spark):
    df = spark.createDataFrame([("p4",), ("p6",), ("p10",), ("x",), (None,), ("p0",)], "prompt_version string")
    got = rows(served.document_sets(df, {1: ["a"], 6: ["b", "c"]}, "prompt_version"))
    assert got == [("p10", "b"), ("p10", "c"), ("p4", "a"), ("p6", "b"), ("p6", "c")]


def test_what_a_party_may_see(spark):
    day = lambda d: f"unix_date(date'{d}')"
    probes = spark.createDataFrame([("V1", "2023/24", "A", "p5"), ("V1", "2023/24", "F", "p5"), ("V2", "2024/25", "A", "p5"), ("V1", "2023/24", "A", "p6")], "votering_id string, rm string, parti string, prompt_version string").withColumn("day", F.expr(day("2024-02-01")))
    editions = spark.createDataFrame([("A", "programme", "a-old", "2020-01-01"), ("A", "programme", "a-new", "2024-02-02"), ("A", "agreement", "deal", "2022-01-01"), ("F", "programme", "f", None)], "parti string, document string, slug string, start string").withColumn("start", F.to_date("start"))
    budgets = spark.createDataFrame([("A", "2023/24", "bud", "2023-10-01", "2023/24:1"), ("A", "2024/25", "bud2", "2024-10-01", "2024/25:1")], "parti string, rm string, slug string, start string, motion string").withColumn("start", F.to_date("start"))
    none = spark.createDataFrame([], "votering_id string, motion string")
    sets = {5: ["programme", "agreement", "budget"], 6: ["programme"]}
    see = lambda refs: rows(served.served(probes, editions, budgets, refs, sets, "agreement", "budget", ["F"]).select("prompt_version", "votering_id", "parti", "slug"))
    base = [("p5", "V1", "A", "a-old"), ("p5", "V1", "A", "bud"), ("p5", "V1", "F", "deal"), ("p5", "V2", "A", "a-old"), ("p6", "V1", "A", "a-old")]
    assert see(none) == base
    own = spark.createDataFrame([("V1", "2023/24:1"), ("V1", "2023/24:1")], "votering_id string, motion string")
    assert see(own) == [r for r in base if r[3] != "bud"]
    assert served.served(probes.where("false"), editions, budgets, none, sets, "agreement", "budget", ["F"]).count() == 0


# ---- nested documents ----

STATUS = {
    "dokumentstatus": {
        "dokutskottsforslag": {"utskottsforslag": [{"votering_id": "ab-1", "punkt": "2", "rubrik": "R", "forslag": "<p>Bifall</p>", "motforslag_nummer": "1, 3"}, {"votering_id": "", "punkt": "3"}]},
        "dokmotforslag": {"motforslag": [{"nummer": "1", "utskottsforslag_punkt": "2", "rubrik": "Ett", "partier": "'A'"}, {"nummer": "2", "utskottsforslag_punkt": "2", "rubrik": "Två"}, {"nummer": "3", "utskottsforslag_punkt": "2", "rubrik": ""}, {"nummer": "1", "utskottsforslag_punkt": "9"}]},
        "dokuppgift": {"uppgift": {"kod": "notis", "text": "  kort "}},
        "dokreferens": {"referens": [{"referenstyp": "behandlar", "ref_dok_id": f"H{i}", "ref_dok_typ": "mot", "ref_dok_dokumentnamn": "Motion", "ref_dok_rm": "2023/24", "ref_dok_bet": str(i)} for i in range(30)] + [{"referenstyp": "annat", "ref_dok_id": "X"}, {"referenstyp": "behandlar"}]},
    }
}


def test_status_documents(spark):
    single = {"dokumentstatus": {"dokutskottsforslag": {"utskottsforslag": {"votering_id": "cd-2", "punkt": "1", "forslag": "Avslag"}}}}
    df = spark.createDataFrame([("a", json.dumps(STATUS)), ("b", json.dumps(single)), ("c", "{broken"), ("d", None)], "dok string, json string")
    points = nested.status_points(df)
    got = {r.votering_id: r for r in points.select("votering_id", nested.alternatives(points).alias("alts"), nested.references().alias("refs"), nested.first_by(F.col("notes"), "notis", "text").alias("note"), nested.first_by(F.col("notes"), "annat", "text").alias("gone")).collect()}
    assert set(got) == {"AB-1", "CD-2"}
    assert [(a.alt_id, a.text) for a in got["AB-1"].alts] == [("utskottet", "<p>Bifall</p>"), ("res-1", "Ett"), ("res-3", "Reservation 3")]
    assert len(got["AB-1"].refs) == 20 and got["AB-1"].refs[0].label == "Motion 2023/24:0" and got["AB-1"].note == "kort" and got["AB-1"].gone is None
    assert [a.alt_id for a in got["CD-2"].alts] == ["utskottet"] and got["CD-2"].refs == [] and got["CD-2"].note is None


def table(caption, *parties):
    return {"caption": caption, "tbody": {"tr": [{"th": "Parti", "td": ["Ja"]}, *[{"th": p, "td": list(map(str, n))} for p, *n in parties], {"th": "Totalt", "td": ["1", "2", "3", "4"]}]}}


@pytest.mark.parametrize(
    "wrapper, want",
    [
        ({"table": table("sakfrågan", ("A", 94, 0, 0, 13))}, [("A", [94, 0, 0, 13])]),
        ({"table": [table("motivfrågan", ("A", 1, 1, 1, 1)), table({"p": "om sakfrågan"}, ("A", 2, 0, 0, 0), ("f ", 3, 0, 0, 1))]}, [("A", [2, 0, 0, 0]), ("F", [3, 0, 0, 1])]),
        ({"table": table("sakfrågan", ("A", 1, 1, 1, 1), ("F", 1, "x", 1, 1))}, None),
        ({"table": []}, None), ({}, None), (None, None),
    ],
)
def test_official_tables(spark, wrapper, want):
    got = spark.createDataFrame([(None if wrapper is None else json.dumps(wrapper, ensure_ascii=False),)], "j string").select(nested.official_counts(F.col("j"))).first()[0]
    assert got == want or [(r.parti, list(r.counts)) for r in got] == want


def test_official_counts_against_ours(spark):
    official = spark.createDataFrame([("1", [("A", [1, 0, 0, 0]), ("X", [9, 9, 9, 9])]), ("2", [("A", [0, 0, 0, 1])]), ("3", None)], "votering_id string, official array<struct<parti:string,counts:array<int>>>")
    ours = spark.createDataFrame([("1", "A", 1, 0, 0, 0), ("2", "A", 0, 0, 1, 0)], "votering_id string, parti string, n_ja int, n_nej int, n_avstar int, n_franvarande int")
    assert rows(nested.count_check(official, ours)) == [(2, 1)]


def test_maps_and_chunks(spark):
    df = spark.createDataFrame([("v", "res-1", "a", 1), ("v", " RES-1", "b", 2), ("v", "", "c", 3), ("v", "utskottet", "d", None), ("w", None, "x", 1)], "v string, k string, t string, o int")
    assert [(r.v, r.entries) for r in nested.last_by_key(df, ["v"], F.col("k"), "t", "o").collect()] == [("v", {"RES-1": "b", "UTSKOTTET": "d"})]
    lists = spark.createDataFrame([(["a"], [["x"]]), ([], [["x"], ["y", "z"]]), (None, None)], "a array<string>, b array<array<string>>")
    assert [r[0] for r in lists.select(nested.flat_or_chunks(F.col("a"), F.col("b"))).collect()] == [["a"], ["x", "y", "z"], None]


# ---- citations ----

CITED = "id int, citations array<struct<document:string,slug:string,quote:string,svag:boolean>>, flags array<string>"


def test_citations_are_aligned_in_place(spark):
    data = [(1, [("d", "s", "rätt", None), ("d", "s", "fel", None), ("d", "s", "", None), ("d", "t", "hittas ej", True)], ["kort"]), (2, [], None), (3, None, []), (4, [("d", "s", None, None)], [])]
    verdicts = spark.createDataFrame([("s", "rätt", True, None, None), ("s", "fel", False, "fell", 0.8), ("t", "hittas ej", False, "nej", 0.4)], "slug string, quote string, verbatim boolean, span string, ratio double")
    got = {r.id: r for r in repair.aligned(spark.createDataFrame(data, CITED), verdicts, ["id"]).collect()}
    assert [c.quote for c in got[1].citations] == ["rätt", "fell", "", ""] and [c.quote_ej_verifierad for c in got[1].citations] == [None, None, None, "hittas ej"]
    assert (got[1].n_ok, got[1].n_fixed, got[1].n_failed) == (1, 1, 1) and got[1].flags == ["kort", "citat_korrigerat", "citat_ej_verifierat"]
    assert got[2].citations == [] and got[2].flags == [] and got[3].citations is None and got[4].n_failed == 0


def test_listed_phrases_and_weak_marks(spark):
    data = [(1, [("p", "s", "Vi VÄNTAS vara  klar snart", None), ("v", "s", "väntas vara klar", True), ("p", "s", "annat", True)], ["citat_svagt"]), (2, None, None), (3, [("p", "s", None, None)], ["x"])]
    df = spark.createDataFrame(data, CITED)
    phrases = [("p", "väntas vara klar")]
    got = {r.id: r for r in repair.stripped(df, phrases).collect()}
    assert [c.quote for c in got[1].citations] == ["väntas vara klar", "annat"] and got[1].n_blocked == 1 and "citat_blockerat" in got[1].flags and got[2].n_blocked == 0 and got[3].flags == ["x"]
    once = repair.marked(df, phrases)
    assert {r.id: (r.n_weak, [c.svag for c in r.citations or []], r.flags) for r in once.collect()} == {1: (1, [True, None, None], ["citat_svagt"]), 2: (0, [], []), 3: (0, [None], ["x"])}
    again = repair.marked(once.drop("n_weak"), phrases)
    assert rows(again.select("id", "flags", "n_weak")) == rows(once.select("id", "flags", "n_weak"))
    cleared = repair.marked(once.drop("n_weak"), [("p", "ingenting sådant")])
    assert all("citat_svagt" not in (r.flags or []) for r in cleared.collect())


def test_nearest_spans_equal_brute_force():
    r = random.Random(6)
    vocabulary = "kommunernas ansvar stärks genom tydligare statlig styrning vården skolan budgeten vägar".split()
    damage = lambda w: w.replace("r", "n", 1) if r.random() < 0.5 else w + r.choice("cx")
    for _ in range(40):
        words = r.choices(vocabulary, k=r.randrange(3, 40))
        quote = " ".join(damage(w) if r.random() < 0.7 else w for w in words[: r.randrange(1, 9)])
        n = len(quote.split())
        spans = [" ".join(words[i : i + k]) for k in sorted({max(3, n - 3), n, n + 3, n + 8}) for i in range(len(words) - k + 1)]
        best = max((difflib.SequenceMatcher(None, quote, s, autojunk=False).ratio() for s in spans), default=0.0)
        assert match.closest_span(quote, " ".join(words))[1] == pytest.approx(best)
    assert match.closest_span("kommunernas ansvar stärks genom tydligare statlig styrning", "kommunemas ansvaret starks genomm tydligarc statligt styrningen")[1] > 0.85


# ---- order without one task ----


def test_rows_are_numbered_as_by_a_sort(spark):
    r = random.Random(3)
    data = [(r.choice(["a", None, "b"]), r.randrange(50), i, float(r.randrange(5))) for i in range(500)]
    df = spark.createDataFrame(data, "g string, o int, k int, c double")
    got = {x.k: (x._row, x._size, x.s, x.s_total) for x in shape.ordered(df, ["g"], [F.col("o"), F.col("k")], running={"s": "c"}, parts=7).collect()}
    for g in ("a", None, "b"):
        mine = sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[2]))
        total = 0.0
        for i, x in enumerate(mine):
            total += x[3]
            assert got[x[2]] == (i, len(mine), pytest.approx(total), pytest.approx(sum(y[3] for y in mine)))
    assert shape.ordered(df.where("false"), ["g"], [F.col("o")]).count() == 0
    assert sorted(x._row for x in shape.ordered(df, [], [F.desc("k")]).collect()) == list(range(500))


def test_groups_are_balanced_and_bounded(spark):
    data = [("a", i, float(10 + i % 3)) for i in range(100)] + [("b", i, 0.0) for i in range(70)] + [("c", 0, 500.0), ("c", 1, None)]
    done = shape.balanced_groups(spark.createDataFrame(data, "g string, i int, c double"), ["g"], [F.col("i")], "c", 110.0, 30).collect()
    assert len(done) == len(data)
    for g in "abc":
        mine = sorted((x for x in done if x.g == g), key=lambda x: x.i)
        numbers = [x.group_no for x in mine]
        assert numbers == sorted(numbers) and set(numbers) == set(range(max(numbers) + 1)) and max(numbers.count(n) for n in numbers) <= 30
    assert max(x.group_no for x in done if x.g == "a") == 9 and max(x.group_no for x in done if x.g == "b") == 2
    sizes = [sum(x.c for x in done if x.g == "a" and x.group_no == n) for n in range(10)]
    assert max(sizes) - min(sizes) <= 2 * 12


def test_coverage_equals_brute_force(spark):
    r = random.Random(9)
    want = [("k", f"w{i}", [str(r.randrange(12)) for _ in range(r.randrange(4))] if i else None) for i in range(12)]
    have = [("k", i, [str(r.randrange(12)) for _ in range(r.randrange(5))]) for i in range(9)]
    got = {(x.w, x.rank): (x.h, x.score) for x in match.top_coverage(spark.createDataFrame(want, "k string, w string, ws array<string>"), spark.createDataFrame(have, "k string, h int, hs array<string>").withColumn("o", F.col("h")), ["k"], ["w"], "ws", "h", "hs", "o", 3).collect()}
    for _, w, ws in want:
        ranked = sorted(((-(len(set(ws) & set(hs)) / len(set(ws)) if ws else 0.0), h) for _, h, hs in have))[:3]
        assert [got[w, i + 1] for i in range(3)] == [(h, pytest.approx(-s)) for s, h in ranked]


def test_prefixes(spark):
    asked = spark.createDataFrame([("ab",), ("abc",), ("zz",)], "p string")
    ids = spark.createDataFrame([("abc1",), ("abd2",), ("x",)], "k string")
    assert rows(match.prefix_lookup(asked, ids, "p", "k", [2, 3])) == [("ab", 2, None, "many"), ("abc", 1, "abc1", "one"), ("zz", 0, None, "none")]


# ---- texts ----

REPORT = "Utskottet. 1. Vägar, punkt 2 (A, KS) 2. Broar, punkt 3 (F) 1. Vägar, punkt 2 (A, KS) av Anna A (A). Förslag till riksdagsbeslut Vi föreslår. Ställningstagande " + "Vägarna är dåliga. " * 4 + "2. Broar, punkt 3 (F) av Bo B (F). Förslag till riksdagsbeslut Nej. Ställningstagande Broarna är &#x41; bra. Bilaga 1"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c"))).first()[0]


def test_reservations_of_a_report(spark):
    found = one(spark, REPORT, tx.indexed_reservations)
    assert [(x.num, x.heading, x.point, list(x.parties)) for x in found] == [(1, "Vägar", 2, ["A", "KS"]), (2, "Broar", 3, ["F"])] and found[1].body == "Broarna är bra."
    signed = one(spark, REPORT, tx.reservations)
    assert [list(x.parties) for x in signed] == [["A"]] and signed[0].body.startswith("Vägarna är dåliga.")
    blocks = one(spark, "Motion 2023/24:1 och 2023/24:2. Utskottets ställningstagande Nej. 2023/24:3 Utskottets ställningstagande Ja. Särskilt yttrande x", tx.committee_blocks)
    assert [(list(b.motions), b.body) for b in blocks] == [(["2023/24:1", "2023/24:2"], "Nej. 2023/24:3"), (["2023/24:3"], "Ja.")]
    assert one(spark, "", tx.reservations) == [] and one(spark, None, tx.reservations) is None


@pytest.mark.parametrize(
    "f, value, want",
    [
        (tx.entities, "&Aring;&#246;&#xE4; &amp;lt; & x", "Åöä &lt; & x"), (tx.composed, "é å", "é å"), (tx.folded, "Straße ﬁ", "strasse fi"), (tx.match_key, " Å  ß ", "å ss"),
        (tx.unreadable, "ᚠᚢᚦᚨ abc", True), (tx.unreadable, "Vanlig rad", False), (tx.line_kind, "1.2 Vägar", "subheading"), (tx.line_kind, "VÄGAR", "heading"), (tx.line_kind, "• en punkt", "bullet"), (tx.line_kind, "Kort mening.", "para"), (tx.line_kind, "Vägar och broar", "subheading"),
        (tx.document_title, "partiprogram-a-2022-1", "Partiprogram 2022 — Allmogen"), (tx.document_title, "okänd", "okänd"), (tx.repaired_signs, "a\r\nﬁ​ x\x07", "a\nfi x"),
        (lambda c: F.to_json(tx.provenance(c)), "<!-- Titel | 2024 | https://x.se -->", '{"title":"Titel","note":"2024","href":"https://x.se"}'), (tx.provenance, "vanlig rad", None),
        (lambda c: tx.merged_lines(F.split(c, "\n"), F.lit(30)), "En lång rad som fyller spalten\noch fort-\nsätter.\nNy.\n\nEfter.", ["En lång rad som fyller spalten och fortsätter.", "Ny.", "Efter."]),
        (lambda c: tx.merged_lines(F.split(c, "\n"), F.lit(400)), "En mening\nsom fortsätter.\n• punkt\nAnnat", ["En mening som fortsätter.", "• punkt Annat"]),
    ],
)
def test_forms_of_text(spark, f, value, want):
    assert one(spark, value, f) == want


# ---- pruned scans ----


@pytest.mark.parametrize("name, unread", [("cohesion_series", ["forslag_text", "notis", "banknummer"]), ("agreement", ["motivering", "citations", "usage", "forslag_text"]), ("party_positions", ["dok_id", "datum", "rm"]), ("flips", ["motivering", "citations"]), ("pairs_matrix", ["forslag_text"]), ("kappa", ["motivering"]), ("area_cube", ["citations"]), ("gap_blocks", ["usage"]), ("cases_by_area", ["forslag_text"]), ("chamber_outcome", ["valkrets"])])
def test_columns_that_are_not_needed_are_not_read(spark, name, unread):
    import __spark_entry__

    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    schemas = " ".join(line.split("ReadSchema:")[1] for line in plan.split("\n") if "ReadSchema:" in line)
    assert schemas and not [c for c in unread if c in schemas]


def test_verbatim_equals_brute_force(spark):
    r = random.Random(1)
    vocabulary = "a bb ccc dddd e ff ggg".split()
    blocks = [(r.choice("xy"), " ".join(r.choices(vocabulary, k=r.randrange(1, 30)))) for _ in range(60)]
    quotes = []
    for i in range(150):
        slug, text = r.choice(blocks)
        start = r.randrange(len(text))
        quote = text[start : start + r.randrange(1, 50)]  # may begin and end within a word
        quotes.append((i, r.choice("xyz") if r.random() < 0.2 else slug, quote.replace("c", "C") if r.random() < 0.5 else quote + r.choice(["", "", " zz"])))
    got = {x.i: x.verbatim for x in match.verbatim(spark.createDataFrame(quotes, "i int, slug string, quote string"), spark.createDataFrame(blocks, "slug string, text string"), ["slug"], "quote", "text").collect()}
    assert got == {i: bool(q.strip()) and any(s == b and " ".join(q.lower().split()) in t for b, t in blocks) for i, s, q in quotes}


def test_segments_hold_every_run(spark):
    r = random.Random(2)
    pieces = [("d", i, " ".join(f"w{r.randrange(1000)}" for _ in range(r.choice([1, 3, 40])))) for i in range(60)] + [("e", 0, "ensam"), ("e", 1, " ")]
    got = spark.createDataFrame(pieces, "slug string, i int, text string")
    parts = [x for x in match.segments(got, ["slug"], [F.col("i")], "text", 50, 12).collect()]
    whole = " ".join(t for s, _, t in pieces if s == "d").split()
    texts = [f" {x.text} " for x in parts if x.slug == "d"]
    assert len(texts) > 3 and all(any(f" {' '.join(whole[i : i + 12])} " in t for t in texts) for i in range(len(whole) - 11))
    assert [x.text for x in parts if x.slug == "e"] == ["ensam"] and max(len(t.split()) for t in texts) <= 50 + 12 + 2 * 40
