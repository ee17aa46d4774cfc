"""Readers, sinks and streams on files."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from votaria import domain
from votaria.sources import readers, sinks
from votaria.streaming import flows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_votes_from_archives(spark, tmp_path):
    vid = "0" * 35 + "a"
    vote = dict.fromkeys(readers.VOTE_FIELDS, "x") | {"punkt": "2", "votering_id": vid}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr(f"HB1-2-{vid}.json", "﻿" + json.dumps({"dokvotering": {"votering": [vote, vote | {"punkt": "z"}]}}))
        z.writestr(f"HB2-2-{vid}.json", json.dumps({"dokvotering": {"votering": vote | {"extra": 1}}}))
        z.writestr(f"HB3-2-{vid}.json", "{broken")
        z.writestr("readme.json", "{}")
    got = readers.votes_from_archives(spark, str(tmp_path))
    assert rows(got.select("dok_id", "punkt", "votering_id")) == [("HB1", 2, vid.upper()), ("HB1", None, vid.upper()), ("HB2", 2, vid.upper())]


def test_tolerant_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"cid": "1"}, {"cid": "2"}]')
    (tmp_path / "b.json").write_text('{"decisions": [{"cid": "3"}]}')
    (tmp_path / "c.json").write_text('{"cid": "4"}')
    (tmp_path / "d.json").write_text('{"cid": "5"},\n\n{"cid": "6", "flags": ["x"]}\nnoise\n{"cid": "7", "ro')
    got = readers.tolerant_records(spark, str(tmp_path))
    assert rows(got.select("file", "cid")) == [("a.json", "1"), ("a.json", "2"), ("b.json", "3"), ("c.json", "4"), ("d.json", "5"), ("d.json", "6")]


def test_logs_statistics_and_polls(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": "a", "n": 1, "v": "x"}\n{"k": "a", "n": 2, "v": "y"}\nbroken\n{"k": "b", "n": 1, "v": "z"}\n')
    assert rows(readers.keyed_log(spark, str(tmp_path / "log.jsonl"), "k string, n int, v string", ["k"], "n")) == [("a", 2, "y"), ("b", 1, "z")]
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "x.json").write_text(json.dumps({"dimension": {"Tid": {"category": {"index": {"2024M01": 0, "2024M02": 1}}}}, "value": [1.5, None]}))
    (tmp_path / "s1" / "y.json").write_text(json.dumps({"dimension": {"Tid": {"category": {"index": {"2024M03": 0, "2024M04": 1}}}}, "value": {"1": 4}}))
    assert rows(readers.json_stat(spark, str(tmp_path / "s1"), "Tid")) == [("2024-01", 1.5), ("2024-04", 4.0)]
    (tmp_path / "p.csv").write_text("day,A,F\n2024-01-02,1.5,2\n2024-01-03,x,3\nnone,1,2\n")
    assert rows(readers.polls(spark, str(tmp_path / "p.csv"), ["A", "F"], 2)) == [("2024-01-02", "A", 1.5), ("2024-01-02", "F", 2.0)]
    assert readers.optional_table(spark, str(tmp_path / "nowhere"), "a int").count() == 0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "avtal-a.txt").write_text("﻿ Hej \n")
    assert rows(readers.text_documents(spark, str(tmp_path / "d")))[0][0] == "avtal-a"


def test_transcripts_and_dated_lines(spark, tmp_path):
    lines = [("r", "w", "s1", "m1", 5), ("r", "w", "s1", "m1", 9), ("r", "w", "s2", "m1", 9), ("r", "w", "s2", "m2", 4)]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps({"run": a, "worker": b, "session": c, "message": d, "output_tokens": n, "input_tokens": 1, "at": "2024-01-01T00:00:00Z"}) for a, b, c, d, n in lines))
    got = readers.transcripts(spark, str(tmp_path / "t.jsonl")).first()
    assert (got.session, got.turns, got.output_tokens) == ("s2", 2, 13)
    text = ["==Händelser==", "===Januari===", "* 3 – Något sker", "** Mer samma dag", "===Februari===", "* 4 – Annat"]
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "d string, i int, t string")
    got = rows(readers.dated_lines(df, ["d"], "i", "t").select("month", "day", "item"))
    assert got == [("Februari", "4", "Annat"), ("Januari", "3", "Mer samma dag"), ("Januari", "3", "Något sker")]


def test_made_decisions_follow_their_weights(spark):
    cases = spark.range(2000).select(F.col("id").cast("string").alias("votering_id"))
    share = {r.rost: r.n / 16_000 for r in readers.made_decisions(cases, domain.parties(spark), "r", 3).groupBy("rost").agg(F.count("*").alias("n")).collect()}
    assert abs(share["Ja"] - 0.72) < 0.02 and abs(share["Nej"] - 0.16) < 0.02


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x"], None), ("b", 2, None, "bad")], "k string, n int, l array<string>, reason string")
    sinks.write_documents(df, "k", str(tmp_path / "docs"))
    assert json.loads((tmp_path / "docs" / "a.json").read_text()) == {"k": "a", "n": 1, "l": ["x"]}
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["k", "n", "reason"]
    first = (sinks.write_gzip(df, [F.desc("n")], str(tmp_path / "1.gz")), (tmp_path / "1.gz").read_bytes())
    assert first == (sinks.write_gzip(df, [F.desc("n")], str(tmp_path / "2.gz")), (tmp_path / "2.gz").read_bytes())
    sinks.quarantine(df, "reason", str(tmp_path / "good"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == spark.read.parquet(str(tmp_path / "bad")).count() == 1
    sinks.write_summary(df, str(tmp_path / "s.json"))
    assert len(json.loads((tmp_path / "s.json").read_text())) == 2
    with pytest.raises(ValueError):
        sinks.write_summary(df, str(tmp_path / "s.json"), 1)
    sinks.write_lines(df, str(tmp_path / "l"), [F.col("n")])
    assert spark.read.json(str(tmp_path / "l")).count() == 2


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 2)], "k string, n int")
    path = str(tmp_path / "t")
    assert sinks.append_new(df, path, ["k"], F.col("n")) == 2
    assert sinks.append_new(df, path, ["k"], F.col("n")) == 0
    assert sinks.append_new(df.union(spark.createDataFrame([("c", 1)], "k string, n int")), path, ["k"], F.col("n")) == 1
    assert rows(spark.read.parquet(path)) == [("a", 0), ("b", 2), ("c", 1)]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k": "a", "n": 1}\n{"k": "a", "n": 2}\n{"k": "b"')
    run = lambda: flows.ingest(flows.file_stream(spark, str(src), "k string, n int"), str(tmp_path / "out"), ["k"], "n", str(tmp_path / "cp")).awaitTermination()
    run()
    (src / "2.json").write_text('{"k": "a", "n": 9}\n{"k": "c", "n": 3}')
    run()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("a", 1), ("c", 3)]

    base = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(i, base + dt.timedelta(minutes=7 * i), "x", float(i)) for i in range(40)], "i int, ts timestamp_ntz, kind string, value double")
    events.write.parquet(str(tmp_path / "ev"))
    schema = "i int, ts timestamp_ntz, kind string, value double"
    stream = flows.tumbling(flows.file_stream(spark, str(tmp_path / "ev"), schema, "parquet"), "ts", "1 hour", "10 minutes", ["kind"], "value")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == 40
    growing = flows.latest_usage(flows.file_stream(spark, str(tmp_path / "ev"), schema, "parquet"), ["kind"], "value")
    q = growing.writeStream.format("memory").queryName("u").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.sql("select * from u")) == [("x", 39.0)]
    assert flows.sessions(flows.file_stream(spark, str(tmp_path / "ev"), schema, "parquet"), "ts", "1 hour", "1 hour", ["kind"]).isStreaming
    timed = flows.file_stream(spark, str(tmp_path / "ev"), "i int, ts timestamp, kind string, value double", "parquet")
    assert flows.bounded_distinct(timed, "ts", ["i"], "1 hour").isStreaming


def test_contract():
    import __spark_entry__ as entry

    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 60 and {"p1_found", "p2_found", "p4_found"} <= set(queries)


def test_table_rows_notices_and_pages(spark, tmp_path):
    import datetime

    from votaria.sources import readers

    (tmp_path / "px.json").write_text('﻿{"data":[{"key":["a","2024M01"],"values":["1.5"]},{"key":["a","2024M02"],"values":[".."]},{"key":["b"],"values":[]}]}', encoding="utf-8")
    assert [(list(r.keys), r.value) for r in readers.pxweb(spark, str(tmp_path / "px.json")).collect()] == [(["a", "2024M01"], 1.5)]
    (tmp_path / "n1.json").write_text('[{"published":"2024-05-01T10:00","title":"T","preamble":" "},{"published":"","title":"X"},{"published":"2024-05-02","preamble":"P","url":"u"}]')
    (tmp_path / "n2.json").write_text('{"items":[{"published":"2024-05-02","preamble":"P","url":"u"}]}')
    got = sorted((r.day, r.text, r.source) for r in readers.notices(spark, str(tmp_path / "n*.json")).collect() if r.source or True)
    assert sorted(got, key=str) == [(datetime.date(2024, 5, 1), "T", None), (datetime.date(2024, 5, 2), "P", "u")]
    item = "En händelse som är lång nog för att tas med i listan"
    (tmp_path / "page.html").write_text(f'<p id="2024_March_5">x</p><ul><li>{item} <b>1</b></li><li>kort</li>' + "".join(f"<li>{item} {i}</li>" for i in range(2, 10)) + f'<li>{item}\na\nb\nc</li></ul><p id="2024_March_6"></p><li>{"y" * 500}</li>')
    pages = readers.daily_pages(spark, str(tmp_path / "page.html")).collect()
    assert sorted(r.text for r in pages if r.day == datetime.date(2024, 3, 5)) == [f"{item} {i}" for i in range(1, 7)]
    assert [len(r.text) for r in pages if r.day == datetime.date(2024, 3, 6)] == [400]


def test_runs_versions_and_merges(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from votaria.sources import readers, sinks

    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "A.jsonl").write_text('{"cid":"1","rost":"Ja"}\n\n{"cid":"2"\n')
    assert [r.cid for r in readers.run_decisions(spark, str(tmp_path / "run")).collect()] == ["1"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "A.jsonl").write_text("\n")
    with pytest.raises(ValueError):
        readers.run_decisions(spark, str(tmp_path / "empty"))
    place = str(tmp_path / "versions")
    for n in (3, 5):
        sinks.replace_table(spark.range(n), place)
        assert sinks.read_current(spark, place).count() == n
    files = tmp_path / "workers"
    files.mkdir()
    (files / "g1.json").write_text('[{"cid":"a","rost":"Ja"},{"cid":"a","rost":"Nej"},{"cid":"zz"}]')
    (files / "g2.json").write_text('{"cid":"b"}\n{"cid":"c"')
    issued = spark.createDataFrame([("g1.json", "a"), ("g2.json", "b"), ("g2.json", "c")], "file string, cid string")
    target = str(tmp_path / "merged")
    assert {r.verdict: r.n for r in sinks.merge_files(spark, str(files), issued, target).collect()} == {"added": 2, "repeated": 1, "foreign": 1, "missing": 1}
    assert {r.verdict: r.n for r in sinks.merge_files(spark, str(files), issued, target).collect()} == {"added": 0, "repeated": 3, "foreign": 1, "missing": 1}
    assert sinks.next_batch(spark.createDataFrame([(4,), (7,)], "batch_no int")) == 8 and sinks.next_batch(spark.createDataFrame([], "batch_no int")) == 1
    keyed = spark.createDataFrame([(1, "p", 1), (1, "p", 2), (2, "q", 1)], "k int, part string, o int")
    for want in (2, 0):
        assert sinks.append_new(keyed, str(tmp_path / "parts"), ["k", "part"], F.col("o"), "part") == want
    assert sinks.append_new(keyed.withColumn("k", F.col("k") + 10).where("part = 'q'"), str(tmp_path / "parts"), ["k", "part"], F.col("o"), "part") == 1


def test_a_cycle_of_a_run(spark, tmp_path):
    from votaria.plans.cycle import run_cycle

    text = "Regeringen ska stärka kommunernas ansvar för skolan och vården i hela landet."
    blocks = spark.createDataFrame([("s", 1, text)], "slug string, place int, text string")
    cite = lambda q, d="plan": {"document": d, "slug": "s", "quote": q}
    rows = [{"cid": "1", "citations": [cite("stärka kommunernas ansvar"), cite("stärka kommunemas ansvar för skolan och vården"), cite("något som inte alls finns här")]}, {"cid": "2", "citations": []}, {"cid": "9"}]
    import json

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "g.json").write_text(json.dumps(rows), encoding="utf-8")
    issued = spark.createDataFrame([("g.json", "1"), ("g.json", "2"), ("g.json", "3")], "file string, cid string")
    for _ in range(2):  # again, without effect
        done = {r.name: r.n_bad for r in run_cycle(spark, str(tmp_path / "in"), issued, blocks, str(tmp_path / "run"), str(tmp_path / "mended"), [("plan", "hela landet")], [("plan", "kommunernas ansvar")]).collect()}
        assert done == {"foreign": 1, "missing": 1, "repeated": 0, "not verbatim": 0}
    from votaria.sources import sinks

    mended = {r.cid: r for r in sinks.read_current(spark, str(tmp_path / "mended")).collect()}
    assert [c.quote for c in mended["1"].citations] == ["stärka kommunernas ansvar", "stärka kommunernas ansvar för skolan och vården", ""] and mended["1"].n_weak == 2
    assert set(mended["1"].flags) == {"citat_korrigerat", "citat_ej_verifierat", "citat_svagt"} and mended["2"].citations == []
