"""The general data problems against brute force, and their edge cases."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from votaria.expr import day_of, period_start
from votaria.operators.asof import asof_join, validity_intervals
from votaria.operators.packed import packed_values, split_packed
from votaria.operators.references import Reference, Target, orphan_references


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("broadcast_rows", [500_000, -1])
def test_asof_join_equals_brute_force(spark, broadcast_rows):
    r = random.Random(3)
    attributes = [(i, r.choice("ab"), r.choice([None, *range(60)]), r.randrange(50), r.randrange(5)) for i in range(150)]
    events = [(i, r.choice([None, *range(0, 70)])) for i in range(80)]
    a = spark.createDataFrame(attributes, "obs long, entity string, available int, p int, v int")
    e = spark.createDataFrame(events, "ev long, day int")
    intervals = validity_intervals(a, ["entity"], "available", F.struct("p", "v", (-F.col("obs")).alias("o")))
    got = rows(asof_join(e, intervals, "day", broadcast_rows=broadcast_rows).select("ev", "entity", (-F.col("best.o")).alias("obs")))
    want = []
    for ev, day in events:
        for entity in "ab":
            known = [(p, v, -o) for o, x, av, p, v in attributes if x == entity and av is not None and day is not None and av <= day]
            if known:
                want.append((ev, entity, -max(known)[2]))
    assert got == sorted(want, key=repr)


def test_asof_join_of_empty_tables_and_clashing_columns(spark):
    a = spark.createDataFrame([], "obs long, entity string, available int")
    e = spark.createDataFrame([(1, 5, "x")], "ev long, day int, best2 string")
    assert asof_join(e, validity_intervals(a, ["entity"], "available", F.struct("obs")), "day").count() == 0
    a = spark.createDataFrame([(1, "k", 3)], "obs long, entity string, available int")
    none = e.where("false")
    assert asof_join(none, validity_intervals(a, ["entity"], "available", F.struct("obs")), "day").count() == 0
    assert asof_join(e, validity_intervals(a, ["entity"], "available", F.struct("obs")), "day").count() == 1


def test_days_and_periods(spark):
    df = spark.createDataFrame([("2024-02-03",), ("20240203",), ("2024-02-03T08:00:00",), ("2024-02-30",), ("x",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(day_of("s")).collect()] == [dt.date(2024, 2, 3)] * 3 + [None] * 4
    df = spark.createDataFrame([("2024-02",), ("2024M11",), ("2024K3",), ("2024-Q1",), ("2024-05-06",), ("2024K5",), ("2024-13",), (None,)], "s string")
    assert [r[0] for r in df.select(period_start("s")).collect()] == [dt.date(2024, 2, 1), dt.date(2024, 11, 1), dt.date(2024, 7, 1), dt.date(2024, 1, 1), dt.date(2024, 5, 6), None, None, None]


def _brute(children, parents):
    out = {}
    for key, at in children:
        if key is None or not key.strip():
            continue
        k = key.strip().upper()
        own = [p for p in parents if p[0] is not None and p[0].strip().upper() == k]
        arrived = [p for p in own if p[1] is not None and at is not None and p[1] <= at]
        if any(p[2] is None or p[2] > at for p in arrived):
            continue
        reason = "missing" if not own else "deleted" if arrived else "late"
        row = ("c", "ref", k, at and at.strftime("%Y-%m"), reason)
        out[row] = out.get(row, 0) + 1
    return sorted(((*k, n) for k, n in out.items()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_orphans_equal_brute_force(spark, seed):
    r = random.Random(seed)
    t = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(days=r.randrange(90), hours=r.randrange(24))
    keys = ["a", "A ", " b", "c", "d", "e", None, " "]
    children = [(r.choice(keys) if i % 3 else "a", r.choice([t(), t(), t(), None])) for i in range(120)]
    parents = []
    for _ in range(25):
        start = t()
        parents.append((r.choice(["a", "b", "B", "c", None]), r.choice([start, start, None]), r.choice([None, start + dt.timedelta(days=r.randrange(-2, 20)), start])))
    c = spark.createDataFrame(children, "ref string, inkom_ts timestamp_ntz").withColumn("key", F.lit("clash"))
    p = spark.createDataFrame(parents, "id string, inkom_ts timestamp_ntz, borttagen_ts timestamp_ntz").withColumn("spans", F.lit(1))
    got = orphan_references([Reference(c, "c", "ref", "p")], [Target(p, "p", "id")], 0 if seed % 2 else 100_000)
    assert rows(got.select("src_table", "ref_field", "ref_value", "period", "reason", "n")) == _brute(children, parents)


def test_orphans_of_empty_tables(spark):
    c = spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "ref string, inkom_ts timestamp_ntz")
    p = spark.createDataFrame([], "id string, inkom_ts timestamp_ntz, borttagen_ts timestamp_ntz")
    assert rows(orphan_references([Reference(c, "c", "ref", "p")], [Target(p, "p", "id")])) == [("c", "ref", "A", "2024-01", "missing", 1)]
    assert orphan_references([Reference(c.where("false"), "c", "ref", "p")], [Target(p, "p", "id")]).count() == 0


PACKED = {
    '"Hembygd ""Vi"""': ['Hembygd "Vi"'], '["Hembygd \\"Vi\\"", "GR"]': ['Hembygd "Vi"', "GR"], "'Gröna rutan','HV'": ["Gröna rutan", "HV"], "A och F": ["A", "F"], '"Land, torv och hav"; N': ["Land, torv och hav", "N"],
    " (A, B) ": ["A", "B"], "A,,B,": ["A", "B"], "A\tB\nC": ["A", "B", "C"], "A | B / C + D & E;F": ["A", "B", "C", "D", "E", "F"], "A, A": ["A", "A"], '"': [], "": [], "  ": [], '"A","B': ["A", "B"], "24a": ["24a"],
}


def test_packed_values(spark):
    df = spark.createDataFrame([(s,) for s in PACKED], "s string")
    assert {r[0]: r[1] for r in df.select("s", packed_values("s")).collect()} == PACKED
    assert spark.createDataFrame([(None,)], "s string").select(packed_values("s")).first()[0] is None


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(alphabet='ab ,;"&', min_size=1, max_size=6).map(str.strip).filter(bool), min_size=1, max_size=4), min_size=1, max_size=8))
def test_quoted_values_come_back(spark, lists):
    df = spark.createDataFrame([(i, ", ".join('"' + v.replace('"', '""') + '"' for v in vs)) for i, vs in enumerate(lists)], "i int, s string")
    # a doubled quote beside an opening or closing one is ambiguous; texts without quotes are exact
    exact = [i for i, vs in enumerate(lists) if not any('"' in v for v in vs)]
    got = {r[0]: r[1] for r in df.select("i", packed_values("s")).collect()}
    assert all(got[i] == lists[i] for i in exact)


def test_split_keeps_positions_and_extra_columns(spark):
    df = spark.createDataFrame([(1, "a,b", "x"), (2, "c", "y"), (3, None, "z")], "id int, s string, value string")
    assert rows(split_packed(df.select("id", "s"), "s", ["id"], 2)) == [(1, 1, "a"), (1, 2, "b")]
    assert rows(split_packed(df.select("id", "s"), "s", ["id"])) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]
    long = "x," * 20_000
    assert split_packed(spark.createDataFrame([(1, long)], "id int, s string"), "s", ["id"]).count() == 20_000


def test_signs_used_inside_are_kept(spark):
    from votaria.operators import packed

    odd = "".join(chr(c) for c in range(0xE0FE, 0xE118)) + packed._QUOTE
    text = f'a{odd}b, "c{odd}, d" , {packed._ESCAPE}a'
    got = spark.createDataFrame([(text,)], "t string").select(packed.packed_values("t")).first()[0]
    assert got == [f"a{odd}b", f"c{odd}, d", f"{packed._ESCAPE}a"]


def test_daily_means_round_as_in_sql(spark, tmp_path, monkeypatch):
    """Means that end in five at the fifth place: values are added in the order of rows, also beside a distinct count, and rounded by the product."""
    import duckdb

    from votaria.plans import context

    r = random.Random(5)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(days=k % 40), r.randrange(6), [None, "a", "b"][k % 3], r.randrange(60_000) / 100) for k in range(960)]
    rows += [(960, None, None, None, None), (961, dt.datetime(2024, 5, 1), 1, "a", None), (962, dt.datetime(2024, 5, 2), 1, "a", float("inf"))]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    frame.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(context.ORACLE["daily_events"][len(f"with {context.pl.BASE}") :]).fetchall()

    class Read:
        def __init__(self, spark, root):
            self.spark, self.root = spark, root

    monkeypatch.setattr(context, "Frames", Read)
    got = [tuple(x) for x in context.QUERIES["daily_events"](spark, str(tmp_path)).select("day", "event_type", "n", "users", "mean").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
