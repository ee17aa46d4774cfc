"""The whole mixture against SQL over a fixed table of sizes and weights."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from votaria.llm import mixing

SQL = """
with ok as (select * from docs where source is not null and source <> '' and tokens > 0),
so as (select source, sum(tokens) as source_tokens, avg(quality) as mean_quality from ok group by source),
tw as (select distinct mix_id, lower(trim(source)) as source, greatest(coalesce(weight, 0), 0) as weight, greatest(coalesce(max_repeat, 0), 0) as max_repeat, total_factor from targets),
tg as (select mix_id, source, sum(weight) as weight, max(max_repeat) as max_repeat, max(total_factor) as total_factor from tw group by all),
pl as (select tg.*, coalesce(weight / nullif(sum(weight) over (partition by mix_id), 0), 0) as share, coalesce(total_factor, 0) * (select sum(tokens) from docs) as whole from tg),
pb as (select pl.*, share * whole as budget, source_tokens, mean_quality from pl left join so using (source)),
ep as (select *, coalesce(least(floor(budget / source_tokens), max_repeat), 0) as epochs from pb),
re as (select *, case when epochs < max_repeat then budget - epochs * source_tokens else 0 end as rest from ep),
ke as (select ok.doc_id, ok.tokens, re.*, -ln(ok.u) * re.mean_quality / ok.quality as key from ok join re using (source)),
ru as (select *, sum(tokens) over (partition by mix_id, source order by key, doc_id rows unbounded preceding) as running from ke)
select mix_id, source, doc_id, tokens, (epochs + case when rest > 0 and running <= rest then 1 else 0 end)::bigint as repeats from ru where epochs + case when rest > 0 and running <= rest then 1 else 0 end > 0"""


@pytest.mark.parametrize("bucket_docs", [15, 100_000])
def test_mixture_equals_sql(spark, monkeypatch, bucket_docs):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", bucket_docs)
    r = random.Random(12)
    rows = [(i, r.choice(["a", "b", "B ", "c", None, ""]), r.randrange(0, 400), round(r.uniform(0.25, 1.0), 4)) for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long, quality double")
    targets = [(1, "A", 2.0, 2, 0.4), (1, "b", 1.0, 4, 0.4), (1, "none", 1.0, 3, 0.4), (2, "c", 0.5, 3, 1.7), (2, "b", 0.25, 1, 1.7), (3, "a", None, 2, 1.0), (3, "b", 1.0, 1, None), (4, "c", 1.0, 0, 1.0), (5, "c", 3.0, 9, 0.01), (1, "A", 2.0, 2, 0.4)]
    t = spark.createDataFrame(targets, "mix_id int, source string, weight double, max_repeat int, total_factor double")
    # sizes and weights as they are in the table, in place of those of a text
    monkeypatch.setattr(mixing, "measured", lambda df, *a: df.drop("_text").join(docs.select("doc_id", "tokens", "quality"), "doc_id"))
    chosen, plan = mixing.mixture(docs.withColumn("text", F.lit("")), t)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    frame = docs.withColumn("source", F.lower(F.trim("source"))).withColumn("u", u).toPandas()
    con = duckdb.connect()
    con.register("docs", frame)
    con.register("targets", t.toPandas())
    want = sorted(con.sql(SQL).fetchall())
    assert sorted(tuple(x) for x in chosen.select("mix_id", "source", "doc_id", "tokens", "repeats").collect()) == want and want
    shares = {(x.mix_id, x.source): x for x in mixing.shares(chosen, plan).collect()}
    assert all(x.most_repeats <= (x.max_repeat or 0) and x.actual_tokens <= x.target_tokens + 1e-6 for x in shares.values())
    assert abs(sum(x.actual_share for k, x in shares.items() if k[0] == 1) - 1) < 1e-9
