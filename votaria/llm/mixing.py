"""Mixing sources to target weights by weighted sampling without replacement, in tokens."""

from __future__ import annotations

import base64
import importlib
import sys
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votaria.session import cut

TOKENIZER = "byte_bpe_50k.tiktoken"
FOLDER = "/opt/tokenizers"
#: Documents of a source in one bucket of keys, on average.
BUCKET_DOCS = 5_000
#: Plan rows (mixes times sources) up to which the plan is broadcast.
BROADCAST_ROWS = 100_000


def _pattern(folder: str) -> str:
    """The pre-tokenising pattern that belongs to the vocabulary files; read on the driver alone."""
    try:
        public = importlib.import_module("public_tokenizers")
    except ImportError:
        sys.path.append(folder.rpartition("/")[0])
        public = importlib.import_module("public_tokenizers")
    return public.PATTERN


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _quality(text: str) -> float:
    """Share of letters and blanks of the whole text, and its length up to 400 characters, as a weight from 0.25 to 1."""
    n = len(text)
    if not n:
        return 0.25
    letters = sum(map(len, text.split())) and sum(k for c, k in Counter(text).items() if c.isalpha() or c == " ") / n
    usual = min(1.0, n / 400)
    return 0.25 + 0.75 * max(0.0, min(1.0, (letters - 0.5) * 2)) * (0.5 + 0.5 * usual)


def measured(documents: DataFrame, text: str, tokenizer: str = TOKENIZER, folder: str = FOLDER) -> DataFrame:
    """``documents`` with ``tokens`` and ``quality`` instead of the text; a null text has no tokens.

    The vocabulary file is read where the driver runs, and served from there to the workers.
    """
    documents.sparkSession.sparkContext.addFile(f"{folder}/{tokenizer}")
    pattern = _pattern(folder)

    def run(texts: pd.Series) -> pd.DataFrame:
        encode = _encoding(SparkFiles.get(tokenizer), pattern).encode_ordinary
        return pd.DataFrame({"tokens": [0 if t is None else len(encode(t)) for t in texts], "quality": [0.25 if t is None else _quality(t) for t in texts]})

    sized = F.pandas_udf(run, "tokens long, quality double")(text)
    return documents.withColumn("_size", sized).withColumn("tokens", F.col("_size.tokens")).withColumn("quality", F.col("_size.quality")).drop(text, "_size")


def mixture(documents: DataFrame, targets: DataFrame, doc_key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42, tokenizer: str = TOKENIZER, folder: str = FOLDER) -> tuple[DataFrame, DataFrame]:
    """The chosen documents with their repeats, and the plan with target and actual sizes.

    ``targets`` holds ``mix_id, source, weight, max_repeat, total_factor``. A mix has ``total_factor`` times all tokens
    of ``documents``; a source's budget is its weight over the sum of the mix's weights. Whole epochs come first, at
    most ``max_repeat``; the rest of the budget takes documents in the order of exponential keys divided by quality
    (weighted sampling without replacement), as long as the running total stays within it. Sources are compared
    trimmed and in lower case. Documents without source or tokens are never chosen; unknown sources, null or negative
    weights get nothing; repeated target rows count once. Empty tables give empty results.

    No source is sorted as a whole: keys fall into buckets, bucket totals give the bucket in which the budget ends,
    and only that bucket (about ``BUCKET_DOCS`` documents) is sorted.
    """
    name = F.lower(F.trim(F.col(source)))
    sized = measured(documents.select(F.col(doc_key).alias("doc_id"), name.alias("source"), F.col(text).alias("_text")), "_text", tokenizer, folder)
    sized = cut(sized)
    usable = sized.where("source is not null and source <> '' and tokens > 0")
    sources = usable.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("n_docs"), F.avg("quality").alias("mean_quality"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]

    wanted = targets.select("mix_id", name.alias("source"), F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeat", F.lit(0)), F.lit(0)).alias("max_repeat"), "total_factor").distinct()
    wanted = wanted.groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.max("max_repeat").alias("max_repeat"), F.max("total_factor").alias("total_factor"))
    by_mix = Window.partitionBy("mix_id")
    share = F.coalesce(F.try_divide("weight", F.sum("weight").over(by_mix)), F.lit(0.0))
    budget = F.col("target_share") * F.coalesce("total_factor", F.lit(0.0)) * F.lit(float(total))
    epochs = F.least(F.floor(F.try_divide("target_tokens", "source_tokens")), F.col("max_repeat").cast("bigint"))
    plan = (
        wanted.withColumn("target_share", share).withColumn("target_tokens", budget).join(sources, "source", "left")
        .withColumn("epochs", F.coalesce(epochs, F.lit(0)))
        .withColumn("rest", F.when(F.col("epochs") < F.col("max_repeat"), F.col("target_tokens") - F.col("epochs") * F.col("source_tokens")).otherwise(0.0))
    )
    plan = cut(plan.select("mix_id", "source", "target_share", "target_tokens", "source_tokens", "epochs", "rest", "max_repeat"))
    n_plan = plan.count()
    small = lambda df: F.broadcast(df) if n_plan <= BROADCAST_ROWS else df

    # u in (0, 1); 1 - exp(-key) has the order of the key and is spread over (0, 1)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    buckets = F.ceil(F.col("n_docs") / F.lit(BUCKET_DOCS))
    keyed = usable.join(small(sources), "source").withColumn("key", -F.log(u) * F.col("mean_quality") / F.col("quality"))
    keyed = keyed.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), buckets - 1)).select("doc_id", "source", "tokens", "key", "bucket")
    totals = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("bucket_tokens"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumn("after", F.sum("bucket_tokens").over(upto))
    ends = plan.where("rest > 0").select("mix_id", "source", "rest").join(totals, "source").where("after > rest")
    ends = ends.groupBy("mix_id", "source").agg(F.min_by(F.struct("bucket", (F.col("after") - F.col("bucket_tokens")).alias("before")), "bucket").alias("end"))
    rows = keyed.join(small(plan.join(ends, ["mix_id", "source"], "left").select("mix_id", "source", "epochs", "rest", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("end_before"))), "source")
    whole = rows.where("end_bucket is null or bucket <> end_bucket").withColumn("extra", F.when((F.col("rest") > 0) & (F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket"))), 1).otherwise(0))
    running = F.sum("tokens").over(Window.partitionBy("mix_id", "source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    last = rows.where("bucket = end_bucket").withColumn("extra", F.when(F.col("end_before") + running <= F.col("rest"), 1).otherwise(0))
    out = ["mix_id", "source", "doc_id", "tokens", (F.col("epochs") + F.col("extra")).alias("repeats")]
    chosen = whole.select(*out).unionByName(last.select(*out)).where("repeats > 0")
    return chosen, plan


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """Per mix and source: target and actual tokens and shares; a source that is missing or exhausted shows its shortfall."""
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"), F.count("*").alias("n_docs"), F.max("repeats").alias("most_repeats"))
    both = plan.select("mix_id", "source", "target_share", "target_tokens", "max_repeat").join(got, ["mix_id", "source"], "left").fillna(0, ["actual_tokens", "n_docs", "most_repeats"])
    return both.withColumn("actual_share", F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), F.sum("actual_tokens").over(Window.partitionBy("mix_id"))), F.lit(0.0)))
