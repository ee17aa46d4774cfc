"""Queries of the problems on text: 3, 5, 6, 7 and 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votaria.expr import key_form
from votaria.llm.leakage import leaks
from votaria.llm.mixing import mixture, shares
from votaria.llm.personal import personal_mentions, redacted
from votaria.llm.scanrepair import repaired
from votaria.llm.textform import LOOKALIKES, classes, lookalike_pairs, to_comparison, to_visual
from votaria.tables import table


def _texts(spark: SparkSession, root: str) -> DataFrame:
    """``field, key, text`` of the fields that hold passages."""
    cases = table(spark, root, "cases").select(F.lit("forslag_text").alias("field"), key_form("votering_id").alias("key"), F.col("forslag_text").alias("text"))
    quotes = table(spark, root, "decisions").select(F.inline("citations")).select(F.lit("citation_quote").alias("field"), F.col("cite_id").cast("string").alias("key"), F.col("quote").alias("text"))
    blocks = table(spark, root, "docblocks").where("kind = 'para'").select(F.lit("docblock_text").alias("field"), F.col("block_id").cast("string").alias("key"), "text")
    return cases.unionByName(quotes).unionByName(blocks)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of records of a field that look the same but differ in characters."""
    return lookalike_pairs(_texts(spark, root), ["field"], "key", "text")


def p3_forms(spark: SparkSession, root: str) -> DataFrame:
    """Every passage in the common form, and in the folded one that ignores case and compatibility as well."""
    return _texts(spark, root).where("key is not null").distinct().select("field", "key", to_visual("text").alias("text"), to_comparison("text").alias("folded")).distinct()


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    """Records with look-alikes, with the class they belong to (named after its first record) and the number of spellings."""
    found = classes(_texts(spark, root).where("key is not null"), ["field"], "text").distinct()
    spellings = found.groupBy("field", "form_id").agg(F.count_distinct("raw_id").alias("n_spellings"), F.min("key").alias("class_key"))
    return found.join(spellings, ["field", "form_id"]).select("field", "key", "class_key", "n_spellings").distinct()


def _scanned(spark: SparkSession, root: str) -> DataFrame:
    blocks = table(spark, root, "docblocks")
    titles = blocks.where("slug is not null").groupBy("slug").agg(F.min_by("text", "seq").alias("title"))
    paragraphs = blocks.where("kind = 'para'").select(F.lit("docblocks").alias("src_table"), F.col("block_id").cast("string").alias("rec_key"), "slug", "page", "text")
    quotes = table(spark, root, "decisions").select(F.inline("citations")).select(F.lit("citations").alias("src_table"), F.col("cite_id").cast("string").alias("rec_key"), "slug", F.lit(None).cast("int").alias("page"), F.col("quote").alias("text"))
    return repaired(paragraphs.unionByName(quotes).where("rec_key is not null"), titles)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Records damaged by scanning, by kind of damage."""
    return _scanned(spark, root).select("src_table", "rec_key", F.explode("noise").alias("noise")).distinct()


def p5_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Every record as continuous paragraphs, repaired."""
    return _scanned(spark, root).select("src_table", "rec_key", "text", F.array_join("noise", ",").alias("noise")).distinct()


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with the evaluation items of which they carry a passage."""
    return leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id").distinct()


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    """Per leaked item: documents that carry it and the number of its passages found."""
    found = leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id", F.explode("passages").alias("passage"))
    return found.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("passage").alias("n_passages"))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    """The documents of each mix with their repeats."""
    chosen, _ = mixture(table(spark, root, "documents"), table(spark, root, "mix_targets"))
    return chosen


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    return shares(*mixture(table(spark, root, "documents"), table(spark, root, "mix_targets")))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Mentions of personal information, by kind and place."""
    return personal_mentions(table(spark, root, "documents")).select("doc_id", "kind", "start_pos").distinct()


def p8_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every document with placeholders for personal information."""
    return redacted(table(spark, root, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_forms, p3_classes, p5_found, p5_repaired, p6_found, p6_report, p7_mix, p7_shares, p8_found, p8_redacted)}

_WINDOWS = """
w as (select 'd' as kind, doc_id as id, text from documents where doc_id is not null union all select 'i', item_id, text from eval_items where item_id is not null),
tok as (select kind, id, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(strip_accents(nfc_normalize(text))), '[²]', '2', 'g'), '\\p{M}', '', 'g'), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as ws from w where text is not null),
win as (select kind, id, unnest(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(list_slice(ws, i, i + 11), ' '))) as p from tok where len(ws) >= 12)"""


def _visual_sql(x: str) -> str:
    """The common form in SQL, for the disguises of these tables: wide forms, ligatures, blanks, marks, signs without width, look-alikes."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    more = {"ё": "ë", "ї": "ï", "Ё": "Ë", "Ї": "Ï", "ӓ": "ä", "ӧ": "ö", "Ӓ": "Ä", "Ӧ": "Ö", "ѐ": "è", "Ѐ": "È", "ό": "ó", "Ό": "Ó", "ӑ": "ă", "Ӑ": "Ă", "µ": "μ", "\u2010": "-", "\u2011": "-"}
    pairs = {c: b for c, b in LOOKALIKES.items() if len(b) == 1} | more
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    x = f"regexp_replace({x}, '[\\x{{ad}}\\x{{61c}}\\x{{200b}}-\\x{{200f}}\\x{{202a}}-\\x{{202e}}\\x{{2060}}-\\x{{206f}}\\x{{fe00}}-\\x{{fe0f}}\\x{{feff}}\\x{{180e}}\\x{{34f}}]', '', 'g')"
    for a, b in {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "…": "..."}.items():
        x = f"replace({x}, '{a}', '{b}')"
    x = f"nfc_normalize(translate({x}, '{wide}{''.join(pairs)}', '{narrow}{''.join(pairs.values())}'))"
    return f"regexp_replace(regexp_replace({x}, '[\\t\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]', ' ', 'g'), ' +(\n|$)', '\\1', 'g')"


_PASSAGES = f"""t3 as (
  select 'forslag_text' as field, upper(trim(votering_id)) as key, forslag_text as t from cases where trim(votering_id) <> ''
  union select 'citation_quote', x.cite_id::varchar, x.quote from (select unnest(citations) as x from decisions)
  union select 'docblock_text', block_id::varchar, text from docblocks where kind = 'para'),
v3 as (select field, key, t, {_visual_sql("t")} as form from t3 where t is not null and key is not null),
sp as (select field, form, count(distinct t) as n_spellings from v3 group by all having count(distinct t) > 1)"""

ORACLE: dict[str, str] = {
    "p3_found": f"with {_PASSAGES} select distinct a.field, a.key as key_a, b.key as key_b from v3 a join v3 b on a.field = b.field and a.form = b.form and a.key < b.key and a.t <> b.t",
    "p3_classes": f"with {_PASSAGES} select distinct field, key, min(key) over (partition by field, form) as class_key, n_spellings from v3 join sp using (field, form)",
    "p6_found": f"with {_WINDOWS} select distinct d.id as doc_id, i.id as item_id from win d join win i on d.p = i.p and d.kind = 'd' and i.kind = 'i'",
    "p6_report": f"with {_WINDOWS} select i.id as item_id, count(distinct d.id) as n_docs, count(distinct i.p) as n_passages from win d join win i on d.p = i.p and d.kind = 'd' and i.kind = 'i' group by i.id",
}
