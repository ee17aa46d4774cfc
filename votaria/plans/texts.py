"""Queries on the form of texts: cleaning, kinds of lines, reflow, meanings, titles and parsed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from votaria import domain
from votaria.expr import key_form
from votaria.functions import text as tx
from votaria.operators.shape import islands
from votaria.plans import context
from votaria.plans import parliament as pl
from votaria.plans.context import _WS, _q
from votaria.plans.documents import _RES, _alternatives
from votaria.plans.parliament import Frames, _with
from votaria.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        def run(spark, root):
            return build(Frames(spark, root))

        run.__name__, run.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = run
        if sql:
            ORACLE[build.__name__] = f"with {pl.BASE} {sql}"
        return run

    return register


_collapse = lambda x: f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"
_shorten = lambda x, n: f"(case when length({x}) <= {n} then {x} else regexp_replace(left({x}, {n - 1}), ' [^ ]*$', '') || '…' end)"


def _blocks(f: Frames, *columns: str) -> DataFrame:
    return table(f.spark, f.root, "docblocks").select(*columns).distinct()


@query(f"select distinct block_id, {context._KEY.format('text')} as key from docblocks where text is not null and block_id is not null")
def match_keys(f: Frames) -> DataFrame:
    """The form in which passages are matched: composed, collapsed, case-folded."""
    return _blocks(f, "block_id", "text").where("text is not null and block_id is not null").select("block_id", tx.match_key(F.col("text")).alias("key")).distinct()


_SIGNS = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"


def _signs_sql(x: str) -> str:
    x = f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')"
    for a, b in tx.LIGATURES.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"regexp_replace(regexp_replace({x}, '{_SIGNS}', '', 'g'), '[\\x{{A0}}\\x{{2007}}\\x{{202F}}]', ' ', 'g')"


@query(f"select distinct block_id, sha256({_signs_sql('text')}) as digest, length({_signs_sql('text')}) as n_chars from docblocks where text is not null and block_id is not null")
def repaired_signs(f: Frames) -> DataFrame:
    """Blocks with line ends, ligatures, invisible signs and hard blanks put right."""
    fixed = tx.repaired_signs(F.col("text"))
    return _blocks(f, "block_id", "text").where("text is not null and block_id is not null").select("block_id", F.sha2(fixed, 256).alias("digest"), F.length(fixed).cast("bigint").alias("n_chars")).distinct()


_LETTERS = "length(regexp_replace(line, '[^\\p{L}]', '', 'g'))"
_UNREADABLE = f"({_LETTERS} >= 3 and length(regexp_replace(line, '[^\\p{{L}}]|[A-Za-z{tx.KNOWN_LETTERS}]', '', 'g'))::double / {_LETTERS} > 0.3)"
_LINE_KIND = f"""case when {_UNREADABLE} then 'unreadable' when regexp_matches(line, '{tx.BULLET}') then 'bullet'
when not (length(line) <= 90 and len(regexp_split_to_array(trim(line), '\\s+')) <= 14) or regexp_matches(regexp_replace(line, '[:;]$', ''), '{_q(tx.SENTENCE_END)}') then 'para'
when regexp_matches(line, '{tx.NUMBERED}') then case when contains(regexp_extract(line, '^\\s*([0-9]{{1,2}}(?:\\.[0-9]{{1,2}})*)[.)]?\\s+\\p{{Lu}}', 1), '.') then 'subheading' else 'heading' end
when {_LETTERS} >= 3 and regexp_replace(line, '[^\\p{{L}}]', '', 'g') = upper(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) then 'heading' when regexp_matches(line, '^[A-ZÅÄÖ]') then 'subheading' else 'para' end"""


@query(f"select kind, line_kind, count(*) as n from (select kind, {_LINE_KIND} as line_kind from (select kind, line from (select distinct block_id, kind, text from docblocks where text is not null), unnest(string_split(text, chr(10))) as u(line)) where trim(line) <> '') group by all")
def line_kinds(f: Frames) -> DataFrame:
    """Lines by the kind their form shows, beside the kind of their block."""
    lines = _blocks(f, "block_id", "kind", "text").where("text is not null").select("kind", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return lines.groupBy("kind", tx.line_kind(F.col("line")).alias("line_kind")).agg(F.count("*").alias("n"))


_SHAPE = "case when kind in ('heading', 'subheading') then 'heading' when kind in ('bullet', 'toc') then 'list' else 'text' end"


@query(_with(f"b as (select distinct slug, seq, block_id, {_SHAPE} as shape from docblocks where slug is not null and seq is not null), r as (select *, row_number() over (partition by slug order by seq, block_id) - row_number() over (partition by slug, shape order by seq, block_id) as run from b)", "select slug, min(seq) as first, max(seq) as last, count(*) as n, case when shape = 'heading' and count(*) >= 4 then 'toc' else shape end as shape from r group by slug, shape, run"))
def block_runs(f: Frames) -> DataFrame:
    """Runs of like blocks: four or more headings in a row are a table of contents, bullets in a row one list."""
    shape = F.when(F.col("kind").isin("heading", "subheading"), "heading").when(F.col("kind").isin("bullet", "toc"), "list").otherwise("text")
    rows = _blocks(f, "slug", "seq", "block_id", "kind").where("slug is not null and seq is not null").select("slug", "seq", "block_id", shape.alias("shape")).distinct()
    runs = islands(rows.withColumn("at", F.struct("seq", "block_id")), ["slug"], "at", ["shape"])
    return runs.select("slug", F.col("first.seq").alias("first"), F.col("last.seq").alias("last"), "n", F.when((F.col("shape") == "heading") & (F.col("n") >= 4), "toc").otherwise(F.col("shape")).alias("shape"))


_NAMES = ", ".join(f"('{p.lower()}', '{n}')" for p, n in zip(domain.PARTIES, domain.PARTY_NAMES, strict=True))


@query(_with(f"nm(code, name) as (values {_NAMES}), kn(kind, label) as (values ('partiprogram', 'Partiprogram'), ('valmanifest', 'Valmanifest'), ('budgetmotion', 'Budgetmotion'), ('avtal', 'Överenskommelse')), s as (select distinct slug, regexp_extract(slug, '^(\\w+)-', 1) as kind, regexp_extract(slug, '^\\w+-(.+)-\\d{{4}}-\\d+$', 1) as code, regexp_extract(slug, '-(\\d{{4}})-\\d+$', 1) as year from docblocks where slug is not null)", "select slug, coalesce(label || ' ' || year || ' — ' || name, slug) as title from s left join nm using (code) left join kn using (kind)"))
def document_titles(f: Frames) -> DataFrame:
    """A title for each document, from its slug."""
    return _blocks(f, "slug").where("slug is not null").select("slug", tx.document_title(F.col("slug")).alias("title"))


def _widths(lines: DataFrame) -> DataFrame:
    """``slug, width``: the 90th percentile of line lengths by rank, from counts per length."""
    counts = lines.where("line <> ''").groupBy("slug", F.length("line").alias("w")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("slug").orderBy("w").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy("slug")))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 9 / 10)) + 1
    return ranked.where(F.col("upto") >= at).groupBy("slug").agg(F.min("w").alias("width"))


_END = _q(tx.SENTENCE_END)


@query(_with(f"""bl as (select distinct slug, block_id, text from docblocks where kind = 'para' and slug is not null and block_id is not null and text is not null),
li as (select slug, block_id, text, i, trim(l) as line from bl, unnest(string_split(text, chr(10))) with ordinality as u(l, i)),
wd as (select slug, l[(least(len(l) - 1, floor(0.9 * len(l))) + 1)::int] as width from (select slug, list(length(line) order by length(line)) as l from li where line <> '' group by slug)),
pv as (select li.*, width, lag(line) over (partition by slug, block_id, text order by i) as last from li left join wd using (slug)),
jn as (select *, regexp_matches(last, '[a-zåäöéü]-$') and regexp_matches(line, '^[a-zåäöéü]') as hy, case when width > 0 and width < 150 then length(last) >= 0.72 * width else not regexp_matches(last, '{_END}') and not regexp_matches(line, '{tx.BULLET}') and not regexp_matches(line, '{tx.NUMBERED}') end as on_ from pv where line <> ''),
nb as (select *, case when last is not null and last <> '' and (hy or on_) then 0 else 1 end as brk from jn),
gp as (select *, sum(brk) over (partition by slug, block_id, text order by i) as para, lead(brk = 0 and hy) over (partition by slug, block_id, text order by i) as cut from nb),
pa as (select slug, block_id, text, para, rtrim(string_agg(case when coalesce(cut, false) then line[:-2] else line || ' ' end, '' order by i)) as p from gp group by all)""", "select block_id, slug, list(p order by para) as paragraphs from pa group by block_id, slug, text"))
def merged_lines(f: Frames) -> DataFrame:
    """Blocks as paragraphs, their lines put together by the width of their document."""
    blocks = _blocks(f, "slug", "block_id", "kind", "text").where("kind = 'para' and slug is not null and block_id is not null and text is not null").select("slug", "block_id", "text").distinct()
    lines = blocks.select("slug", F.explode(F.split("text", "\n")).alias("l")).select("slug", F.trim("l").alias("line"))
    rows = blocks.join(_widths(lines), "slug", "left")
    return rows.select("block_id", "slug", tx.merged_lines(F.split("text", "\n"), F.coalesce("width", F.lit(0))).alias("paragraphs")).where("size(paragraphs) > 0")


def _meaning(lang: int) -> str:
    topic = _shorten(_collapse(f"regexp_extract(forslag_text, '{tx.TOPIC}', 1)"), tx.LONGEST_TOPIC)
    rules = ", ".join(f"case when regexp_matches(forslag_text, '{row[0]}') then " + (f"'{_q(row[lang].removesuffix('{x}'))}' || {topic}" if "{x}" in row[lang] else f"'{_q(row[lang])}'") + " end" for row in tx.ACTIONS)
    first = _shorten(_collapse("string_split(forslag_text, '.')[1]"), tx.LONGEST_SENTENCE)
    kept = f"list_slice(list_filter([{rules}], lambda x: x is not null), 1, 2)"
    return f"case when len({kept}) > 0 then array_to_string({kept}, '{' samt ' if lang == 1 else ' and '}') else {first} end"


_MONTH = "[" + ", ".join(f"'{m}'" for m in tx.MONTHS) + "]"


@query(f"select votering_id, {_meaning(1)} as meaning_sv, {_meaning(2)} as meaning_en, {_MONTH}[month(datum)] || ' ' || year(datum) as month_label from c where forslag_text is not null")
def meanings(f: Frames) -> DataFrame:
    """What each proposal does, in a phrase or two of both languages, and when it was decided."""
    text = F.col("forslag_text")
    label = F.when(F.col("datum").isNotNull(), tx.month_label(F.col("datum")))
    return f.cases.where("forslag_text is not null").select("votering_id", tx.meanings(text).alias("meaning_sv"), tx.meanings(text, "en").alias("meaning_en"), label.alias("month_label"))


@query(_with(f"w as (select votering_id, string_split({_collapse('forslag_text')}, ' ') as ws from c where forslag_text is not null)", "select votering_id, case when len(ws) <= 8 then array_to_string(ws, ' ') else array_to_string(ws[:8], ' ') || ' [+' || (len(ws) - 8) || ']' end as head, case when len(ws) <= 8 then array_to_string(ws, '|') else array_to_string(ws[:5], '|') || ',' || array_to_string(ws[-4:], '|') end as link_words from w"))
def text_heads(f: Frames) -> DataFrame:
    """The first words of each proposal with the number left out, and the words of its link."""
    text = F.col("forslag_text")
    link = F.replace(F.url_decode(F.replace(F.substring_index(tx.fragment_link(text), "text=", -1), F.lit("%20"), F.lit("|"))), F.lit("+"), F.lit("+"))
    return f.cases.where("forslag_text is not null").select("votering_id", tx.first_words(text, 8).alias("head"), link.alias("link_words"))


_SUBSTANCE = context._SCRUBBED
for _pattern, _by in ((tx.PARTY_TAG, ""), (tx.PARTY_NAME, "\\1partiet\\2")):
    _SUBSTANCE = f"regexp_replace({_SUBSTANCE}, '{_q(_pattern)}', '{_by}', 'g')"


@query(f"select votering_id, {_collapse(_SUBSTANCE)} as text from c where forslag_text is not null")
def scrubbed_substance(f: Frames) -> DataFrame:
    """Proposals without authors, numbers, dates, party tags and party names."""
    return f.cases.where("forslag_text is not null").select("votering_id", tx.scrub_substance(F.col("forslag_text")).alias("text"))


@query(f"select votering_id, {_collapse('forslag_text')} as plain from c where forslag_text is not null")
def cleaned_markup(f: Frames) -> DataFrame:
    """Proposals written as markup with entities and read back as plain text."""
    coded = F.col("forslag_text")
    for a, b in (("&", "&amp;"), ("<", "&#x3C;"), (">", "&gt;"), ("å", "&aring;"), ("ö", "&#246;"), ("\n", "<br/>\n")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return f.cases.where("forslag_text is not null").select("votering_id", tx.plain(F.concat(F.lit("<p class='x'>"), coded, F.lit("</p>"))).alias("plain"))


_BODY = "regexp_replace(replace(text, 'Bilaga', 'bilaga'), '[()]', '', 'g')"


@query(_with(f"{_RES}, who as (select votering_id, alt_id, {_BODY} as body, list_filter(regexp_split_to_array(upper(source_partier), '[^A-ZÅÄÖ]+'), lambda x: x in ({', '.join(repr(p) for p in domain.PARTIES)})) as ps from a1 where alt_id like 'res-%' and text is not null and source_partier is not null)", f"select votering_id, alt_id, ps as parties, {_collapse('body')} as body from who where len(ps) > 0 and length({_collapse('body')}) >= 40"))
def parsed_reservations(f: Frames) -> DataFrame:
    """Reservations written as the section of a report, and found in it again by their signature."""
    body = F.regexp_replace(F.replace("text", F.lit("Bilaga"), F.lit("bilaga")), "[()]", "")
    codes = F.filter(F.split(F.upper("source_partier"), "[^A-ZÅÄÖ]+"), lambda x: x.isin(list(domain.PARTIES)))
    rows = _alternatives(f).where("alt_id like 'res-%' and text is not null").select("votering_id", "alt_id", body.alias("body"), codes.alias("codes")).where("size(codes) > 0")
    report = F.concat(F.lit("Utskottet föreslår. (A) Motioner. "), F.lit("("), F.array_join("codes", ", "), F.lit("). Förslag till riksdagsbeslut Riksdagen beslutar. Ställningstagande "), F.col("body"), F.lit(" Reservation 2 (X) slutar. Bilaga"))
    return rows.select("votering_id", "alt_id", tx.plain(report).alias("report")).select("votering_id", "alt_id", F.inline(tx.reservations(F.col("report"))))


@query(_with("t as (select votering_id, list_filter(i, lambda x, k: list_position(i, x) = k) as ids, b from (select votering_id, regexp_extract_all(forslag_text, '" + tx.MOTION_REF + f"') as i, {_collapse('regexp_replace(notis, chr(39) || chr(63), chr(32))')} as b from c where forslag_text is not null and trim(notis) <> ''))", "select votering_id, ids as motions, b as body from t"))
def parsed_committee_blocks(f: Frames) -> DataFrame:
    """The committee's positions written into a report and found again, with the motions discussed before each."""
    report = F.concat("forslag_text", F.lit(" Utskottets ställningstagande "), "notis", F.lit(" Reservation 1 (A) anser annat."))
    return f.cases.where("forslag_text is not null and trim(notis) <> ''").select("votering_id", tx.plain(report).alias("report")).select("votering_id", F.inline(tx.committee_blocks(F.col("report"))))


@query(f"select count(*) as n, count(*) filter (a = b) as n_equal from (select upper(trim(votering_id)) as k, min(trim(dok_id)) as a, max(trim(dok_id)) as b from votes where trim(votering_id) <> '' group by all)")
def id_spellings(f: Frames) -> DataFrame:
    """Divisions whose report is spelt in one way only."""
    rows = table(f.spark, f.root, "votes").groupBy(key_form("votering_id").alias("k")).agg(F.min(F.trim("dok_id")).alias("a"), F.max(F.trim("dok_id")).alias("b")).where("k is not null")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))
