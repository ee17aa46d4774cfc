"""Text expressions: cleaning, scrubbing, leak labels, extraction, shortening, labels and links. All stay in the JVM."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from votaria.domain import PARTIES, PARTY_NAMES

# Joined characters of extracted text, and the months.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
MONTHS = ["januari", "februari", "mars", "april", "maj", "juni", "juli", "augusti", "september", "oktober", "november", "december"]
# Patterns are written without look-around and in hexadecimal escapes, so that Java and RE2 read them alike. The first
# group holds the sign before the match. Signs without width may stand anywhere in a number; digits, slash, colon and
# hyphen may be wide or of another shape.
_THIN = r"[\x{AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]*"
_BLANK = r"[\t\n\r \x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]"
_EDGE = r"(^|[^\p{L}\p{N}_])"
_digit = lambda n="": rf"(?:\p{{Nd}}{_THIN}){n}"
_dash = rf"[-\x{{2010}}-\x{{2014}}\x{{2212}}\x{{FF0D}}]{_THIN}"
# A document number: a session of two years, a colon, up to five letters of a committee, a serial, perhaps a letter.
SESSION = rf"{_digit('{4}')}[/\x{{FF0F}}\x{{2044}}\x{{2215}}]{_THIN}{_digit('{2}')}"
DOCUMENT_REF = rf"{_EDGE}{SESSION}[:\x{{FF1A}}]{_THIN}(?:[A-ZÅÄÖa-z]{_THIN}){{0,5}}{_digit('+')}[a-z]?"
MOTION_REF = rf"\p{{Nd}}{{4}}/\p{{Nd}}{{2}}:\p{{Nd}}+"
DATE = rf"{_EDGE}{_digit('{4}')}{_dash}{_digit('{2}')}{_dash}{_digit('{2}')}"
_CODES = "(?:" + "|".join(sorted(PARTIES, key=len, reverse=True)) + ")"
# Who wrote a proposal: "av", up to twenty words on one line, and party codes in brackets; or "av" and a code.
_BY = rf"{_BLANK}+av{_BLANK}+"
AUTHOR_CLAUSE = rf"{_BY}(?:[^\t\n\r ()]+[\t ]+){{1,20}}\((?:\p{{L}}+ )?{_CODES}(?:, *{_CODES})*\)"
AUTHOR_CODE = rf"{_BY}{_CODES}($|[^\p{{L}}\p{{N}}_])"
PARTY_TAG = rf"\({_CODES}\)"
PARTY_NAME = rf"{_EDGE}(?:{'|'.join(PARTY_NAMES)})($|[^\p{{L}}\p{{N}}_])"
# Words that tell how a division ended, each with its endings, and identifiers that must not be shown.
OUTCOMES = ["sa ja", "sa nej", "sade ja", "sade nej", "biföll", "biföllen", "biföllt", "bifölls", "biföllses", "avslog", "avslogs", "godkändes", "antogs", "beslutade", "beslutades", "röstade igenom", "röstades ned", "röstades igenom", "fick majoritet", "vann omröstningen", "avslag på propositionen"]
OUTCOME = rf"(?i){_EDGE}(?:{'|'.join(w.replace(' ', _BLANK + '+') for w in OUTCOMES)})($|[^\p{{L}}\p{{N}}_])"
REPORT_ID = r"(^|[^\p{L}\p{N}_])[A-Z]{2}[0-9]{2}[A-Z]{1,4}[0-9]{1,3}($|[^\p{L}\p{N}_])"
DIVISION_ID = r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}"


def _all(c: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs.items(), c)


def _strip(c: Column) -> Column:
    """Without blanks and line ends around it."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _arrow(change: Callable[[str], str]) -> Callable[[Column], Column]:
    """A text function as an Arrow batch function, for what the engine has no expression for."""
    run = F.pandas_udf(lambda texts: texts.map(change, na_action="ignore"), "string")
    return lambda c: run(c)


def entities(c: Column) -> Column:
    """Entities of any kind decoded once, named, decimal or hexadecimal; texts without an ampersand stay in the JVM."""
    return F.coalesce(_arrow(html.unescape)(F.when(F.contains(c, F.lit("&")), c)), c)


def composed(c: Column) -> Column:
    """Canonical composed form; texts of plain letters stay in the JVM."""
    return F.coalesce(_arrow(lambda t: unicodedata.normalize("NFC", t))(F.when(c.rlike(r"[^\x00-\xFF]"), c)), c)


def folded(c: Column) -> Column:
    """Full case folding; texts of letters for which that is the same as lower case stay in the JVM."""
    return F.coalesce(_arrow(str.casefold)(F.when(c.rlike(r"[^\x00-\x7FåäöÅÄÖéÉüÜ]"), c)), F.lower(c))


def clean_html(c: Column) -> Column:
    """Readable lines of an HTML fragment: breaks become line ends, tags go, entities are decoded, soft hyphens go."""
    text = F.regexp_replace(c, r"(?i)<br\s*/?>|</p>", "\n")
    text = F.translate(F.replace(entities(F.regexp_replace(text, r"<[^>]*>", "")), F.lit("­"), F.lit("")), "\xa0", " ")
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t]+\n", "\n")
    return _strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def plain(c: Column) -> Column:
    """One line of text: tags become blanks, white space collapses."""
    return collapse(entities(F.regexp_replace(c, r"<[^>]*>", " ")))


def collapse(c: Column) -> Column:
    """White space of any kind becomes single blanks."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def match_key(c: Column) -> Column:
    """The form in which quotes are matched: composed, collapsed and case-folded."""
    return folded(collapse(composed(c)))


def match_keys(c: Column) -> Column:
    """``match_key`` of each text of an array; null texts stay null. Arrays of plain letters stay in the JVM."""
    simple = F.forall(c, lambda x: F.coalesce(x.rlike(r"\A[\x00-\x7FåäöÅÄÖéÉüÜ]*\z"), F.lit(True)))

    def run(lists: pd.Series) -> pd.Series:
        key = lambda t: None if t is None else " ".join(unicodedata.normalize("NFC", t).split()).casefold()
        return lists.map(lambda xs: None if xs is None else [key(x) for x in xs])

    return F.coalesce(F.pandas_udf(run, "array<string>")(F.when(~simple, c)), F.transform(c, lambda x: F.lower(collapse(x))))


def normalise_lines(c: Column) -> Column:
    """Extracted text: leading comment dropped, composed, ligatures resolved, dot leaders cut, words joined over lines, numeric lines and broken fonts dropped."""
    text = composed(F.regexp_replace(c, r"(?s)\A\s*<!--.*?-->\s*", ""))
    text = F.regexp_replace(_all(text, LIGATURES), r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)(?<=\p{L})[-¬­][ \t]*\n(?=\p{Ll})", ""), r"\.{4,}", " ")
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*[\d .,%/–-]+\s*$") & (F.regexp_count(x, F.lit(r"[\x01-\x08\x0b-\x1f\x7f-\x9fĀ-ɏ]")) < 2))
    return _strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def scrub(c: Column, labelled: Column | None = None) -> Column:
    """Document numbers and dates become placeholders; author clauses go unless the row is ``labelled``."""
    without = F.regexp_replace(F.regexp_replace(c, AUTHOR_CLAUSE, ""), AUTHOR_CODE, "$1")
    text = without if labelled is None else F.when(labelled, c).otherwise(without)
    return F.regexp_replace(F.regexp_replace(text, DOCUMENT_REF, "$1[nr]"), DATE, "$1[datum]")


def scrub_substance(c: Column) -> Column:
    """``scrub`` without party tags and party names."""
    return collapse(F.regexp_replace(F.regexp_replace(scrub(c), PARTY_TAG, ""), PARTY_NAME, "$1partiet$2"))


#: What gives a text away, in order.
LEAKS = {"tag": [PARTY_TAG], "name": [PARTY_NAME], "author": [AUTHOR_CLAUSE, AUTHOR_CODE], "outcome": [OUTCOME], "reference": [DOCUMENT_REF], "report": [REPORT_ID], "division": [DIVISION_ID], "date": [DATE]}


def leak_label(c: Column) -> Column:
    """What gives a text away, the first of LEAKS; null when nothing does."""
    return F.coalesce(*[F.when(reduce(lambda x, y: x | y, [c.rlike(p) for p in patterns]), F.lit(name)) for name, patterns in LEAKS.items()])


def motion_ids(c: Column) -> Column:
    """Distinct motion numbers in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"({MOTION_REF})"), F.lit(1)))


def shorten(c: Column, n: int) -> Column:
    """At most ``n`` characters, cut at a word, with an ellipsis where something was cut."""
    head = F.regexp_replace(F.substring(c, 1, n - 1), r" [^ ]*$", "")
    return F.when(F.length(c) <= n, c).otherwise(F.concat(head, F.lit("…")))


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words, with the number of words left out."""
    words = F.split(collapse(c), " ")
    return F.when(F.size(words) <= n, collapse(c)).otherwise(F.concat(F.array_join(F.slice(words, 1, n), " "), F.format_string(" [+%d]", F.size(words) - n)))


def fragment_link(c: Column) -> Column:
    """Text-fragment link: up to eight words whole, else the first five and the last four."""
    words = F.split(collapse(c), " ")
    n = F.size(words)
    encode = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    ends = F.concat(encode(F.array_join(F.slice(words, 1, 5), " ")), F.lit(","), encode(F.array_join(F.slice(words, F.greatest(n - 3, F.lit(1)), F.lit(4)), " ")))
    return F.concat(F.lit("#:~:text="), F.when(n <= 8, encode(collapse(c))).otherwise(ends))


def search_blob(*columns: Column) -> Column:
    """One lower-case text to search in; nulls are skipped."""
    return F.lower(F.concat_ws(" ", *columns))


def month_label(date: Column) -> Column:
    """Month name and year, without the session's locale."""
    return F.concat_ws(" ", F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(date)), F.year(date).cast("string"))


# Phrases that tell the kind of a proposal, and the report that sets the budget frames.
BUDGET = r"(?i)utgiftsram|utgiftstak|anvisar\s+anslag|finansplan|rambeslut"
BILL = r"(?i)antar regeringens förslag|godkänner regeringens förslag|bifaller\s+(?:riksdagen\s+)?proposition"
MOTION = r"(?i)avslår motion|bifaller motion"
BUDGET_REPORT = "FiU1"


def is_budget(text: Column, report: Column) -> Column:
    """Whether a proposal sets budget frames; never null."""
    return F.coalesce(text.rlike(BUDGET), F.lit(False)) | F.coalesce(F.trim(report) == BUDGET_REPORT, F.lit(False))


def proposal_kind(text: Column, report: Column) -> Column:
    """Class of a proposal by precedence: budget, proposition, motion, other; null is other."""
    return F.when(is_budget(text, report), "budget").when(text.rlike(BILL), "proposition").when(text.rlike(MOTION), "motion").otherwise("other")


# What a proposal does, in the order in which rules are tried; {x} stands for the captured topic.
TOPIC = r"(?i)ställer sig bakom det som (?:utskottet anför|anförs) om (?:att )?(.+?) och tillkännager"
ACTIONS = [
    (TOPIC, "ett tillkännagivande som uppmanar regeringen att agera om {x}", "a formal request telling the government to act on {x}"),
    (r"(?i)antar regeringens förslag", "att anta regeringens lagförslag", "adopting the government's legislative proposal"),
    (r"(?i)anvisar anslagen", "att fördela budgetanslagen enligt utskottets förslag", "allocating the budget funds as the committee proposes"),
    (r"(?i)godkänner regeringens förslag", "att godkänna regeringens förslag", "approving the government's proposal"),
    (r"(?i)godkänner", "att godkänna det som utskottet föreslår", "approving what the committee proposes"),
    (r"(?i)lägger (?:regeringens\s+)?skrivelse[^.]*till handlingarna", "att lägga regeringens skrivelse till handlingarna", "closing the file on the government's report"),
    (r"(?i)avslår motion", "att avslå motionsyrkandena", "rejecting the motions"),
    (r"(?i)bifaller (?:riksdagen )?motion", "att bifalla motionsyrkanden", "approving motion proposals"),
]
LONGEST_TOPIC, LONGEST_SENTENCE = 120, 140


def meanings(c: Column, lang: str = "sv") -> Column:
    """What a proposal does: the first two actions that apply, with a topic of at most 120 characters, else its first sentence."""
    topic = shorten(collapse(F.regexp_extract(c, TOPIC, 1)), LONGEST_TOPIC)
    phrase = lambda row: row[1 if lang == "sv" else 2]
    found = F.array(*[F.when(c.rlike(row[0]), F.concat(F.lit(phrase(row).removesuffix("{x}")), topic) if "{x}" in phrase(row) else F.lit(phrase(row))) for row in ACTIONS])
    kept = F.slice(F.filter(found, lambda x: x.isNotNull()), 1, 2)
    return F.when(F.size(kept) > 0, F.array_join(kept, " samt " if lang == "sv" else " and ")).otherwise(shorten(collapse(F.substring_index(c, ".", 1)), LONGEST_SENTENCE))


# Letters that occur in readable text beside A to Z.
KNOWN_LETTERS = "ÅÄÖåäöÉéÈèÊêËëÜüÁáÀàÂâÍíÎîÓóÔôÒòØøÆæÑñÇçÝýÞþŠšŽžŁłĆćČčŚśŃńĐđ"


def repaired_signs(c: Column) -> Column:
    """One kind of line end, ligatures resolved, signs without width gone, hard blanks plain."""
    text = _all(F.regexp_replace(c, "\r\n?", "\n"), LIGATURES)
    text = F.regexp_replace(text, r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]", "")
    return F.regexp_replace(text, r"[\x{A0}\x{2007}\x{202F}]", " ")


def unreadable(c: Column) -> Column:
    """Whether a line of at least three letters holds more than 30 per cent that no readable text has."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    strange = F.length(F.regexp_replace(c, rf"[^\p{{L}}]|[A-Za-z{KNOWN_LETTERS}]", ""))
    return (letters >= 3) & (strange / letters > 0.3)


# Forms of bullets, numbered headings and sentence ends.
BULLET = r"^\s*(?:[•▪◦·]|[-–—*])\s+\S"
NUMBERED = r"^\s*[0-9]{1,2}(?:\.[0-9]{1,2})*[.)]?\s+\p{Lu}"
SENTENCE_END = "[.!?:;»”\"']$"


def line_kind(c: Column) -> Column:
    """The kind of a block: unreadable, bullet, para, heading or subheading, by length, numbering, capitals and end."""
    short = (F.length(c) <= 90) & (F.size(F.split(F.trim(c), r"\s+")) <= 14)
    closed = F.regexp_replace(c, "[:;]$", "").rlike(SENTENCE_END)
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    numbered = F.regexp_extract(c, r"^\s*([0-9]{1,2}(?:\.[0-9]{1,2})*)[.)]?\s+\p{Lu}", 1)
    return (
        F.when(unreadable(c), "unreadable").when(c.rlike(BULLET), "bullet").when(~short | closed, "para")
        .when(c.rlike(NUMBERED), F.when(F.contains(numbered, F.lit(".")), "subheading").otherwise("heading"))
        .when((F.length(letters) >= 3) & (letters == F.upper(letters)), "heading").when(c.rlike("^[A-ZÅÄÖ]"), "subheading").otherwise("para")
    )


def document_title(slug: Column, lang: str = "sv") -> Column:
    """A title for a document from the parts of its slug: kind, party, year; the slug itself where it has another form."""
    kinds = {"partiprogram": ("Partiprogram", "Party programme"), "valmanifest": ("Valmanifest", "Election manifesto"), "budgetmotion": ("Budgetmotion", "Shadow budget"), "avtal": ("Överenskommelse", "Agreement")}
    part = lambda i: F.regexp_extract(slug, r"^(\w+)-(.+)-(\d{4})-\d+$", i)
    name = F.element_at(F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[0 if lang == "sv" else 1])]), part(1))
    party = F.element_at(F.create_map(*[F.lit(x) for pair in zip([p.lower() for p in PARTIES], PARTY_NAMES, strict=True) for x in pair]), part(2))
    return F.coalesce(F.concat(name, F.lit(" "), part(3), F.lit(" — "), party), slug)


def provenance(first_line: Column) -> Column:
    """``struct<title, note, href>`` of a comment such as ``<!-- title | note | https://… -->``; null for any other line."""
    inside = F.regexp_extract(first_line, r"^<!--\s*(.*?)\s*-->$", 1)
    parts = F.filter(F.transform(F.split(inside, r"\|"), lambda x: F.trim(x)), lambda p: p != "")
    rest = F.slice(parts, 2, 100)
    link = F.try_element_at(F.filter(rest, lambda p: p.rlike("^https?://")), F.lit(1))
    note = F.array_join(F.filter(rest, lambda p: ~p.rlike("^https?://")), " · ")
    return F.when(F.size(parts) > 0, F.struct(F.try_element_at(parts, F.lit(1)).alias("title"), F.when(note != "", note).alias("note"), link.alias("href")))


def merged_lines(lines: Column, width: Column) -> Column:
    """Physical lines put together to paragraphs, as an array.

    A line end hyphen after a small letter before another one goes. In a hard-wrapped text (``width``, the 90th
    percentile of its line lengths, under 150) a line goes on if it fills 0.72 of the width; in any other one, if it
    does not end a sentence and the next line is neither a bullet nor numbered. An empty line ends a paragraph.
    """
    wrapped = (width > 0) & (width < 150)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("last"))

    def step(state: Column, raw: Column) -> Column:
        line, last = F.trim(raw), state["last"]
        n = F.size(state["out"])
        buffer = F.try_element_at(state["out"], n)
        rest = F.slice(state["out"], 1, F.greatest(n - 1, F.lit(0)))
        hyphen = last.rlike("[a-zåäöéü]-$") & line.rlike("^[a-zåäöéü]")
        on = F.when(wrapped, F.length(last) >= 0.72 * width).otherwise(~last.rlike(SENTENCE_END) & ~line.rlike(BULLET) & ~line.rlike(NUMBERED))
        joined = F.when(hyphen, F.concat(F.substring(buffer, F.lit(1), F.length(buffer) - 1), line)).when(on, F.concat(buffer, F.lit(" "), line))
        out = F.when(line == "", state["out"]).when((last != "") & joined.isNotNull(), F.concat(rest, F.array(joined))).otherwise(F.concat(state["out"], F.array(line)))
        return F.struct(out.alias("out"), line.alias("last"))

    return F.aggregate(lines, start, step)["out"]


def block_kind(c: Column) -> Column:
    """Class of a text block by its shape."""
    return F.when(c.rlike(r"^\s*[•\-*] "), "bullet").when(c.rlike(r"(?m)\.{4,}\s*\d+\s*$"), "toc").when(c.rlike(r"^\d+(\.\d+)*\s"), "numbered").when((F.length(c) <= 70) & ~c.rlike(r"[.!?:;]\s*$"), "short").otherwise("text")


def party_of_slug(c: Column) -> Column:
    """The party code among the parts of a slug; null when there is none."""
    return F.try_element_at(F.filter(F.split(F.upper(c), "-"), lambda x: F.array_contains(F.array(*[F.lit(p) for p in PARTIES]), x)), F.lit(1))


# Function words that tell Swedish from English.
SWEDISH_WORDS = ["och", "att", "för", "som", "inte", "till", "med", "av", "en", "ett", "är", "har"]
ENGLISH_WORDS = ["and", "the", "of", "to", "in", "is", "that", "with", "has", "for", "at", "by"]


def count_words(c: Column, words: list[str]) -> Column:
    """How many of the words of a text are among ``words``."""
    return F.size(F.filter(F.split(F.lower(collapse(c)), " "), lambda w: w.isin(words)))


def language_guess(c: Column) -> Column:
    """sv or en, by which function words are more; null on a tie."""
    sv, en = count_words(c, SWEDISH_WORDS), count_words(c, ENGLISH_WORDS)
    return F.when(sv > en, "sv").when(en > sv, "en")


def clean_wikitext(c: Column) -> Column:
    """Plain text of wiki markup: references, three levels of templates, links, bold and italics."""
    text = F.regexp_replace(F.regexp_replace(c, r"(?is)<ref[^>/]*>.*?</ref>|<ref[^>]*/>", ""), r"(?s)<!--.*?-->", "")
    for _ in range(3):
        text = F.regexp_replace(text, r"\{\{[^{}]*\}\}", "")
    text = F.regexp_replace(text, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return collapse(F.regexp_replace(F.regexp_replace(text, r"\[https?://\S+ ?([^\]]*)\]", "$1"), r"'{2,}", ""))


def narrative(c: Column) -> Column:
    """Running text of a page of tables: tables and scripts go, words are joined over lines, numeric lines are dropped."""
    text = F.regexp_replace(c, r"(?is)<(table|script|style)\b.*?</\1>", " ")
    text = entities(F.regexp_replace(text, r"<[^>]+>", "\n"))
    return normalise_lines(text)


# Words that part a report's sections, and those that stand around a reservation.
SEAM = r"Reservation \d+ \(|Särskilt yttrande|\bBilaga\b"
DECISION, ARGUMENT = "Förslag till riksdagsbeslut", "Ställningstagande"
_SIGNED = rf"\(([A-ZÅÄÖ]{{1,3}}(?:, ?[A-ZÅÄÖ]{{1,3}})*)\) ?\. ?{DECISION}"
_HEADED = r"(?:(\d+)\. )?(\p{Lu}[^,.()]{1,59}), punkt (\d+) ?\(([A-ZÅÄÖ, ]+)\) av "


def _argument(section: Column) -> Column:
    """What a section argues, from its first argument heading to the next seam; null where it has none."""
    after = F.try_element_at(F.split(section, ARGUMENT, 2), F.lit(2))
    return collapse(F.regexp_replace(F.try_element_at(F.split(after, SEAM, 2), F.lit(1)), "&#x[0-9a-f]+;", " "))


def _codes(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda p: p != "")


def reservations(c: Column) -> Column:
    """Reservations in a plain report (see ``plain``) in order, ``array<struct<parties, body>>``.

    The text is cut at signatures (party codes in brackets right before a proposed decision), and each section argues
    its reservation; arguments under 40 characters are left out. Numbers of entities that were left become blanks.
    """
    signed, sections = F.regexp_extract_all(c, F.lit(_SIGNED), F.lit(1)), F.split(c, _SIGNED)
    made = F.transform(signed, lambda p, i: F.struct(F.filter(_codes(p), lambda x: x.isin(list(PARTIES))).alias("parties"), _argument(F.element_at(sections, i + 2)).alias("body")))
    return F.filter(made, lambda x: F.length(x["body"]) >= 40)


def indexed_reservations(c: Column) -> Column:
    """Reservations of a plain report with number, heading, point and parties, as ``array<struct<num, heading, point, parties, body>>``.

    The text is cut at headings; a section without a decision and an argument is a line of a list, and no reservation.
    """
    group = lambda i: F.regexp_extract_all(c, F.lit(_HEADED), F.lit(i)).alias(f"g{i}")
    sections = F.split(c, _HEADED)
    number = lambda x: F.when(x != "", x).cast("int")
    made = F.transform(F.arrays_zip(*[group(i) for i in (1, 2, 3, 4)]), lambda x, i: F.struct(number(x["g1"]).alias("num"), F.trim(x["g2"]).alias("heading"), number(x["g3"]).alias("point"), _codes(x["g4"]).alias("parties"), F.when(F.contains(F.element_at(sections, i + 2), F.lit(DECISION)), _argument(F.element_at(sections, i + 2))).alias("body")))
    return F.filter(made, lambda x: x["body"].isNotNull())


COMMITTEE_MARK = "Utskottets ställningstagande"


def committee_blocks(c: Column) -> Column:
    """The committee's positions in a plain report in order, ``array<struct<motions, body>>``: motions named since the position before, and the text up to the next seam."""
    pieces = F.split(c, COMMITTEE_MARK)
    body = lambda p: F.trim(F.try_element_at(F.split(p, SEAM, 2), F.lit(1)))
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p, i: F.struct(motion_ids(F.element_at(pieces, i + 1)).alias("motions"), body(p).alias("body")))


def letter_label(i: Column) -> Column:
    """A, B, C … for 0, 1, 2 …"""
    return F.chr(F.lit(65) + i)
