"""Personal information in free text: candidate spans, boosted trees, calibrated thresholds, typed placeholders."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votaria.llm.boosting import Boosted
from votaria.session import cut

KINDS = ("email", "phone", "idnr", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "idnr": "[IDNR]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Labelled texts made for training, and the seed they are made with.
TRAINING_TEXTS = 8_000
SEED = 11

# How an at sign and a dot are written out, street nouns, and cue words.
_AT = r"(?:@|\(at\)|\[at\]|\{at\}|<at>|\(a\)|snabel-?a)"
_DOT = r"(?:\.|\s+punkt\s+|\s+dot\s+|\s?\((?:punkt|dot|\.)\)\s?|\s?\[(?:punkt|dot|\.)\]\s?)"
STREETS_SV = "gatan|gata|vägen|väg|gränden|gränd|torget|torg|stigen|stig|backen|backe|allén|allé|kajen|kaj|plan|esplanaden|slingan|ringen|stråket|leden|liden"
STREETS_EN = "Street|Road|Lane|Avenue|Alley|Square|Close|Court|Drive|Way|Row|Hill|Terrace|Crescent|Place"
ROADS = {"riksväg", "länsväg", "europaväg", "motorväg", "landsväg", "järnväg"}
# Classes of words that say what may stand beside them. Closed classes and plain nouns of the two languages.
CLASSES = {
    "title": "herr fru fröken mr mrs ms miss dr doktor prof professor sir madam ordförande ledamot handläggare sekreterare chef advokat domare",
    "place": "i på vid in at nära mellan mot utanför kring near between genom under",
    "agent": "av by från from till to med with hos åt enligt om about gäller rör för kontakta contact tack hälsningar hälsning regards sincerely dear hej kära bästa undertecknad signed",
    "joint": "och and samt eller or",
    "article": "den det de en ett the a an denna detta this that vår our hela nya norra södra östra västra nedre övre stora lilla gamla new north south old great",
    "contact": "tel telefon tfn mobil mob ring nås fax sms växel phone call mobile cell ringa nummer number",
    "identity": "personnummer pnr personnr född identitet identity born samordningsnummer",
    "account": "org orgnr organisationsnummer bankgiro plusgiro postgiro konto isbn issn dnr diarienummer serienummer serial faktura fakturanummer ärende ärendenummer art invoice account",
    "home": "adress address bor bosatt lives boende resident gatuadress besöksadress postadress",
    "law": "lex lag lagen act prop",
    "unit": "kronor kr mkr miljoner miljarder procent percent euro meter km kg år years sek",
    "company": "ab hb kb aktiebolag handelsbolag stiftelsen föreningen söner sons co ltd inc plc gmbh kommun län stad municipality county council kyrkan kyrka church skolan universitet university torg square park parken museum bridge river lake hospital station sjukhus nyheter bladet posten tidningen times post news if ff bk fc ik club klubb bank banken förlag partiet party",
}
_CLASS = {w: i for i, words in enumerate(CLASSES.values(), 1) for w in words.split()}
_SIGN = {sign: len(CLASSES) + 1 + i for i, sign in enumerate("(:,.;&!?/@")}
# Common given names, and how surnames often end.
GIVEN = set("anna eva maria karin kristina lena sara kerstin emma ingrid marie malin birgitta inger annika ulla linda susanne elin monica jenny hanna johanna elisabeth carina katarina anita helena sofia åsa camilla ida anneli marianne gunilla julia siv jessica amanda josefin frida agneta caroline matilda cecilia barbro lisa sandra lars mikael anders johan erik per karl peter jan thomas daniel fredrik hans andreas stefan mats marcus mattias magnus bengt jonas bo niklas björn leif robert oskar alexander ulf christer patrik emil henrik göran håkan david viktor sven kjell rolf martin simon christoffer gustav anton joakim christian roger tommy jakob filip adam ali john james mary robert patricia michael jennifer william linda david barbara richard susan joseph thomas sarah charles karen george nancy paul helen ola kalle nils olof arne kent rune nina anne ole kari matti juha".split())
SURNAME_ENDS = ("sson", "son", "berg", "ström", "kvist", "quist", "lund", "gren", "blad", "man", "dahl", "dal", "holm", "stedt", "stad", "vall", "lind", "sen", "datter", "dotter", "ov", "ova", "ski", "ska", "nen", "ic", "ez")
#: A word counts as ordinary from this share of all words on in lower case, so that the table holds at most its inverse.
ORDINARY_SHARE = 2e-6

# Character classes by rule: letters of the Latin blocks.
_UP = "".join(chr(c) for c in range(0x41, 0x250) if chr(c).isupper())
_LOW = "".join(chr(c) for c in range(0x61, 0x250) if chr(c).islower()) + "̀-ͯ"
# Patterns start with the sign searched for, then look behind it: the search skips from one such sign to the next.
_AT_SIGN = re.compile(_AT, re.I)
_LOCAL = re.compile(r"[\w%-]+(?:[.+][\w%-]+)*\s?$")
_DOMAIN = re.compile(rf"\s?(?P<domain>[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)*)", re.I)
_NUMBER = re.compile(r"(?:\+|\((?=0\d{1,3}\))|\d)(?<![\w/:.,].)(?:(?<=\d)|\d)(?:(?:[^\S\n]?\n|[ \t\xa0()/-]{0,3})\d){6,15}(?![\w]|[/:]\d)")
_IDNR = re.compile(r"\d(?<![\w/-].)(?:\d{2})?\d{5}[-+–  ]?\d{4}(?![\w-])")
_HOUSE = re.compile(r"\s(?P<no>\d{1,4})(?P<tail>\s?[A-Za-z](?!\w))?(?![\w:]|[,.]\d)")
_STREET = re.compile(rf"(?:[{_UP}][^\W\d_][^\W\d_'-]*[^\S\n]){{1,2}}[{_LOW}]+$|[^\W\d_][^\W\d_-]*$")
_SUFFIXES_SV = tuple(STREETS_SV.split("|"))
_ADDRESS_EN = re.compile(rf"\d(?<![\w.,:/-].)\d{{0,3}}[A-Za-z]?\s+(?P<street>(?:[{_UP}][^\W\d_][^\W\d_'-]*\s+){{1,3}}(?i:{STREETS_EN}))(?!\w)")
_ADDRESS_REST = re.compile(rf"(?:,?\s+lgh\.?\s*\d+)?(?:,?\s+\d{{3}}\s?\d{{2}}\s+[{_UP}][\w-]+|(?<=\d),\s+[{_UP}][\w-]+)?")
_CAP = rf"(?:[{_UP}][{_LOW}]+(?:[-'’][{_UP}]?[{_LOW}]+)*|[{_UP}][{_UP}̀-ͯ]+(?:[-'’][{_UP}]+)*)"
_GAP = r"(?:[^\S\n]+|[^\S\n]?\n[^\S\n]?)"
_NAME = re.compile(rf"(?P<one>[{_UP}](?<![\w@.+-].)(?:[{_LOW}]+(?:[-'’][{_UP}]?[{_LOW}]+)*|[{_UP}̀-ͯ]+(?:[-'’][{_UP}]+)*|\.))(?P<mid>(?:{_GAP}[{_UP}]\.)*)(?P<sep>,?{_GAP})(?P<two>{_CAP})(?![\w@]|[-.+]\w)")
_INITIAL_LAST = re.compile(rf"(?<![\w@.-])(?P<one>{_CAP}),?{_GAP}(?P<two>[{_UP}]\.)(?!\w|{_GAP}{_CAP})")
_LOWER_PAIR = re.compile(rf"(?<![\w@.+-])(?=(?P<one>[{_LOW}]+(?:-[{_LOW}]+)?),?{_GAP}(?P<two>[{_LOW}]{{3,}}(?:-[{_LOW}]+)?)(?![\w@]))")
_LETTERS = re.compile(r"[^\W\d_]+")
# Words of running text: those in addresses, codes and compounds say nothing of how a word is written.
RUNNING = r"(?<![^\s(\"'])(\p{L}+)(?=[,.;:!?)\"']*(?:\s|$))"
_RUNNING = re.compile(RUNNING.replace(r"\p{L}", r"[^\W\d_]"))
_CAP_END, _CAP_NEXT = re.compile(rf"{_CAP}$"), re.compile(rf"{_GAP}{_CAP}")
_PARTY_NEXT, _NUMBER_NEXT, _CLAUSE_NEXT = re.compile(rf"\s*\([{_UP}]{{1,4}}\)"), re.compile(r"\s+\d"), re.compile(rf",\s[{_LOW}]")
_WORD = re.compile(r"[^\W\d_]+|&|\d+|[^\s\w]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(digits[-10:]):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


@lru_cache(maxsize=200_000)
def _kind_of(token: str) -> int:
    """The class of a neighbouring word or sign."""
    low = token.lower()
    if low in _CLASS:
        return _CLASS[low]
    if token in _SIGN:
        return _SIGN[token]
    return 24 if token.isdigit() else 25 if not token[0].isalpha() else 26 if token[0].isupper() else 27


def _common(text: str, start: int, end: int) -> list[int]:
    """Context: classes of two words on either side, and whether a line begins."""
    before, after = _WORD.findall(text[max(0, start - 40) : start])[-2:], _WORD.findall(text[end : end + 40])[:2]
    near, far = (before[-1:] or [""])[0], before[0] if len(before) > 1 else ""
    nxt, then = (after[:1] or [""])[0], after[1] if len(after) > 1 else ""
    return [*(_kind_of(t) if t else 0 for t in (near, far, nxt, then)), int(start == 0 or text[start - 1] == "\n")]


class Casing(dict):
    """How words are written in a corpus: 1 where most occurrences are in lower case, 2 where some are; 0 for all others."""

    def __missing__(self, word: str) -> int:
        return 0


def casing_of(texts: Iterable[str]) -> Casing:
    """``Casing`` of a few texts."""
    seen: dict[str, list[int]] = {}
    for text in texts:
        for w in _RUNNING.findall(text):
            n = seen.setdefault(w.lower(), [0, 0])
            n[w == w.lower()] += 1
    return Casing({w: 1 if low >= up else 2 for w, (up, low) in seen.items() if low})


def casing(documents: DataFrame, text: str = "text", share: float = ORDINARY_SHARE) -> Casing:
    """``Casing`` of all documents, counted in the JVM. Words under ``share`` of all words are left out: at most ``1 / share`` stay."""
    words = documents.where(F.col(text).isNotNull()).select(F.explode(F.regexp_extract_all(text, F.lit(RUNNING), F.lit(1))).alias("w"))
    counts = words.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("w") == F.lower("w")).alias("low"))
    counts = cut(counts.where("low > 0"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    kept = counts.where(F.col("low") >= share * total).select("word", F.when(F.col("low") * 2 >= F.col("n"), 1).otherwise(2).alias("level"))
    return Casing({r.word: r.level for r in kept.toLocalIterator()})


def _identity(digits: str) -> bool:
    """Whether the digits could be a personal identity number: a date and a right check digit."""
    return len(digits) in (10, 12) and 1 <= int(digits[-8:-6]) <= 12 and 1 <= int(digits[-6:-4]) <= 31 and _luhn(digits)


Candidate = tuple[str, int, int, list[int]]


def _emails(text: str) -> Iterator[Candidate]:
    if not ("@" in text or "(a" in text or "[a" in text or "{a" in text or "<a" in text or "(A" in text or "[A" in text or "snabel" in text or "SNABEL" in text):
        return
    for m in _AT_SIGN.finditer(text):
        local = _LOCAL.search(text[max(0, m.start() - 80) : m.start()])
        domain = _DOMAIN.match(text, m.end())
        if not local or not domain:
            continue
        start, end, host = m.start() - len(local[0]), domain.end(), domain["domain"]
        dots = len(re.findall(_DOT, host, re.I))
        yield "email", start, end, [*_common(text, start, end), min(dots, 5), len(local[0]), int(local[0][-1].isspace()) + 2 * int(host != domain[0]), int(m[0] == "@"), len(re.split(_DOT, host)[-1]), int("_" in host)]


def _number_matches(text: str) -> Iterator[re.Match]:
    """Runs of digits; one that crosses a line end is offered whole and from the new line on."""
    for m in _NUMBER.finditer(text):
        yield m
        if (cut := m[0].find("\n")) >= 0 and (rest := _NUMBER.match(text, m.start() + cut + 1)):
            yield rest


def _numbers(text: str) -> Iterator[Candidate]:
    for m in _number_matches(text):
        raw = m[0]
        digits = re.sub(r"\D", "", raw)
        groups = [len(g) for g in re.findall(r"\d+", raw)]
        prefix = 3 if raw.startswith("+46") else 4 if raw.startswith("0046") else 2 if raw.startswith("(0") else 1 if raw[0] == "0" and raw[1:2] != "0" else 0
        national = re.sub(r"^(?:46|0046)0?", "0", digits) if prefix >= 3 else digits
        yield "phone", m.start(), m.end(), [*_common(text, m.start(), m.end()), prefix, len(digits), len(national), len(groups), max(groups), groups[0], int("-" in raw), int("+" in raw[1:]), int("\n" in raw), int(_identity(digits))]
    for m in _IDNR.finditer(text):
        digits = re.sub(r"\D", "", m[0])
        six = digits[-10:-4]
        month, day = int(six[2:4]), int(six[4:6])
        date = int(1 <= month <= 12) + 2 * int(1 <= day <= 31) + 4 * int(61 <= day <= 91)
        century = 0 if len(digits) == 10 else 1 if digits[:2] in ("19", "20", "18") else 2
        yield "idnr", m.start(), m.end(), [*_common(text, m.start(), m.end()), len(digits), date, int(_luhn(digits)), century, 1 + "-+ ".find(m[0][-5])]


def _address(text: str, english: int, start: int, end: int, street: str, no: str) -> Candidate:
    rest = _ADDRESS_REST.match(text, end)
    whole = max(end, rest.end()) if rest else end
    words = street.split()
    return "address", start, whole, [*_common(text, start, end), english, len(words), int(words[-1].lower() in ROADS), len(words[-1]), len(no), int(whole > end), int(1900 <= int(no) <= 2100), int(street[0].isupper())]


def _addresses(text: str) -> Iterator[Candidate]:
    for m in _HOUSE.finditer(text):
        before = text[max(0, m.start() - 60) : m.start()].rstrip()
        if before.lower().endswith(_SUFFIXES_SV) and (street := _STREET.search(before)):
            yield _address(text, 0, max(0, m.start() - 60) + street.start(), m.end(), street[0], m["no"])
    for m in _ADDRESS_EN.finditer(text):
        yield _address(text, 1, m.start(), m.end(), m["street"], re.match(r"\d+", m[0])[0])


def _part(word: str, known: Casing) -> list[int]:
    """What a part of a name looks like: how the corpus writes it, whether it is a given name or ends like a surname, its length and form."""
    low = word.lower().rstrip(".")
    pieces = re.split(r"[-'’]", low)
    ordinary = max((known[x] for x in pieces), key=lambda level: (level == 1, level)) if len(pieces[0]) > 1 else 0
    return [ordinary, int(all(x in GIVEN for x in pieces)) + 2 * int(pieces[-1].endswith(SURNAME_ENDS)), min(len(low), 20), int(len(pieces) > 1), int(word.isupper() and len(low) > 1) + 2 * int(word.islower()), _kind_of(low)]


def _name(text: str, start: int, end: int, one: str, two: str, mid: bool, comma: bool, known: Casing) -> Candidate:
    around = text[max(0, start - 30) : start] + text[end : end + 30]
    letters = sum(c.isalpha() for c in around)
    upper = 10 * sum(c.isupper() for c in around) // max(1, letters)
    before, ahead = text[max(0, start - 24) : start].rstrip(), text[end : end + 24]
    last = _LETTERS.findall(before)[-1:]
    features = [
        *_common(text, start, end), *_part(one, known), *_part(two, known), int(one.endswith(".")) + 2 * int(two.endswith(".")), int(mid), int(comma), int("\n" in text[start:end]), upper,
        int(bool(_CAP_END.search(before))) + 2 * int(bool(last) and known[last[0].lower()] == 1), int(bool(_CAP_NEXT.match(ahead))),
        int(bool(_PARTY_NEXT.match(ahead))), int(before == "" or before[-1] in ".!?:" or text[start - 1 : start] == "\n"), int(bool(_NUMBER_NEXT.match(ahead))), int(bool(_CLAUSE_NEXT.match(ahead))),
    ]
    return "name", start, end, features


def _names(text: str, known: Casing) -> Iterator[Candidate]:
    at = 0
    while m := _NAME.search(text, at):
        at = m.end("one") if m.end("one") > m.start() + 1 else m.start() + 1
        yield _name(text, m.start(), m.end(), m["one"], m["two"], bool(m["mid"]), m["sep"].startswith(","), known)
    for m in _INITIAL_LAST.finditer(text):
        yield _name(text, m.start(), m.end(), m["one"], m["two"], False, "," in m[0], known)
    # in lower case, only beside a known given name: any two words would be a candidate otherwise
    if not GIVEN.isdisjoint(text.split()):
        for m in _LOWER_PAIR.finditer(text):
            if m["one"] in GIVEN or (m["two"] in GIVEN and "," in text[m.end("one") : m.start("two")]):
                yield _name(text, m.start("one"), m.end("two"), m["one"], m["two"], False, "," in text[m.end("one") : m.start("two")], known)


def candidates(text: str, known: Casing) -> list[Candidate]:
    """Overlapping spans of high recall: (kind, start, end, features)."""
    return [*_emails(text), *_numbers(text), *_addresses(text), *_names(text, known)]


# ---- training ----

# Function words of the two languages; all other words of the training texts are made up.
FUNCTION_WORDS = {
    "sv": "och att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan när år säger hon under också efter eller nu sin där vid mot ska skulle kommer ut får finns vara hade alla andra mycket än här då sedan över bara in blir upp även vad få två vill ha många hur mer går sverige detta nya procent skall hela något någon utan kunde varit tre stora blev denna dessa del fick mellan genom samt dock dessutom därefter därför enligt inom såg svarade skrev bad tog kom ville måste borde behöver nya svenska norra södra gamla första sista".split(),
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all their there been if more when will would who so no out up into do any what has only some than other time about these two may then first such over new our most even where after also many before must through back years much your way down should because each just those people how too little good very make still own see work long here both between being under never day another know while last might great old year off come since go against came right used take three".split(),
}
_START = "b d f g h k l m n p r s t v st kr sk fl br tr gr sv kl sp".split()
_END = ["n", "r", "l", "s", "t", "k", "rd", "nd", "ng", "ll", "m", ""]


def _word(r: random.Random, parts: int = 0) -> str:
    return "".join(r.choice(_START) + r.choice("aeiouyåäö") + r.choice(["", "", "r", "n", "l"]) for _ in range(parts or r.randint(1, 3))) + r.choice(_END)


class _Writer:
    """Writes sentences of function words and made-up words, with labelled spans among them; no sentence is fixed."""

    def __init__(self, r: random.Random):
        self.r = r
        self.ordinary = [_word(r) + r.choice(["a", "e", "en", "ar", "et", "er", "na", "ing", "ed", "s"]) for _ in range(3_000)]

    def words(self, n: int, lang: str) -> list[str]:
        return [self.r.choice(FUNCTION_WORDS[lang]) if self.r.random() < 0.45 else self.r.choice(self.ordinary) if self.r.random() < 0.97 else _word(self.r) + "ing" for _ in range(n)]

    def name(self) -> str:
        r = self.r
        given = r.choice(sorted(GIVEN)) if r.random() < 0.4 else _word(r, r.choice([1, 2])) + r.choice(["", "a", "e", "us", "o"])
        given = given.capitalize() + (f"-{_word(r, 1).capitalize()}" if r.random() < 0.1 else "")
        last = (_word(r, r.choice([1, 2, 2, 3])) + r.choice(SURNAME_ENDS) if r.random() < 0.5 else _word(r, r.choice([1, 2, 3, 3, 4])) + r.choice(["", "", "a", "i", "u", "o", "å"])).capitalize()
        last += f"-{_word(r, 2).capitalize()}" if r.random() < 0.08 else ""
        u = r.random()
        made = f"{given} {last}" if u < 0.6 else f"{given[0]}. {last}" if u < 0.7 else f"{given} {_word(r, 1)[0].upper()}. {last}" if u < 0.79 else f"{last}, {given}" if u < 0.93 else f"{last}, {given[0]}."
        v = r.random()
        return made.upper() if v < 0.1 else made.lower() if v < 0.13 and given.lower() in GIVEN else made.replace(" ", "\n", 1) if v > 0.95 else made

    def email(self) -> str:
        r = self.r
        d = "".join(r.choices("0123456789", k=r.choice([2, 4])))
        a, b = _word(r), _word(r)
        local = r.choice([f"{a}.{b}", f"{a}_{b}{d}", f"{a}+{b}", f"{a}{d}", a, f"{a[0]}{b}", f"{a[0]}.{b}"])
        at = r.choice(["@"] * 6 + [" @ ", "(at)", " (at) ", "[at]", " [at] ", " snabel-a ", "{at}"])
        dot = r.choice(["."] * 3 + [" punkt ", " dot ", " (dot) ", "[punkt]"]) if at != "@" else "."
        made = local + at + dot.join([_word(r), *([_word(r)] if r.random() < 0.4 else []), r.choice(["se", "com", "org", "net", "nu", "eu", "test", "info", "example", "invalid"])])
        return made.upper() if r.random() < 0.1 else made

    def phone(self) -> str:
        r = self.r
        area, size = r.choice([("8", 6), ("8", 8), ("31", 6), ("31", 7), ("40", 7), ("70", 7), ("72", 7), ("73", 7), ("980", 6), ("980", 5), ("46", 6), ("243", 5)])
        n = "".join(r.choices("0123456789", k=size))
        tail = r.choice([n, n, f"{n[:-4]} {n[-4:-2]} {n[-2:]}", f"{n[:3]} {n[3:5]} {n[5:]}".strip(), f"{n[:3]} {n[3:]}", f"{n[:2]} {n[2:4]} {n[4:]}"])
        head = r.choice([f"0{area}-", f"0{area}-", f"0{area} ", f"0{area}", f"(0{area}) ", f"0{area}", f"0{area}", f"+46 {area} ", f"+46{area}", f"+46{area}", f"+46 (0){area}-", f"+46-{area}-", f"0046-{area}-", f"0046 {area} ", f"0{area}/"])
        return head + tail if r.random() < 0.93 else f"+{r.choice(['44', '49', '358', '1'])} {n[:3]} {n[3:]}"

    def idnr(self) -> str:
        r = self.r
        day = r.randint(1, 28) + (60 if r.random() < 0.06 else 0)
        nine = f"{r.randint(0, 99):02d}{r.randint(1, 12):02d}{day:02d}" + "".join(r.choices("0123456789", k=3))
        check = next(c for c in "0123456789" if _luhn(nine + c))
        return r.choice(["", "", "19", "20"]) + nine[:6] + r.choice(["-", "-", "", "", "+", " "]) + nine[6:] + check

    def address(self) -> str:
        r = self.r
        d = lambda n: "".join(r.choices("0123456789", k=n))
        no = str(r.randint(1, 250)) + r.choice(["", "", "", " A", "B", "C", " B", "d"])
        if r.random() < 0.25:
            return f"{r.randint(1, 250)} {' '.join(_word(r).capitalize() for _ in range(r.choice([1, 1, 2])))} {r.choice(STREETS_EN.split('|'))}"
        street = _word(r, r.choice([1, 2, 3])).capitalize() + r.choice(STREETS_SV.split("|")) if r.random() < 0.85 else f"{_word(r).capitalize()} {r.choice(STREETS_SV.split('|'))}"
        street = street.lower() if r.random() < 0.05 else street.upper() if r.random() < 0.05 else street
        place = _word(r).capitalize()
        return f"{street} {no}" + r.choice(["", "", "", f", lgh {d(4)}", f", lgh {d(4)}, {place}", f", {d(3)} {d(2)} {place}", f"\n{d(3)} {d(2)} {place.upper()}", f", {place}"])

    def other(self) -> str:
        """What is like one of the kinds and is none."""
        r = self.r
        d = lambda n: "".join(r.choices("0123456789", k=n))
        cap = lambda k=0: _word(r, k).capitalize()
        low, street = r.choice(self.ordinary), cap() + r.choice(STREETS_SV.split("|"))
        place = cap(2) + r.choice(["by", "torp", "vik", "näs", "inge", "ås", "hult", "stad", "dal", "köping", "träsk", "sund"])
        where = r.choice(CLASSES["place"].split())
        return r.choice([
            f"{r.choice('23456789')}{d(1)}{r.randint(20, 99)}{d(2)}-{d(4)}", f"org.nr {d(2)}{r.randint(20, 99)}{d(2)}-{d(4)}", f"{r.choice(['19', '20'])}{d(9)}", f"{r.choice(CLASSES['account'].split())} {d(r.choice([8, 10, 11]))}", f"{d(r.choice([3, 4]))}-{d(4)}", f"{d(2)} {d(3)} {d(3)} {r.choice(CLASSES['unit'].split())}",
            f"{r.randint(1, 9)} {d(3)} {d(3)} {r.choice(CLASSES['unit'].split())}", f"{r.randint(1950, 2030)}/{d(6)}", f"{r.randint(1950, 2030)}-{r.randint(1950, 2030)}", f"{r.randint(1950, 2030)}–{r.randint(1950, 2030)}", f"{d(2)}.{d(2)}–{d(2)}.{d(2)}", f"{d(1)}:{d(3)}", f"{r.randint(1, 9)}{d(9)}", f"{d(6)}-{d(4)}", f"ISBN {d(3)}-{d(2)}-{d(4)}-{d(3)}-{d(1)}",
            f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.choice(['kl', 'klockan', 'at', ''])} {d(2)}.{d(2)}", f"{cap()} {r.choice(CLASSES['company'].split()[11:]).capitalize()}", f"@{_word(r)}_{d(1)}", f"{where} {place}", f"{where} {cap()} {place}", f"{where} {place} {r.choice(CLASSES['joint'].split())} {place}", f"{r.choice(CLASSES['article'].split()).capitalize()} {place}", f"{r.choice(CLASSES['article'].split()).capitalize()} {low.capitalize()}", f"{low.capitalize()} {r.choice(CLASSES['company'].split()).capitalize()}",
            f"{cap()} {r.choice(CLASSES['company'].split()[:11]).upper()}", f"{cap()} {cap()} {r.choice(CLASSES['company'].split()[:3]).upper()}", f"{cap()} & {r.choice(['Söner', 'Sons', cap(), 'Co'])} AB", f"lex {cap()}", f"lex {cap()} {cap()}", f"{r.choice(FUNCTION_WORDS['sv']).capitalize()} {place}", f"{r.choice(self.ordinary).capitalize()} {place}", f"{r.choice(FUNCTION_WORDS['en']).capitalize()} {place}",
            f"{place} {low}", f"{place}. {r.choice(self.ordinary).capitalize()}", f"{place}.\n\n{low.capitalize()}", f"{place}.\n{r.choice(FUNCTION_WORDS['sv']).capitalize()} {low} {where} {place}", street, f"{where} {street}", f"{where} {street} {where} {r.randint(1990, 2030)}", f"{r.choice(sorted(ROADS)).capitalize()} {r.randint(1, 400)}", f"{place} {r.choice(CLASSES['company'].split()[11:24])}", f"{place} {r.randint(1950, 2030)}",
            f"{low.capitalize()} {place}", f"{r.choice(sorted(GIVEN))} {low}", f"{r.choice(sorted(GIVEN))} {r.choice(FUNCTION_WORDS['sv'] + FUNCTION_WORDS['en'])}", f"EU {low}", f"{low} {r.randint(1, 400)}", f"§ {r.randint(1, 90)}", f"{r.choice(['Herr', 'Fru', 'Mr', 'Madam'])} {low}!", " ".join(w.upper() for w in self.words(r.randint(3, 9), r.choice(["sv", "en"]))), f"{cap()}. {place}", f"{place}, {place} {r.choice(CLASSES['joint'].split())} {place}", f"{r.choice(FUNCTION_WORDS['sv']).upper()} {place.upper()} {r.randint(1, 90)}",
        ])

    def lead(self, kind: str, lang: str) -> str:
        """What may stand before a span: words of its class, a sign, or nothing special."""
        r = self.r
        of = {"name": ["agent", "agent", "title", "joint", "article"], "phone": ["contact", "joint", "agent"], "email": ["agent", "joint", "contact"], "idnr": ["identity", "joint", "agent"], "address": ["home", "place", "agent"]}[kind]
        cue = r.choice(CLASSES[r.choice(of)].split()) + r.choice(["", "", "", ":", ".", ","])
        return r.choice([cue, cue, f"{r.choice(self.words(1, lang))} {cue}", r.choice(self.words(1, lang)), r.choice(self.words(1, lang)) + r.choice([",", ":", ";"]), f"{r.choice(self.words(1, lang))} {r.randint(1, 400)}{r.choice(['', ':', '.'])}"])

    def sentence(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        lang = "sv" if r.random() < 0.75 else "en"
        text, spans = "", []

        def add(piece: str, glue: str = " ") -> int:
            nonlocal text
            text += (glue if text and text[-1] not in "\n(" else "") + piece
            return len(text) - len(piece)

        for w in self.words(r.choice([0, 0, 0, 1, 2, 4, 7]), lang):
            add(w)
        text = text[:1].upper() + text[1:]
        for _ in range(r.choice([1, 1, 2, 3])):
            if r.random() < 0.45:
                add(self.other() if text or r.random() < 0.5 else self.other().capitalize())
            else:
                kind = r.choices(KINDS, weights=[1, 1.5, 1, 1.2, 4])[0]
                made = getattr(self, kind)()
                open_sign = r.random() < 0.12 and bool(text)
                if not open_sign and (text or r.random() < 0.85):
                    cue = self.lead(kind, lang)
                    add(cue if text else cue.capitalize())
                if open_sign:
                    add("(")
                spans.append((kind, add(made, r.choice([" ", " ", " ", "\n"]))))
                if kind == "name" and not open_sign and r.random() < 0.2:
                    add(r.choice(CLASSES["joint"].split()))
                    spans.append((kind, add(self.name())))
                text += ")" if open_sign else ""
                if kind == "name" and r.random() < 0.25:
                    add(f"({r.choice('ABCDGHKLMNSTV')}{r.choice(['', 'P', 'D', 'HV', 'TH'])})")
            text += r.choice(["", "", "", ",", ";", "."]) if r.random() < 0.4 else ""
            for w in self.words(r.choice([0, 1, 2, 5]), lang):
                add(w.capitalize() if text.endswith(".") else w)
        # as a whole sentence in capitals, only where it holds no label
        text = text.upper() if not spans and r.random() < 0.1 else text
        return text + r.choice([".", ".", ".", "!", "", "?"]), spans


def training_texts(n: int = TRAINING_TEXTS, seed: int = SEED) -> Iterator[tuple[str, set[tuple[str, int]]]]:
    """Made texts of a few sentences, with the kind and start of each labelled span."""
    r = random.Random(seed)
    writer = _Writer(r)
    for _ in range(n):
        text, spans = "", set()
        for _ in range(r.randint(2, 5)):
            text += r.choice([" ", " ", " ", "\n", "\n\n"]) if text else ""
            sentence, found = writer.sentence()
            spans |= {(kind, len(text) + at) for kind, at in found}
            text += sentence
        yield text, spans


@lru_cache(maxsize=1)
def trained(n: int = TRAINING_TEXTS, seed: int = SEED) -> dict[str, Boosted]:
    """One model per kind, trained on ``n`` made, labelled texts (the bound of the training sample)."""
    x: dict[str, list[list[int]]] = {k: [] for k in KINDS}
    y: dict[str, list[int]] = {k: [] for k in KINDS}
    made = list(training_texts(n, seed))
    known = casing_of(t for t, _ in made)
    r = random.Random(seed)
    known = Casing({w: level for w, level in known.items() if r.random() < 0.92})  # no corpus shows every word in lower case
    for text, spans in made:
        for kind, start, _, features in candidates(text, known):
            x[kind].append(features)
            y[kind].append((kind, start) in spans)
    return {k: Boosted(trees=100 if k == "name" else 60, depth=5 if k == "name" else 4).fit(np.array(x[k]), np.array(y[k])) for k in KINDS}


# ---- application ----


def mentions_of(texts: list[str], models: dict[str, Boosted], known: Casing) -> list[list[tuple[str, int, int]]]:
    """Per text, the chosen spans in order: the likeliest first, none that overlaps a chosen one."""
    found: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    by_kind: dict[str, list[tuple[int, int, int, list[int]]]] = {k: [] for k in KINDS}
    for i, text in enumerate(texts):
        for kind, start, end, features in candidates(text, known):
            by_kind[kind].append((i, start, end, features))
    for kind, rows in by_kind.items():
        if rows:
            p = models[kind].probability(np.array([r[3] for r in rows]))
            for (i, start, end, _), q in zip(rows, p, strict=True):
                if q >= models[kind].threshold:
                    found[i].append((float(q), kind, start, end))
    out = []
    for spans in found:
        chosen: list[tuple[str, int, int]] = []
        for _, kind, start, end in sorted(spans, key=lambda s: (-s[0], s[2], s[3])):
            if all(end <= b or start >= c for _, b, c in chosen):
                chosen.append((kind, start, end))
        out.append(sorted(chosen, key=lambda s: s[1]))
    return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its placeholder, otherwise unchanged."""
    parts, at = [], 0
    for kind, start, end in spans:
        parts += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join([*parts, text[at:]])


def _batches(frames, size: int = 200) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), size):
            yield frame.iloc[at : at + size]


def personal_mentions(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = TRAINING_TEXTS, seed: int = SEED) -> DataFrame:
    """One row per mention: ``key, kind, start_pos, length`` (code points). Null texts have none.

    Rows of ``documents`` that repeat give repeated rows. The models are trained on
    the driver from ``n`` made texts; how words are written is counted over all documents. Both are bounded, and broadcast.
    """
    models = documents.sparkSession.sparkContext.broadcast(trained(n, seed))
    known = documents.sparkSession.sparkContext.broadcast(casing(documents, text))

    def run(frames):
        for part in _batches(frames):
            keys, rows = part[key].to_numpy(), mentions_of(list(part[text]), models.value, known.value)
            flat = [(k, kind, start, end - start) for k, spans in zip(keys, rows, strict=True) for kind, start, end in spans]
            yield pd.DataFrame(flat, columns=[key, "kind", "start_pos", "length"])

    schema = f"{key} {documents.schema[key].dataType.simpleString()}, kind string, start_pos int, length int"
    return documents.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, schema)


def redacted(documents: DataFrame, key: str = "doc_id", text: str = "text", n: int = TRAINING_TEXTS, seed: int = SEED) -> DataFrame:
    """``key, text, n_mentions`` with placeholders instead of personal information; null stays null."""
    models = documents.sparkSession.sparkContext.broadcast(trained(n, seed))
    known = documents.sparkSession.sparkContext.broadcast(casing(documents, text))

    def run(frames):
        for part in _batches(frames):
            texts = list(part[text])
            rows = mentions_of([t or "" for t in texts], models.value, known.value)
            yield pd.DataFrame({key: part[key].to_numpy(), text: [None if t is None else redact(t, s) for t, s in zip(texts, rows, strict=True)], "n_mentions": [len(s) for s in rows]})

    schema = f"{key} {documents.schema[key].dataType.simpleString()}, {text} string, n_mentions int"
    return documents.select(key, text).mapInPandas(run, schema)
