"""One consistent form for texts that look alike but differ in their characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from votaria.session import cut

# Letters of other scripts that look like a Latin letter, and the Latin letter.
LOOKALIKES = dict(zip("аеорсухѕіјԁһԛԝАВЕКМНОРСТХЅІЈԌ", "aeopcyxsijdhqwABEKMHOPCTXSIJG", strict=True)) | dict(zip("ονϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovcjABEZHIKMNOPTYX", strict=True)) | dict(zip("ӕӔ", "æÆ", strict=True))
# Hyphens that print like the plain one.
HYPHENS = "‐‑"
# Default-ignorable ranges besides the general category Cf.
IGNORABLE = r"­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸"

_IGNORABLE = re.compile(f"[{IGNORABLE}]")
_BLANKS = re.compile(r"[^\S\n]")
_LINE_ENDS = re.compile("\r\n?|[\x0b\x0c\x1c-\x1e\x85  ]")
_LOOKALIKE_TABLE = {ord(a): b for a, b in LOOKALIKES.items()} | {ord(h): "-" for h in HYPHENS}
_END_BLANKS = re.compile(r" +(?=\n|\Z)")
#: Texts of these characters alone are already in the visual form, but for blanks at line ends.
PLAIN = r"\A[\n -~åäöÅÄÖéüÉ²³½«»–—†°•¬]*"
_PLAIN = re.compile(PLAIN + r"\Z")
#: Members of a class that meet in one task of the pair join, and classes up to which they are broadcast.
PAIR_ROWS = 1_000
BROADCAST_ROWS = 500_000


class _Visual(dict):
    """Per character: its compatibility form, unless a reader can tell the two apart (raised, lowered, fraction)."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        kind = unicodedata.decomposition(c)
        apart = kind.startswith(("<super>", "<sub>", "<fraction>", "<circle>", "<square>"))
        self[code] = c if apart else unicodedata.normalize("NFKC", c)
        return self[code]


_VISUAL = _Visual()


def visual_form(text: str) -> str:
    """The form under which texts that look the same to a reader are equal, and others stay different.

    Default-ignorable characters go; blanks of any kind become plain ones, and those at line ends go; full-width
    letters, ligatures and the like take their compatibility form, except where the sign looks different (raised
    digits, fractions). Then marks are split off, look-alike letters of other scripts become Latin, and all is composed
    again, so canonically equal texts have one form. Case and line ends stay.
    """
    if _PLAIN.match(text):
        return _END_BLANKS.sub("", text) if " \n" in text or text.endswith(" ") else text
    text = _IGNORABLE.sub("", _LINE_ENDS.sub("\n", text))
    text = unicodedata.normalize("NFD", text.translate(_VISUAL)).translate(_LOOKALIKE_TABLE)
    text = _BLANKS.sub(" ", unicodedata.normalize("NFC", text))
    return _END_BLANKS.sub("", text)


_WORDS = re.compile(r"[^\W\d_µ]+|µ")
_HELD = "\ue0ff"


def _foreign(word: str) -> bool:
    """Whether a word is whole in another script: no Latin letter in it, and not look-alikes alone."""
    return not any(c < "\u0250" or "\u1e00" <= c <= "\u1eff" or unicodedata.normalize("NFKC", c) < "\u0250" for c in word) and any(c not in LOOKALIKES for c in word)


def latin_form(text: str) -> str:
    """The visual form, but with words that are whole in another script, and micro signs, as they are.

    A look-alike letter is taken for Latin only in a word that holds a Latin letter as well, or nothing but look-alikes.
    """
    if _PLAIN.match(text) or _HELD in text:
        return visual_form(text)
    held: list[str] = []

    def keep(m: re.Match) -> str:
        if m[0] != "µ" and (m[0].isascii() or not _foreign(m[0])):
            return m[0]
        held.append(m[0])
        return _HELD

    text = visual_form(_WORDS.sub(keep, text))
    return re.sub(_HELD, lambda _, words=iter(held): next(words), text)


def folded(form: str) -> str:
    """A visual form in composed compatibility form with full case folding and mapped blanks."""
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", form).casefold())
    return " ".join(text.translate(_LOOKALIKE_TABLE).split())


def comparison_form(text: str) -> str:
    """NFKC with full case folding, mapped blanks and no ignorables: for comparisons that are to ignore case as well.

    It is made from the visual form, so texts that look alike are equal here too.
    """
    return folded(visual_form(text))


def _per_distinct(form: Callable[[str], str]) -> Callable[[Column], Column]:
    def run(texts: pd.Series) -> pd.Series:
        codes, values = pd.factorize(texts)
        done = np.array([form(v) for v in values] + [None], dtype=object)
        return pd.Series(done[codes], index=texts.index)

    return F.pandas_udf(run, "string")


def to_visual(col: Column | str) -> Column:
    """``visual_form`` of a column; plain texts never leave the JVM. Null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    plain = c.rlike(PLAIN + r"\z")
    return F.coalesce(_per_distinct(visual_form)(F.when(~plain, c)), F.regexp_replace(c, r" +(?=\n|\z)", ""))


def to_comparison(col: Column | str) -> Column:
    """``comparison_form`` of a column, once per distinct value of a batch. Null stays null."""
    return _per_distinct(comparison_form)(F.col(col) if isinstance(col, str) else col)


def classes(records: DataFrame, by: list[str], text: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Records whose text looks like that of another one with other characters, with the class they belong to.

    Texts are blocked by their folded compatibility form, and a block is refined by the form that keeps what a reader
    tells apart. Adds ``form_id`` (128-bit hash of both forms) and ``raw_id`` (of the characters). Only classes with
    two or more different spellings stay. Hashes travel, texts don't; the spread of spellings is tested by a combinable
    min/max, so a class with a third of all rows is no more than one row in each map task. The classes are broadcast to
    the records while they are few; beyond ``broadcast_rows`` both meet in a shuffle, which adaptive execution splits
    where one class is large. The hashes are written once, as both sides need them. Null texts are left out.
    """
    wide = lambda c: F.substring(F.sha2(c, 256), 1, 32)
    formed = records.where(F.col(text).isNotNull()).withColumn("_form", to_visual(text))
    simple = F.col("_form").rlike(r"\A[\n -~åäöÅÄÖéüÉ]*\z")
    block = F.coalesce(_per_distinct(folded)(F.when(~simple, F.col("_form"))), F.trim(F.regexp_replace(F.lower("_form"), r"[ \n]+", " ")))
    hashed = cut(formed.withColumn("form_id", wide(F.concat_ws("\x1f", block, "_form"))).withColumn("raw_id", wide(F.col(text))).drop(text, "_form"))
    many = hashed.groupBy(*by, "form_id").agg(F.min("raw_id").alias("_a"), F.max("raw_id").alias("_b")).where("_a <> _b").select(*by, "form_id")
    many = cut(many)
    return hashed.join(F.broadcast(many) if many.count() <= broadcast_rows else many, [*by, "form_id"], "left_semi")


def lookalike_pairs(records: DataFrame, by: list[str], key: str, text: str, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Pairs ``key_a < key_b`` of records of one ``by`` group whose texts look the same but differ in characters.

    The pairs are asked for, so a class of k records gives up to k² of them; ``classes`` is the form that grows with the
    rows alone. The work of a large class is spread: one side is dealt by a hash of its key into parts of about
    ``pair_rows``, the other meets every part. Repeated rows give no further pairs; null keys and texts give none. An
    empty table gives no pairs.
    """
    found = cut(classes(records.where(F.col(key).isNotNull()), by, text).select(*by, "form_id", "raw_id", key).distinct())
    parts = found.groupBy(*by, "form_id").agg(F.ceil(F.count("*") / F.lit(pair_rows)).cast("int").alias("_parts"))
    sized = found.join(parts, [*by, "form_id"])
    a = sized.select(*by, "form_id", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int").alias("_part"), F.col("raw_id").alias("_raw_a"), F.col(key).alias("key_a"))
    b = sized.select(*by, "form_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.col("raw_id").alias("_raw_b"), F.col(key).alias("key_b"))
    return a.join(b, [*by, "form_id", "_part"]).where("key_a < key_b and _raw_a <> _raw_b").select(*by, "key_a", "key_b").distinct()
