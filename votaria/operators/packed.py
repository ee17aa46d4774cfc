"""Several values packed in one field: one row per value, with its position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The signs that part values, besides line ends, and the word that does.
DELIMITERS = ",;|/&+\t\n\r "
WORD_DELIMITER = "och"
BRACKETS = "()[]{}"

# Private-use stand-ins for delimiters and brackets within quotes, and for an escaped quote.
_GUARDED = DELIMITERS + BRACKETS
_STANDINS = "".join(chr(0xE100 + i) for i in range(len(_GUARDED)))
_QUOTE = ""
# Stand-ins that a text already holds are written as this sign and a letter while it is taken apart.
_ESCAPE = chr(0xE0FE)
_HELD = _ESCAPE + _STANDINS + _QUOTE


def _replace(c: Column, source: str, target: str) -> Column:
    return F.translate(c, source, target)


def _escaped(c: Column) -> Column:
    done = reduce(lambda x, i: F.replace(x, F.lit(_HELD[i]), F.lit(_ESCAPE + chr(97 + i))), range(len(_HELD)), c)
    return F.when(c.rlike(f"[{_HELD}]"), done).otherwise(c)


def _restored(c: Column) -> Column:
    done = reduce(lambda x, i: F.replace(x, F.lit(_ESCAPE + chr(97 + i)), F.lit(_HELD[i])), reversed(range(len(_HELD))), c)
    return F.when(F.contains(c, F.lit(_ESCAPE)), done).otherwise(c)


def packed_values(col: Column | str) -> Column:
    """The values of a packed text as ``array<string>``, in order, repeated values kept.

    The text is split on its quote character (the double quote where it occurs, else an enclosing single quote). Odd
    pieces are literals and keep their delimiters, an empty even piece between two literals is a doubled quote, and
    even pieces are split on delimiters. A fold over the pieces builds the text back with the literals guarded. Values
    come without surrounding blanks, brackets and quotes. Null gives null; an empty or blank text gives an empty array.
    """
    text = F.col(col) if isinstance(col, str) else col
    text = F.regexp_replace(F.regexp_replace(_escaped(text), r'\\"', _QUOTE), r"\\'", "'")
    single = F.regexp_replace(text, r"(?:(?<=^|[\[(,;|/&+\t\n ])'|'(?=$|[\]),;|/&+\t\n ]))", '"')
    pieces = F.split(F.when(F.contains(text, F.lit('"')), text).otherwise(single), '"', -1)

    def step(state: Column, piece: Column) -> Column:
        odd = state["i"] % 2 == 1
        doubled = (piece == "") & (state["i"] > 0)
        part = F.when(odd, _replace(piece, _GUARDED, _STANDINS)).when(doubled, _QUOTE).otherwise(piece)
        return F.struct((state["i"] + 1).alias("i"), F.concat(state["text"], part).alias("text"))

    # the last piece is none between quotes: it stays as it is
    inner = F.slice(pieces, 1, F.size(pieces) - 1)
    guarded = F.concat(F.aggregate(inner, F.struct(F.lit(0).alias("i"), F.lit("").alias("text")), step)["text"], F.element_at(pieces, -1))
    bare = F.translate(guarded, BRACKETS, " " * len(BRACKETS))
    values = F.split(F.regexp_replace(bare, rf"(?i)(?<=\s){WORD_DELIMITER}(?=\s)", ","), r"[,;|/&+\s]+", -1)
    restored = F.transform(values, lambda v: _restored(F.trim(F.translate(v, _STANDINS + _QUOTE, _GUARDED + '"'))))
    return F.when(text.isNotNull(), F.filter(restored, lambda v: v != ""))


def split_packed(df: DataFrame, field: str, keep: list[str], least: int = 1) -> DataFrame:
    """One row per value: ``keep`` columns, ``pos`` (from 1) and ``value``; texts with under ``least`` values are left out."""
    split = df.select(*keep, packed_values(field).alias("_values")).where(F.size("_values") >= least)
    return split.select(*keep, F.posexplode("_values").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)
