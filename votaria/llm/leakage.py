"""Evaluation texts leaking into training text: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from votaria.llm import bitfilter
from votaria.llm.textform import IGNORABLE
from votaria.session import cut

#: Consecutive words that make a leak, and words in a shingle.
PASSAGE_WORDS = 12
SHINGLE_WORDS = 5
#: Item minima (about 30 bytes each), and pairs of a document and an item, up to which they are broadcast.
BROADCAST_ROWS = 500_000

_DROPPED = re.compile(f"[{IGNORABLE}]")


class _Folded(dict):
    """Per character: its letters and digits without case and marks; a blank for anything else."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        plain = "".join(x for x in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(x))
        self[code] = "" if unicodedata.combining(c) or _DROPPED.match(c) else "".join(x if x.isalnum() else " " for x in plain)
        return self[code]


_FOLDED = _Folded()


class _Hashes(dict):
    """64-bit hash of a word; kept for the words met so far, up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def words_of(text: str) -> list[str]:
    """Unbroken runs of letters and digits, without case and accents."""
    return text.translate(_FOLDED).split()


@dataclass
class Windows:
    """Windows of one length over several texts: text number, first word in it and in all, MinHash; and the hashes of all words."""

    owner: np.ndarray
    first: np.ndarray
    low: np.ndarray
    at: np.ndarray
    hashes: np.ndarray
    length: int

    def whole(self, pick: np.ndarray) -> np.ndarray:
        """A 64-bit hash of all words, in order, of the picked windows."""
        at, total = self.at[pick], np.zeros(int(pick.sum()), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.length):
                total = (total ^ self.hashes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                total ^= total >> np.uint64(29)
        return total


def window_minima(words: list[list[str]], passage: int = PASSAGE_WORDS, shingle: int = SHINGLE_WORDS) -> Windows:
    """MinHash of every window of ``passage`` words: the minimum over its shingles.

    All windows are sets of one size, ``passage - shingle + 1`` shingles; for sets of one size containment is equality,
    so a window of an item that occurs in a text always has its minimum there: one permutation gives full recall.
    """
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    n = int(lengths.sum())
    if n < passage:
        none = np.empty(0, np.int64)
        return Windows(none, none, np.empty(0, np.uint64), none, np.empty(0, np.uint64), passage)
    h = np.fromiter((_HASHES[x] for w in words for x in w), dtype=np.uint64, count=n)
    owner = np.repeat(np.arange(len(words)), lengths)
    with np.errstate(over="ignore"):
        s = np.zeros(n - shingle + 1, dtype=np.uint64)
        for k in range(shingle):
            s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : n - shingle + 1 + k]
        s ^= s >> np.uint64(31)
        s *= np.uint64(0xBF58476D1CE4E5B9)
        s ^= s >> np.uint64(29)
    span, m, done = passage - shingle + 1, s, 1
    while done < span:  # minimum over span shingles by doubling
        step = min(done, span - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    at = np.nonzero(owner[: len(m)] == owner[passage - 1 : passage - 1 + len(m)])[0]
    first = at - np.concatenate(([0], np.cumsum(lengths)[:-1]))[owner[at]]
    return Windows(owner[at], first, m[at], at, h, passage)


def run_length(n_words: int, passage: int = PASSAGE_WORDS, share: float = 0.0) -> int:
    """Consecutive words that make a leak of an item of ``n_words``."""
    return max(passage, math.ceil(share * n_words))


def size_class(n_words: int, passage: int = PASSAGE_WORDS) -> int:
    """The size partition of an item: 0 up to twice the passage, 1 up to four times, and so on."""
    return max(0, (n_words // passage).bit_length() - 1)


def window_of(partition: int, passage: int = PASSAGE_WORDS, share: float = 0.0) -> int:
    """Words in the windows of a size partition: the shortest run that is a leak of its smallest item."""
    return run_length(passage << partition if partition else passage, passage, share)


def _parts(frames: Iterable[pd.DataFrame], size: int = 500) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), size):
            yield frame.iloc[start : start + size]


def _item_minima(frames, key: str, text: str, passage: int, shingle: int, share: float) -> Iterator[pd.DataFrame]:
    for part in _parts(frames):
        words = [words_of(t) for t in part[text]]
        keys = part[key].to_numpy()
        by_window: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= passage:
                by_window.setdefault(window_of(size_class(len(w), passage), passage, share), []).append(i)
        for window, at in by_window.items():
            found = window_minima([words[i] for i in at], window, shingle)
            whole = found.whole(np.ones(len(found.low), dtype=bool))
            yield pd.DataFrame({key: keys[np.array(at)[found.owner]], "window": window, "low": found.low.astype(np.int64), "whole": whole.astype(np.int64)}).drop_duplicates()


def _document_windows(frames, key: str, text: str, filters: dict[int, tuple[np.ndarray, np.ndarray]], shingle: int) -> Iterator[pd.DataFrame]:
    for part in _parts(frames):
        words = [words_of(t) for t in part[text]]
        keys = part[key].to_numpy()
        for window, (low_bits, whole_bits) in filters.items():
            found = window_minima(words, window, shingle)
            near = bitfilter.passes(low_bits, found.low)
            whole = found.whole(near)
            same = bitfilter.passes(whole_bits, whole)
            yield pd.DataFrame({key: keys[found.owner[near][same]], "window": window, "whole": whole[same].astype(np.int64)}).drop_duplicates()


def _shingles(words: list[str], n: int) -> Iterator[tuple[str, ...]]:
    return zip(*(words[i:] for i in range(n)), strict=False)


def verified(document: list[str], item: list[str], run: int, shingle: int = SHINGLE_WORDS) -> tuple[float, list[int]]:
    """Share of the item's shingles in the document, and where its windows of ``run`` words that stand there begin (each text once)."""
    mine = set(_shingles(item, shingle))
    shared = mine.intersection(_shingles(document, shingle))
    if not shared:
        return 0.0, []
    first = {w: i for i, w in reversed(list(enumerate(_shingles(item, run))))}
    return len(shared) / len(mine), sorted(first[w] for w in set(first).intersection(_shingles(document, run)))


def leaks(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", passage: int = PASSAGE_WORDS, shingle: int = SHINGLE_WORDS, share: float = 0.0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``doc_key, item_key, estimate, containment, passages``: items of which a run of words stands in a document.

    A leak is a run of ``passage`` words, or of ``share`` of the item's words where that is more; ``passages`` tells where
    in the item such runs begin. Items are partitioned by size. The items of a partition are cut into windows of its
    shortest leak, and each window, a set of one size, is signed with the MinHash of its shingles; so are the windows of
    that size of every document, whatever its length. A leaked run holds a window of its partition, whose minimum is then
    the same on both sides: no leak is lost. Minima of items fill a bit filter for each partition, sized by their
    count, and so do hashes of their whole windows; documents are read once, a window whose minimum is a candidate is
    hashed as a whole, and only 64-bit hashes that pass both leave the scan. The share of an item's minima met in a
    document estimates its containment. Every pair with a common window is then verified on the texts, by exact
    containment of shingles and by the run. Null texts and keys, and texts under ``passage`` words, give
    nothing; documents and items with several texts give a row for each pair of texts.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    known = lambda df, c: df.where(F.col(c).isNotNull() & F.col(text).isNotNull()).select(c, text)
    context = documents.sparkSession.sparkContext
    signed = cut(known(items, item_key).mapInPandas(lambda it: _item_minima(it, item_key, text, passage, shingle, share), f"{item_key} {kind(items, item_key)}, window int, low long, whole long").distinct())
    sizes = signed.groupBy("window").agg(F.count_distinct("low").alias("low"), F.count_distinct("whole").alias("whole")).collect()  # a row for each size partition
    own = lambda r, c: bitfilter.build(signed.where(F.col("window") == r["window"]).select(c).distinct(), c, r[c])
    filters = context.broadcast({r["window"]: (own(r, "low"), own(r, "whole")) for r in sizes})
    met = known(documents, doc_key).mapInPandas(lambda it: _document_windows(it, doc_key, text, filters.value, shingle), f"{doc_key} {kind(documents, doc_key)}, window int, whole long")
    total = signed.groupBy(item_key).agg(F.count_distinct("low").alias("_minima"))
    few = signed.count() <= broadcast_rows
    small = lambda df, n: F.broadcast(df) if n <= broadcast_rows else df
    hits = met.join(F.broadcast(signed) if few else signed, ["window", "whole"]).groupBy(doc_key, item_key).agg(F.count_distinct("low").alias("_hits"))
    pairs = hits.join(F.broadcast(total) if few else total, item_key).select(doc_key, item_key, F.least(F.lit(1.0), F.col("_hits") / F.col("_minima")).alias("estimate"))
    pairs = cut(pairs)
    # texts are fetched for pairs with a common minimum alone
    texts = known(documents, doc_key).withColumnRenamed(text, "_document")
    both = texts.join(small(pairs, pairs.count()), doc_key).distinct()
    both = both.join(known(items, item_key).distinct().withColumnRenamed(text, "_item"), item_key)

    def check(frames):
        for part in _parts(frames):
            items_of: dict[str, list[str]] = {}
            done = []
            for d, i in zip(part["_document"], part["_item"], strict=True):
                if i not in items_of:
                    items_of[i] = words_of(i)
                done.append(verified(words_of(d), items_of[i], run_length(len(items_of[i]), passage, share), shingle))
            yield pd.DataFrame({doc_key: part[doc_key].to_numpy(), item_key: part[item_key].to_numpy(), "estimate": part["estimate"].to_numpy(), "containment": [c for c, _ in done], "passages": [p for _, p in done]})

    out = f"{doc_key} {kind(documents, doc_key)}, {item_key} {kind(items, item_key)}, estimate double, containment double, passages array<int>"
    return both.mapInPandas(check, out).where(F.size("passages") > 0)
