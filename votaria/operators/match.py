"""Joins beyond equality: pending work, as-of variants, look-back windows, containment, nearest spans, one-to-one matches."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from votaria.functions.text import match_key
from votaria.operators.asof import asof_join
from votaria.operators.shape import ordered
from votaria.session import cut

#: Documents (rows) up to which a document dimension is broadcast.
BROADCAST_ROWS = 100_000


def pending(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose key is not in ``done`` (anti-join; a null key is always pending)."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def versions(df: DataFrame, by: list[str], start: str) -> DataFrame:
    """Versions with ``valid_from`` and ``valid_to`` (null: still valid) in days, by their start dates; the last row of a day counts."""
    w = Window.partitionBy(*by).orderBy("valid_from")
    day = df.where(F.col(start).isNotNull()).withColumn("valid_from", F.unix_date(start))
    rest = [c for c in df.columns if c not in by]
    one = day.groupBy(*by, "valid_from").agg(F.max(F.struct(*rest)).alias("_v"))
    return one.select(*by, "valid_from", F.lead("valid_from").over(w).alias("valid_to"), "_v.*")


def asof_version(probes: DataFrame, versions: DataFrame, day: str, by: list[str], strict: bool = False, fallback_first: list[str] | None = None, most_days: int | None = None) -> DataFrame:
    """The version in force at each probe's ``day`` (int); probes without one are left out.

    ``strict`` takes versions that began before the day, ``fallback_first`` lets the first version of these keys hold
    from the beginning, ``most_days`` drops versions older than that.
    """
    v = versions
    if strict:
        v = v.withColumns({"valid_from": F.col("valid_from") + 1, "valid_to": F.col("valid_to") + 1})
    v = v.withColumn("_began", F.col("valid_from") - (1 if strict else 0))
    if fallback_first:
        first = F.row_number().over(Window.partitionBy(*fallback_first).orderBy("valid_from")) == 1
        v = v.withColumn("valid_from", F.when(first, F.lit(-1_000_000)).otherwise(F.col("valid_from")))
    joined = asof_join(probes, v, day, by)
    if most_days is not None:
        joined = joined.where(F.col(day) - F.col("_began") <= most_days)
    return joined.drop("_began")


def within_window(probes: DataFrame, events: DataFrame, by: list[str], day: str, at: str, back: int) -> DataFrame:
    """Pairs of a probe and the events of the ``back`` days before it, ``[day - back, day)``.

    Both sides fall into buckets of ``back`` days; a probe meets its own bucket and the one before, so the join is an
    equi-join and no pair is met twice.
    """
    bucket = lambda c: F.floor(c / F.lit(back))
    left = probes.withColumn("_b", F.explode(F.array(bucket(F.col(day)), bucket(F.col(day)) - 1)))
    right = events.withColumn("_b", bucket(F.col(at)))
    return left.join(right, [*by, "_b"]).where((F.col(at) < F.col(day)) & (F.col(at) >= F.col(day) - back)).drop("_b")


def fallback_join(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """The value under the exact key, else under the key without regard to case (the least, where several differ)."""
    exact = right.groupBy(F.col(key)).agg(F.min(value).alias("_exact"))
    loose = right.groupBy(F.lower(key).alias("_key")).agg(F.min(value).alias("_loose"))
    joined = left.join(exact, key, "left").withColumn("_key", F.lower(key)).join(loose, "_key", "left")
    return joined.withColumn(value, F.coalesce("_exact", "_loose")).drop("_key", "_exact", "_loose")


#: Whole words by which long quotes meet the texts that may hold them.
GRAM_WORDS = 5


def _gram(hashes: Column, first: Column) -> Column:
    """Hash of the run of GRAM_WORDS words that begins at ``first`` (from 0), from the hashes of the words."""
    return F.xxhash64(*[F.get(hashes, first + k) for k in range(GRAM_WORDS)])


def _grams(words: Column) -> Column:
    """Hashes of all runs of GRAM_WORDS words. Words are split and hashed once: a lambda would do so again for each run."""
    last = lambda h: F.size(h) - GRAM_WORDS
    runs = lambda h: F.when(last(h) >= 0, F.array_distinct(F.transform(F.sequence(F.lit(0), last(h)), lambda i: _gram(h, i))))
    return F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), runs), 0)


def verbatim(citations: DataFrame, blocks: DataFrame, on: list[str], quote: str, text: str) -> DataFrame:
    """Adds ``verbatim``: whether some block of the cited document contains the quote; an empty quote is none.

    A quote may begin and end within a word, but its inner words stand whole in the block. So a quote of GRAM_WORDS + 2
    words or more meets the blocks of its document by the hash of its second to sixth word, and only blocks with that
    run are searched; no document is multiplied by its quotes. Shorter quotes are compared with each distinct block.
    """
    quotes = cut(citations.where(F.trim(quote) != "").select(*on, quote).distinct().withColumn("_q", match_key(F.col(quote))))
    texts = cut(blocks.select(*on, match_key(F.col(text)).alias("_t")).distinct().withColumn("_id", F.monotonically_increasing_id()))
    n_words = F.size(F.split("_q", " "))
    inner = F.transform(F.slice(F.split("_q", " "), 2, GRAM_WORDS), lambda w: F.xxhash64(w))
    long = quotes.where(n_words >= GRAM_WORDS + 2).select(*on, quote, "_q", _gram(inner, F.lit(0)).alias("_g"))
    # runs are numbers until they meet; texts follow for those that did
    runs = texts.select(*on, "_id", F.explode(_grams(F.split("_t", " "))).alias("_g"))
    met = long.join(runs, [*on, "_g"]).drop("_g").join(texts.select("_id", "_t"), "_id")
    short = quotes.where(n_words < GRAM_WORDS + 2).select(*on, quote, "_q").join(texts, on)
    hits = met.select(*on, quote, "_q", "_t").unionByName(short.select(*on, quote, "_q", "_t")).where(F.contains("_t", F.col("_q"))).select(*on, quote).distinct().withColumn("verbatim", F.lit(True))
    return citations.join(hits, [*on, quote], "left").withColumn("verbatim", F.coalesce("verbatim", F.lit(False)))


def segments(pieces: DataFrame, by: list[str], order: list[Column], text: str, words: int, overlap: int) -> DataFrame:
    """``by, segment, text``: the pieces of each group in order, joined to texts of about ``words`` words that overlap.

    Any run of up to ``overlap`` words of the whole lies in the segment in which it begins. A group is numbered by
    ranges (see ``ordered``), so its size bounds no task.
    """
    sized = pieces.withColumn("_n", F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("bigint")).where("_n > 0")
    laid = ordered(sized, by, order, running={"_end": "_n"}).withColumn("_start", F.col("_end") - F.col("_n"))
    first = F.greatest(F.lit(0), F.floor((F.col("_start") - F.lit(overlap)) / F.lit(words)))
    each = laid.withColumn("segment", F.explode(F.sequence(first, F.floor((F.col("_end") - 1) / F.lit(words)))))
    # about ``words`` words, and a piece at either end
    return each.groupBy(*by, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", text))), lambda x: x[text]), " ").alias(text))


def _matched(a: str, b: str) -> int:
    """Signs in the matching blocks of two texts, as ``difflib`` has them: the longest block, first in ``a``, then in ``b``, and so on at both sides."""
    total, rest = 0, [(a, b)]
    while rest:
        a, b = rest.pop()
        size = at = 0
        for i in range(len(a)):
            if i + size >= len(a):
                break
            if a[i : i + size + 1] in b:
                at, size = i, size + 1
                while at + size < len(a) and a[at : at + size + 1] in b:
                    size += 1
        if size:
            total += size
            j = b.index(a[at : at + size])
            rest += [(x, y) for x, y in ((a[:at], b[:j]), (a[at + size :], b[j + size :])) if x and y]
    return total


def _ratio(a: str, b: str) -> float:
    """The Ratcliff/Obershelp ratio, equal to ``difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()``."""
    return 2.0 * _matched(a, b) / (len(a) + len(b)) if a or b else 1.0


#: Signs of a quote that are looked up exactly to find a first span, and the fewest that a piece may have to be looked up.
SEED_SIGNS, PIECE_SIGNS = 16, 6
#: Starts of windows that are bounded together.
STARTS_AT_ONCE = 12


class _Search:
    """The best window of one text for one quote, as far as it is known."""

    def __init__(self, spans: Spans, quote: str, widths: list[int], least: float):
        self.spans, self.quote, self.widths = spans, quote, widths
        self.best, self.top, self.place = "", max(0.0, float(np.nextafter(least, 0.0))), (0, 0)
        self.bounds: dict[int, list[tuple[float, int, int]]] = {}  # bounds of the windows from a start

    def bounded(self, starts: Iterable[int]) -> list[tuple[float, int, int]]:
        """Bound, start and width of the windows from some starts: the longest common subsequence holds the signs of all blocks."""
        new, n, at = [i for i in starts if i not in self.bounds], len(self.quote), self.spans.at
        signs = set(self.quote)
        for some in (new[k : k + STARTS_AT_ONCE] for k in range(0, len(new), STARTS_AT_ONCE)):
            sizes = [[at[i + w] - at[i] - 1 for w in self.widths if i + w < len(at)] for i in some]
            lane = max(x[-1] for x in sizes) + 1  # a bit between them takes the carry
            first = at[min(some)]
            stretch = (1 << (max(at[i] + x[-1] for i, x in zip(some, sizes, strict=True)) - first)) - 1
            lanes = [(at[i] - first, (1 << x[-1]) - 1, k * lane) for k, (i, x) in enumerate(zip(some, sizes, strict=True))]
            every = sum(ones << low for _, ones, low in lanes)
            masks = {}
            for c in signs:
                here, mask = (self.spans.mask(c) >> first) & stretch, 0
                if here:
                    for head, ones, low in lanes:
                        mask |= ((here >> head) & ones) << low
                masks[c] = mask
            state = every
            for c in self.quote:
                hit = state & masks[c]
                if hit:
                    state = ((state + hit) | (state ^ hit)) & every
            state ^= every
            for i, x, (_, _, low) in zip(some, sizes, lanes, strict=True):
                own = state >> low
                self.bounds[i] = [(2.0 * (own & ((1 << m) - 1)).bit_count() / (m + n), i, w) for m, w in zip(x, self.widths, strict=False)]
        return [w for i in starts for w in self.bounds[i]]

    def compare(self, windows: list[tuple[float, int, int]]) -> None:
        """Compares windows in the order of their bounds; the first in the text, then the narrowest, stays on ties."""
        for bound, start, width in sorted(windows, key=lambda w: (-w[0], w[1], w[2])):
            if bound < self.top:
                break
            span = self.spans.window(start, width)
            r = self.top if span == self.best else _ratio(self.quote, span)
            if r > self.top or (r == self.top and self.best and (start, width) < self.place):
                self.best, self.top, self.place = span, r, (start, width)

    def seed(self) -> None:
        """A first good span: where most pieces of the quote stand at the same distance."""
        spans, votes = self.spans, Counter()
        for o in range(0, len(self.quote) - SEED_SIGNS + 1, SEED_SIGNS):
            at = spans.text.find(self.quote[o : o + SEED_SIGNS])
            if at >= 0:
                votes[(at - o) // SEED_SIGNS] += 1
        if votes:
            near = bisect_right(spans.at, votes.most_common(1)[0][0] * SEED_SIGNS) - 1
            last = len(spans.words) - self.widths[0]
            self.compare(self.bounded(range(max(0, near - 1), min(last, near + 4) + 1)))

    def by_pieces(self) -> bool:
        """Looks where a better window must be: it holds one of so many pieces unchanged. False if pieces would be too short.

        A window of at least the best ratio leaves at most ``most`` signs of both texts out of its blocks. Each of them
        spoils one piece of the quote at most, and shifts the pieces after it by one sign.
        """
        n, spans = len(self.quote), self.spans
        most = int((1 - self.top) * 2 * n / self.top + 1e-6) if self.top > 0 else n
        size = n // (most + 1)
        if size < PIECE_SIGNS:
            return False
        last = len(spans.words) - self.widths[0]
        starts: set[int] = set()
        for o in range(0, (most + 1) * size, size):
            piece = self.quote[o : o + size]
            at = spans.text.find(piece)
            while at >= 0:
                starts.update(range(bisect_left(spans.at, at - o - most), min(last, bisect_right(spans.at, at - o + most) - 1) + 1))
                at = spans.text.find(piece, at + 1)
        self.compare(self.bounded(sorted(starts)))
        return True

    def by_distance(self) -> None:
        """Looks at the windows whose end is near enough to the quote by edits (the best over all beginnings, at once for all ends)."""
        spans, n = self.spans, len(self.quote)
        every = (1 << len(spans.text)) - 1
        masks = {c: spans.mask(c) for c in set(self.quote)}
        more = fewer = 0  # where the distance rises or falls from one sign of the text to the next
        for c in self.quote:
            same = masks[c]
            across = (((same & more) + more) ^ more) | same
            up = (((fewer | ((across | more) ^ every)) << 1) | 1) & every
            down = ((more & across) << 1) & every
            same |= fewer
            more = down | ((same | up) ^ every)
            fewer = up & same
        bits = [np.unpackbits(np.frombuffer(x.to_bytes(len(spans.text) // 8 + 1, "little"), dtype=np.uint8), bitorder="little").astype(np.int32) for x in (more, fewer)]
        distance = n + np.cumsum(bits[0] - bits[1])
        at = np.array(spans.at)
        found = []
        for w in self.widths:
            sizes = at[w:] - at[:-w] - 1
            # blocks leave out at least as many signs as there are edits, and as the lengths differ by
            most = (sizes + n - np.maximum(distance[at[w:] - 2], np.abs(sizes - n))) // 2
            bounds = 2.0 * most / (sizes + n)
            found += [(float(bounds[i]), int(i)) for i in np.nonzero(bounds >= self.top)[0]]
        reach: dict[int, float] = {}  # the best bound of each start
        for bound, start in found:
            reach[start] = max(bound, reach.get(start, 0.0))
        order = sorted(reach, key=lambda i: (-reach[i], i))
        for k in range(0, len(order), STARTS_AT_ONCE):
            some = [i for i in order[k : k + STARTS_AT_ONCE] if reach[i] >= self.top]
            if not some:
                break
            self.compare(self.bounded(some))


class Spans:
    """The windows of words of one text, searched for any number of quotes."""

    def __init__(self, source: str):
        self.words = source.split()
        self.text = " ".join(self.words)
        self.at = [0, *accumulate(len(w) + 1 for w in self.words)]  # where each word starts
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self._masks: dict[str, int] = {}

    def mask(self, sign: str) -> int:
        """The places of a sign in the text, as the bits of a number."""
        if sign not in self._masks:
            self._masks[sign] = int.from_bytes(np.packbits(self.codes == ord(sign), bitorder="little").tobytes(), "little")
        return self._masks[sign]

    def window(self, start: int, width: int) -> str:
        return self.text[self.at[start] : self.at[start + width] - 1]

    def closest(self, quote: str, least: float = 0.0) -> tuple[str, float]:
        """The window most like ``quote``, with its Ratcliff/Obershelp ratio, if that is ``least`` or more; see ``closest_span``."""
        q = " ".join(quote.split())
        n = len(q.split())
        widths = [w for w in sorted({max(3, n - 3), n, n + 3, n + 8}) if 0 < w <= len(self.words)]
        if not q or not widths:
            return "", 0.0
        search = _Search(self, q, widths, least)
        search.seed()
        if not search.by_pieces():
            search.by_distance()
        return (search.best, search.top) if search.best else ("", 0.0)


def closest_span(quote: str, source: str) -> tuple[str, float]:
    """The window of words in ``source`` most like ``quote``, with its Ratcliff/Obershelp ratio; the first on ties.

    Windows are as wide as the quote, 3 words narrower, 3 or 8 wider; without any the span is empty with ratio 0. The signs of all matching blocks are a common
    subsequence, so the longest one bounds the ratio from above, and so does the distance by edits. If a first span is
    good enough, a better one must hold a piece of the quote unchanged, and only the windows around these pieces are
    bounded; else the distance of all windows is bounded at once. Windows are compared in the order of their bound, until
    no bound reaches the best ratio found.
    """
    return Spans(source).closest(quote)


def closest_spans(quotes: Column | str, source: Column | str, least: float = 0.0) -> Column:
    """``closest_span`` of each of an array of ``quotes`` as ``array<struct<quote, span, ratio>>``; null where either side is null.

    A span whose ratio is under ``least`` is not looked for: it comes out as empty, with ratio 0.
    """

    def run(quotes: pd.Series, sources: pd.Series) -> pd.Series:
        def of(listed, source):
            if listed is None or not isinstance(source, str):
                return None
            spans = Spans(source)
            return [{"quote": q, **dict(zip(("span", "ratio"), spans.closest(q, least), strict=True))} for q in listed]

        return pd.Series([of(q, s) for q, s in zip(quotes, sources, strict=True)], dtype=object)

    return F.pandas_udf(run, "array<struct<quote:string,span:string,ratio:double>>")(quotes, source)


def prefix_lookup(asked: DataFrame, rows: DataFrame, prefix: str, key: str, lengths: list[int]) -> DataFrame:
    """``prefix, n, key, verdict``: how many keys begin with a prefix (none, one, many), and the key where it is one.

    ``lengths`` are the lengths of the prefixes; keys meet them in an equi-join on their first signs.
    """
    heads = rows.select(key, F.explode(F.array(*[F.substring(key, 1, n) for n in lengths])).alias(prefix))
    counts = asked.select(prefix).distinct().join(heads, prefix, "left").groupBy(prefix).agg(F.count(key).alias("n"), F.min(key).alias("_one"))
    return counts.select(prefix, "n", F.when(F.col("n") == 1, F.col("_one")).alias(key), F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many").alias("verdict"))


def phrase_match(citations: DataFrame, phrases: DataFrame, document: str, quote: str, name: str) -> DataFrame:
    """Adds ``name``: whether a listed phrase of the same document contains the quote, or the other way round.

    ``phrases`` (``document, phrase``) is a list kept by hand; it is gathered per document and broadcast.
    """
    listed = phrases.select(F.col("document").alias(document), match_key(F.col("phrase")).alias("_p")).groupBy(document).agg(F.collect_set("_p").alias("_list"))
    joined = citations.join(F.broadcast(listed), document, "left").withColumn("_q", match_key(F.col(quote)))
    hit = F.exists(F.coalesce("_list", F.array().cast("array<string>")), lambda p: F.contains(p, F.col("_q")) | F.contains(F.col("_q"), p))
    return joined.withColumn(name, F.coalesce((F.col("_q") != "") & hit, F.lit(False))).drop("_q", "_list")


def best_overlap(left: DataFrame, right: DataFrame, on: list[str], left_set: str, right_set: str, order: str) -> DataFrame:
    """For each row of ``left`` the row of ``right`` under the same key with most members in common; the first in ``order`` on ties."""
    names = [c for c in right.columns if c not in on]
    shared = F.size(F.array_intersect(F.col(left_set), F.col(right_set)))
    joined = left.join(right, on, "left").withColumn("_n", F.when(F.col(right_set).isNull(), -1).otherwise(shared))
    keys = left.columns
    best = F.min_by(F.struct(*names, F.col("_n").alias("n_shared")), F.struct(-F.col("_n"), F.col(order)))
    return joined.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def top_coverage(wanted: DataFrame, have: DataFrame, on: list[str], key: list[str], want_set: str, have_id: str, have_set: str, order: str, k: int) -> DataFrame:
    """The ``k`` rows of ``have`` that cover most of the wanted set (a top-k report); earlier ones first on ties; an empty want scores 0.

    ``key`` names a row of ``wanted``, ``have_id`` one of ``have``. Both sets are exploded and meet in an equi-join, so only
    rows with a member in common are made. Rows without any can only fill up the ``k``; the first ``2 k`` under a key are
    enough for that, as at most ``k`` of them are already there.
    """
    sizes = wanted.select(*on, *key, F.size(F.array_distinct(F.coalesce(want_set, F.array().cast("array<string>")))).alias("_want"))
    left = wanted.select(*on, *key, F.explode(F.array_distinct(want_set)).alias("_m"))
    right = have.select(*on, have_id, order, F.explode(F.array_distinct(have_set)).alias("_m"))
    met = left.join(right, [*on, "_m"]).groupBy(*on, *key, have_id, order).agg(F.count("*").alias("_n"))
    first = have.select(*on, have_id, order).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*on).orderBy(order, have_id))).where(F.col("_r") <= 2 * k).drop("_r")
    filler = sizes.select(*on, *key).join(first, on).withColumn("_n", F.lit(0).cast("bigint"))
    scored = met.unionByName(filler).groupBy(*on, *key, have_id, order).agg(F.max("_n").alias("_n")).join(sizes, [*on, *key])
    scored = scored.withColumn("score", F.coalesce(F.try_divide(F.col("_n").cast("double"), F.col("_want").cast("double")), F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), order, have_id))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).drop("_n", "_want")


def greedy_pairs(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """One-to-one matches in order, within ``by``: first by a member in common, else the next unused one.

    ``left`` has ``left_id, left_order, left_set``, ``right`` ``right_id, right_order, right_set``. Each choice depends
    on those before it, so each group (the reservations of one report) is matched in pandas.
    """

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values(["left_order", "left_id"]), b.sort_values(["right_order", "right_id"])
        free = [(i, set(s) if s is not None else set()) for i, s in zip(b["right_id"], b["right_set"], strict=True)]
        out = []
        for _, row in a.iterrows():
            want = set(row["left_set"]) if row["left_set"] is not None else set()
            hit = next((x for x in free if x[1] & want), free[0] if free else None)
            if hit:
                free.remove(hit)
            out.append([*(row[c] for c in by), row["left_id"], hit[0] if hit else None])
        return pd.DataFrame(out, columns=[*by, "left_id", "right_id"])

    kinds = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*by, "left_id", "right_id"])
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(match, schema)


def with_flag(flags: Column, flag: str, on: Column) -> Column:
    """The flags with ``flag`` set or cleared; order kept, null counts as none."""
    have = F.coalesce(flags, F.array().cast("array<string>"))
    return F.when(on, F.array_union(have, F.array(F.lit(flag)))).otherwise(F.array_remove(have, flag))
