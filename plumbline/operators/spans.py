"""Segments, offsets and intervals: all offsets are code points from 0, ends are exclusive."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.stored import stored


def window_starts(length: Column, size: int, overlap: int) -> Column:
    """Starts of fixed windows over a text of so many characters (none for an empty one)."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a window is longer than its overlap")
    last = F.greatest(F.lit(0), F.ceil((length - size) / (size - overlap)).cast("int"))
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * (size - overlap))).otherwise(F.array().cast("array<int>"))


def fixed_windows(docs: DataFrame, key: str, text: str = "text", size: int = 20_000, overlap: int = 500, keep_empty: bool = False) -> DataFrame:
    """``key, seq, start, end, segment``. D2; with ``keep_empty`` an empty text is one empty window."""
    length = F.length(text)
    starts = window_starts(length, size, overlap)
    if keep_empty:
        starts = F.when(length == 0, F.array(F.lit(0))).otherwise(starts)
    rows = docs.select(key, text, F.posexplode(starts).alias("seq", "start"))
    end = F.least(F.col("start") + size, F.length(text))
    return rows.select(key, "seq", "start", end.alias("end"), F.substring(F.col(text), F.col("start") + 1, end - F.col("start")).alias("segment"))


def invalid_segments(segments: DataFrame, docs: DataFrame, key: str, most: int) -> DataFrame:
    """D3: segments that are out of bounds, too long, or not the text between their offsets."""
    good = (
        (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("text"))
        & (F.col("end") - F.col("start") <= most)
        & (F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")) == F.col("segment"))
    )
    return segments.join(docs.select(key, "text"), key, "left").where(~F.coalesce(good, F.lit(False))).drop("text")


def context_window(text: Column, start: Column, end: Column, limit: int) -> tuple[Column, Column, Column]:
    """Start, end and text of a window of ``limit`` characters centred on a span, kept inside the text."""
    length = F.length(text)
    spare = F.greatest(F.lit(0), F.lit(limit) - (end - start))
    low = F.greatest(F.lit(0), start - F.floor(spare / 2).cast("int"))
    high = F.least(length, low + F.greatest(F.lit(limit), end - start))
    low = F.greatest(F.lit(0), high - F.greatest(F.lit(limit), end - start))
    return low, high, F.substring(text, low + 1, high - low)


def shared_windows(spans: DataFrame, group: str, limit: int) -> DataFrame:
    """One window for all spans of a group, centred on their envelope; ``fits`` is false where the
    envelope is longer than the limit. ``spans`` has ``start``, ``end`` and ``length`` of the source."""
    of = Window.partitionBy(group)
    rows = spans.withColumn("low", F.min("start").over(of)).withColumn("high", F.max("end").over(of))
    spare = F.floor((F.lit(limit) - (F.col("high") - F.col("low"))) / 2).cast("int")
    begin = F.greatest(F.lit(0), F.least(F.col("low") - spare, F.col("length") - limit))
    return rows.withColumn("fits", F.col("high") - F.col("low") <= limit).withColumn("window_start", begin).withColumn("window_end", F.least(F.col("length"), begin + limit)).drop("low", "high")


def offsets(text: Column, quote: Column) -> Column:
    """Starts of the occurrences from left to right that do not overlap. No quote, no occurrence."""
    literal = F.concat(F.lit(r"\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pieces = F.slice(F.transform(F.split(text, literal), F.length), F.lit(1), F.size(F.split(text, literal)) - 1)
    start = F.aggregate(
        pieces, F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("at")),
        lambda acc, n: F.struct(F.concat(acc["found"], F.array(acc["at"] + n)).alias("found"), (acc["at"] + n + F.length(quote)).alias("at")),
        lambda acc: acc["found"],
    )
    return F.when((F.length(quote) > 0) & (F.instr(text, quote) > 0), start).otherwise(F.array().cast("array<int>"))


def overlapping_offsets(text: Column, quote: Column) -> Column:
    """Starts of all occurrences, overlapping ones too: the text is cut before each of them."""
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    pieces = F.transform(F.split(text, literal), F.length)
    first = F.when(F.startswith(text, quote), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    later = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.struct(F.array().cast("array<int>").alias("found"), F.lit(0).alias("at")),
        lambda acc, n: F.struct(F.concat(acc["found"], F.array(acc["at"] + n)).alias("found"), (acc["at"] + n).alias("at")),
        lambda acc: acc["found"],
    )
    return F.when((F.length(quote) > 0) & (F.instr(text, quote) > 0), F.concat(first, later)).otherwise(F.array().cast("array<int>"))


def overlapping_pairs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """intervals of a and b that share a character. Columns: ``start, end`` and ``b_start, b_end``."""
    return a.join(b, key).where((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")))


def containment(occurrences: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """F8: each occurrence (``occurrence, start, end``) and how many segments hold it whole."""
    s = segments.select(key, F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    inside = (F.col("s_start") <= F.col("start")) & (F.col("end") <= F.col("s_end"))
    return occurrences.join(s, key, "left").groupBy(key, "occurrence", "start", "end").agg(F.count_if(inside).alias("holding"))


def merge_intervals(intervals: DataFrame, key: str) -> DataFrame:
    """Union of intervals that overlap or touch, ``key, start, end``."""
    ordered = Window.partitionBy(key).orderBy("start", "end")
    before = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)
    islands = intervals.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(ordered))
    return islands.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def segment_measures(docs: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """H20 without quotes: segments, longest, coverage of all and of non-space characters, overlap."""
    solid = F.length(F.regexp_replace("piece", r"[\s\x1c-\x1f\x{85}\p{Z}]", ""))
    merged = merge_intervals(segments.select(key, "start", "end"), key).join(docs.select(key, "text"), key)
    merged = merged.withColumn("piece", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    covered = merged.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.sum(solid).alias("solid_covered"))
    counts = segments.groupBy(key).agg(
        F.count("*").alias("segments"), F.max(F.col("end") - F.col("start")).alias("longest"), F.sum(F.col("end") - F.col("start")).alias("characters")
    )
    total = docs.select(key, F.length("text").alias("length"), F.length(F.regexp_replace("text", r"[\s\x1c-\x1f\x{85}\p{Z}]", "")).alias("solid"))
    rows = total.join(counts, key, "left").join(covered, key, "left").fillna(0)
    return rows.select(
        key, "segments", (F.col("segments") > 1).alias("several"), "longest",
        F.coalesce(F.try_divide("covered", "length"), F.lit(1.0)).alias("covered_ratio"),
        F.coalesce(F.try_divide("solid_covered", "solid"), F.lit(1.0)).alias("covered_solid_ratio"),
        (F.col("characters") - F.col("covered")).alias("overlap_excess"),
    )


def quote_measures(occurrences: DataFrame, segments: DataFrame, key: str, quote: str) -> DataFrame:
    """H20 for quotes: grounded quotes, those that some segment holds whole, cut ones, repeated exposures.
    ``occurrences`` has ``key, quote, occurrence, start, end``."""
    s = segments.select(key, F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    inside = (F.col("s_start") <= F.col("start")) & (F.col("end") <= F.col("s_end"))
    held = occurrences.join(s, key, "left").groupBy(key, quote, "occurrence").agg(F.count_if(inside).alias("holding"))
    quotes = held.groupBy(key, quote).agg(F.max("holding").alias("most"), F.sum(F.greatest(F.col("holding") - 1, F.lit(0))).alias("extra"))
    return quotes.groupBy(key).agg(
        F.count("*").alias("grounded"), F.count_if(F.col("most") > 0).alias("contained"),
        F.count_if(F.col("most") == 0).alias("cut"), F.sum(F.when(F.col("most") > 0, F.col("extra")).otherwise(0)).alias("duplicate_exposures"),
    )


def pack_sentences(sentences: Column, budget: int = 500) -> Column:
    """Sentences joined up to a budget of words; a sentence over the budget stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("words"))

    def add(acc, s):
        n = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
        full = (F.size(acc["open"]) > 0) & (acc["words"] + n > budget)
        done = F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"])
        open_ = F.when(full, F.array(s)).otherwise(F.concat(acc["open"], F.array(s)))
        return F.struct(done.alias("done"), open_.alias("open"), F.when(full, n).otherwise(acc["words"] + n).alias("words"))

    return F.aggregate(sentences, start, add, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"]))


def even_chunks(text: Column, sentences: Column, budget: int = 350) -> Column:
    """As many equal runs of sentences as the text has budgets of words, and one more; a text without
    sentences is one chunk."""
    own = F.when(F.size(sentences) > 0, sentences).otherwise(F.array(text))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))

    def runs(x: Column) -> Column:
        each = F.greatest(F.floor(F.size(x["own"]) / (F.floor(x["words"] / budget) + 1)).cast("int"), F.lit(1))
        return F.transform(F.array(each), lambda n: F.transform(F.sequence(F.lit(1), F.size(x["own"]), n), lambda i: F.array_join(F.slice(x["own"], i, n), " ")))[0]

    # as a variable, the sentences are split once and not for each chunk again
    return F.transform(F.array(F.struct(own.alias("own"), words.alias("words"))), runs)[0]


def segments_with(docs: DataFrame, key: str, segment: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """L7, extension point: ``key, seq, start, end, segment`` by a segmenter of one's own, which gives (start, end) pairs for a text."""

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "end": b} for a, b in segment(t or "")] for t in texts])

    rows = docs.select(key, "text", F.posexplode(run("text")).alias("seq", "s"))
    return rows.select(key, "seq", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("segment"))


_MEASURES = "segments long, longest int, covered long, solid_covered long, characters long, grounded long, contained long, cut long, duplicate_exposures long"
_SOLID = np.array([not chr(p).isspace() for p in range(0x3002)])


def occurrences(text: str, quote: str) -> list[int]:
    """Starts of all occurrences, overlapping ones too; none of an empty quote."""
    found, at = [], text.find(quote) if quote else -1
    while at >= 0:
        found.append(at)
        at = text.find(quote, at + 1)
    return found


def measured(segments: list[tuple[int, int]], solid: np.ndarray, spots: list[tuple[int, np.ndarray]], most: int) -> tuple | None:
    """H20 for one text: the fields of ``_MEASURES``, nothing where the segments do not hold. ``solid`` has the number of non-space characters before
    each offset, ``spots`` the length and the starts of each grounded quote. Sorted once, the segments are walked in time linear in the text."""
    if not segments:
        return (0, 0, 0, 0, 0, len(spots), 0, len(spots), 0) if len(solid) == 1 else None
    start, end = np.array(sorted(segments), np.int64).T
    if start[0] < 0 or (start >= end).any() or end.max() >= len(solid) or (end - start).max() > most:
        return None
    fresh = np.minimum(np.maximum(start, np.concatenate(([0], np.maximum.accumulate(end)[:-1]))), end)
    contained = extra = 0
    for n, at in spots:
        fits = end - start >= n
        holding = np.searchsorted(start[fits], at, "right") - np.searchsorted(np.sort(end[fits]) - n, at, "left")
        if holding.max() > 0:
            contained, extra = contained + 1, extra + int(np.maximum(holding - 1, 0).sum())
    sums = (len(start), (end - start).max(), (end - fresh).sum(), (solid[end] - solid[fresh]).sum(), (end - start).sum())
    return (*map(int, sums), len(spots), contained, len(spots) - contained, extra)


def compare_segmenters(docs: DataFrame, quotes: DataFrame, key: str, size: int, overlap: int, segment: Callable[[str], list[tuple[int, int]]]) -> DataFrame:
    """The measures (H20) of each document under fixed windows (``baseline``) and under another segmenter (``candidate``), over the same
    documents and quotes (``key, quote``). Segments that do not hold, and a text without any, are an error.

    A document's text meets its quotes in one row, is read once for both segmenters, and leaves numbers only: no segment is a row of its own. ``docs`` has
    one row for each key."""

    def run(text: str | None, starts: list[int], quotes: list[str] | None) -> tuple:
        text = text or ""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        solid = np.concatenate(([0], np.cumsum(_SOLID[np.minimum(points, 0x3001)])))
        spots = [(len(q), np.array(at)) for q in quotes or [] if (at := occurrences(text, q))]
        windows = [(a, min(a + size, len(text))) for a in starts]
        return len(text), int(solid[-1]), measured(windows, solid, spots, size), measured(list(segment(text)), solid, spots, size)

    held = quotes.groupBy(key).agg(F.collect_set("quote").alias("quotes"))
    measure = F.udf(run, f"length long, solid long, baseline struct<{_MEASURES}>, candidate struct<{_MEASURES}>", useArrow=False)
    starts = window_starts(F.length("text"), size, overlap)
    rows = docs.select(key, "text").join(held, key, "left").select(key, measure("text", starts, "quotes").alias("x"))
    rows = stored(rows.select(key, "x.*"))
    for name in ("baseline", "candidate"):
        if not rows.where(F.col(name).isNull()).isEmpty():
            raise ValueError(f"the {name} segments do not hold")
    both = F.explode(F.array(*(F.struct(F.lit(name).alias("segmenter"), F.col(name).alias("m")) for name in ("baseline", "candidate"))))
    return rows.select(key, "length", "solid", both.alias("s")).select(key, "length", "solid", "s.segmenter", "s.m.*").select(
        key, "segments", (F.col("segments") > 1).alias("several"), "longest",
        F.coalesce(F.try_divide("covered", "length"), F.lit(1.0)).alias("covered_ratio"),
        F.coalesce(F.try_divide("solid_covered", "solid"), F.lit(1.0)).alias("covered_solid_ratio"),
        (F.col("characters") - F.col("covered")).alias("overlap_excess"),
        "grounded", "contained", "cut", "duplicate_exposures", "segmenter",
    )


def comparison_summary(rows: DataFrame) -> DataFrame:
    """One row for each segmenter."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("segments", "grounded", "contained", "cut", "duplicate_exposures")]
    return rows.groupBy("segmenter").agg(F.count_if("several").alias("several"), F.min("covered_solid_ratio").alias("least_solid_ratio"), *sums)
