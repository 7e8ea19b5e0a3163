"""Substring deduplication by sliding sentence spans (operator 1).

Sentences end at ``. ! ?`` before white space, or at a line end. A sentence of more than ``LONG`` words
counts in pieces: a piece begins where the hash of two neighbouring words is the least within ``REACH`` words,
which copies of a passage agree on wherever it stands. A span is ``SENTENCES`` consecutive
sentences (or pieces). Every span of every text is hashed (128 bits), however short, and the hashes are
joined globally. The first occurrence of a span (smallest doc_id, then the earliest row and sentence) stays; the
sentences that any other occurrence covers are removed.

A repeated run of any length of ``SENTENCES`` sentences or more is a chain of repeated spans, so these spans cover all of it, both ends included. All that they
cover is removed. The option ``least_words`` leaves stretches of fewer words; the query sets it to ``WORDS``.

Hashes are counted first, with map-side sums, so a passage that a third of the documents share is one row a task. Only the
places of hashes that occur again are looked at further: the join with those hashes has a written table on its small side and its other
side is split by adaptive execution, and a hash's first place is a map-side minimum. Words are hashed one by one in C, all the rest is arithmetic on whole
Arrow batches, so the spans are made anew for the join, which costs less than to store them.

Defined results: null and blank texts have no spans and are returned as they are; a text with fewer
sentences than a span has no spans; repeated rows are occurrences of one document and
number (row) breaks the tie, so one row keeps its text; an empty table gives no rows; a null doc_id
sorts last; other columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, done, prepare, table

SENTENCES = 2
LONG = 20
#: What the query leaves: stretches of fewer words, lines that many clean documents have in common.
WORDS = 15
REACH = 3
#: Bytes that are looked at at once; cut at line ends, where sentences end anyway.
BLOCK = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True
_TOP = ~np.uint64(0)
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class Units(NamedTuple):
    """The sentences (or pieces) of some texts: bytes from and up to in the joined texts, words, row, two hashes."""

    start: np.ndarray
    stop: np.ndarray
    words: np.ndarray
    row: np.ndarray
    one: np.ndarray
    two: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _cuts(words: np.ndarray, sentence: np.ndarray, long: int) -> np.ndarray:
    """After which word a long sentence is cut: where the pair with the next word has the least hash around."""
    same = (np.bincount(sentence)[sentence] > long)[:-1] & (sentence[1:] == sentence[:-1])
    at = np.flatnonzero(same)
    pair = _mixed((words[at] * _BASES[0]) ^ words[at + 1])
    place = np.full(len(same) + 2 * REACH, _TOP, np.uint64)  # pairs of other sentences never have the least hash
    place[at + REACH] = pair
    owner = np.full(len(place), -1, np.int64)
    owner[at + REACH] = sentence[at]
    least = np.ones(len(at), bool)
    for d in range(1, REACH + 1):
        before, after = at + REACH - d, at + REACH + d
        least &= pair < np.where(owner[before] == sentence[at], place[before], _TOP)
        least &= pair <= np.where(owner[after] == sentence[at], place[after], _TOP)
    return at[least]


def _units_of(joined: bytes, offset: int, long: int | None) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(joined, np.uint8)
    edge = np.diff((~_SPACE[data]).view(np.int8), prepend=0, append=0)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    words = np.fromiter(map(xxhash.xxh64_intdigest, joined.split()), np.uint64, len(starts))
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    ends = _END[data[stops - 1]]
    ends[:-1] |= line[1:] != line[:-1]
    ends[-1] = True
    if long is not None:
        ends[_cuts(words, np.cumsum(ends) - ends, long)] = True
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    count = last - first + 1
    place = np.arange(len(words)) - np.repeat(first, count)
    one, two = (np.add.reduceat(h * _powers(b, int(count.max()))[place], first) for h, b in zip((words, _mixed(words)), _BASES, strict=True))
    return starts[first] + offset, stops[last] + offset, count, _mixed(one + count.astype(np.uint64)), _mixed(two ^ count.astype(np.uint64))


def units(texts: list[bytes], long: int | None = LONG) -> Units:
    """The sentences of the texts in order; offsets are those in the texts joined by line ends."""
    joined, parts, at = b"\n".join(texts), [], 0
    while at < len(joined):
        stop = joined.find(b"\n", at + BLOCK) + 1 or len(joined)
        parts.append(_units_of(joined[at:stop], at, long))
        at = stop
    start, stop, words, one, two = map(np.concatenate, zip(*parts, strict=True)) if parts else _units_of(b"", 0, long)
    rows = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Units(start, stop, words, np.searchsorted(rows, start, "right") - 1, one, two)


def spans(own: Units, sentences: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first sentence in the row, hash, hash) of each run of so many sentences."""
    count = max(0, len(own.row) - sentences + 1)
    whole = np.flatnonzero(own.row[sentences - 1 :][:count] == own.row[:count])
    hashes = []
    for h, base in zip((own.one, own.two), _BASES, strict=True):
        power = _powers(base, sentences + 1)
        hashes.append(_mixed(sum((h[whole + j] * power[j + 1] for j in range(sentences)), np.zeros(len(whole), np.uint64))))
    return own.row[whole], whole - np.searchsorted(own.row, own.row[whole]), *hashes


_SPANS = "row long, doc_id long, first int, hi long, lo long"


def _spans(sentences: int, long: int | None):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            row, first, hi, lo = spans(units([t or b"" for t in texts], long), sentences)
            row = pa.array(row)
            yield pa.record_batch(
                [batch.column("row").take(row), batch.column("doc_id").take(row), pa.array(first.astype(np.int32)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))],
                names=["row", "doc_id", "first", "hi", "lo"],
            )

    return run


def stretches(first: np.ndarray, words: np.ndarray, sentences: int, least_words: int) -> list[tuple[int, int]]:
    """(first, last) of the covered stretches of a text that have enough words. ``first``: where repeated spans begin;
    ``words`` of each sentence."""
    covered = np.zeros(len(words) + 1, np.int8)
    for j in range(sentences):
        covered[first + j] = 1
    edge = np.diff(covered, prepend=0)
    total = np.concatenate([[0], np.cumsum(words)])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(a, b - 1) for a, b in zip(begin.tolist(), end.tolist(), strict=True) if total[b] - total[a] >= least_words]


def without(text: bytes, start: np.ndarray, gone: list[tuple[int, int]]) -> tuple[bytes, list[dict]]:
    """The text without the stretches (the white space after them goes too), and their code points. ``start``: the byte
    where each sentence begins."""
    edges, kept, at = [*start.tolist(), len(text)], [], 0
    points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    spots = []
    for first, last in gone:
        a, b = edges[first], edges[last + 1]
        kept.append(text[at:a])
        spots.append({"start": int(points[a]), "stop": int(points[b])})
        at = b
    left = b"".join([*kept, text[at:]])
    return (left.rstrip() if gone and gone[-1][1] == len(start) - 1 else left), spots


_KIND = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _removed(sentences: int, least_words: int, long: int | None):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            firsts = batch.column("firsts").to_pylist()
            counts, spots = [0] * len(texts), [[] for _ in texts]
            rows = [i for i, f in enumerate(firsts) if f]
            own = units([texts[i] for i in rows], long)
            bounds, base = np.searchsorted(own.row, np.arange(len(rows) + 1)), 0
            for n, i in enumerate(rows):
                part = slice(bounds[n], bounds[n + 1])
                gone = stretches(np.array(firsts[i]), own.words[part], sentences, least_words)
                counts[i] = sum(b - a + 1 for a, b in gone)
                begins, base = own.start[part] - base, base + len(texts[i]) + 1
                if gone:
                    texts[i], spots[i] = without(texts[i], begins, gone)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int32()), pa.array(spots, _KIND)],
                names=["doc_id", "text", "removed", "removed_spans"],
            )

    return run


def substring_dedup(docs: DataFrame, sentences: int = SENTENCES, least_words: int = 0, long: int | None = LONG) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``, a stored table: ``doc_id, text`` (without
    what was removed), ``removed`` (how many sentences or pieces), ``removed_spans`` (code points
    of the original text, from and up to). A span has ``sentences`` sentences; sentences of more than ``long`` words
    count in pieces (None: whole); a stretch that is removed has ``least_words`` words or more (by default any)."""
    prepare(docs.sparkSession)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_spans(sentences, long), _SPANS)
    repeated = cut(found.groupBy("hi", "lo").agg(F.count("*").alias("times")).where("times > 1").select("hi", "lo"))
    again = cut(found.join(repeated, ["hi", "lo"]))
    done(repeated)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "first")
    origins = again.groupBy("hi", "lo").agg(F.min(place).alias("origin"))
    stays = F.lit(True).alias("stays")
    places = again.select("row", "first", (~stays).alias("stays")).union(origins.select("origin.row", "origin.first", stays))
    held = places.groupBy("row").agg(F.collect_list("first").alias("all"), F.collect_list(F.when(F.col("stays"), F.col("first"))).alias("stay"))  # bounded by the row's text
    covered = cut(held.select("row", F.array_except("all", "stay").alias("firsts")).where(F.size("firsts") > 0))
    done(again)
    schema = "doc_id long, text string, removed int, removed_spans array<struct<start:int,stop:int>>"
    return texts.join(covered, "row", "left").select("doc_id", "text", "firsts").mapInArrow(_removed(sentences, least_words, long), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), least_words=WORDS)
