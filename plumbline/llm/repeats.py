"""Periodic runs of words in whole texts (operator 11).

A run is a stretch of consecutive words with smallest period q, words q apart being identical, of at least
``max(LEAST, 2 * q)`` words, that neither neighbour extends. A run of length L matches itself at lag q in L - q
neighbouring places, so a lag is looked at only if it has ``max(LEAST - q, q)`` matches.

Matches of all lags are counted at once: words that occur more than about sqrt(n) times by the exact autocorrelation of
their places (one Fourier transform for each, the power spectra added, one transform back), all other words by the
differences of the pairs of their places. Both are n sqrt(n) steps at most, up to a logarithm.

A lag with enough matches is scanned for islands, stretches of matches. A lag q > 64 is probed first at
q / 16 apart: an island of q places holds 16 probes in a row, so what is not probed 16 times in a row is not
looked at. A run with period q also matches at each multiple m of q. Where a pair of words m apart lies inside a known run, the
stretch of period m around it is that run (its first m + 1 words have period q, and q divides m), so its matches
are taken off the count of each multiple: a text that is one word over and over is scanned once. Lags go upwards,
so the first period under which a stretch is found is its smallest.

A word is dropped if a run contains it after the run's first q words. Each row is worked on in its own task, with memory
for one text; nothing is shuffled.

Defined results: a null, empty or blank text has no words, no runs, and an empty text is left of it; equal rows each give a
row; a null doc_id stays null; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import prepare, table

LEAST = 12
#: A lag up to this is scanned in all places.
PROBED = 64
_PROBES = 16


def lag_matches(ids: np.ndarray) -> np.ndarray:
    """How many places i have ``ids[i] == ids[i + lag]``, for each lag from 0 to half the length (0 stays 0)."""
    n, half = len(ids), len(ids) // 2
    matches = np.zeros(half + 1, np.int64)
    times = np.bincount(ids)
    bound = max(_PROBES, int(n**0.5))
    frequent = np.flatnonzero(times > bound)
    if len(frequent):
        size = 1 << int(n + half).bit_length()  # no lag up to half wraps around
        power = np.zeros(size // 2 + 1)
        for word in frequent:
            spectrum = np.fft.rfft(ids == word, size)
            power += spectrum.real**2 + spectrum.imag**2
        matches += np.rint(np.fft.irfft(power, size)[: half + 1]).astype(np.int64)
    places = np.argsort(ids, kind="stable")
    places = places[times[ids[places]] <= bound]
    words = ids[places]
    for k in range(1, bound):
        same = words[k:] == words[:-k]
        if not same.any():
            break
        lags = (places[k:] - places[:-k])[same]
        matches += np.bincount(lags[lags <= half], minlength=half + 1)
    matches[0] = 0
    return matches


def stretches(flags: np.ndarray, least: int) -> np.ndarray:
    """(start, stop) of each stretch of at least ``least`` true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).reshape(-1, 2)
    return edges[edges[:, 1] - edges[:, 0] >= least]


def islands(ids: np.ndarray, lag: int, least: int, known: list[tuple[int, int, int]]):
    """(start, stop) of the islands of at least ``least`` matches at a lag, but for ``known`` runs of which it is a multiple."""
    end = len(ids) - lag
    if least <= PROBED:
        yield from stretches(ids[:end] == ids[lag:], least).tolist()
        return
    step = least // _PROBES
    probes = ids[:end:step] == ids[lag::step]
    for first, stop in stretches(probes, least // step).tolist():
        low, high = max(0, (first - 1) * step + 1), min(end, stop * step)
        if any(lag % q == 0 and s <= first * step and (stop - 1) * step + lag < s + length for s, length, q in known):
            continue
        for a, b in stretches(ids[low:high] == ids[low + lag : high + lag], least).tolist():
            yield low + a, low + b


def runs(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period."""
    if len(ids) < max(least, 2):
        return []
    matches = lag_matches(ids)
    needed = np.arange(len(matches))
    needed = np.maximum(least - needed, needed)
    found: dict[tuple[int, int], int] = {}
    long: list[tuple[int, int, int]] = []
    for q in (np.flatnonzero(matches[1:] >= needed[1:]) + 1).tolist():
        if matches[q] < needed[q]:  # what is left of it belongs to known runs
            continue
        for start, stop in islands(ids, q, int(needed[q]), long):
            length = stop - start + q
            if (start, length) in found:
                continue
            found[start, length] = q
            multiples = np.arange(2 * q, min(length, len(matches)), q)
            matches[multiples] -= length - multiples
            if length > PROBED:
                long.append((start, length, q))
    return sorted((start, length, q) for (start, length), q in found.items())


def left(count: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """The numbers of the words that stay."""
    change = np.zeros(count + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:-1]) == 0)


def plain_words(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in UTF-8."""
    return (text or "").encode().split()


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_BATCH_CHARS = 1 << 22


def _detect(words_of: Callable, least: int):
    def run(batches):
        rows, held = [], 0

        def take():
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(doc_id, text)
                number: dict[bytes, int] = {}
                ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                found = runs(ids, least)
                if found:
                    words = [words[i] for i in left(len(ids), found)]
                whole = b" ".join(words).decode()
                rows.append((doc_id, len(ids), [{"start": s, "length": n, "period": q} for s, n, q in found], whole))
                held += len(whole)
                if held >= _BATCH_CHARS or len(rows) >= 5000:
                    yield take()
                    rows, held = [], 0
        if rows:
            yield take()

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST, words_of: Callable = plain_words) -> DataFrame:
    """``doc_id, n_words, runs(start, length, period), collapsed`` for each row of ``docs(doc_id, text)``: all runs
    by start, then period, and the words that stay, joined by spaces. ``words_of(doc_id, text)`` gives a text's words in UTF-8."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(_detect(words_of, least), schema)


def planted_words(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of the contract: a tenth of the documents, by the crc32 of their ids, repeat a stretch of their words to the end."""
    words = plain_words(doc_id, text)
    g, rest = divmod(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), 10)
    if rest or not words:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), words_of=planted_words)
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    order = lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    best = found.withColumn("best", F.array_max(F.transform("runs", order)))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"), F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
