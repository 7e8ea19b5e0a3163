"""Operator 11 against brute force over all lags and places."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import queries
from plumbline.llm import repeats as R


def brute(words, least=R.LEAST):
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q) and not any((i, length, p) in found for p in range(1, q)):
                found.add((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def ids(words):
    number = {}
    return np.array([number.setdefault(w, len(number)) for w in words], np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(2, 14))
def test_runs_equal_brute_force(words, least):
    assert R.runs(ids(words), least) == brute(words, least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), min_size=1, max_size=90), st.integers(1, 5)), min_size=1, max_size=5))
def test_long_periods_equal_brute_force(parts):
    words = [w for part, times in parts for w in part * times]
    assert R.runs(ids(words)) == brute(words)


@pytest.mark.parametrize("n", [0, 1, 5, 64, 700, 3000])
@pytest.mark.parametrize("kinds", [1, 2, 40, 5000])
def test_lag_matches_are_exact(n, kinds):
    x = np.random.default_rng(n + kinds).zipf(1.3, n) % kinds if n else np.zeros(0, np.int64)
    assert R.lag_matches(x).tolist() == [0] * min(1, n // 2 + 1) + [int((x[q:] == x[:-q]).sum()) for q in range(1, n // 2 + 1)]


def test_long_texts_take_no_time():
    rng = np.random.default_rng(1)
    assert R.runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    noise = rng.integers(0, 2, 60_000)
    block = rng.integers(0, 1000, 9_000)
    found = R.runs(np.concatenate([noise, np.tile(block, 3), np.full(20_000, 7)]))
    assert (60_000, 27_000, 9_000) in found or any(s <= 60_000 and q == 9_000 and s + n >= 87_000 for s, n, q in found)
    assert any(q == 1 and n >= 20_000 for _, n, q in found)


TEXTS = [None, "", " \t\n", "a", "a b " * 5, "a b " * 6, "x " + "a b " * 6 + "y", "one two three four five six seven eight nine ten eleven twelve " * 2, "a " * 12 + "b " * 13, "é ü " * 20, "A a " * 8, "w" * 5000, ("p q r\n" * 9 + "z ") * 4]


def expected(doc_id, text):
    words = [w for w in (text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    stay = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(stay))


def test_op11(spark, tmp_path):
    sometimes = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rng = np.random.default_rng(5)
    drawn = [" ".join(map(str, rng.integers(0, 60, rng.integers(1, 300)))) for _ in sometimes]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + list(zip(sometimes, drawn, strict=True)) + [(None, "a b " * 9), (4, "a b " * 5), (4, "a b " * 5)]
    spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, runs int, n_runs string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_an_empty_table_gives_no_rows(spark):
    assert R.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
