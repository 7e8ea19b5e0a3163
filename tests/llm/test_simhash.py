"""Operator 2 against brute force."""

import numpy as np
import pytest
import xxhash

from plumbline.llm import simhash as S


def brute_print(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, distance):
    root = list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= distance) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


@pytest.mark.parametrize("text", ["", " \n", "One", "a B c", "a b c d", "x y z w v u t " * 9, "É straße A b c\x0bd e f g h"])
def test_fingerprint_equals_the_definition(text):
    assert S.fingerprint(text.encode()) == brute_print(text)


def test_fingerprint_of_a_long_text_uses_all_of_it():
    words = [f"w{i * i % 39_989}" for i in range(40_000)]
    assert S.fingerprint(" ".join(words).encode()) == brute_print(" ".join(words))
    assert S.fingerprint(" ".join(words).encode()) != S.fingerprint(" ".join(words[:20_000]).encode())


@pytest.mark.parametrize("distance", [0, 2, 4, 7])
def test_segments_meet_the_pigeonhole_bound(distance):
    parts = S.segments(distance)
    assert sum(r + 1 for _, _, r in parts) == distance + 1
    assert sum(size for _, size, _ in parts) == 64


@pytest.mark.parametrize("distance", [1, 4, 6])
def test_pairs_meet_in_a_leaf(distance, monkeypatch):
    monkeypatch.setattr(S, "LEAF_TARGET", 16)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    other = base.copy()
    for i in range(len(other)):
        for b in rng.choice(64, distance, replace=False):
            other[i] ^= np.uint64(1 << int(b))
    points = np.concatenate([base, other])
    forest = S.Forest(rng.choice(points, 2000), len(points), distance)
    assert forest.depth >= 8
    rows, leaves = forest.route(points)
    met = {(r, leaf) for r, leaf in zip(rows.tolist(), leaves.tolist())}
    at = {}
    for r, leaf in met:
        at.setdefault(r, set()).add(leaf)
    assert all(at[i] & at[i + 3000] for i in range(3000))


def near_texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    while len(out) < n:
        text = list(rng.choice(words, int(rng.integers(30, 200))))
        for _ in range(int(rng.integers(1, 6))):
            copy = list(text)
            copy[int(rng.integers(0, len(copy)))] = "changed"
            out.append(" ".join(copy))
    return out[:n]


@pytest.mark.parametrize(("target", "cap"), [(256, 1024), (8, 6)])
def test_components_equal_brute_force(spark, monkeypatch, target, cap):
    monkeypatch.setattr(S, "LEAF_TARGET", target)
    monkeypatch.setattr(S, "LEAF_CAP", cap)
    texts = near_texts(400, 3) + ["", None, "  ", "same words here"] + ["same words here"] * 40
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, fp string, root int")
    got = {r.doc_id: (r.fp, r.component_id) for r in S.near_dedup(docs).collect()}
    prints = np.array([brute_print(t or "") for t in texts], np.uint64)
    assert {d: np.uint64(f & (2**64 - 1)) for d, (f, _) in got.items()} == dict(enumerate(prints))
    assert [got[i][1] for i in range(len(texts))] == brute_components(prints, 4)
    assert len(set(c for _, c in got.values())) < len(texts) - 100
    kept = sorted(r.doc_id for r in S.near_dedup(docs).where("kept").collect())
    assert kept == sorted({c for _, c in got.values()})


def test_the_query_returns_its_columns(spark, tmp_path):
    texts = near_texts(60, 8) + ["", None, "One two three four five"]
    spark.createDataFrame([(3 * i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op2_simhash(spark, str(tmp_path))
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    prints = [brute_print(t or "") for t in texts]
    roots = brute_components(np.array(prints, np.uint64), 4)
    assert sorted(tuple(r)[:3] for r in got.collect()) == sorted((3 * i, f"{p:016x}", 3 * roots[i]) for i, p in enumerate(prints))


def test_deep_trees_are_fitted_on_more_points(monkeypatch):
    monkeypatch.setattr(S, "LEAF_TARGET", 4)
    assert S.depth_for(4) == 0 and S.depth_for(5) == 1 and S.depth_for(1 << 60) == S.MAX_DEPTH
    assert S.LEAF_SAMPLE << S.MAX_DEPTH <= 1 << 21


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_dedup(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id or -1 for r in S.near_dedup(docs).where("kept").collect()) == [-1, 3]
    assert sorted(r.doc_id or -1 for r in S.keep_near(docs).collect()) == [-1, 3]
    twice = spark.createDataFrame([(5, "x y z"), (5, "x y z"), (None, "x y z"), (6, "q r")], "doc_id long, text string")
    assert sorted(r.doc_id for r in S.near_dedup(twice).where("kept").collect()) == [5, 6]
    assert sorted(r.doc_id for r in S.keep_near(twice).collect()) == [5, 6]
    assert S.keep_near(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in S.near_dedup(docs).collect()) == [(-1, -1), (-1, -1), (3, 3)]
