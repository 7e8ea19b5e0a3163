"""The pipeline's near stage against brute-force Jaccard similarity."""

import random

import pytest

import corpus_pipeline as C
from plumbline.llm import near_dedup as N


def shingle_set(text, width=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_kept(rows):
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def texts(seed):
    rng, out = random.Random(seed), []
    for _ in range(60):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(900)}"
            out.append(" ".join(copy))
    base = [f"b{i}" for i in range(150)]
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(150), 1 + 2 * (i % 2)):
            copy[k] = f"c{i}"
        out.append(" ".join(copy))
    return [*out, "", None, " \n", "One two", "one TWO", "two one"]


@pytest.mark.parametrize("cell", [256, 7])
def test_near_stage_equals_brute_force_jaccard(spark, tmp_path, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL", cell)
    rows = list(enumerate(texts(5)))
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    kept = C.near(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path))
    got, want = sorted(r.doc_id for r in kept.collect()), brute_kept(rows)
    assert got == want and len(want) < len(rows) - 80


def test_pairs_at_the_least_similarity_share_a_band():
    rng, missed = random.Random(3), 0
    for _ in range(500):
        own = [rng.getrandbits(64) for _ in range(110)]
        a, b = (N.np.unique(N.np.array(x, N.np.uint64)) for x in (own[:100], own[10:110]))
        assert N.similar(a, b, 0.8)
        missed += not set(N.bands(a).tolist()) & set(N.bands(b).tolist())
    assert missed == 0
