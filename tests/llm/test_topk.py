"""Operator 8 against brute force over rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import topk as T


def brute(rows, k, divisor):
    """(query id, rank, id, score) of every query row, with repeats."""
    own = []
    for ident, v in rows:
        if ident is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own.append((ident, [math.floor(x * 1024) for x in v]))
    out = Counter()
    for n, (q, a) in enumerate(own):
        if q % divisor == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(own) if m != n and len(b) == len(a))
            out.update((q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k]))
    return out


def search(spark, rows, k, divisor):
    df = spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(5)
    v = df.select("vec_id", T.integers(F.col("embedding")).alias("vector")).where("vec_id is not null and vector is not null")
    return Counter(tuple(r) for r in T.top_k(v, F.col("vec_id") % divisor == 0, k).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("block", [1 << 22, 800])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(T, "QUERY_BYTES", block)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(150)] + [(2000 + i, [0.0] * 6) for i in range(30)]
    rows += [(3000, [1.0, float("nan")] * 3), (3010, None), (None, [1.0] * 6), (3020, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (3030, [1.0, 2.0]), (3040, [2.0, 1.0]), (3050, []), (3060, [float("inf")] * 6), (3070, [1.0])]
    rows += [(7, rows[7][1]), (20, [9.0] * 6), (20, [9.0] * 6), (30, [-9.0] * 6), (31, [8.0] * 6), (31, [1.0] * 6), (1000, [0.5] * 6)]
    got, want = search(spark, rows, 10, 10), brute(rows, 10, 10)
    assert got == want and max(want.values()) > 1


def test_rows_of_one_id_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0])]
    assert search(spark, rows, 10, 100) == {(0, 1, 1, 1048576): 1, (0, 2, 1, 524288): 1}


def test_the_gathered_lists_see_one_slice_only(spark):
    """The best in each slice is not the best in all: both lists miss the winner, which the cutoff must let through."""
    rows = [(0, [1.0, 1.0])] + [(i, [4.0, -3.0]) for i in range(1, 20)] + [(20 + i, [-3.0, 4.0 + i]) for i in range(19)] + [(50, [3.0, 3.0]), (51, [2.5, 2.5])]
    rows += [(60 + i, [3.5 + i / 8, -9.0]) for i in range(30)] + [(100 + i, [-9.0, 3.5 + i / 8]) for i in range(30)]
    got = search(spark, rows, 3, 1000)
    assert got == brute(rows, 3, 1000) and (0, 1, 38, 1024 * 1024 * 19) in got


def test_large_components_stay_exact_and_overflow_stops():
    a, b = np.array([[2**39 + 1, 3]]), np.array([[2**19 + 1, 7]])
    assert T._product(a, b).tolist() == [[(2**39 + 1) * (2**19 + 1) + 21]]
    with pytest.raises(OverflowError):
        T._product(np.array([[2**40]]), np.array([[2**40]]))


def test_empty_table(spark):
    v = spark.createDataFrame([], "vec_id long, vector array<bigint>")
    assert T.top_k(v, F.col("vec_id") % 100 == 0).count() == 0


def test_the_query_and_its_sql(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(3)
    rows = [(int(i) % 450, [float(np.float32(x)) for x in rng.normal(size=4)], 1) for i in range(500)] + [(100, [0.0, 1.0, float("nan"), 2.0], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = T.op8_topk(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(duck.execute(T.OP8_SQL).fetchall()) == brute([r[:2] for r in rows], 10, 100)
