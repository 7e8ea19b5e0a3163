"""Operator 10 against a plain computation of the same rule."""

import hashlib
import math
from collections import Counter

import pytest

from plumbline.llm import mixing as M


def uniform(seed, doc_id):
    return int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52


def quantile(rate, u):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def frame(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 4}", i) for i in range(2000)] + [(None, None, None, 1), (5, "t5", "hot", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n int"), rows


@pytest.mark.parametrize("weights", [None, {"hot": 1, "s0": 3, "s3": 0}, {}])
def test_copies_equal_the_inverse_of_the_distribution(spark, weights):
    docs, rows = frame(spark)
    sizes = Counter(r[2] for r in rows)
    w = {s: 1.0 if weights is None else float(weights.get(s, 0)) for s in sizes}
    total = sum(w.values())
    want = Counter()
    for doc_id, _, source, _ in rows:
        if w[source]:
            want[(doc_id, source)] += quantile(w[source] / total * len(rows) / sizes[source], uniform(M.SEED, doc_id))
    got = M.mix(docs, weights).collect()
    assert Counter((r.doc_id, r.source) for r in got) == +want
    if weights is None:
        shares = Counter(r.source for r in got)
        assert abs(shares["hot"] / len(got) - 1 / len(sizes)) < 0.05


def test_the_order_is_global(spark):
    docs, _ = frame(spark)
    keys = [r.shuffle_key for r in M.mix(docs, partitions=7).collect()]
    assert keys == sorted(keys) and len(keys) > 1000


def test_empty_clash_and_rates(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(empty).count() == 0
    docs, _ = frame(spark)
    mixed = M.mix(docs.selectExpr("*", "7 AS copy", "'x' AS shuffle_key"))
    assert mixed.columns == [*docs.columns, "copy", "shuffle_key", "copy_", "shuffle_key_"]
    assert {r[0] for r in mixed.select("copy").distinct().collect()} == {7} and mixed.count() == M.mix(docs).count()


def draws(rate, doc_id):
    n = 1 if rate <= 700 else math.ceil(rate / 500)
    names = ["" if doc_id is None else str(doc_id)] if n == 1 else [f"{'' if doc_id is None else doc_id}:draw:{k}" for k in range(1, n + 1)]
    return sum(quantile(rate / n, uniform(M.SEED, name)) for name in names)


@pytest.mark.parametrize("spread", [4096, 64])
def test_rates_of_any_size(spark, monkeypatch, spread):
    monkeypatch.setattr(M, "SPREAD", spread)
    weights = {"rare": 0.001, "one": 1.0, "often": 501.0, "most": 20_000.0}
    rows = [(k, s) for k, s in enumerate(weights)] + [(10 + i, "x") for i in range(99_996)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    # one row each: a source's rate is its share of the output's rows
    total = sum(weights.values())
    got = {r.source: (r.n, r.copies, r.last) for r in M.mix(docs, weights, epochs=total / 100_000).groupBy("source").agg(M.F.count("*").alias("n"), M.F.count_distinct("copy").alias("copies"), M.F.max("copy").alias("last")).collect()}
    want = {s: draws(w, k) for k, (s, w) in enumerate(weights.items())}
    assert got == {s: (n, n, n) for s, n in want.items() if n} and abs(want["most"] - 20_000) < 600


@pytest.mark.parametrize("limit", [10_000, 2])
def test_sources_that_the_weights_leave_out(spark, monkeypatch, limit):
    monkeypatch.setattr(M, "MAX_BROADCAST", limit)
    docs, rows = frame(spark)
    sizes = Counter(r[2] for r in rows)
    w = {s: {"hot": 0.5, "s0": 0.0}.get(s, 2.0) for s in sizes}
    want = Counter()
    for doc_id, _, source, _ in rows:
        if w[source]:
            want[(doc_id, source)] += draws(w[source] / sum(w.values()) * len(rows) / sizes[source], doc_id)
    got = Counter((r.doc_id, r.source) for r in M.mix(docs, {"hot": 0.5, "s0": 0.0}, other=2.0).collect())
    assert got == +want


def test_the_query_equals_its_sql_and_meets_the_weights(spark, tmp_path):
    import duckdb

    rows = [(i, f"t{i}", "src0" if i % 3 else f"src{i % 9}") for i in range(3000)] + [(-1, "rare", "src4"), (None, "null", None), (7, "t7", "src0")]
    rows += [(5000, "alone", "src77")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op10_mixing(spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = [d[0] for d in duck.execute(M.OP10_SQL).description]
    assert names == got.columns
    found = got.collect()
    assert Counter(map(tuple, found)) == Counter(duck.execute(M.OP10_SQL).fetchall())
    shares, weight = Counter(r.source for r in found), lambda s: M.WEIGHTS.get(s, M.OTHER)
    total = sum(weight(s) for s in {r[2] for r in rows})
    assert all(abs(shares[s] / len(found) - weight(s) / total) < 0.06 for s in {r[2] for r in rows})


def test_a_source_of_one_row_in_a_large_table(spark):
    small = [(None, None), (-1, "a"), (-2, "b"), (-3, "b")]
    docs = spark.range(12_000).selectExpr("id AS doc_id", "'x' AS source").union(spark.createDataFrame(small, "doc_id long, source string"))
    got = Counter((r.doc_id, r.source) for r in M.mix(docs).collect() if r.source != "x")
    sizes = Counter(s for _, s in small)
    want = {row: draws(12_004 / 4 / sizes[row[1]], row[0]) for row in small}
    assert got == want and abs(sum(want.values()) - 9_003) < 400


def test_summed_draws_have_the_mean_and_the_deviation(spark):
    docs = spark.createDataFrame([(i, f"s{i}") for i in range(100)], "doc_id long, source string")
    copies = list(Counter(r.doc_id for r in M.mix(docs.union(spark.range(100, 200_000).selectExpr("id", "'x'"))).where("source <> 'x'").select("doc_id").collect()).values())
    rate, mean = 200_000 / 101, sum(copies) / 100
    deviation = math.sqrt(sum((c - mean) ** 2 for c in copies) / 99)
    assert abs(mean - rate) < 4 * math.sqrt(rate / 100) and 0.7 < deviation / math.sqrt(rate) < 1.3
