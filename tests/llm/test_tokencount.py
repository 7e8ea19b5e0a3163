"""Operator 9 against a plain scan of the same files."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import tokencount as C
from plumbline.llm.tokens import TOKENIZER


def brute(ids, end):
    out, n = [], 0
    for x in ids:
        if x == end:
            out.append((n, True))
            n = 0
        else:
            n += 1
    return out + [(n, False)] * (n > 0)


@pytest.mark.parametrize("ranges", [True, False])
@pytest.mark.parametrize(("dtype", "block"), [("<u2", 8), (">u4", 16), ("<u4", 1 << 20)])
def test_flat_files(spark, tmp_path, monkeypatch, dtype, block, ranges):
    monkeypatch.setattr(C, "in_ranges", lambda _: ranges)
    monkeypatch.setattr(C, "RANGE", 64)
    rng, files = random.Random(2), {}
    for k, size in enumerate([0, 1, 7, 400, 900]):
        ids = [rng.choice([9, 1, 2, 3, 4, 0x909]) for _ in range(size)]
        if k == 4:
            ids[100:600] = [5] * 500
        files[f"f{k}"] = ids
        (tmp_path / f"f{k}").write_bytes(np.array(ids, dtype).tobytes())
    got = {}
    for r in C.token_counts(spark, str(tmp_path), dtype, 9, block).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.ordinal, r.tokens, r.ended))
    want = {f: [(i, n, e) for i, (n, e) in enumerate(brute(ids, 9))] for f, ids in files.items()}
    assert {f: sorted(x) for f, x in got.items()} == {f: x for f, x in want.items() if x}


def test_documents(spark, tmp_path):
    texts = ["one two", None, "", "three " * 4000, "Ünïcode 日本", "hot", "hot"] * 3
    rows = [(i, t, "path", 1) for i, t in enumerate(texts)] + [(None, "x", "path", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, path string, tokens int").repartition(3).write.parquet(str(tmp_path / "d"))
    exact = Tokenizer.from_file(TOKENIZER)
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens) for r in C.count_documents(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert got == sorted(((-1 if i is None else i), len(exact.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)


def test_documents_where_a_session_rolls_files(spark, tmp_path):
    spark.createDataFrame([(i, "word " * i, "x") for i in range(10)], "doc_id long, text string, tokens string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 3)
    try:
        got = {r.doc_id: r.n_tokens for r in C.op9_tokencount(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    exact = Tokenizer.from_file(TOKENIZER)
    assert got == {i: len(exact.encode("word " * i, add_special_tokens=False).ids) for i in range(10)}


def test_a_lost_document_stops_the_query(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "a b c") for i in range(8)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    write = C.write_token_files
    monkeypatch.setattr(C, "write_token_files", lambda docs, *a: write(docs.where("doc_id < 5"), *a))
    with pytest.raises(Exception, match="lack a document"):
        C.op9_tokencount(spark, str(tmp_path)).collect()


def test_errors_and_empty(spark, tmp_path):
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole number of tokens"):
        C.token_counts(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError):
        C.token_counts(spark, str(tmp_path), "<u4", 1, 6)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "e"))
    assert C.count_documents(spark.read.parquet(str(tmp_path / "e"))).count() == 0


def test_no_task_sees_all_blocks_of_a_file(spark):
    """A file of 100,000 blocks: its sums are added up by groups, and equal a plain scan."""
    rng = np.random.default_rng(4)
    n = 100_000
    ends = np.where(rng.random(n) < 0.2, rng.integers(1, 4, n), 0)
    head, tail = rng.integers(0, 50, n), rng.integers(0, 50, n)
    tokens = np.where(ends > 0, head + tail + 10 * (ends - 1), head)
    tail, head = np.where(ends > 0, tail, tokens), np.where(ends > 0, head, tokens)
    df = spark.createDataFrame(pd.DataFrame({"path": "f", "block": np.arange(n), "tokens": tokens, "ends": ends, "head": head, "tail": tail}))
    got = C.placed_blocks(df.withColumn("between", F.array().cast("array<bigint>")), 1000).orderBy("block").toPandas()
    seen = np.cumsum(tokens) - tokens
    last = np.maximum.accumulate(np.where(ends > 0, seen + tokens - tail, 0))
    assert (got["before"] == np.cumsum(ends) - ends).all() and (got["carried"] == seen - np.concatenate([[0], last[:-1]])).all()
    plan = C.placed_blocks(df, 1000)._jdf.queryExecution().optimizedPlan().toString()
    assert "between" not in plan


def test_a_store_that_python_does_not_know():
    assert C.in_ranges("file:/tmp/x") and not C.in_ranges("viewfs://store/x")
