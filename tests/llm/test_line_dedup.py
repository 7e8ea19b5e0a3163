"""Operator 12 against brute force and its SQL; the perfect hash by itself."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from plumbline.llm import line_dedup as L
from plumbline.llm import queries

WHITE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_docs=10, least=1, counted=None):
    own = [(i, (t or "").split("\n")) for i, t in rows]
    docs = Counter(k for _, t in (counted if counted is not None else rows) for k in set(map(key, (t or "").split("\n"))))
    out = []
    for i, lines in own:
        kept = [x for x in lines if not (len(key(x)) >= least and docs[key(x)] >= min_docs)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus(n=400):
    rng = np.random.default_rng(2)
    common = ["All rights reserved.", "  ALL RIGHTS RESERVED.\t", "é Ünï", "x", "\x0bPage 1\r", "<br>", "", " \t ", " nbsp"]
    rows = []
    for i in range(n):
        lines = [f"own line {i} {j}" for j in range(rng.integers(0, 4))] + list(rng.choice(common, rng.integers(0, 4))) + [f"group {i % 37}", f"pair {i % 41}"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    return rows + [(None, "x\n\n"), (5, None), (5, None), (6, ""), (7, "\n"), (8, "x\nx\nx"), (9, "a\r\nb\x85c\x1cd"), (10, "same\n" * 30000)]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"block_chars": 700, "shard_keys": 3}])
@pytest.mark.parametrize("least", [1, 3])
def test_drop_lines_equals_brute_force(spark, sizes, least):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, block string, shard int")
    assert ordered(L.drop_lines(docs, least=least, **sizes).collect()) == ordered(brute(rows, least=least))


def test_a_written_index_serves_other_documents(spark, tmp_path):
    rows, other = corpus(), [(1, "x\nGROUP 1\nnever seen\npair 3"), (2, None), (3, "All rights reserved.")]
    schema = "doc_id long, text string"
    L.line_index(spark.createDataFrame(rows, schema), block_chars=900, shard_keys=20).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() > 4
    assert ordered(L.drop_lines(spark.createDataFrame(other, schema), index).collect()) == ordered(brute(other, counted=rows))
    empty = L.line_index(spark.createDataFrame([], schema))
    assert ordered(L.drop_lines(spark.createDataFrame(other, schema), empty).collect()) == ordered(brute(other, counted=[]))


@pytest.mark.parametrize("n", [0, 1, 2, 9, 1000, 50_000])
def test_the_hash_is_minimal_and_perfect(n):
    keys = L.hashed(str(i).encode() for i in range(n))
    levels = L.perfect_hash(keys)
    assert sorted(L.slots(levels, keys).tolist()) == list(range(n))
    assert sum(map(len, levels)) * 8 <= 4 * n + 200
    others = L.hashed(f"other {i}".encode() for i in range(2000))
    assert (L.slots(levels, others) < n).all()
    if n > 1:
        with pytest.raises(ValueError, match="distinct"):
            L.perfect_hash(np.concatenate([keys[:2], keys[:2]]))


def test_op12(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n_lines int, kept string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_line_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    found = ordered(got.collect())
    assert found == ordered((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(rows))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert ordered(duck.execute(queries.ORACLE_SQL["op12_line_dedup"]).fetchall()) == found


def test_an_empty_table_gives_no_rows(spark):
    assert L.drop_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
