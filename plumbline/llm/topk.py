"""Exact top-k inner products by a three-phase uniform threshold (operator 8).

A vector's components are cut into ``SLICES`` slices; a score is the sum of the slices' local
scores. (1) The slices are lists of their own, each on tasks of its own, which see nothing of the others. Each
task gathers, for each query, its k + 1 best local scores; the vectors on the k + 1 best places of each slice's list
are scored in full, and the (k + 1)-th best of these totals is a safe cutoff. (2) The cutoff
goes to all tasks: a vector that reaches it must reach the cutoff's uniform share in one slice at
least, and only such entries are collected. (3) Where an entry is collected, its score is resolved exactly; each
task hands on its k + 1 best for each query, from which the ranks follow.

The cutoff bounds what is collected, resolved and handed on; the local scores of each pair are multiplied in phase 1 and
again in phase 2, as to keep them all would take more room than the vectors.

Every row is a candidate of its own, also where ids repeat. Equal vectors are compared once, with their k + 1 smallest rows
(by id, then by row), and equal queries are searched once; so a vector that is very common costs
nothing more. Queries come in blocks of about ``QUERY_BYTES``: that bounds what is broadcast
and what the driver sees, and each block is a pass over the candidates whose entries go to a table.

Defined results: rows whose id or vector is null, or whose vector holds null or non-finite
components, take no part; a query has every other row as a candidate, rows of its own id and repeated rows
too, and rows with one id are queries each; of equal scores the smaller id ranks first; vectors of different
lengths are no candidates of each other; an empty table gives no rows; other columns are not
looked at. Scores that do not fit a long stop the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, done, prepare, scratch, table

SLICES = 2
QUERY_BYTES = 4 << 20
_ROWS = 1024


def _int_matrix(lists: list) -> np.ndarray:
    return np.array(lists, np.int64).reshape(len(lists), -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T without loss: in doubles where no sum can pass 2**53, else in longs."""
    _fits(a, b)
    if _top(a, b) < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _top(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])


def _fits(a: np.ndarray, b: np.ndarray) -> None:
    if _top(a, b) >= 2**61:
        raise OverflowError("an inner product does not fit a long")


def edges(size: int) -> list[int]:
    """Where the slices of a vector of ``size`` components begin, and its end."""
    return [size * i // SLICES for i in range(SLICES + 1)]


def _matrices(batches, sizes, column: str):
    """(number of components, row of each, vectors) in pieces of rows of one length that has queries."""
    for batch in batches:
        size, vectors = batch.column("size").to_numpy(), batch.column(column)
        for n in np.intersect1d(size, sizes):
            rows = np.flatnonzero(size == n)
            for a in range(0, len(rows), _ROWS):
                part = rows[a : a + _ROWS]
                yield int(n), batch.take(pa.array(part)), _int_matrix(vectors.take(pa.array(part)).to_pylist())


_NONE = -(2**62)  # below every score, and its negative is a long too


def _best(which: np.ndarray, score: np.ndarray, least: np.ndarray, ident: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """The ``keep`` best entries of each query: the score falls, then the smaller id, then the smaller row."""
    order = np.lexsort([ident, least, -score, which])
    which, score, least, ident = (x[order] for x in (which, score, least, ident))
    good = np.arange(len(which)) - np.searchsorted(which, which) < keep
    return which[good], score[good], least[good], ident[good]


def _gather(shared, keep: int):
    """Phase 1, on the rows of one slice: each query's best local scores."""

    def run(batches):
        queries = shared.value
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            for number in np.unique(batch.column("slice").to_numpy()).tolist():
                own = batch.filter(pa.array(batch.column("slice").to_numpy() == number))
                for n, rows, part in _matrices([own], list(queries), "part"):
                    a, b = edges(n)[number : number + 2]
                    local = _product(part, queries[n][1][:, a:b])
                    take = min(keep, len(part))
                    at = np.argpartition(-local, take - 1, axis=0)[:take]
                    which = np.broadcast_to(np.arange(local.shape[1]), at.shape).ravel()
                    score, ident = np.take_along_axis(local, at, 0).ravel(), rows.column("pid").to_numpy()[at].ravel()
                    old = held.get((n, number), [np.zeros(0, np.int64)] * 4)
                    new = (which, score, ident, ident)
                    held[n, number] = list(_best(*(np.concatenate(x) for x in zip(old, new, strict=True)), keep))
        for (n, number), (which, score, _, ident) in held.items():
            yield pa.record_batch([pa.array(queries[n][0][which]), pa.array(np.full(len(which), number, np.int32)), pa.array(score), pa.array(ident)], names=["qid", "slice", "score", "pid"])

    return run


def _resolve(shared):
    """Whole scores of the pairs (qid, vector)."""

    def run(batches):
        queries = shared.value
        place = {int(q): (n, i) for n, (ids, _) in queries.items() for i, q in enumerate(ids)}
        for batch in batches:
            scores = []
            for q, v in zip(batch.column("qid").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                n, i = place[q]
                scores.append(sum(int(x) * y for x, y in zip(queries[n][1][i], v, strict=True)))
            yield pa.record_batch([batch.column("qid"), pa.array(scores, pa.int64())], names=["qid", "score"])

    return run


def _collect(shared, cutoffs, keep: int):
    """Phases 2 and 3: entries that reach the uniform share in a slice, resolved; the best of this task."""

    def run(batches):
        queries, limits = shared.value, cutoffs.value
        held: dict[int, list] = {n: [np.zeros(0, np.int64)] * 4 for n in queries}
        for n, rows, vectors in _matrices(batches, list(queries), "vector"):
            own = queries[n][1]
            _fits(vectors, own)
            limit = np.array([limits.get(int(i), _NONE) for i in queries[n][0]], np.int64)
            share = np.where(limit == _NONE, _NONE, -(-limit // SLICES))  # of integers that add up to the limit one is as large
            cuts = edges(n)
            reached = np.zeros((len(vectors), len(own)), bool)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                reached |= _product(vectors[:, a:b], own[:, a:b]) >= share
            at, which = np.nonzero(reached)
            for i in range(0, len(at), 1 << 16):
                r, w = at[i : i + (1 << 16)], which[i : i + (1 << 16)]
                score = np.einsum("ij,ij->i", vectors[r], own[w])
                good = score >= limit[w]
                new = (w[good], score[good], rows.column("least").to_numpy()[r[good]], rows.column("pid").to_numpy()[r[good]])
                held[n] = list(_best(*(np.concatenate(x) for x in zip(held[n], new, strict=True)), keep))
        for n, (which, score, least, ident) in held.items():
            yield pa.record_batch([pa.array(queries[n][0][which]), pa.array(score), pa.array(least), pa.array(ident)], names=["qid", "score", "least", "pid"])

    return run


def integers(vector: Column) -> Column:
    """floor(1024 x) of each component as long; null for vectors that take no part."""
    wide = vector.cast("array<double>")
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(wide, lambda x: F.floor(x * 1024)))


def _first(by: list, order: list, keep: int) -> tuple[Column, Column]:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)), F.col("n") <= keep


def _entries(points: DataFrame, own, keep: int) -> DataFrame:
    """The three phases for one block of queries, ``own`` (qid, vector) on the driver."""
    spark = points.sparkSession
    by_size: dict[int, list] = {}
    for ident, vector in zip(own["qid"], own["vector"], strict=True):
        by_size.setdefault(len(vector), []).append((ident, vector))
    shared = spark.sparkContext.broadcast({n: (np.array([i for i, _ in x], np.int64), _int_matrix([v for _, v in x])) for n, x in by_size.items()})
    bound = lambda i: f"cast(size * {i} div {SLICES} as int)"
    lists = None
    for i in range(SLICES):
        part = F.expr(f"slice(vector, {bound(i)} + 1, {bound(i + 1)} - {bound(i)})")
        one = points.select("pid", "size", F.lit(i).alias("slice"), part.alias("part"))
        lists = one if lists is None else lists.union(one)
    n, few = _first(["qid", "slice"], [F.desc("score"), F.col("pid")], keep)
    gathered = lists.mapInArrow(_gather(shared, keep), "qid long, slice int, score long, pid long").withColumn("n", n).where(few)
    gathered = cut(gathered.select("qid", "pid").distinct())  # SLICES * keep rows a query at most
    totals = points.select("pid", "vector").join(F.broadcast(gathered), "pid").select("qid", "vector").mapInArrow(_resolve(shared), "qid long, score long")
    n, few = _first(["qid"], [F.desc("score")], keep)
    limits = totals.withColumn("n", n).where(few).groupBy("qid").agg(F.min("score").alias("limit"), F.count("*").alias("n"))
    cutoffs = spark.sparkContext.broadcast({r.qid: r.limit for r in limits.where(F.col("n") == keep).collect()})
    done(gathered)
    found = points.select("size", "pid", "least", "vector").mapInArrow(_collect(shared, cutoffs, keep), "qid long, score long, least long, pid long")
    n, few = _first(["qid"], [F.desc("score"), F.col("least"), F.col("pid")], keep)
    return found.withColumn("n", n).where(few).select("qid", "score", "pid")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows of ``vectors(vec_id, vector)`` (array<long>, no nulls) for which
    ``is_query`` holds, against all other rows."""
    spark = vectors.sparkSession
    prepare(spark)
    keep = k + 1
    rows = cut(vectors.select("vec_id", "vector", F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")))
    n, few = _first(["vector"], [F.col("vec_id"), F.col("row")], keep)
    points = cut(
        rows.withColumn("n", n).where(few).groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("few"))
        .select(F.size("vector").alias("size"), F.col("few")[0]["row"].alias("pid"), F.col("few")[0]["vec_id"].alias("least"), "vector", "few")
    )
    asking = rows.where("asks").select("vec_id", "row", "vector")
    distinct = cut(asking.groupBy("vector").agg(F.min("row").alias("qid")))
    asking = cut(asking.join(distinct, "vector").select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "qid"))
    bytes_ = distinct.agg(F.sum(8 * F.size("vector") + 16)).first()[0] or 0
    blocks, path = -(-bytes_ // QUERY_BYTES), scratch(spark, "topk")
    schema = "qid long, score long, pid long"
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        own = distinct.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toPandas().sort_values("qid")
        _entries(points, own, keep).write.mode("append").parquet(path)
    found = spark.read.schema(schema).parquet(path).join(points.select("pid", "few"), "pid").select("qid", "score", F.explode("few").alias("c"))
    pairs = asking.join(found, "qid").where("c.row <> query_row").select("query_id", "query_row", "score", F.col("c.vec_id").alias("vec_id"), F.col("c.row").alias("row"))
    n, few = _first(["query_row"], [F.desc("score"), F.col("vec_id"), F.col("row")], k)
    return pairs.withColumn("n", n).where(few).select("query_id", F.col("n").cast("int").alias("rank"), "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("vector"))
    return top_k(vectors.where("vec_id is not null and vector is not null"), F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.place, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON c.place <> q.place AND len(c.vector) = len(q.vector)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER w::INTEGER AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY place ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10
"""
