"""Quality classifier on random-indexing word vectors (operator 4).

A word, a number or a run of symbols is a token; tokens hash into ``BUCKETS`` names, apart
by shape (lower case, capitalised, upper case, no letters). Each name has a fixed sparse
ternary index vector; a name's word vector is the sum of the index vectors of the tokens within
``WINDOW`` places of it, over the whole corpus. A document pools its tokens' word vectors at unit length:
their mean, their deviation, how near each is to the next one on average, and the logarithm of their number. A
two-layer network in numpy scores it. Rows that the network does not learn from say when to stop, and a temperature
fitted on them calibrates the probabilities.

The word vectors are sums over all documents: a task adds up its own counts, Spark adds those by
bucket, and the table that reaches the driver has ``BUCKETS`` rows at any corpus size. The
network learns from at most ``MAX_LABELLED`` labelled ids, those with the smallest hash.

Defined results: null, empty and blank texts have the zero vector and its score; a document with
several labels has the largest; without labels every score is 0.5, with labels of one class the
score is that of the prior; repeated rows get equal scores; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.bytesview import flat, runs
from plumbline.llm.common import crc_of_id, cut, prepare, smallest_by_hash, table

BUCKETS, DIMS, NONZERO, WINDOW = 8192, 64, 4, 2
MAX_LABELLED = 20_000
HIDDEN, EPOCHS, DECAY, SEED = 32, 40, 1e-3, 11
POOLED = 2 * DIMS + 2
THRESHOLD = 0.7

_KIND = np.zeros(256, np.uint8)  # 0 space, 1 letter, 2 digit, 3 symbol
_KIND[33:128] = 3
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_TOKENS = 1 << 15  # at once while pooling
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, ``NONZERO`` dimensions and their signs."""
    rng = np.random.default_rng(SEED)
    dims = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :NONZERO]
    return dims, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each token and the row that it stands in; a token is a run of one kind of byte."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    change = np.empty(len(data), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    edges = bounds[:-1]
    change[edges[edges < len(data)]] = True
    start = np.flatnonzero(change)
    stop = np.append(start[1:], len(data))
    power, back = (p[: len(data)] for p in _powers(len(data)))
    total = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data] + np.uint64(1)) * power, dtype=np.uint64)])
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    word = kind[start] > 0
    start, stop = start[word], stop[word]
    hashes = (total[stop] - total[start]) * back[start]
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    capitals, size = upper[stop] - upper[start], stop - start
    shape = np.where(kind[start] != 1, 3, np.where((capitals == size) & (size > 1), 2, np.where(capitals > 0, 1, 0)))
    share = BUCKETS // 4
    bucket = shape * share + ((hashes >> np.uint64(32)) % np.uint64(share)).astype(np.int64)
    return bucket, np.searchsorted(bounds, start, "right") - 1


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(21, int(n).bit_length())
    if size not in _cache:
        both = []
        for x in (_BASE, _INVERSE):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _cache.clear()
        _cache[size] = tuple(both)
    return _cache[size]


def _context(batches):
    dims, signs = index_vectors()
    total, seen = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS, bool)
    for batch in batches:
        data, bounds = flat(batch.column("text"))
        for a, b in runs(bounds):
            bucket, row = tokens(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
            seen[bucket] = True
            for k in range(1, WINDOW + 1):
                same = row[k:] == row[:-k]
                left, right = bucket[:-k][same], bucket[k:][same]
                for one, two in ((left, right), (right, left)):
                    for j in range(NONZERO):
                        total += np.bincount(one * DIMS + dims[two, j], signs[two, j], BUCKETS * DIMS)
    which = np.flatnonzero(seen)
    sums = total.reshape(BUCKETS, DIMS)[which].astype(np.int64)
    if len(which):
        yield pa.record_batch([pa.array(which), *(pa.array(sums[:, i]) for i in range(DIMS))], names=["bucket", *(f"d{i}" for i in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of word vectors, ``BUCKETS`` rows of unit length (zero where nothing was seen)."""
    schema = "bucket long, " + ", ".join(f"d{i} long" for i in range(DIMS))
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_context, schema)
    sums = parts.groupBy("bucket").agg(*(F.sum(f"d{i}").alias(f"d{i}") for i in range(DIMS))).toPandas()
    out = np.zeros((BUCKETS, DIMS), np.float32)
    values = sums[[f"d{i}" for i in range(DIMS)]].to_numpy(np.float64)
    out[sums["bucket"].to_numpy(np.int64)] = values / np.maximum(np.linalg.norm(values, axis=1, keepdims=True), 1e-9)
    return out


def pool(vectors: np.ndarray, bucket: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """One row of pooled features for each of ``rows`` documents; tokens of a document stand together."""
    total, squares, near = np.zeros((rows, DIMS)), np.zeros((rows, DIMS)), np.zeros(rows)
    for i in range(0, len(bucket), _TOKENS):
        own = row[i : i + _TOKENS]
        v = vectors[bucket[i : i + len(own) + 1]]  # and the first token after them
        first = np.flatnonzero(np.diff(own, prepend=-1))
        total[own[first]] += np.add.reduceat(v[: len(own)], first, axis=0)
        squares[own[first]] += np.add.reduceat(v[: len(own)] ** 2, first, axis=0)
        same = row[i : i + len(v) - 1] == row[i + 1 : i + len(v)]
        near += np.bincount(row[i : i + len(v) - 1][same], np.einsum("ij,ij->i", v[:-1], v[1:])[same], rows)
    count = np.bincount(row, minlength=rows)
    mean = total / np.maximum(count, 1)[:, None]
    deviation = np.sqrt(np.maximum(squares / np.maximum(count, 1)[:, None] - mean**2, 0))
    return np.hstack([mean, deviation, (near / np.maximum(count - 1, 1))[:, None], np.log1p(count)[:, None]]).astype(np.float32)


def _pooled(shared):
    def run(batches):
        vectors = shared.value
        for batch in batches:
            data, bounds = flat(batch.column("text"))
            out = np.zeros((batch.num_rows, POOLED), np.float32)
            for a, b in runs(bounds):
                out[a:b] = pool(vectors, *tokens(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]), b - a)
            yield pa.record_batch([batch.column("doc_id"), pa.array([x.tobytes() for x in out], pa.binary())], names=["doc_id", "vector"])

    return run


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, POOLED).astype(np.float64)


class Network:
    """tanh layer, sigmoid output, temperature. ``fit`` is deterministic."""

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Network:
        """``held`` marks the rows that only stop the learning and set the temperature."""
        self.prior = float(y.mean()) if len(y) else 0.5
        self.weights, self.temperature = None, 1.0
        if len(np.unique(y[~held])) < 2:
            return self
        self.mean, self.scale = x[~held].mean(0), x[~held].std(0) + 1e-6
        z = (x - self.mean) / self.scale
        rng = np.random.default_rng(SEED)
        w = [rng.normal(0, 1 / np.sqrt(POOLED), (POOLED, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
        learn, test = np.flatnonzero(~held), held if held.any() else ~held
        self.weights, best, lowest = w, None, np.inf
        for _ in range(max(EPOCHS, 2000 * 64 // max(1, len(learn)))):
            for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
                hidden = np.tanh(z[rows] @ w[0] + w[1])
                error = (self._sigmoid(hidden @ w[2] + w[3]) - y[rows]) / len(rows)
                back = np.outer(error, w[2]) * (1 - hidden**2)
                grads = [z[rows].T @ back + DECAY * w[0], back.sum(0), hidden.T @ error + DECAY * w[2], error.sum(keepdims=True)]
                step += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    w[i] -= 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            loss = self._loss(self._logits(x[test]), y[test])
            if loss < lowest:
                best, lowest = [p.copy() for p in w], loss
        self.weights = best
        logits, truth = self._logits(x[test]), y[test]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [self._loss(logits / t, truth) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self

    @staticmethod
    def _loss(logits: np.ndarray, truth: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(truth == 1, -logits, logits)).mean())

    @staticmethod
    def _sigmoid(a: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(a, -40, 40)))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(((x - self.mean) / self.scale) @ w[0] + w[1]) @ w[2] + w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return self._sigmoid(self._logits(x) / self.temperature)


def _scored(shared):
    def run(batches):
        for batch in batches:
            scores = shared.value.score(_matrix(batch.column("vector").to_pylist()))
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``doc_id, score`` of each row of ``docs(doc_id, text)``. ``labels(doc_id, label)`` are the
    rows to learn from, label 0 or 1."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = cut(texts.mapInArrow(_pooled(spark.sparkContext.broadcast(word_vectors(texts))), "doc_id long, vector binary"))
    known = labels.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = cut(known)
    chosen = F.broadcast(smallest_by_hash(known, "doc_id", max_labelled, known.count()))  # max_labelled rows at most
    sample = vectors.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("vector").alias("vector"), F.max("label").alias("label")).toPandas()  # an id may stand in any number of rows
    sample = sample.sort_values("doc_id")
    x, y = _matrix(sample["vector"]), sample["label"].to_numpy(np.float64)
    network = Network().fit(x, y, np.arange(len(y)) % 5 == 4)
    return vectors.mapInArrow(_scored(spark.sparkContext.broadcast(network)), "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(crc_of_id() % 4 != 2)
    scored = classify(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
