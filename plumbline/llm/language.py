"""Language identification by hierarchical discrimination (operator 6).

A first decision names the language family, a second one the language within it. Both are
votes of one-versus-one linear support vector machines on hashed byte n-grams (one to
three bytes, ASCII lower-cased, all that is not a letter read as a space), square-rooted and at
unit length. Languages that ``FAMILIES`` does not list are each a family of their own.

A level has at most ``WIDE`` classes: where there are more families, levels of groups stand above them. A group holds families whose
mean features are close; it comes from halving the largest group along its first principal direction. So every language with a labelled
row is learned, and the number of machines grows with the number of languages, not with its square.

The machines learn from a bounded sample of labelled documents: at most ``PER_LANGUAGE`` of each language, those with the smallest hash of
doc_id, and of each side of a machine at most ``PER_SIDE`` (one of each language at least). Each machine is fitted by a task of its own.
The driver gets the planes only: 8 KB each, at most about eight a language. Every whole text is scored.

``keep_identified`` (the pipeline's stage) rejects documents whose language is not identified: those without a letter, and those
for which the machines' score is below ``SURE``.

Defined results: ``und`` with score 0 for null texts and texts without a letter; with one learned
language every other text is that one; without any, ``und``; repeated rows get equal
results; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.bytesview import flat
from plumbline.llm.common import crc_of_id, delete, prepare, scratch, table

FEATURES = 2048
PER_LANGUAGE, PER_SIDE = 600, 6000
WIDE = 16
STEPS, RIDGE = 300, 1e-4
SURE = 0.1

#: Language codes by family.
FAMILIES = {
    "germanic": ["da", "de", "en", "is", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "baltic": ["lt", "lv"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
}

_LETTER = np.full(256, 32, np.uint64)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_CHUNK = 1 << 18


def family(language: str) -> str:
    return next((name for name, codes in FAMILIES.items() if language in codes), f"own:{language}")


def grams(row: np.ndarray) -> np.ndarray:
    """Counts of the hashed n-grams of one text."""
    counts = np.zeros(FEATURES)
    for a in range(0, len(row), _CHUNK):
        x = _LETTER[row[max(0, a - 2) : a + _CHUNK]]  # n-grams that begin in the chunk before count here
        skip = min(a, 2)
        two = x[1:] + x[:-1] * np.uint64(257)
        three = x[2:] + two[:-1] * np.uint64(257)
        for n, found in ((1, x), (2, two), (3, three)):
            found = found[max(0, skip - n + 1) :]
            hashed = (found * np.uint64(0x9E3779B97F4A7C15 + 2 * n)) >> np.uint64(53)
            counts += np.bincount(hashed.astype(np.int64), minlength=FEATURES)
    return counts


def scaled(counts: np.ndarray) -> np.ndarray:
    root = np.sqrt(counts)
    return root / max(np.linalg.norm(root), 1e-9)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of hashed n-gram features for each text."""
    out = np.zeros((len(bounds) - 1, FEATURES), np.float32)
    for i in range(len(bounds) - 1):
        out[i] = scaled(grams(data[bounds[i] : bounds[i + 1]]))
    return out


def machine(x: np.ndarray, side: np.ndarray) -> np.ndarray:
    """A linear support vector machine: squared hinge loss with a ridge, both sides of equal weight, by accelerated gradient."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(side > 0, 0.5 / max(1, (side > 0).sum()), 0.5 / max(1, (side < 0).sum()))
    w = ahead = np.zeros(x.shape[1])
    for step in range(STEPS):
        slack = np.maximum(0, 1 - side * (x @ ahead.astype(x.dtype)))  # as wide as x, which is not copied then
        new = ahead - 0.2 * (RIDGE * ahead - 2 * ((share * slack * side).astype(x.dtype) @ x))
        ahead, w = new + step / (step + 3) * (new - w), new
    return w


class Votes:
    """One-versus-one machines over ``classes``, in the order of their pairs."""

    def __init__(self, classes: list[str]):
        self.classes = sorted(classes)
        self.pairs = list(combinations(range(len(self.classes)), 2))
        self.planes = np.zeros((len(self.pairs), FEATURES + 1), np.float32)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class with most votes (then the largest sum of margins), and a score in [0, 1]."""
        n, votes, sums = len(x), np.zeros((len(x), len(self.classes))), np.zeros((len(x), len(self.classes)))
        least = np.full((n, len(self.classes)), 20.0)
        margins = x @ self.planes[:, :-1].T + self.planes[:, -1]
        for k, (a, b) in enumerate(self.pairs):
            m = margins[:, k]
            votes[:, a] += m >= 0
            votes[:, b] += m < 0
            sums[:, a] += m
            sums[:, b] -= m
            least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
        best = np.argmax(votes + 0.5 * np.tanh(sums / 10), axis=1) if self.classes else np.zeros(n, int)
        return best, 1 / (1 + np.exp(-4 * least[np.arange(n), best]))


def halved(names: list[str], means: np.ndarray) -> list[list[str]]:
    """``WIDE`` groups of names (fewer, if there are fewer names) with close means."""
    groups = [np.arange(len(names))]
    while len(groups) < min(WIDE, len(names)):
        own = groups.pop(max(range(len(groups)), key=lambda k: len(groups[k])))
        off = means[own] - means[own].mean(axis=0)
        direction = off[np.argmax(np.einsum("ij,ij->i", off, off))]
        for _ in range(30):
            direction = off.T @ (off @ direction)
            direction /= max(np.linalg.norm(direction), 1e-30)
        order = own[np.argsort(off @ direction, kind="stable")]
        groups += [np.sort(order[: len(order) // 2]), np.sort(order[len(order) // 2 :])]
    return [[names[i] for i in own] for own in groups]


def levels(languages: list[str], means) -> dict[tuple, dict[str, list[str]]]:
    """The decisions: for each path of classes, its classes with their languages. ``means()`` gives the mean features of languages, in order."""
    kin, out = {}, {}
    for c in sorted(languages):
        kin.setdefault(family(c), []).append(c)
    of_family = None
    if len(kin) > WIDE:
        mean = dict(zip(sorted(languages), means(), strict=True))
        of_family = {f: np.mean([mean[c] for c in codes], axis=0) for f, codes in kin.items()}

    def grow(path: tuple, families: list[str]) -> None:
        if len(families) > WIDE:
            groups = {f"near:{own[0]}": own for own in halved(families, np.array([of_family[f] for f in families]))}
            out[path] = {name: [c for f in own for c in kin[f]] for name, own in groups.items()}
            for name, own in groups.items():
                grow((*path, name), own)
        else:
            out[path] = {f: kin[f] for f in families}
            out.update({(*path, f): {c: [c] for c in kin[f]} for f in families})

    grow((), sorted(kin))
    return out


class Hierarchy:
    """Votes for each path of ``levels``."""

    def __init__(self, decisions: dict | None = None):
        self.votes = {path: Votes(list(classes)) for path, classes in (decisions or {(): {}}).items()}

    def fit(self, x: np.ndarray, languages: np.ndarray) -> Hierarchy:
        """Fits the machines here, on rows at hand; ``learn`` fits them on tasks."""
        codes = sorted(set(languages.tolist()))
        decisions = levels(codes, lambda: np.array([x[languages == c].mean(axis=0) for c in codes]))
        self.__init__(decisions)
        for path, votes in self.votes.items():
            own = [np.isin(languages, decisions[path][name]) for name in votes.classes]
            for k, (a, b) in enumerate(votes.pairs):
                rows = own[a] | own[b]
                votes.planes[k] = machine(x[rows], np.where(own[a][rows], 1.0, -1.0))
        return self

    @property
    def top(self) -> Votes:
        return self.votes[()]

    @property
    def below(self) -> dict[str, Votes]:
        return {f: self.votes[(f,)] for f in self.top.classes}

    @property
    def languages(self) -> list[str]:
        return sorted(c for path, votes in self.votes.items() for c in votes.classes if path and (*path, c) not in self.votes)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, scores = np.full(len(x), "und", dtype=object), np.zeros(len(x))
        if self.top.classes and len(x):
            self._descend((), x, np.arange(len(x)), np.ones(len(x)), names, scores)
        return names, scores

    def _descend(self, path: tuple, x: np.ndarray, rows: np.ndarray, sure: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        best, score = self.votes[path].decide(x[rows])
        score = sure * score
        if path and (*path, self.votes[path].classes[0]) not in self.votes:
            names[rows], scores[rows] = np.array(self.votes[path].classes, dtype=object)[best], score
            return
        for i in np.unique(best):
            own = best == i
            self._descend((*path, self.votes[path].classes[i]), x, rows[own], score[own], names, scores)


def _counted(batches):
    for batch in batches:
        data, bounds = flat(batch.column("text"))
        counts = [grams(data[a:b]).astype(np.uint32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.record_batch([batch.column("lang"), batch.column("n"), pa.array(counts, pa.binary())], names=["lang", "n", "counts"])


def _rows(table: pa.Table) -> np.ndarray:
    """Features of the rows in an order of their own, so that sums do not depend on how they arrive."""
    order = table.select(["lang", "counts"]).to_pandas().sort_values(["lang", "counts"], kind="stable")
    out = np.zeros((len(order), FEATURES), np.float32)
    for i, counts in enumerate(order["counts"]):
        out[i] = scaled(np.frombuffer(counts, np.uint32))
    return out


def _mean(key: tuple, table: pa.Table) -> pa.Table:
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "mean": pa.array([_rows(table).mean(axis=0).tobytes()], pa.binary())})


def _fitted(key: tuple, table: pa.Table) -> pa.Table:
    first = table.column("first").to_numpy()
    x = [_rows(table.filter(pa.array(own))) for own in (first, ~first)]
    side = np.repeat([1.0, -1.0], [len(own) for own in x])
    plane = machine(np.vstack(x), side).astype(np.float32)
    node, a, b = (k.as_py() for k in key)
    return pa.table({"node": pa.array([node], pa.int32()), "a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()), "plane": pa.array([plane.tobytes()], pa.binary())})


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Hierarchy:
    """The machines fitted on ``labelled(doc_id, text, lang)``, on at most ``per_language`` ids of each language. Small tables are
    written, so that Spark knows their sizes and broadcasts them only below its threshold."""
    spark = labelled.sparkSession
    folder = scratch(spark, "languages")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    known = labelled.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    counts = written(known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("of_lang")).coalesce(1), "counts")  # a sketch, which needs no shuffle of ids
    languages = sorted(r.lang for r in counts.select("lang").collect())
    if not languages:
        delete(spark, folder)
        return Hierarchy()
    # only rows below a hash bound that about per_language rows of a language pass go on, so a hot one is no large group
    share = F.lit(1.3 * (per_language + 12 * per_language**0.5 + 100)) / F.col("of_lang")
    low = known.join(counts, "lang").where(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= share).drop("of_lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = low.select("lang", "doc_id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    rows = low.join(written(chosen, "chosen"), ["doc_id", "lang"]).select("lang", "n", "text")
    sample = rows.mapInArrow(_counted, "lang string, n int, counts binary").groupBy("lang", "n").agg(F.min("counts").alias("counts"))  # an id may stand in any number of rows
    sample = written(sample, "sample")

    def means() -> np.ndarray:
        found = {r.lang: r.mean for r in sample.groupBy("lang").applyInArrow(_mean, "lang string, mean binary").collect()}
        return np.frombuffer(b"".join(found[c] for c in languages), np.float32).reshape(-1, FEATURES)

    decisions = levels(languages, means)
    model = Hierarchy(decisions)
    paths = list(decisions)
    members = [
        (c, node, k, len(votes.classes), max(1, PER_SIDE // len(decisions[path][name])))
        for node, path in enumerate(paths)
        for votes in [model.votes[path]]
        for k, name in enumerate(votes.classes)
        for c in decisions[path][name]
    ]
    members = spark.createDataFrame(members, "lang string, node int, own int, classes int, most int").where("classes > 1")
    sides = (
        sample.join(members, "lang")
        .where("n <= most")
        .withColumn("other", F.explode(F.expr("sequence(0, classes - 1)")))
        .where("other <> own")
        .select("node", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") < F.col("other")).alias("first"), "lang", "counts")
    )
    machines = sum(len(votes.pairs) for votes in model.votes.values())
    if machines:
        # a number of partitions of its own, as adaptive execution would put small samples on one task
        dealt = sides.repartition(min(2 * machines, 2048), "node", "a", "b").groupBy("node", "a", "b")
        places = [{pair: k for k, pair in enumerate(model.votes[path].pairs)} for path in paths]
        for r in dealt.applyInArrow(_fitted, "node int, a int, b int, plane binary").collect():
            model.votes[paths[r.node]].planes[places[r.node][r.a, r.b]] = np.frombuffer(r.plane, np.float32)
    delete(spark, folder)
    return model


def _blank(texts: pa.Array) -> np.ndarray:
    """Which texts are null or without a letter."""
    return np.array([not t or not any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)


def _judged(shared):
    def run(batches):
        model = shared.value
        for batch in batches:
            data, bounds = flat(batch.column("text"))
            names, scores = np.full(batch.num_rows, "und", dtype=object), np.zeros(batch.num_rows)
            for a in range(0, batch.num_rows, 1024):
                b = min(a + 1024, batch.num_rows)
                names[a:b], scores[a:b] = model.predict(features(data, bounds[a : b + 1]))
            blank = _blank(batch.column("text"))
            names[blank], scores[blank] = "und", 0.0
            yield pa.record_batch([batch.column("doc_id"), pa.array(names.tolist(), pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(learn(labelled, per_language))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_judged(model), "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, labelled: DataFrame, sure: float = SURE, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The rows of ``docs`` whose language is identified with a score of ``sure`` or more, with their columns. Where fewer than two
    languages were learned there is nothing to discriminate: only null texts and those without a letter go. The texts are judged where they are read, without a shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(learn(labelled, per_language))

    def run(batches):
        for batch in batches:
            keep = ~_blank(batch.column("text"))
            if len(model.value.languages) > 1:
                keep &= next(_judged(model)(iter([batch.select(["doc_id", "text"])]))).column("score").to_numpy() >= sure
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents that the language machines may learn from."""
    return docs.select("doc_id", "text", "lang").where(crc_of_id() % 3 != 1)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), training_rows(docs))
    return found.select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "lang_pred", "score")
