"""Completion of operator 2 where a similarity of the shingles is asked for (the pipeline's stage ``near``).

A similarity of 0.8 is a distance of about ten bits between fingerprints, which vantage-point trees cannot prune. The
links that the trees miss come from min-hash bands: texts that share a band are in one bucket, and a pair at
0.8 shares none of 24 bands of 4 with a probability of 3e-6. Every link is verified on the
whole sets of 64-bit shingle hashes, those of the trees too.

A bucket is never written out as pairs. First each member meets its bucket's smallest row, beside the pairs that the trees link;
that connects large groups at a cost in proportion to their size. Then only buckets whose members are not all connected
remain: the members outside the bucket's largest component meet all members of other components, in cells
of at most ``CELL`` times ``CELL`` texts.

Defined results: null, empty and blank texts are equal; a text of fewer words than a shingle is one
shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import connected_components, cut, done

BANDS, BAND_ROWS = 24, 4
CELL = 256
_STEP = 4096

_rng = np.random.default_rng(8)
_MASKS = _rng.integers(0, 1 << 64, (BANDS * BAND_ROWS, 1), np.uint64)
_FACTORS = _rng.integers(0, 1 << 64, (BANDS * BAND_ROWS, 1), np.uint64) | np.uint64(1)
_JOIN = _rng.integers(0, 1 << 64, (BANDS, BAND_ROWS), np.uint64) | np.uint64(1)
_SALT = _rng.integers(0, 1 << 64, BANDS, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct hashes of a UTF-8 text's shingles; words as in ``simhash.fingerprint``."""
    words = text.lower().split()
    hashes = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    count = max(1, len(words) - width + 1)
    out = np.full(count, len(words) < width and len(words), np.uint64)
    for k in range(min(width, len(words))):
        out = _mixed(out + hashes[k : k + count])
    return np.unique(out)


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of the min-hashes of a set."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for i in range(0, len(own), _STEP):
        least = np.minimum(least, ((own[None, i : i + _STEP] ^ _MASKS) * _FACTORS).min(1))
    return _mixed((_mixed(least).reshape(BANDS, BAND_ROWS) * _JOIN).sum(1, dtype=np.uint64) + _SALT)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a similarity of ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) >= least


def _sets(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            own = pa.array([shingles(t or b"", width).tobytes() for t in texts], pa.binary())
            yield pa.record_batch([batch.column("row"), own], names=["row", "own"])

    return run


def _verified(least: float):
    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("own").to_pylist(), batch.column("other").to_pylist(), strict=True)
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least) for x, y in pairs]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def cell_links(rows: list[int], components: list[int], probes: list[bool], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links between probes and the rest that connect components which are not yet connected."""
    root, out = {c: c for c in components}, []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    rest = [i for i, p in enumerate(probes) if not p]
    for i in (i for i, p in enumerate(probes) if p):
        for j in rest:
            x, y = find(components[i]), find(components[j])
            if x != y and similar(sets[i], sets[j], least):
                root[max(x, y)] = min(x, y)
                out.append((rows[i], rows[j]))
    return out


def _cell(least: float):
    def run(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("row", "component", "probe")]
        sets = [np.frombuffer(x, np.uint64) for x in group.column("own").to_pylist()]
        found = np.array(cell_links(*columns, sets, least), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    return run


def similar_links(texts: DataFrame, keys: DataFrame, near: DataFrame, width: int, least: float) -> DataFrame:
    """Verified links ``a, b`` between rows of ``texts(row, text)`` that connect what all links connect. ``keys(row, key)``: the
    texts' bands; ``near(row, other)``: pairs that are likely to be links."""
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("row").alias("first")).where("size > 1").drop("size"))
    bucketed = cut(keys.join(shared, "key"))
    stars = bucketed.where("row <> first").select("row", F.col("first").alias("other"))
    pairs = cut(near.union(stars).distinct())
    rows = cut(bucketed.select("row").union(near.select("row")).union(near.select("other")).distinct())
    sets = cut(texts.join(rows, "row", "left_semi").mapInArrow(_sets(width), "row long, own binary"))
    left = pairs.select(F.col("row").alias("a"), F.col("other").alias("b")).join(sets.select(F.col("row").alias("a"), "own"), "a")
    both = left.join(sets.select(F.col("row").alias("b"), F.col("own").alias("other")), "b")
    links = cut(both.select("a", "b", "own", "other").mapInArrow(_verified(least), "a long, b long"))

    labels = connected_components(links)
    members = cut(
        bucketed.join(labels, bucketed.row == labels.node, "left").select("key", "row", F.coalesce("root", "row").alias("component"))
    )
    done(shared, bucketed, rows, pairs, labels)
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("sum"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("size"), F.sum("sum").alias("sum"))
    # buckets with the same members are looked at once
    mixed = mixed.where("parts > 1").groupBy("size", "sum").agg(F.min(F.struct("key", "main", "most")).alias("one")).select("size", "one.*")
    blocks = lambda n: F.ceil(n / CELL).cast("int")
    mixed = cut(mixed.select("key", "main", blocks(F.col("size") - F.col("most")).alias("p"), blocks(F.col("size")).alias("q")))
    own = members.join(mixed, "key")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    probes = own.where("component <> main").select("key", F.expr("cast(pmod(xxhash64(row), p) as int)").alias("i"), spread(F.col("q")).alias("j"), "row", "component", F.lit(True).alias("probe"))
    rest = own.select("key", spread(F.col("p")).alias("i"), F.expr("cast(pmod(xxhash64(row), q) as int)").alias("j"), "row", "component", F.lit(False).alias("probe"))
    cells = probes.select("key", "i", "j", "row", "component", "probe").union(rest).join(sets, "row")
    more = cut(cells.groupBy("key", "i", "j").applyInArrow(lambda g: _cell(least)(g), "a long, b long"))
    every = cut(links.union(more))
    done(members, mixed, sets, links, more)
    return every
