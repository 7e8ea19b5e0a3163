"""SimHash near-deduplication with vantage-point trees (operator 2).

A fingerprint is taken from every shingle of a whole text. Equal fingerprints are one point.
All pairs of points within ``distance`` bits are found by a forest of vantage-point trees: the
bits are cut into segments, and a pair within ``distance`` bits lies within a small radius in
one segment at least (4 = radii 1, 1 and 0 in three segments). Each segment has a tree of its
own. A node holds a vantage point and a threshold on the Hamming distance to it: nearer points
go to the inner shard, farther ones to the outer shard, and by the triangle inequality only
outer points at most the radius beyond the threshold have to visit the inner shard too; every
other branch is pruned. A pair within the radius so meets in one leaf.

The trees are fitted on a bounded sample (the points with the smallest hash, ``SAMPLE`` or
``LEAF_SAMPLE`` a leaf) and every point is routed. Their depth follows the number of points, so that
leaves keep their size up to ``LEAF_TARGET << MAX_DEPTH`` distinct fingerprints. A leaf compares its points exactly. A leaf with more than ``LEAF_CAP`` points is cut
into blocks, and each pair of blocks becomes a shard of its own, so no task gets a hot
leaf whole. A shard reports links as a forest (a point and its root), never all pairs of a group.

``keep_near`` asks for a similarity of the shingles instead (the pipeline's stage ``near``): what the trees link is
verified on the whole shingle sets, and ``similar_links`` completes what a distance cannot reach.

Defined results: null, empty and blank texts have fingerprint zero and link like any other;
repeated rows share a fingerprint and so a component, of which the first one is kept; a null
doc_id sorts last (a component of null ids only has a null component_id); an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import connected_components, cut, done, prepare, smallest_by_hash, table
from plumbline.llm.near_dedup import bands, shingles, similar_links

SAMPLE = 65_536
LEAF_TARGET = 256
LEAF_CAP = 1024
LEAF_SAMPLE = 8
MAX_DEPTH = 18
_STEP = 1 << 15


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text: words are runs without ASCII white space,
    A-Z is lower-cased, a shingle has ``width`` words (fewer words: one shingle of all)."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    count = max(1, len(words) - width + 1)
    starts, stops = (ends - lengths)[:count].tolist(), ends[-count:].tolist()
    one = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for i in range(0, count, _STEP):
        part = [one(joined[a:b], seed) for a, b in zip(starts[i : i + _STEP], stops[i : i + _STEP], strict=True)]
        bits += np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > count, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            prints = np.array([fingerprint(t or b"", width) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("row"), pa.array(prints)], names=["doc_id", "row", "fp"])

    return run


def segments(distance: int, count: int = 3) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment; the radii plus one add up to distance plus one."""
    count = min(count, distance + 1)
    radii = [(distance + 1) // count + (i < (distance + 1) % count) - 1 for i in range(count)]
    share = 64 // count
    sizes = [share + 1 if i < 64 - share * count else share for i in range(count)]
    return [(sum(sizes[:i]), sizes[i], radii[i]) for i in range(count)]


def depth_for(points: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(1, points) / LEAF_TARGET)), 0, MAX_DEPTH))


class Forest:
    """One vantage-point tree for each segment, in heap order, for vectorised routing."""

    def __init__(self, sample: np.ndarray, points: int, distance: int):
        self.depth = depth_for(points)
        self.parts = segments(distance)
        self.trees = [self._grow(self._cut(sample, s), s[2], k) for k, s in enumerate(self.parts)]

    @staticmethod
    def _cut(prints: np.ndarray, part: tuple[int, int, int]) -> np.ndarray:
        return (prints >> np.uint64(part[0])) & np.uint64((1 << part[1]) - 1)

    def _grow(self, sample: np.ndarray, radius: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        inner_nodes = (1 << self.depth) - 1
        vantage, limit = np.zeros(inner_nodes, np.uint64), np.full(inner_nodes, 64, np.int16)
        rng, held = np.random.default_rng(seed), {0: sample}
        for node in range(inner_nodes):
            own = held.pop(node, sample[:0])
            best = (float(len(own)) ** 2, None, 64)
            for v in rng.choice(own, 6) if len(own) > 1 else []:
                within = np.cumsum(np.bincount(np.bitwise_count(own ^ v), minlength=64 + radius)).astype(float)
                cost = within[radius : 64 + radius] ** 2 + (len(own) - within[:64]) ** 2
                cost[(within[:64] == 0) | (within[:64] == len(own))] = np.inf
                t = int(np.argmin(cost))
                if cost[t] < best[0]:
                    best = (cost[t], v, t)
            if best[1] is not None:
                vantage[node], limit[node] = best[1], best[2]
            far = np.bitwise_count(own ^ vantage[node])
            held[2 * node + 1], held[2 * node + 2] = own[far <= limit[node] + radius], own[far > limit[node]]
        return vantage, limit

    def route(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of ``prints`` and the leaf of each visit."""
        rows_out, leaves_out = [], []
        for k, (part, (vantage, limit)) in enumerate(zip(self.parts, self.trees, strict=True)):
            key, rows, node = self._cut(prints, part), np.arange(len(prints)), np.zeros(len(prints), np.int64)
            for _ in range(self.depth):
                far, t = np.bitwise_count(key[rows] ^ vantage[node]).astype(np.int16), limit[node]
                inner, edge = far <= t, (far > t) & (far <= t + part[2])
                rows = np.concatenate([rows, rows[edge]])
                node = np.concatenate([np.where(inner, 2 * node + 1, 2 * node + 2), 2 * node[edge] + 1])
            rows_out.append(rows)
            leaves_out.append(node - ((1 << self.depth) - 1) + (k << MAX_DEPTH))
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def _visits(forest: Forest, heavy: dict[int, int] | None):
    """Counts of visits by leaf (``heavy`` None), or the visits, with heavy leaves cut into pairs of blocks."""

    def run(batches):
        for batch in batches:
            prints = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(prints), _STEP):
                rows, leaves = forest.route(prints[i : i + _STEP])
                if heavy is None:
                    which, count = np.unique(leaves, return_counts=True)
                    yield pa.record_batch([pa.array(which), pa.array(count)], names=["leaf", "visits"])
                    continue
                points, cells = prints[i : i + _STEP][rows], leaves << 40
                hot = np.isin(leaves, np.fromiter(heavy, np.int64, len(heavy)))
                more_points, more_cells = [points[~hot]], [cells[~hot]]
                for leaf in np.unique(leaves[hot]).tolist():
                    own, blocks = points[leaves == leaf], heavy[leaf]
                    at = ((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % blocks
                    for other in range(blocks):
                        more_points.append(own)
                        more_cells.append((leaf << 40) | (np.minimum(at, other) << 20) | np.maximum(at, other))
                yield pa.record_batch(
                    [pa.array(np.concatenate(more_cells)), pa.array(np.concatenate(more_points).view(np.int64))],
                    names=["cell", "fp"],
                )

    return run


def links(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of distinct ``prints`` within ``distance`` bits, as (index, root)."""
    n = len(prints)
    near = np.zeros(n, bool)
    step = max(1, (1 << 21) // max(1, n))
    for i in range(0, n, step):
        near[i : i + step] = (np.bitwise_count(prints[i : i + step, None] ^ prints[None, :]) <= distance).sum(1) > 1
    left, out = np.flatnonzero(near), []
    while len(left):
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            hit = np.bitwise_count(prints[left] ^ prints[queue.pop()]) <= distance
            found, left = left[hit].tolist(), left[~hit]
            queue += found
            out += [(x, root) for x in found]
    return out


def _leaf_links(distance: int):
    def run(group: pa.Table) -> pa.Table:
        points = np.unique(group.column("fp").to_numpy())
        found = np.array(links(points.view(np.uint64), distance), np.int64).reshape(-1, 2)
        return pa.table({"a": points[found[:, 0]], "b": points[found[:, 1]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def near_links(points: DataFrame, distance: int = 4) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints ``points(fp)``: every pair within
    ``distance`` bits is connected by links of the result, and each link is such a chain."""
    total = points.count()
    size = max(SAMPLE, LEAF_SAMPLE << depth_for(total))
    sample = smallest_by_hash(points, "fp", size, total).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    forest = Forest(sample, total, distance)
    counts = points.mapInArrow(_visits(forest, None), "leaf long, visits long").groupBy("leaf").agg(F.sum("visits").alias("visits"))
    # at most 3 << MAX_DEPTH leaves exist, whatever the input
    heavy = {r.leaf: -(-r.visits // LEAF_CAP) for r in counts.where(F.col("visits") > LEAF_CAP).collect()}
    visits = points.mapInArrow(_visits(forest, heavy), "cell long, fp long")
    return visits.groupBy("cell").applyInArrow(lambda g: _leaf_links(distance)(g.select(["fp"])), "a long, b long")


def near_dedup(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fp, component_id, kept, row`` of each row of ``docs(doc_id, text)``; component_id is the
    smallest doc_id that chains of links reach, the row's own included, and ``kept`` marks the first row with it.
    ``row`` is the row's number in ``docs`` as read."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    prints = cut(texts.mapInArrow(_fingerprints(width), "doc_id long, row long, fp long"))
    points = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("rep")))
    labels = connected_components(near_links(points.select("fp"), distance))
    linked = labels.join(points, labels.node == points.fp)
    least = linked.groupBy("root").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "root").select(F.col("node").alias("fp"), "least")
    first = F.coalesce("least", "rep")
    classes = cut(points.join(linked, "fp", "left").select("fp", first["doc_id"].alias("component_id"), first["row"].alias("keep_row")))
    done(points, labels)
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", (F.col("row") == F.col("keep_row")).alias("kept"), "row")


def _sketches(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            sets = [shingles(t or b"", width) for t in texts]
            prints = np.array([print_of(x) for x in sets], np.uint64).view(np.int64)
            keys = pa.array([bands(x).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("row"), pa.array(prints), keys], names=["row", "fp", "keys"])

    return run


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        bits += np.unpackbits(hashes[i : i + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def keep_near(docs: DataFrame, width: int = 5, least: float = 0.8, distance: int = 4) -> DataFrame:
    """The first row of each component of texts whose sets of ``width``-word shingles have a similarity of ``least`` or
    more, with the columns of ``docs``, which must be a stored table, so that a second scan gives its rows in the same order.

    The trees link texts whose fingerprints differ in ``distance`` bits or fewer. A pair at 0.8 differs in about ten bits of 64,
    where no branch of a tree can be pruned, so ``similar_links`` finds the links that are farther apart.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    sketches = cut(texts.select("row", "text").mapInArrow(_sketches(width), "row long, fp long, keys array<bigint>"))
    points = cut(sketches.groupBy("fp").agg(F.min("row").alias("rep")))
    near = cut(near_links(points.select("fp"), distance))
    ends = [points.select(F.col("fp").alias(c), F.col("rep").alias(r)) for c, r in (("a", "row"), ("b", "other"))]
    far = near.join(ends[0], "a").join(ends[1], "b").select("row", "other")
    copies = sketches.join(points, "fp").where("row <> rep").select("row", F.col("rep").alias("other"))
    links = similar_links(texts.select("row", "text"), sketches.select("row", F.explode("keys").alias("key")), cut(far.union(copies)), width, least)
    labels = connected_components(links)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    linked = cut(texts.select("doc_id", "row").join(labels, F.col("row") == labels.node).select("doc_id", "row", "root"))
    firsts = cut(linked.groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.row").alias("row")))
    gone = cut(linked.select("row").join(firsts, "row", "left_anti"))
    done(sketches, points, near, links, labels, linked, firsts)
    mark = "__plumbline_row"
    return docs.withColumn(mark, F.monotonically_increasing_id()).join(gone.withColumnRenamed("row", mark), mark, "left_anti").drop(mark)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
