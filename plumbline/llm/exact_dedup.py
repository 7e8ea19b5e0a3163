"""Exact deduplication by deterministic block naming (operator 5).

A text, without the characters of ``[\\x20\\x09-\\x0D]``, is cut into blocks of a fixed number
of bytes. The distinct blocks are sorted and get integer names; then adjacent names are taken
as pairs, the distinct pairs get names in turn, until one name is left for each document.
Documents with as many blocks and the same last name have equal texts: a name stands for one
block or one pair, never for a hash.

Only distinct blocks travel as text, once, after each task has dropped its own repeats. The
references to them carry a 128-bit key; the naming step holds key and text together, and if two texts ever
share a key the blocks get new keys from another seed, so no key can merge two texts. Hot blocks, pairs and groups are
counted before they are shuffled, and the joins have written tables on both sides, which
adaptive execution splits.

Defined results: null counts as empty, all empty texts are one group; repeated rows are members
of one group, of which one row stays; a null doc_id sorts last; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, done, prepare, table

SPACE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 4096

_REFS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("n", pa.int32()), ("key", pa.binary()), ("chars", pa.int64()), ("sha", pa.binary())]
)


def _normal(column: pa.Array) -> list[bytes]:
    return [(x or b"").translate(None, SPACE) for x in column.cast(pa.binary()).to_pylist()]


def _pieces(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [b""]


def _distinct_blocks(size: int, key):
    def run(batches):
        for batch in batches:
            seen = {p for text in _normal(batch.column("text")) for p in _pieces(text, size)}
            blocks = sorted(seen)
            for i in range(0, len(blocks), 4096):
                part = blocks[i : i + 4096]
                yield pa.record_batch(
                    [pa.array([key(b) for b in part], pa.binary()), pa.array(part, pa.binary())],
                    names=["key", "block"],
                )

    return run


def _references(size: int, key):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in _REFS]
            rows = zip(
                batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(),
                batch.column("chars").to_pylist(), _normal(batch.column("text")), strict=True,
            )
            for row, doc_id, chars, text in rows:
                parts = _pieces(text, size)
                sha = hashlib.sha256(text).digest()
                for i, part in enumerate(parts):
                    for to, x in zip(out, (row, doc_id, i, len(parts), key(part), None if i else chars, None if i else sha), strict=True):
                        to.append(x)
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, _REFS, strict=True)], schema=_REFS)

    return run


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integer names in sorted order; the same names again if a task is run again."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, digest=xxhash.xxh3_128_digest) -> DataFrame:
    """``row, doc_id, n, name, chars, sha`` of each row of ``docs(doc_id, text)``.

    ``row`` is the row's number in ``docs`` as read (a file scan gives the same again);
    (n, name) is the identity of the text. ``digest(block, seed=)`` makes the keys.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for seed in range(1 << 30):
        key = partial(digest, seed=seed)
        blocks = texts.select("text").mapInArrow(_distinct_blocks(block_bytes, key), "key binary, block binary").distinct()
        names = cut(_named(blocks, ["block"]).select("key", "name"))
        if names.groupBy("key").count().where("count > 1").isEmpty():
            break
        done(names)
    refs = (
        texts.withColumn("row", F.monotonically_increasing_id())
        .withColumn("chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
        .mapInArrow(_references(block_bytes, key), "row long, doc_id long, pos int, n int, key binary, chars long, sha binary")
    )
    level = cut(refs.join(names, "key").select("row", "doc_id", "pos", "n", "name", "chars", "sha"))
    heads = level.where("pos = 0").select("row", "doc_id", "n", "chars", "sha")
    done(names)
    used, ends = [level], level.where("n = 1").select("row", "name")
    rest = level.where("n > 1").select("row", "pos", F.col("n").alias("left"), "name")
    while not rest.isEmpty():
        pairs = cut(
            rest.groupBy("row", F.expr("pos div 2").cast("int").alias("pos"), F.expr("(left + 1) div 2").cast("int").alias("left"))
            .agg(F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("x"), F.coalesce(F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))), F.lit(-1)).alias("y"))
        )
        names = cut(_named(pairs.select("x", "y").distinct(), ["x", "y"]))
        level = cut(pairs.join(names, ["x", "y"]).select("row", "pos", "left", "name"))
        done(pairs, names)
        used.append(level)
        ends = ends.union(level.where("left = 1").select("row", "name"))
        rest = level.where("left > 1")
    found = cut(heads.join(ends, "row"))
    done(*used)
    return found


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, row``.

    Of equal texts, the row with the most code points in the original text stays, then the one
    with the smallest doc_id, then the first row.
    """
    ids = identities(docs, block_bytes)
    best = F.min(F.struct(-F.col("chars"), F.col("doc_id").isNull(), "doc_id", "row"))
    groups = cut(
        ids.groupBy("n", "name").agg(best.alias("best"), F.count("*").alias("group_size"))
        .select("n", "name", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    )
    return ids.join(groups, ["n", "name"]).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "row",
    )


def keep_exact(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. ``docs`` must be a stored table, so
    that a second scan gives its rows in the same order."""
    mark = "__plumbline_row"
    kept = cut(exact_dedup(docs, block_bytes).where("kept").select(F.col("row").alias(mark)))
    return docs.withColumn(mark, F.monotonically_increasing_id()).join(kept, mark, "left_semi").drop(mark)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


OP5_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
