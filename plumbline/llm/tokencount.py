"""Token counts of flat token files by a separator scan (operator 9).

A token file is nothing but ids of one width, one document after the other, each ended by the
end-of-document id; there is no index. Files are cut into blocks of ``BLOCK_BYTES``; only names and
sizes are listed, and a task reads the bytes of its blocks. A block is
searched with one vectorised comparison; it reports the counts between its separators, what
stands before the first and after the last, and its size. A prefix scan over the blocks of
a file (sums of separators and tokens, and the last separator's place so far) gives each block
the number of its first document and the tokens that it inherits, which stitches documents
across any number of blocks.

``write_token_files`` makes such files with Spark's own writer, so they can be in any store: ids
are big-endian 16-bit, and the separator is 0xC480 = 50304, no id of the vocabulary, whose bytes
are the UTF-8 form of one character, which the writer puts after each document.

Defined results: a null text is an empty document with no tokens; ids after the last separator
are a document with ``ended`` false; an empty file has no documents; a file whose size is no
multiple of the width stops the query, and so does a document of the table that is not found in the files; files may
have any size; repeated rows and ids are counted each; an empty table gives no rows; other columns are not looked at.

A store that pyarrow knows (local, HDFS, S3, GCS) is read in ranges of ``RANGE`` bytes, whatever a file's size. A store that only
Spark knows has no ranges for Python; its files come whole through Spark, which reads files below 2 GB so.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, delete, prepare, scratch, table
from plumbline.llm.tokens import RANKS, TOKENIZER, encoder

END = 0xC480
END_TEXT = b"\xc4\x80".decode()
BLOCK_BYTES = 1 << 20
RANGE = 1 << 24
#: Neighbouring blocks that one task adds up.
GROUP = 4096


def _encoded(tokenizer: str, ranks: str):
    def run(batches):
        encode = encoder(tokenizer, ranks).encode
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.record_batch([pa.array([encode(t or "").astype(">u2").tobytes() for t in texts], pa.binary())], names=["ids"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, ranks: str = RANKS) -> None:
    """Writes the texts of ``docs`` as flat token files, one for each partition, in row order. Files never roll over."""
    prepare(docs.sparkSession)
    ids = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_encoded(tokenizer, ranks), "ids binary")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", END_TEXT).option("maxRecordsPerFile", 0).text(path)


def scan_block(block: bytes, dtype: str, end: int) -> tuple[int, int, int, int, np.ndarray]:
    """Tokens and separators of a block, tokens before the first separator (all if there is none) and
    after the last, and the counts between separators. Separators are no tokens."""
    ids = np.frombuffer(block, dtype)
    at = np.flatnonzero(ids == end)
    if not len(at):
        return len(ids), 0, len(ids), len(ids), at
    return len(ids) - len(at), len(at), int(at[0]), len(ids) - 1 - int(at[-1]), np.diff(at) - 1


_SCAN = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("tokens", pa.int64()), ("ends", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("between", pa.list_(pa.int64()))]
)


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _SCAN, strict=True)], schema=_SCAN)


def _scanned(dtype: str, end: int):
    def run(batches):
        for batch in batches:
            for path, number, block in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "bytes")), strict=True):
                yield _rows([(path, number, *scan_block(block, dtype, end))])

    return run


def _ranged(dtype: str, end: int, block_bytes: int, range_bytes: int):
    """The blocks of ``range_bytes`` of a file, from block ``first`` on."""

    def run(batches):
        for batch in batches:
            for path, first in zip(*(batch.column(c).to_pylist() for c in ("path", "first")), strict=True):
                store, name = _opened(path)
                with store.open_input_file(name) as file:
                    for number in range(first, first + range_bytes // block_bytes):
                        block = file.read_at(min(block_bytes, max(0, file.size() - number * block_bytes)), number * block_bytes)
                        if len(block):
                            yield _rows([(path, number, *scan_block(block, dtype, end))])

    return run


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def in_ranges(path: str) -> bool:
    """Whether a file is in a store that can be read in ranges from Python."""
    try:
        _opened(path)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def placed_blocks(scanned: DataFrame, group: int = GROUP) -> DataFrame:
    """The prefix scan: adds to each block's counts ``before`` (separators of the file before it) and ``carried`` (tokens since the last of them).

    It is in two steps, so that no task sees all blocks of a file: within groups of ``group`` neighbouring blocks, and over the groups' sums.
    What stands between separators takes no part.
    """
    of = Window.partitionBy("path", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    own = scanned.select("path", "block", "tokens", "ends", "head", "tail", F.floor(F.col("block") / group).alias("group"))
    own = own.withColumn("o_ends", F.coalesce(F.sum("ends").over(of), nothing)).withColumn("o_seen", F.coalesce(F.sum("tokens").over(of), nothing))
    own = own.withColumn("last_end", F.when(F.col("ends") > 0, F.col("o_seen") + F.col("tokens") - F.col("tail"))).withColumn("o_last", F.max("last_end").over(of))
    sums = own.groupBy("path", "group").agg(F.sum("ends").alias("g_ends"), F.sum("tokens").alias("g_tokens"), F.max("last_end").alias("g_last"))
    over = Window.partitionBy("path").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("b_ends", F.coalesce(F.sum("g_ends").over(over), nothing)).withColumn("b_seen", F.coalesce(F.sum("g_tokens").over(over), nothing))
    sums = sums.withColumn("b_last", F.coalesce(F.max(F.col("b_seen") + F.col("g_last")).over(over), nothing))
    rows = own.join(sums.select("path", "group", "b_ends", "b_seen", "b_last"), ["path", "group"])
    last = F.coalesce(F.col("b_seen") + F.col("o_last"), F.col("b_last"))
    return rows.select("path", "block", "ends", "head", "tail", (F.col("b_ends") + F.col("o_ends")).alias("before"), (F.col("b_seen") + F.col("o_seen") - last).alias("carried"))


def token_counts(spark: SparkSession, path: str, dtype: str = ">u2", end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path, ordinal, tokens, ended`` of each document of the token files below ``path``; ordinal
    counts from 0 in each file."""
    prepare(spark)
    width = np.dtype(dtype).itemsize
    if block_bytes % width:
        raise ValueError("a block holds whole tokens")
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    wrong = F.when(F.col("length") % width != 0, F.raise_error(F.concat(F.lit("not a whole number of tokens: "), F.col("path"))))
    files = files.where(wrong.isNull())
    final = ((F.col("length") - 1) / block_bytes).cast("long")
    schema = "path string, block long, tokens long, ends long, head long, tail long, between array<bigint>"
    some = files.select("path").limit(1).collect()
    if some and in_ranges(some[0][0]):
        step = max(1, RANGE // block_bytes)
        first = F.explode(F.sequence(F.lit(0).cast("long"), final, F.lit(step).cast("long")))
        ranges = files.select("path", first.alias("first"))  # names and sizes only
        scanned = ranges.repartition("path", "first").mapInArrow(_ranged(dtype, end, block_bytes, step * block_bytes), schema)
    else:
        rows = files.select("path", "content", F.explode(F.sequence(F.lit(0).cast("long"), final)).alias("block"))
        start = (F.col("block") * block_bytes + 1).cast("int")
        scanned = rows.select("path", "block", F.substring(F.col("content"), start, F.lit(block_bytes)).alias("bytes")).mapInArrow(_scanned(dtype, end), schema)
    scanned = cut(scanned)
    placed = placed_blocks(scanned)
    counts = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("between"))).otherwise(F.array().cast("array<bigint>"))
    ended = scanned.select("path", "block", "between").join(placed, ["path", "block"]).select("path", "before", F.posexplode(counts).alias("n", "tokens"), F.lit(True).alias("ended"))
    rest = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail"))
    end_block = scanned.groupBy("path").agg(F.max("block").alias("block"))
    open_ = placed.join(end_block, ["path", "block"]).where(rest > 0).select("path", (F.col("before") + F.col("ends")).alias("before"), F.lit(0).alias("n"), rest.alias("tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(open_).select("path", (F.col("before") + F.col("n")).alias("ordinal"), "tokens", "ended")


def count_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens`` of each row of ``docs(doc_id, text)``, a stored table: writes flat token
    files to the checkpoint folder, counts them there, and removes them."""
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch(spark, "tokens")
    write_token_files(docs, folder)
    found = token_counts(spark, folder)
    # Spark numbers the files by partition, and rows as monotonically_increasing_id does
    part = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long")
    found = cut(found.select((F.shiftleft(part, 33) + F.col("ordinal")).alias("row"), "tokens"))
    delete(spark, folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    lost = F.raise_error(F.lit("the token files lack a document")).cast("long")
    return rows.join(found, "row", "left").select("doc_id", F.when(F.col("tokens").isNull(), lost).otherwise(F.col("tokens")).alias("n_tokens"))


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
