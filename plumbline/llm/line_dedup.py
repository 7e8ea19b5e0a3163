"""Lines that many documents share are dropped (operator 12).

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case. A key of at least
``least`` code points that is found in at least ``min_docs`` documents loses its lines in every document.

Keys are known by 128-bit hashes. A block of documents gives each of its distinct keys once, with the number
of documents that hold it, packed into arrays. Key space is cut into shards by the hashes' first bits, and a task
for each shard builds a minimal perfect hash over the shard's distinct keys: level after level of bits, where a
key takes the first level on which no other remaining key falls on its bit; its slot is the number of bits set before. A slot
indexes two arrays, a 32-bit fingerprint and the count of documents. Such a shard is one row of the index,
about 8.5 bytes a key, which can be written and used again for other documents.

Documents probe the arrays, a block and shard at a time: a shard's task gets the packed hashes of each block, looks them all up
at once and answers with one bit a hash. No row is ever made for a line. The answers of a block's shards
meet the block's texts again in one task, which holds a block of about 8 million characters.

A key that the index holds is found with certainty; one that it doesn't hold (documents that the index was not built
from) passes for another with a probability of 2^-32.

A common line is one entry in each block, however often it occurs there. Shards are as many as the keys ask for,
and never less than the shuffle partitions.

Defined results: a null text is empty; an empty text is one empty line; lines end at ``\\n`` only; a text that loses all lines is
empty; equal rows are documents each; a null doc_id stays null; an empty table gives no rows; other columns are not looked at. A
table that yields other rows when it is read again stops the query.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.blocks import BLOCK_CHARS, blocks
from plumbline.llm.common import cut, done, prepare, table

MIN_DOCS = 10
#: Keys of a shard, as far as shards can be told apart by their bits.
SHARD_KEYS = 1 << 19
#: Bits of a level for each key that is left.
GAMMA = 1.5
_LEVELS = 200
_FACTOR, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(32)


def key(line: bytes) -> bytes:
    return line.strip().lower()


def hashed(keys: Iterable[bytes]) -> np.ndarray:
    """128-bit hashes, a row of two uint64 each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").astype(np.uint64).reshape(-1, 2)


def _level(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Each key's place on a level of so many bits."""
    x = keys[:, 0] + keys[:, 1] * np.uint64(2 * level + 1)
    x = (x ^ (x >> _SHIFT)) * _FACTOR
    x = (x ^ (x >> np.uint64(29))) * _FACTOR
    return (x ^ (x >> _SHIFT)) % np.uint64(bits)


def perfect_hash(keys: np.ndarray) -> list[bytes]:
    """The levels of a minimal perfect hash over distinct keys, as packed bits."""
    levels: list[bytes] = []
    while len(keys):
        if len(levels) == _LEVELS:
            raise ValueError("keys are not distinct")
        bits = 8 * (int(GAMMA * len(keys)) // 8 + 1)
        place = _level(keys, len(levels), bits).astype(np.int64)
        alone = np.bincount(place, minlength=bits) == 1
        levels.append(np.packbits(alone).tobytes())
        keys = keys[~alone[place]]
    return levels


def slots(levels: list[bytes], keys: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for a key that no level takes."""
    out, left, base = np.full(len(keys), -1), np.arange(len(keys)), 0
    for number, packed in enumerate(levels):
        alone = np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        place = _level(keys[left], number, len(alone)).astype(np.int64)
        taken = alone[place]
        out[left[taken]] = base + np.cumsum(alone)[place[taken]] - 1
        left, base = left[~taken], base + int(alone.sum())
    return out


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (keys[:, 1] >> _SHIFT).astype(np.uint32)


def _keys_of(text: str | None) -> set[bytes]:
    return set(map(key, (text or "").encode().split(b"\n")))


def _counts(k: bytes, least: int) -> bool:
    return len(k) >= least and (least <= 1 or len(k.decode()) >= least)


def _sorted(keys: Iterable[bytes]) -> tuple[list[bytes], np.ndarray]:
    keys = list(keys)
    found = hashed(keys)
    order = np.lexsort((found[:, 1], found[:, 0]))
    return [keys[i] for i in order], found[order]


def _cuts(hashes: np.ndarray, bits: int):
    """(shard, first, stop) of each shard that sorted hashes fall into."""
    shards = (hashes[:, 0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    edges = [*np.flatnonzero(np.diff(shards, prepend=-1)).tolist(), len(shards)]
    return [(int(shards[a]), a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _gathered(size: int, least: int):
    """Distinct keys of each block with the number of its documents that hold them."""

    def run(batches):
        for number, rows in blocks(batches, size):
            held: Counter = Counter()
            for _, text in rows:
                held.update(_keys_of(text))
            keys, hashes = _sorted(k for k in held if _counts(k, least))
            counts = np.array([held[k] for k in keys], np.uint32)
            yield pa.record_batch([pa.array([number]), pa.array([len(keys)]), pa.array([hashes.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["block", "size", "hashes", "counts"])

    return run


def _sliced(bits: int):
    def run(batches):
        for batch in batches:
            for number, packed, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "hashes", "counts")), strict=True):
                hashes = np.frombuffer(packed, np.uint64).reshape(-1, 2)
                rows = [(s, number, packed[16 * a : 16 * b], counts[4 * a : 4 * b]) for s, a, b in _cuts(hashes, bits)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "hashes", "counts"])

    return run


def _hashes(packed: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), np.uint64).reshape(-1, 2)


def _indexed(slices: pa.Table) -> pa.Table:
    """A shard of the index."""
    keys, counts = _hashes(slices["hashes"]), np.frombuffer(b"".join(slices["counts"].to_pylist()), np.uint32)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(1))))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    levels = perfect_hash(keys)
    at = slots(levels, keys)
    prints, held = np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
    prints[at], held[at] = _fingerprints(keys), counts
    small = held.astype(np.uint32) if held.max() < 1 << 32 else held
    return pa.table({"shard": slices["shard"][:1], "levels": pa.array([levels], pa.list_(pa.binary())), "prints": pa.array([prints.tobytes()], pa.binary()), "counts": pa.array([small.tobytes()], pa.binary())})


def _probed(min_docs: int):
    """Which hashes of each block's slice the arrays of the shard count in ``min_docs`` documents, a bit each."""

    def run(slices: pa.Table, index: pa.Table) -> pa.Table:
        parts = slices["hashes"].to_pylist()
        common = np.zeros(sum(map(len, parts)) // 16, bool)
        if len(index) and len(common):
            keys = _hashes(slices["hashes"])
            prints = np.frombuffer(index["prints"][0].as_py(), np.uint32)
            counts = index["counts"][0].as_py()
            counts = np.frombuffer(counts, np.uint32 if len(counts) == 4 * len(prints) else np.int64)
            at = slots(index["levels"][0].as_py(), keys)
            common = (at >= 0) & (prints[at] == _fingerprints(keys)) & (counts[at] >= min_docs)
        ends = np.cumsum([len(p) // 16 for p in parts])
        bits = [np.packbits(x).tobytes() for x in np.split(common, ends[:-1])] if parts else []
        return pa.table({"block": slices["block"], "shard": slices["shard"], "check": pa.array(list(map(zlib.crc32, parts)), pa.int64()), "bits": pa.array(bits, pa.binary())})

    return run


def _tagged(size: int):
    def run(batches):
        for number, rows in blocks(batches, size):
            for first in range(0, len(rows), 1000):
                part = rows[first : first + 1000]
                yield pa.record_batch([pa.array([number] * len(part)), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] or "" for r in part])], names=["block", "doc_id", "text"])

    return run


def _dropped(bits: int, least: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        split = [t.encode().split(b"\n") for t in docs["text"].to_pylist()]
        own = [list(map(key, lines)) for lines in split]
        keys, hashes = _sorted(k for k in set().union(*own) if _counts(k, least))
        said = dict(zip(answers["shard"].to_pylist(), zip(answers["check"].to_pylist(), answers["bits"].to_pylist(), strict=True), strict=True))
        gone: set[bytes] = set()
        cuts = _cuts(hashes, bits)
        if len(cuts) != len(said):
            raise ValueError("the documents are not those whose lines were looked up")
        for shard, first, stop in cuts:
            check, packed = said.get(shard, (None, b""))
            if check != zlib.crc32(hashes[first:stop].tobytes()):
                raise ValueError("the documents are not those whose lines were looked up")
            gone.update(keys[first + i] for i in np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8))[: stop - first]).tolist())
        kept = [[line for line, k in zip(lines, ks, strict=True) if k not in gone] for lines, ks in zip(split, own, strict=True)]
        return pa.table({
            "doc_id": docs["doc_id"], "n_lines": pa.array(list(map(len, split)), pa.int64()), "n_dropped": pa.array([len(a) - len(b) for a, b in zip(split, kept, strict=True)], pa.int64()),
            "kept": pa.array([b"\n".join(k).decode() for k in kept], pa.string()),
        })

    return run


_SLICES = "shard long, block long, hashes binary, counts binary"


def _rows(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _gather(docs: DataFrame, size: int, least: int) -> DataFrame:
    return cut(_rows(docs).mapInArrow(_gathered(size, least), "block long, size long, hashes binary, counts binary"))


def _shard_bits(gathered: DataFrame, shard_keys: int) -> int:
    keys = gathered.agg(F.sum("size")).first()[0] or 0
    shards = max(keys / shard_keys, int(gathered.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return min(40, int(np.ceil(np.log2(shards))))


def _index(gathered: DataFrame, bits: int) -> DataFrame:
    built = gathered.mapInArrow(_sliced(bits), _SLICES).groupBy("shard").applyInArrow(_indexed, "shard long, levels array<binary>, prints binary, counts binary")
    return built.withColumn("shard_bits", F.lit(bits))


def line_index(docs: DataFrame, least: int = 1, block_chars: int = BLOCK_CHARS, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """The index over the lines of ``docs(text)``: ``shard, levels, prints, counts, shard_bits``, a row for each shard."""
    gathered = _gather(docs.select("text", F.lit(None).alias("doc_id")), block_chars, least)
    return _index(gathered, _shard_bits(gathered, shard_keys))


def drop_lines(
    docs: DataFrame, index: DataFrame | None = None, min_docs: int = MIN_DOCS, least: int = 1, block_chars: int = BLOCK_CHARS, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept`` for each row of ``docs(doc_id, text)``; lines are counted in ``docs``,
    or in the documents of an ``index`` that was made with ``line_index`` (with the same ``least``) and written."""
    gathered = _gather(docs, block_chars, least)
    if index is None:
        bits = _shard_bits(gathered, shard_keys)
        index = _index(gathered, bits)
    else:
        row = index.select("shard_bits").first()
        bits = row[0] if row else 0
    slices = gathered.mapInArrow(_sliced(bits), _SLICES)
    answers = cut(slices.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probed(min_docs), "block long, shard long, check long, bits binary"))
    done(gathered)
    tagged = _rows(docs).mapInArrow(_tagged(block_chars), "block long, doc_id long, text string")
    return tagged.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_dropped(bits, least), "doc_id long, n_lines long, n_dropped long, kept string")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: The rule itself, over rows of lines.
OP12_SQL = """
WITH numbered AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
  SELECT row, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, lines, unnest(generate_series(1, len(lines))) AS i FROM numbered)
),
common AS (SELECT key FROM line WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
kept AS (
  SELECT row, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM common)), '') AS text
  FROM line GROUP BY row
)
SELECT n.doc_id, k.n_lines, k.n_dropped, sha256(k.text) AS kept_sha256 FROM numbered n JOIN kept k USING (row)
"""
