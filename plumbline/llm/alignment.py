"""Alignment of two tokenizers' tokens over the same bytes, and how often ids meet in the corpus (operator 13).

Tokenizer A is a byte-level BPE file, B a sentencepiece model that puts a space before a text, so A gets the text with
one. Each byte of a text has an owner among A's tokens and one among B's: token numbers repeated by the tokens' lengths in
bytes. A new pair of owners is a link, two tokens that overlap; where both owners change at once both tokenizers
cut, and a group ends.

Texts are encoded in chunks of white space and a word. Neither tokenizer has a token that reaches from a character
that is no white space into white space (for B that is looked up in its pieces), so the ids of the chunks are the ids of the text, and chunks that
occur again are looked up. Groups never cross chunks either, and a text of any length is aligned ``SPAN`` bytes
at a time. A text with one of the characters 1C to 1F, on which the notions of white space differ, is one chunk.

Each text is encoded once. What a document needs later, its distinct pairs of ids with their numbers of links, is written to the
checkpoint folder; a block of documents gives each of its distinct pairs once with the number of its documents that hold
it. Pairs are summed up over blocks, and each block gets the counts of its own pairs back in one table,
sorted, where all its links look them up at once. So what is shuffled is the pairs of blocks, not those of
documents, and a pair that is everywhere is one row in each block. The highest count of each id of A, the one thing that is
broadcast, has a row for each entry of A's vocabulary at most.

Defined results: texts that are null or empty, and those that B's pieces don't spell byte by byte (U+2581 among them), have no tokens: zeros, and ''
for the groups. Names of special tokens in a text are plain text. Equal rows are documents each; a null doc_id
stays null; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.blocks import blocks
from plumbline.llm.common import cut, delete, prepare, scratch, table
from plumbline.llm.tokens import RANKS, TOKENIZER, Encoder

PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Characters of a block of documents.
BLOCK = 1 << 24
#: Bytes that are aligned at once, and chunks that are remembered, of so many characters at most.
SPAN, REMEMBERED, CHUNK_CHARS = 1 << 20, 1 << 18, 64
_CHUNKS = re.compile(r"\s*\S+|\s+")
_UNCLEAR = re.compile("[\x1c-\x1f]")


def entry_bytes(vocabulary: dict[str, int]) -> dict[int, bytes]:
    """Byte-level entries as bytes: printable Latin-1 characters stand for themselves, the other bytes for 256 upwards."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    return {i: bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode() for entry, i in vocabulary.items()}


@dataclass
class Alignment:
    """Of one text; ``pairs`` are ``a << 32 | b`` in order, ``times`` their numbers of links."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    n_links: int = 0
    groups_sha256: str = ""
    groups: str = ""
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    times: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Aligner:
    """Aligns texts; remembers chunks."""

    def __init__(self, tokenizer: str, ranks: str, pieces: str):
        self.a = Encoder(tokenizer, ranks, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        held = entry_bytes(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True))
        self.length_a = np.zeros(max(held) + 1, np.int64)
        self.length_a[list(held)] = list(map(len, held.values()))
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.length_b = np.array(list(map(len, self.bytes_b)))
        self.cuts = not any(re.search(r"\S\s|\n.", p.replace("▁", " "), re.S) for i, p in enumerate(names) if not self.b.is_byte(i))
        self.lead = len(self.b.encode("\n"))
        self.width = np.array([len(str(i)) for i in range(max(len(self.length_a), len(names)))])
        self.digits = np.frombuffer(b"".join(str(i).encode().ljust(int(self.width[-1]) + 1) for i in range(len(self.width))), np.uint8).reshape(len(self.width), -1)
        self.known: dict[str, tuple[bytes, bytes] | None] = {}

    def encoded(self, chunk: str) -> tuple[bytes, bytes] | None:
        """The ids of both as bytes; nothing if B's pieces do not spell the chunk."""
        a = self.a.encode(chunk)
        b = self.b.encode(chunk[1:]) if chunk[0] == " " and len(chunk) > 1 else self.b.encode("\n" + chunk)[self.lead :]
        if b"".join(map(self.bytes_b.__getitem__, b)) != chunk.encode():
            return None
        return a.astype(np.uint32).tobytes(), np.array(b, np.uint32).tobytes()

    def chunks(self, text: str) -> Iterable[str]:
        if not self.cuts or _UNCLEAR.search(text):
            return (text,)
        return _CHUNKS.findall(text) if len(text) <= SPAN else (m[0] for m in _CHUNKS.finditer(text))

    def look(self, chunk: str) -> tuple[bytes, bytes] | None:
        found = self.encoded(chunk)
        if len(chunk) <= CHUNK_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[chunk] = found
        return found

    def spans(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of A and of B, span by span; ends with None where B does not spell the text."""
        a, b, held, known = [], [], 0, self.known
        for chunk in self.chunks(" " + text):
            found = known[chunk] if chunk in known else self.look(chunk)
            if found is None:
                yield None
                return
            a.append(found[0])
            b.append(found[1])
            held += len(chunk)
            if held >= SPAN:
                yield np.frombuffer(b"".join(a), np.uint32), np.frombuffer(b"".join(b), np.uint32)
                a, b, held = [], [], 0
        if a:
            yield np.frombuffer(b"".join(a), np.uint32), np.frombuffer(b"".join(b), np.uint32)

    def align(self, text: str | None, keep: bool = False) -> Alignment:
        out, tail, said = Alignment(), b"", []
        digest, codes, times = hashlib.sha256(), [], []
        for span in self.spans(text) if text else ():
            if span is None:
                return Alignment()
            ids_a, ids_b = span
            link_a, link_b, group_a, group_b = overlaps(self.length_a[ids_a], self.length_b[ids_b])
            out.n_a, out.n_b, out.n_groups, out.n_links = out.n_a + len(ids_a), out.n_b + len(ids_b), out.n_groups + int(group_a[-1]) + 1, out.n_links + len(link_a)
            found, often = np.unique(ids_a[link_a].astype(np.int64) << 32 | ids_b[link_b], return_counts=True)
            codes.append(found)
            times.append(often)
            words = self.written(ids_a, ids_b, group_a, group_b)
            digest.update(tail + words[:-1])
            if keep:
                said.append(tail + words[:-1])
            tail = b";"
        if codes:
            out.pairs, out.times = summed(codes, times)
            out.groups_sha256, out.groups = digest.hexdigest(), b"".join(said).decode()
        return out

    def written(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3;`` of the groups in order."""
        upto_a, upto_b = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        ids, ends = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[np.arange(len(ids_a)) + np.concatenate(([0], upto_b))[group_a]] = ids_a
        ids[np.arange(len(ids_b)) + upto_a[group_b]] = ids_b
        ends[upto_a + np.concatenate(([0], upto_b[:-1])) - 1] = ord("|")
        ends[upto_a + upto_b - 1] = ord(";")
        signs, width = self.digits[ids], self.width[ids]
        signs[np.arange(len(ids)), width] = ends
        return signs[np.arange(signs.shape[1]) <= width[:, None]].tobytes()


def overlaps(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of each link, and each token's group, of two cuts of the same bytes."""
    owner_a, owner_b = (np.repeat(np.arange(len(x), dtype=np.int32), x) for x in (length_a, length_b))
    new_a, new_b = owner_a[1:] != owner_a[:-1], owner_b[1:] != owner_b[:-1]
    links = np.flatnonzero(np.concatenate(([True], new_a | new_b)))
    cuts = np.flatnonzero(new_a & new_b) + 1
    group_a, group_b = (np.searchsorted(cuts, np.cumsum(x) - x, "right") for x in (length_a, length_b))
    return owner_a[links], owner_b[links], group_a, group_b


def summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and the sums of their times."""
    if len(codes) == 1:
        return codes[0], times[0]
    found, at = np.unique(np.concatenate(codes), return_inverse=True)
    return found, np.bincount(at, np.concatenate(times)).astype(np.int64)


@lru_cache(maxsize=2)
def aligner(tokenizer: str = TOKENIZER, ranks: str = RANKS, pieces: str = PIECES) -> Aligner:
    return Aligner(tokenizer, ranks, pieces)


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_HELD = "block long, is_block boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs array<bigint>, times array<bigint>"


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values).astype(np.int64)))


def _encoded(tokenizer: str, ranks: str, pieces: str, keep: bool, size: int):
    def run(batches):
        align = aligner(tokenizer, ranks, pieces).align

        def batch_of(block, ids, found, is_block=False):
            n = len(found)
            return pa.record_batch([
                pa.array([block] * n), pa.array([is_block] * n), pa.array(ids, pa.int64()), *(pa.array([getattr(x, c) for x in found], pa.int64()) for c in _COUNTS),
                pa.array([x.groups_sha256 for x in found]), pa.array([x.groups if keep else None for x in found], pa.string()), _lists([x.pairs for x in found]), _lists([x.times for x in found]),
            ], names=[c.split()[0] for c in _HELD.split(", ")])

        for block, rows in blocks(batches, size):
            own = []
            for first in range(0, len(rows), 1000):
                part = rows[first : first + 1000]
                found = [align(text, keep) for _, text in part]
                yield batch_of(block, [i for i, _ in part], found)
                own.append(np.concatenate([x.pairs for x in found]))
            pairs, docs = np.unique(np.concatenate(own), return_counts=True)
            yield batch_of(block, [None], [Alignment(pairs=pairs, times=docs)], is_block=True)

    return run


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Looks up all links of a block's documents in the block's counts."""
    counts = counts.sort_by("pair")
    keys, count, best = (counts[c].to_numpy() for c in ("pair", "count", "best"))
    out = docs.select(["doc_id", *_COUNTS])
    pairs, times = docs["pairs"].combine_chunks(), docs["times"].combine_chunks()
    ends = np.concatenate(([0], np.cumsum(pairs.value_lengths().to_numpy())))
    pairs, times = pairs.flatten().to_numpy(), times.flatten().to_numpy()
    if not len(keys) and len(pairs):
        raise ValueError("a block without counts")
    at = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
    if len(pairs) and (keys[at] != pairs).any():
        raise ValueError("a pair without a count")
    for name, value in (("n_best", times * best[at]), ("count_sum", times * count[at])) if len(pairs) else (("n_best", times), ("count_sum", times)):
        upto = np.concatenate(([0], np.cumsum(value.astype(np.int64))))
        out = out.append_column(name, pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"]).append_column("groups", docs["groups"])


def align(docs: DataFrame, keep_groups: bool = False, tokenizer: str = TOKENIZER, ranks: str = RANKS, pieces: str = PIECES, block_chars: int = BLOCK) -> DataFrame:
    """A row for each of ``docs(doc_id, text)``: ``doc_id, n_a, n_b, n_groups, n_links``, ``n_best`` (links whose pair of ids
    is in as many documents as any pair with that id of A), ``count_sum`` (documents of a link's pair, over links), ``groups_sha256``, and ``groups`` if asked for."""
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch(spark, "alignment")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(_encoded(tokenizer, ranks, pieces, keep_groups, block_chars), _HELD).write.parquet(folder)
    held = spark.read.parquet(folder)
    own = held.where("is_block").select("block", F.explode(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("docs"))).alias("x")).select("block", "x.pair", "x.docs")
    counts = own.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))  # at most a row for each entry of A's vocabulary
    counts = counts.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    asked = own.select("block", "pair").join(counts, "pair")
    scored = spark.read.parquet(folder).where("NOT is_block").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_scored, _RESULT)
    result = cut(scored)
    delete(spark, folder)
    return result if keep_groups else result.drop("groups")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
