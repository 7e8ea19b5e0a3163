"""Vector bin packing of tokenised examples into training sequences (operator 7).

An example has three demands: tokens, one segment, and loss-bearing tokens. It goes to the open
sequence whose remaining room has the largest dot product with the demands (both as shares of
the limits), among those with room for the whole. If none has, a new sequence opens, up to
``OPEN_BINS`` of them; beyond that the example is cut and fills the best sequence to its end.
What is open at the end of a partition is laid out anew, cut so that sequences are full and the rest is
powers of two, which need no padding.

Each partition of the input packs its own rows as a stream: no shuffle, no key that could be
hot, memory for the open sequences and one example only. A partition's result depends on its
rows alone, so a task that runs again gives the same pieces. Sequence ids carry the partition.

Defined results: a null text is empty (its one id is the end-of-text id); a null prompt is
empty; equal rows are packed each on their own; an empty table gives no pieces; other columns
are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import prepare, table
from plumbline.llm.tokens import RANKS, TOKENIZER, encoder

OPEN_BINS = 16

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("loss_tokens", pa.int64()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


@dataclass(eq=False)
class Example:
    doc_id: int | None
    ids: np.ndarray
    free: int  # its first ids bear no loss

    def loss(self, start: int, stop: int) -> int:
        return max(0, stop - max(start, self.free))

    def longest(self, start: int, stop: int, tokens: int, loss: int) -> int:
        """How many ids from ``start`` fit into so much room."""
        room = max(0, self.free - start) + loss
        return min(stop - start, tokens, room)


@dataclass(eq=False)
class Sequence:
    pieces: list = field(default_factory=list)
    tokens: int = 0
    loss: int = 0

    def add(self, x: Example, start: int, stop: int) -> None:
        self.pieces.append((x, start, stop))
        self.tokens += stop - start
        self.loss += x.loss(start, stop)


class Packer:
    """Packs examples one after the other; ``add`` and ``finish`` yield full sequences."""

    def __init__(self, tokens: int, segments: int, loss: int, open_bins: int = OPEN_BINS):
        if min(tokens, segments, loss, open_bins) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.open_bins = np.array([tokens, segments, loss], float), open_bins
        self.tokens, self.segments, self.loss, self.open = tokens, segments, loss, []

    def _rooms(self) -> np.ndarray:
        return np.array([(self.tokens - s.tokens, self.segments - len(s.pieces), self.loss - s.loss) for s in self.open], float).reshape(-1, 3)

    def _full(self, s: Sequence) -> bool:
        return s.tokens == self.tokens or len(s.pieces) == self.segments

    def add(self, x: Example):
        at, end = 0, len(x.ids)
        while at < end:
            need = np.array([end - at, 1, x.loss(at, end)], float)
            rooms = self._rooms()
            score = (rooms / self.limits) @ (need / self.limits)
            fits = (rooms >= need).all(1)
            if fits.any():
                s, stop = self.open[int(np.argmax(np.where(fits, score, -1)))], end
            elif len(self.open) < self.open_bins or (need > self.limits).any():
                s = Sequence()
                self.open.append(s)
                stop = at + x.longest(at, end, self.tokens, self.loss)
            else:
                able = np.array([x.longest(at, end, self.tokens - s.tokens, self.loss - s.loss) for s in self.open])
                if not able.any():
                    # nothing can be added to any: the fullest leaves as it is
                    s = max(self.open, key=lambda s: s.tokens)
                    self.open.remove(s)
                    yield s
                    continue
                best = int(np.argmax(np.where(able > 0, score, -1)))
                s, stop = self.open[best], at + int(able[best])
            s.add(x, at, stop)
            at = stop
            if self._full(s):
                self.open.remove(s)
                yield s

    def finish(self):
        pieces = [p for s in self.open for p in s.pieces]
        self.open = []
        left, current = sum(b - a for _, a, b in pieces), Sequence()
        goal = self._goal(left)
        for x, a, b in pieces:
            while a < b:
                n = x.longest(a, b, goal - current.tokens, self.loss - current.loss)
                if n:
                    current.add(x, a, a + n)
                    a, left = a + n, left - n
                if not n or current.tokens == goal or len(current.pieces) == self.segments:
                    yield current
                    current, goal = Sequence(), self._goal(left)
        if current.tokens:
            yield current

    def _goal(self, left: int) -> int:
        """A full sequence, or the largest power of two that is left."""
        return self.tokens if left >= self.tokens else 1 << max(0, left.bit_length() - 1)


def _pack(tokens: int, segments: int, loss: int, end_id: int, tokenizer: str, ranks: str):
    def run(batches):
        encode = encoder(tokenizer, ranks).encode
        packer, number = Packer(tokens, segments, loss), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def put(sequence):
            nonlocal number
            offset = 0
            for x, a, b in sequence.pieces:
                rows.append((x.doc_id, a, b - a, x.ids[a:b].astype("<u4").tobytes(), x.loss(a, b), len(x.ids), number, offset))
                offset += b - a
            number += 1

        def take():
            out = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text, prompt in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "prompt")), strict=True):
                parts = ([encode(prompt)] if prompt else []) + [encode(text or ""), np.array([end_id], np.uint32)]
                for s in packer.add(Example(doc_id, np.concatenate(parts), len(parts[0]) if prompt else 0)):
                    put(s)
                if len(rows) >= 2000:
                    yield take()
        for s in packer.finish():
            put(s)
        if rows:
            yield take()

    return run


def pack(
    examples: DataFrame, max_tokens: int = 2048, max_segments: int = 512, max_loss_tokens: int = 2048, end_id: int = 1,
    tokenizer: str = TOKENIZER, ranks: str = RANKS,
) -> DataFrame:
    """One row for each piece of ``examples(doc_id, text[, prompt])``: ``doc_id, start, length,
    ids`` (little-endian uint32), ``loss_tokens, doc_tokens, sequence_id, offset``. The ids of a
    prompt come first and bear no loss; ``end_id`` ends each example."""
    prepare(examples.sparkSession)
    prompt = F.col("prompt").cast("string") if "prompt" in examples.columns else F.lit(None).cast("string")
    rows = examples.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), prompt.alias("prompt"))
    schema = "doc_id long, start long, length long, ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_pack(max_tokens, max_segments, max_loss_tokens, end_id, tokenizer, ranks), schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
