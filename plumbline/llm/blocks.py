"""Blocks of neighbouring rows: what operators 12 and 13 sum up and look up together.

A partition's rows are dealt into blocks of about ``BLOCK_CHARS`` characters in the order in which they come, so a
block's number depends on its partition alone, and a row longer than that stands in a block with few others.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext

BLOCK_CHARS = 1 << 23
#: What a row counts besides its text, so that blocks of empty texts end too.
ROW_CHARS = 64


def blocks(batches, size: int = BLOCK_CHARS) -> Iterator[tuple[int, list[tuple]]]:
    """(number, rows) of the blocks of a partition's Arrow batches with columns ``doc_id`` and ``text``."""
    number, rows, held = TaskContext.get().partitionId() << 33, [], 0
    for batch in batches:
        for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            rows.append(row)
            held += len(row[1] or "") + ROW_CHARS
            if held >= size:
                yield number, rows
                number, rows, held = number + 1, [], 0
    if rows:
        yield number, rows
