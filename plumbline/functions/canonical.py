"""Canonical JSON and hashes that a row, a table or a receipt is known by."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.stored import stored


def canonical_json(value: Any) -> str:
    """B1: keys sorted, no blanks, ASCII only; values that JSON has no form for are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def sha256_json(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def with_hash(payload: dict) -> dict:
    """B2: the payload and its own hash."""
    return {**payload, "sha256": sha256_json(payload)}


def hash_holds(value: dict) -> bool:
    """B2: whether a payload still has the hash that it carries."""
    return value.get("sha256") == sha256_json({k: v for k, v in value.items() if k != "sha256"})


def _plain(value: Any) -> Any:
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple) or hasattr(value, "tolist"):
        value = value.tolist() if hasattr(value, "tolist") else value
        return [_plain(v) for v in value] if isinstance(value, list | tuple) else value
    return value


def row_json(*columns: str) -> Column:
    """B1 over a row's columns as one object. A text of a Variant or JSON column is not parsed."""

    @F.udf("string", useArrow=True)
    def dump(row):
        return canonical_json(_plain(row))

    return dump(F.struct(*columns))


def row_sha256(*columns: str) -> Column:
    return F.sha2(row_json(*columns), 256)


def unordered_sha256(rows: DataFrame, *columns: str) -> DataFrame:
    """A table's hash, whatever the order of its rows: a tree over the rows' hashes. The hashes are joined in sorted order
    within groups that share their leading digits, the groups' hashes again by three digits less, so that a list has
    about 4096 hashes, however large the table. The number of levels follows the number of rows."""
    hashed = stored(rows.select(row_sha256(*columns).alias("h")))
    count, digits = hashed.count(), 0
    while count > 4096 << (4 * digits):
        digits += 1
    level = hashed.select(F.col("h").alias("path"), "h")
    while True:
        group = F.substring("path", 1, digits)
        digests = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), "")
        level = level.groupBy(group.alias("group")).agg(F.sha2(digests, 256).alias("h")).select(F.col("group").alias("path"), "h")
        if digits == 0:
            empty = F.lit(hashlib.sha256(b"").hexdigest())
            return level.agg(F.coalesce(F.max("h"), empty).alias("sha256"))
        digits = max(0, digits - 3)


#: Characters of the records that are put together in one row before they are hashed.
BLOCK = 1 << 18


def records_sha256(rows: DataFrame, key: str, *columns: str, by: str | None = None) -> DataFrame:
    """``sha256``: the hash of a set of records as the canonical JSON list of them in the order of their key; with ``by`` one of each set, a probe or a bundle,
    which is one value. Without it the rows may be a whole table: they are ordered by ranges, whose tasks write the JSON and put it together in blocks, and
    the hash, which each byte of the list goes through after the one before it, is taken from the stream of blocks, of which one is held at a time."""
    if by is not None:
        listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row_json(*columns).alias("j")))), lambda x: x["j"])
        return rows.groupBy(by).agg(F.sha2(F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), 256).alias("sha256"))
    ordered = rows.select(F.col(key).alias("k"), row_json(*columns).alias("j")).orderBy(F.asc_nulls_last("k"), "j").select(F.spark_partition_id().alias("place"), "j")
    blocks = ordered.mapInPandas(_blocks, "place int, number int, text string")
    return blocks.repartition(1).sortWithinPartitions("place", "number").select("text").mapInPandas(_stream_sha256, "sha256 string")


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of an ordered partition, a comma before each, in blocks of about ``BLOCK`` characters."""
    held, size, number = [], 0, 0
    for batch in batches:
        for place, record in zip(batch["place"], batch["j"], strict=True):
            held.append(f",{record}")
            size += len(held[-1])
            if size >= BLOCK:
                yield pd.DataFrame({"place": [place], "number": [number], "text": ["".join(held)]})
                held, size, number = [], 0, number + 1
    if held:
        yield pd.DataFrame({"place": [place], "number": [number], "text": ["".join(held)]})


def _stream_sha256(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest, first = hashlib.sha256(b"["), True
    for batch in batches:
        for text in batch["text"]:
            digest.update(text[first:].encode())
            first = False
    digest.update(b"]")
    yield pd.DataFrame({"sha256": [digest.hexdigest()]})


def input_sha256(claim_text: str, question: str, source_sha256: str) -> Column:
    """The hash of what a detector sees, without the claim's id."""

    @F.pandas_udf("string")
    def digest(claims: pd.Series, questions: pd.Series, sources: pd.Series) -> pd.Series:
        rows = zip(claims, questions, sources, strict=True)
        return pd.Series([sha256_json({"claim_text": c, "question": q, "source_sha256": s}) for c, q, s in rows])

    return digest(claim_text, question, source_sha256)


def component_sha256(source_text: str, claim_text: str, question: str) -> Column:
    """M3: the hash of source, claim and question."""

    @F.pandas_udf("string")
    def digest(sources: pd.Series, claims: pd.Series, questions: pd.Series) -> pd.Series:
        rows = zip(sources, claims, questions, strict=True)
        return pd.Series([sha256_json({"source_text": s, "claim_text": c, "question": q}) for s, c, q in rows])

    return digest(source_text, claim_text, question)


def profile_sha256(profile: Any) -> str:
    """M5: the hash of a profile or policy, a dataclass whose fields JSON has a form for."""
    return sha256_json(dataclasses.asdict(profile))


def text_sha256(text: Column) -> Column:
    """M6: the hash of a formula or a question as it stands."""
    return F.sha2(text, 256)


def snapshot_key(uri: Column) -> Column:
    """A4: 24 hex digits of the uri's hash."""
    return F.substring(F.sha2(uri, 256), 1, 24)


def url_id(uri: Column) -> Column:
    """The id of a source that is known by its uri only."""
    return F.concat(F.lit("url:"), F.substring(F.sha2(uri, 256), 1, 16))
