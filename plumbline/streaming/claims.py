"""Claims that arrive as a stream, checked against a table of sources.

Not an operator of the batch engine: the same decision tables run on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators import anchor


def verify_stream(claims: DataFrame, sources: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Verifies each new claim once. ``claims`` streams the columns of a claim and ``arrived`` (timestamp); a claim
    id that comes again within ``delay`` is dropped, state older than that is forgotten."""
    fresh = claims.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["claim_id"])

    def batch(rows: DataFrame, number: int) -> None:
        sink(anchor.verify_claims(rows.drop("arrived"), sources), number)

    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def usage_windows(usage: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tokens of each backend in tumbling windows of a usage log with ``at`` (timestamp)."""
    return usage.withWatermark("at", delay).groupBy(F.window("at", width), "backend").agg(F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"))
