"""A check as a process: a JSON request in, a JSON response out, exit code 0, or 2 with an error.

The request names Parquet tables: ``{"claims": path, "sources": path, "output": path,
"policy": {"key": ..., "version": ..., "frozen_at": ..., "min_confidence": ...}}``.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from plumbline import engine
from plumbline.functions.canonical import sha256_json, with_hash
from plumbline.policies import Detector, SupportPolicy

_KEYS = {"claims", "sources", "output", "policy"}


def execute(spark: SparkSession, request: dict) -> dict:
    """Runs the request and writes the accounts and rates below ``output``."""
    if set(request) != _KEYS:
        raise ValueError(f"a request has the keys {sorted(_KEYS)}")
    policy = SupportPolicy(detector=Detector("exact", "normalised-substring", "1"), **request["policy"])
    run = engine.check(spark.read.parquet(request["claims"]), spark.read.parquet(request["sources"]), policy)
    for name in ("accounts", "rates", "support_counts"):
        run[name].write.mode("overwrite").parquet(f"{request['output']}/{name}")
    rates = [r.asDict() for r in spark.read.parquet(f"{request['output']}/rates").orderBy("name").collect()]
    return with_hash({"request_sha256": sha256_json(request), "policy_sha256": policy.sha256, "rates": rates})


def main() -> int:
    try:
        request = json.load(open(sys.argv[1]) if len(sys.argv) > 1 else sys.stdin)
        print(json.dumps(execute(SparkSession.builder.getOrCreate(), request), sort_keys=True))
    except (ValueError, TypeError, OSError) as problem:
        print(json.dumps({"error": str(problem)}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
