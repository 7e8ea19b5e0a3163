"""Whole runs: operators put together as one lazy plan, and the small receipt of a run."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.canonical import canonical_json, unordered_sha256, with_hash
from plumbline.operators import anchor, decisions, extraction, scoring, spans
from plumbline.policies import DomainPack, SupportPolicy
from plumbline.sources import readers

DECISION = "label string, confidence double, reason string, spans array<struct<start:int,end:int,text:string>>, error string, signal string"


def detector(assess: Callable[[str, str, str | None], dict]) -> Callable[[Column, Column, Column], Column]:
    """Extension point (L1, L2): a detector of one's own as a column of decisions. It returns a decision, or a decision and a signal, which is
    kept as canonical JSON. A row whose call fails has the error's name and nothing else; the others are not touched by it."""

    @F.pandas_udf(DECISION)
    def run(sources: pd.Series, claims: pd.Series, questions: pd.Series) -> pd.DataFrame:
        out = []
        for source, claim, question in zip(sources, claims, questions, strict=True):
            try:
                d = assess(source, claim, question)
                d, signal = d if isinstance(d, tuple) else (d, None)
                said = None if signal is None else canonical_json(signal)
                out.append({"label": d["label"], "confidence": d.get("confidence"), "reason": d.get("reason"), "spans": d.get("spans") or [], "error": None, "signal": said})
            except Exception as problem:  # noqa: BLE001  the row's outcome is that the detector failed
                out.append({"label": None, "confidence": None, "reason": None, "spans": [], "error": type(problem).__name__, "signal": None})
        return pd.DataFrame(out, columns=["label", "confidence", "reason", "spans", "error", "signal"])

    return run


def scorer(score: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """Extension point: a relevance scorer or reranker of one's own, null where it fails or leaves [0, 1]."""

    @F.pandas_udf("double")
    def run(questions: pd.Series, evidence: pd.Series) -> pd.Series:
        def one(q, e):
            try:
                value = float(score(q, e))
            except Exception:  # noqa: BLE001
                return None
            return value if 0 <= value <= 1 else None

        return pd.Series([one(q, e) for q, e in zip(questions, evidence, strict=True)], dtype="float64")

    return run


def check(claims: DataFrame, sources: DataFrame, policy: SupportPolicy, assess: Callable | None = None, declarations: DataFrame | None = None) -> dict[str, DataFrame]:
    """Mechanical verification, support under the policy, authority, shadow outcomes and rates.

    ``claims``: claim_id, text, question, source_id, uri, excerpt, locator, provenance_class;
    ``sources``: source_id, uri, text, failure. Without ``assess`` the exact detector decides. The detector
    sees readable sources only.
    """
    verified = anchor.verify_claims(claims, sources)
    rows = verified.withColumn("cited", F.col("source_id").isNotNull() & F.col("uri").isNotNull()).withColumn("resolved", F.col("source_text").isNotNull() & F.col("failure").isNull())
    rows = rows.withColumn("source_failure", F.when(F.col("cited"), F.col("failure"))).drop("failure")
    readable, rest = rows.where("resolved AND cited"), rows.where("NOT (resolved AND cited)")
    if assess is None:
        judged = decisions.exact_support(readable.withColumn("claim_text", F.col("text"))).drop("claim_text").withColumn("detector_error", F.lit(None).cast("string"))
    else:
        judged = readable.withColumn("d", detector(assess)(F.col("source_text"), F.col("text"), F.col("question")))
        bad = ~decisions.spans_valid(F.col("d.spans"), F.col("text"))
        judged = judged.select("*", "d.label", "d.confidence", F.coalesce("d.error", F.when(bad, "SpanMismatch")).alias("detector_error")).drop("d")
    nothing = {c: F.lit(None).cast(t) for c, t in (("label", "string"), ("confidence", "double"), ("detector_error", "string"))}
    rows = decisions.assess_support(judged.unionByName(rest.withColumns(nothing)), policy.min_confidence)
    if declarations is None:
        declarations = claims.sparkSession.createDataFrame([], "claim_id string, kind string, basis string, assigned_by string").withColumn("claim_id", F.col("claim_id").cast(claims.schema["claim_id"].dataType))
    accounts = decisions.assign_authority(rows, declarations)
    shadow = decisions.shadow_outcomes(accounts.withColumn("support_failure", F.col("failure")).withColumn("failure", F.col("source_failure")))
    counts = anchor.verification_counts(verified)
    return {
        "accounts": shadow, "rates": anchor.rate_envelopes(counts), "counts": counts, "by_provenance": anchor.verification_counts(verified, ["provenance_class"]),
        "support_counts": decisions.status_counts(rows, "status", decisions.SUPPORT_STATUSES),
        "authority_counts": decisions.status_counts(accounts, "kind", decisions.AUTHORITY_KINDS),
        "unknown_declarations": decisions.unknown_declarations(claims, declarations),
    }


def analyse(docs: DataFrame, pack: DomainPack, complete: Callable[[DataFrame], DataFrame], size: int = 20_000, overlap: int = 500) -> dict[str, DataFrame]:
    """Documents in windows, a reply for each, verbatim findings of known categories, merged and placed, and
    the coverage. ``docs``: doc, text; ``complete`` adds ``reply`` to rows with ``prompt``."""
    spark = docs.sparkSession
    chunks = spans.fixed_windows(docs, "doc", size=size, overlap=overlap, keep_empty=True).select("doc", F.col("seq").alias("segment"), F.col("segment").alias("chunk"))
    replies = extraction.parse_findings(complete(readers.prompts(chunks, pack.block(), pack.context, pack.noun)))
    categories = spark.createDataFrame([(c.name, c.severity) for c in pack.categories], "category string, severity int")
    found = replies.select("doc", "segment", "chunk", F.explode("findings").alias("category", "quotes")).select("doc", "segment", "chunk", "category", F.posexplode("quotes").alias("ord", "quote"))
    found = extraction.merge_findings(extraction.verbatim(extraction.allowed(found, categories), "chunk", "quote").drop("chunk"))
    placed = found.join(docs.select("doc", "text"), "doc").withColumn("offsets", spans.offsets(F.col("text"), F.col("quote"))).drop("text").join(categories, "category")
    segments = replies.select("doc", "segment", "checked")
    return {"findings": placed, "coverage": extraction.coverage(segments, found, categories), "segments": segments}


def bakeoff(cases: DataFrame, detectors: dict[str, tuple[SupportPolicy, Callable]]) -> DataFrame:
    """Each case (case_id, source_text, claim_text, question, expected_status, kind) under each policy."""
    out = None
    for key, (policy, assess) in sorted(detectors.items()):
        rows = cases.withColumn("d", detector(assess)(F.col("source_text"), F.col("claim_text"), F.col("question")))
        rows = rows.withColumns({"cited": F.lit(True), "resolved": F.lit(True), "source_failure": F.lit(None).cast("string"), "detector_error": F.col("d.error"), "label": F.col("d.label"), "confidence": F.col("d.confidence")})
        rows = decisions.assess_support(rows, policy.min_confidence).select("case_id", "kind", "expected_status", F.col("status").alias("actual"), F.lit(key).alias("policy_key"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no policy to run")
    return out


def bakeoff_scores(runs: DataFrame) -> DataFrame:
    """Accuracy of each policy over all and for each kind."""
    return scoring.accuracy_by(runs, "policy_key", "kind")


def manifest(tables: dict[str, DataFrame], **identities: str) -> dict:
    """Row counts and order-free hashes of the tables of a run beside the hashes of what it ran under, as a
    receipt that has its own hash."""
    parts = {name: {"rows": df.count(), "sha256": unordered_sha256(df, *sorted(df.columns)).first().sha256} for name, df in sorted(tables.items())}
    return with_hash({"tables": parts, "identities": dict(sorted(identities.items()))})
