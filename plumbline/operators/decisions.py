"""Decision tables: support, authority, shadow outcomes, acquisition. Each is an ordered list of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import normalise_anchor

SUPPORT_STATUSES = ["contradicted", "insufficient", "not_assessed", "source_unavailable", "supported"]
AUTHORITY_KINDS = ["analyst_derived", "independent_primary", "independent_secondary", "subject_provided", "unknown_authority"]
SHADOW_OUTCOMES = ["needs_validation", "not_assessed", "source_unavailable", "withheld"]
ANALYST_CLASSES = ["analyst_calculation", "analyst_inference", "recommendation"]


def first_match(rules: list[tuple[Column, Column | str | None]], default: Column | str | None = None) -> Column:
    """The value of the first rule that holds; a rule that is null does not hold."""
    out = F
    for condition, value in rules:
        out = out.when(F.coalesce(condition, F.lit(False)), value if isinstance(value, Column) else F.lit(value))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def status_counts(rows: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """H1: ``status, n`` for every word of the vocabulary, zero where no row has it."""
    words = rows.sparkSession.createDataFrame([(w,) for w in vocabulary], "status string")
    counted = rows.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))
    return words.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def exact_support(claims: DataFrame) -> DataFrame:
    """Label and confidence of the exact detector on ``claim_text, source_text``."""
    needle, haystack = normalise_anchor(F.col("claim_text")), normalise_anchor(F.col("source_text"))
    hit = (F.length(needle) > 0) & (F.length(haystack) > 0) & (F.instr(haystack, needle) > 0)
    return claims.withColumn("label", first_match([(hit, "supported")], "insufficient")).withColumn("confidence", F.lit(1.0))


def spans_valid(spans: Column, claim_text: Column) -> Column:
    """Every span is the claim's text between its offsets."""
    return F.forall(spans, lambda s: (s["start"] >= 0) & (s["end"] <= F.length(claim_text)) & (F.substring(claim_text, s["start"] + 1, s["end"] - s["start"]) == s["text"]))


def assess_support(rows: DataFrame, min_confidence: float | None) -> DataFrame:
    """``status, failure`` from ``cited, resolved, source_failure, detector_error, label, confidence``.
    A null confidence fails a threshold that is set; label and confidence stay as they are."""
    low = F.lit(False) if min_confidence is None else F.col("confidence").isNull() | (F.col("confidence") < min_confidence)
    gone = ~F.col("resolved") | F.col("source_failure").isNotNull()
    status = first_match(
        [(~F.col("cited"), "not_assessed"), (gone, "source_unavailable"), (F.col("detector_error").isNotNull(), "not_assessed"), (low, "insufficient")],
        F.col("label"),
    )
    failure = first_match(
        [
            (~F.col("cited"), "no_source"),
            (gone, F.coalesce("source_failure", F.lit("source_unreachable"))),
            (F.col("detector_error").isNotNull(), F.concat(F.lit("detector_error:"), F.col("detector_error"))),
        ]
    )
    return rows.withColumn("status", status).withColumn("failure", failure)


def assign_authority(claims: DataFrame, declarations: DataFrame) -> DataFrame:
    """``kind, basis, assigned_by`` of each claim: a declaration, else its provenance class."""
    d = declarations.select("claim_id", F.col("kind").alias("d_kind"), F.col("basis").alias("d_basis"), "assigned_by")
    declared, analyst, subject = F.col("d_kind").isNotNull(), F.col("provenance_class").isin(ANALYST_CLASSES), F.col("provenance_class") == "company_assertion"
    kind = first_match([(declared, F.col("d_kind")), (analyst, "analyst_derived"), (subject, "subject_provided")], "unknown_authority")
    basis = first_match([(declared, F.col("d_basis")), (analyst | subject, "artifact_declaration")], "unassigned")
    return claims.join(d, "claim_id", "left").withColumn("kind", kind).withColumn("basis", basis).drop("d_kind", "d_basis")


def unknown_declarations(claims: DataFrame, declarations: DataFrame) -> DataFrame:
    """Declarations about claims that there are not."""
    return declarations.join(claims, "claim_id", "left_anti")


def shadow_outcomes(accounts: DataFrame) -> DataFrame:
    """``outcome, reason`` from ``cited, failure, method, anchor, question``."""
    failed = F.col("failure").isNotNull() | (F.col("method") == "fetch_failed")
    rules = [
        (~F.col("cited"), "not_assessed", F.lit("claim_has_no_external_source")),
        (failed, "source_unavailable", F.coalesce("failure", F.lit("source_unreachable"))),
        (F.col("anchor").isNull() | (F.col("anchor") != "found"), "needs_validation", F.concat(F.lit("anchor_"), F.coalesce("anchor", F.lit("not_assessed")))),
        (F.coalesce(F.trim("question"), F.lit("")) == "", "withheld", F.lit("missing_verification_question")),
    ]
    outcome = first_match([(c, o) for c, o, _ in rules], "withheld")
    reason = first_match([(c, r) for c, _, r in rules], "no_semantic_component_admitted")
    return accounts.withColumn("outcome", outcome).withColumn("reason", reason)


def attach_signals(claims: DataFrame, signals: DataFrame) -> DataFrame:
    """M8: each claim's observations as an array, ordered by role and component."""
    held = signals.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("role", "component", "label"))).alias("signals"))
    empty = F.array().cast("array<struct<role:string,component:string,label:string>>")
    return claims.join(held, "claim_id", "left").withColumn("signals", F.coalesce("signals", empty))


def http_failure(status: Column, media_type: Column) -> Column:
    """A2: what a fetch failed of; null if it did not."""
    return first_match(
        [
            (status.isNull(), "source_unreachable"), (status.isin(401, 402, 403, 429), "source_paywalled"),
            (status >= 400, "source_unreachable"), (media_type == "application/pdf", "pdf_unsupported"),
        ]
    )


def acquire(references: DataFrame, snapshots: DataFrame, live: DataFrame | None, mode: str) -> DataFrame:
    """``strategy, text, failure, live_attempted`` of each reference (source_id, uri).

    A snapshot is found by its uri and must have the same source_id and the hash of its text; a present but
    invalid snapshot is not hidden by a fetch. ``snapshots``: source_id, uri, text, sha256;
    ``live``: uri, text, failure.
    """
    if mode not in ("replay_only", "snapshot_preferred", "refresh"):
        raise ValueError(f"unknown mode: {mode}")
    if mode != "replay_only" and live is None:
        raise ValueError(f"{mode} needs fetched pages")
    s = snapshots.select("uri", F.col("source_id").alias("s_id"), F.col("text").alias("s_text"), F.col("sha256").alias("s_sha"), F.lit(True).alias("present"))
    rows = references.join(s, "uri", "left")
    if live is None:
        rows = rows.withColumn("l_text", F.lit(None).cast("string")).withColumn("l_failure", F.lit(None).cast("string"))
    else:
        rows = rows.join(live.select("uri", F.col("text").alias("l_text"), F.col("failure").alias("l_failure")), "uri", "left")
    use = F.coalesce("present", F.lit(False)) & F.lit(mode != "refresh")
    identity, intact = F.col("s_id") == F.col("source_id"), F.sha2(F.col("s_text"), 256) == F.col("s_sha")
    replay, fetched = F.lit(mode == "replay_only"), F.col("l_text").isNotNull() & F.col("l_failure").isNull()
    strategy = first_match([(use & identity & intact, "snapshot"), (use, "snapshot_invalid"), (replay, "snapshot_missing"), (fetched, "live_archived")], "live_failed")
    text = first_match([(F.col("strategy") == "snapshot", F.col("s_text")), (F.col("strategy") == "live_archived", F.col("l_text"))])
    failure = first_match(
        [
            (F.col("strategy").isin("snapshot", "live_archived"), None), (F.col("strategy") == "snapshot_invalid", "source_changed"),
            (F.col("strategy") == "snapshot_missing", "source_unreachable"),
        ],
        F.coalesce("l_failure", F.lit("source_unreachable")),
    )
    rows = rows.withColumn("strategy", strategy).withColumn("text", text.cast("string")).withColumn("failure", failure.cast("string"))
    return rows.withColumn("live_attempted", ~use & ~replay).select("source_id", "uri", "strategy", "text", "failure", "live_attempted")


def component_label(scores: Column, labels: list[str]) -> Column:
    """The label with the largest score, the first of equal ones."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(scores, F.array_max(scores)).cast("int"))


def binary_support(score: Column, threshold: float) -> Column:
    """Detectors with two classes cannot contradict: below the threshold is insufficient."""
    return first_match([(score >= threshold, "supported")], "insufficient")


def invalid_signals(signals: DataFrame) -> DataFrame:
    """Claims whose signals have several inputs, a repeated (role, component), or scores outside [0, 1]."""
    bad = F.exists(F.map_values("scores"), lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    return signals.groupBy("claim_id").agg(
        (F.count_distinct("input_sha256") > 1).alias("mixed_inputs"),
        (F.count("*") > F.count_distinct("role", "component")).alias("repeated"),
        F.bool_or(F.coalesce(bad, F.lit(False))).alias("bad_scores"),
    ).where("mixed_inputs OR repeated OR bad_scores")


def raw_signals(outputs: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``signal``, a component's output as it came, of any JSON shape; null where it is no JSON, which ``broken`` says."""
    rows = outputs.withColumn("signal", F.try_parse_json(F.col(raw)))
    return rows.withColumn("broken", F.col(raw).isNotNull() & F.col("signal").isNull())


def signal_at(path: str, kind: str) -> Column:
    """What stands at a path of ``signal``, as a value of a kind; null where there is none or another one."""
    return F.try_variant_get("signal", path, kind)


def signal_shapes(signals: DataFrame, by: str) -> DataFrame:
    """``by, signals, broken, shape``: what the outputs of each component have in common."""
    return signals.groupBy(by).agg(F.count("signal").alias("signals"), F.count_if("broken").alias("broken"), F.schema_of_variant_agg("signal").alias("shape"))
