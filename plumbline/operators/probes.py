"""Benchmark seeds, distractor candidates, negation flips, review rows and the probe built from them."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import lexical_overlap
from plumbline.operators.scoring import IRRELEVANT_KIND, RELEVANT_KINDS
from plumbline.stored import stored

# The rules of the negation flip, in order; the first that matches is applied once.
FLIPS = [
    (r"\b(shall|must|will|should|may|can)\s+not\b", ""),
    (r"\b(is|are|was|were|has|have|had)\s+not\b", ""),
    (r"\b(shall|must|will|should|may|can)\b", " not"),
    (r"\b(is|are|was|were|has|have|had)\b", " not"),
]


def negation_flip(text: Column) -> tuple[Column, Column]:
    """The text with one polarity turned at its first place, and the number of the rule; null if none fits."""
    flipped, rule = F, F
    for i, (pattern, suffix) in enumerate(FLIPS):
        hit = text.rlike(f"(?i){pattern}")
        flipped = flipped.when(hit, F.regexp_replace(text, rf"(?is)\A(.*?){pattern}(.*)\z", f"$1$2{suffix}$3"))
        rule = rule.when(hit, F.lit(i + 1))
    return flipped.otherwise(F.lit(None).cast("string")), rule.otherwise(F.lit(None).cast("int"))


def import_seeds(tests: DataFrame, corpus: DataFrame, holdout: DataFrame | None = None) -> DataFrame:
    """Spans of benchmark queries with the text they name.

    ``tests``: query, snippets (array of struct<file_path, span: array<long>>); ``corpus``: source_id,
    text; ``holdout``: sha256 of sources to leave out. Paths that leave the corpus and spans out of
    bounds are in ``problem``.
    """
    spans = tests.select("query", F.explode("snippets").alias("s")).select("query", F.col("s.file_path").alias("source_id"), F.col("s.span")[0].alias("start"), F.col("s.span")[1].alias("end"))
    sources = corpus.select("source_id", "text", F.sha2("text", 256).alias("source_sha256"))
    if holdout is not None:
        sources = sources.join(holdout.select(F.col("sha256").alias("source_sha256")).distinct(), "source_sha256", "left_anti")
    rows = spans.join(sources, "source_id")
    escaped = F.col("source_id").startswith("/") | F.col("source_id").rlike(r"(^|/)\.\.(/|$)")
    bad = (F.col("start") < 0) | (F.col("end") <= F.col("start")) | (F.col("end") > F.length("text"))
    problem = F.when(escaped, "path_escape").when(bad, "span_out_of_bounds")
    text = F.expr("substring(text, int(start) + 1, int(end - start))")
    seed = F.substring(F.sha2(F.concat_ws("\0", "source_sha256", F.col("start").cast("string"), F.col("end").cast("string"), "query"), 256), 1, 20)
    return rows.select(seed.alias("seed_id"), "source_id", "source_sha256", "start", "end", text.alias("span_text"), F.col("query").alias("question"), problem.alias("problem"))


def candidate_pairs(seeds: DataFrame) -> DataFrame:
    """ordered pairs of seeds of one source with other questions, other texts and disjoint spans.
    ``seeds``: seed_id, source_id, source_sha256, question, span_text, start, end."""
    t = seeds.select("source_id", "source_sha256", F.col("seed_id").alias("target_id"), "question", F.col("span_text").alias("target_text"), "start", "end")
    d = seeds.select("source_id", "source_sha256", F.col("seed_id").alias("distractor_id"), F.col("question").alias("d_question"), F.col("span_text").alias("claim_text"), F.col("start").alias("d_start"), F.col("end").alias("d_end"))
    apart = ~((F.col("start") < F.col("d_end")) & (F.col("d_start") < F.col("end")))
    rows = t.join(d, ["source_id", "source_sha256"]).where((F.col("target_id") != F.col("distractor_id")) & (F.col("question") != F.col("d_question")) & (F.col("target_text") != F.col("claim_text")) & apart)
    ident = F.substring(F.sha2(F.concat_ws("\0", "source_sha256", "target_id", "distractor_id"), 256), 1, 20)
    return rows.withColumn("candidate_id", ident).drop("d_question")


#: So many ids may be put in the order of Python's generator; that is done on the driver.
MAX_BATCH = 100_000


def seeded_order(spark: SparkSession, ids: list[str], seed: int) -> DataFrame:
    """``id, place`` in the order of Python's seeded shuffle of the sorted ids. A control-plane list: the
    ids of a review batch."""
    ids = sorted(ids)
    random.Random(seed).shuffle(ids)
    return spark.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), "id string, place int")


def first_in_order(rows: DataFrame, key: str, count: int, seed: int, unique: str | None = None, shuffle: str = "python") -> DataFrame:
    """The first ``count`` rows in seeded order with their ``place``, one for each value of ``unique``. With ``shuffle`` "python" the order is that of Python's
    seeded shuffle, for batches of at most ``MAX_BATCH`` ids; with "digest" that of a hash of seed and id, for tables of any size."""
    if shuffle == "python":
        ids = [str(r[0]) for r in rows.select(key).distinct().limit(MAX_BATCH + 1).collect()]
        if len(ids) > MAX_BATCH:
            raise ValueError(f"more than {MAX_BATCH} ids are no batch; use the digest order")
        order = seeded_order(rows.sparkSession, ids, seed)
        rows = rows.join(order, F.col(key).cast("string") == F.col("id")).drop("id")
    else:
        rows = rows.withColumn("place", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256))
    if unique is not None:
        first = Window.partitionBy(unique).orderBy("place")
        rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    return rows.orderBy("place").limit(count)


def sample_candidates(candidates: DataFrame, count: int, seed: int, unique_sources: bool = True, envelope: int | None = None, shuffle: str = "python") -> DataFrame:
    """The first ``count`` candidates in seeded order, one for each source, whose two spans lie within
    ``envelope`` characters."""
    rows = candidates
    if envelope is not None:
        rows = rows.where(F.greatest("end", "d_end") - F.least("start", "d_start") <= envelope)
    return first_in_order(rows, "candidate_id", count, seed, "source_id" if unique_sources else None, shuffle)


def review_rows(candidates: DataFrame) -> DataFrame:
    """Candidates whose target text can be negated, with the flip and its rule."""
    flipped, rule = negation_flip(F.col("target_text"))
    return candidates.withColumn("flip", flipped).withColumn("flip_rule", rule).where("flip is not null AND flip <> target_text")


def review_manifest(candidates: DataFrame, sources: DataFrame, target: int, reserve: int, seed: int, limit: int, shuffle: str = "python") -> DataFrame:
    """The first ``target`` plus ``reserve`` candidates in seeded order, one for each source, whose text can be negated and whose
    two spans fit a window of ``limit`` characters; with the window, and ``role`` target or reserve. A source that is not there, or too few rows, are an error.
    ``sources``: source_id, text."""
    texts = sources.select("source_id", "text")
    rows = review_rows(candidates).join(texts, "source_id", "left")
    rows = rows.withColumn("text", F.coalesce("text", F.raise_error(F.concat(F.lit("missing candidate source: "), F.col("source_id").cast("string"))).cast("string")))
    low, high = F.least("start", "d_start"), F.greatest("end", "d_end")
    rows = rows.where(high - low <= limit)
    begin = F.greatest(F.lit(0), F.least(low - F.floor((limit - (high - low)) / 2).cast("int"), F.length("text") - limit)).cast("int")
    rows = rows.withColumn("context_start", begin).withColumn("context_end", F.least(F.length("text"), begin + limit).cast("int"))
    rows = rows.withColumn("context_text", F.substring(F.col("text"), F.col("context_start") + 1, F.col("context_end") - F.col("context_start"))).drop("text")
    chosen = stored(first_in_order(rows, "candidate_id", target + reserve, seed, "source_id", shuffle))
    if (found := chosen.count()) != target + reserve:
        raise ValueError(f"only {found} eligible rows for {target + reserve}")
    place = F.row_number().over(Window.orderBy("place"))  # a batch
    return chosen.withColumn("number", place).withColumn("role", F.when(F.col("number") <= target, "target").otherwise("reserve")).drop("place")


def screen(suggestions: DataFrame, low: float, high: float) -> DataFrame:
    """``reasons`` against each suggestion; none means included. Needs ``irrelevant_decision,
    contradiction_decision, overlap, absent``."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("irrelevant_decision") != "accepted", F.concat(F.lit("irrelevance_"), "irrelevant_decision")),
            F.when(F.col("contradiction_decision") != "accepted", F.concat(F.lit("contradiction_"), "contradiction_decision")),
            F.when(~F.col("overlap").between(low, high), "paraphrase_overlap_outside_frozen_band"),
            F.when(~F.col("absent"), "paraphrase_present_in_context"),
        )
    )
    return suggestions.withColumn("reasons", reasons).withColumn("included", F.size("reasons") == 0)


def tampered_decisions(frozen: DataFrame, decided: DataFrame, key: str, shown: list[str]) -> DataFrame:
    """Rows that are missing, unknown, or whose shown columns were changed."""
    d = decided.select(key, *(F.col(c).alias(f"__{c}") for c in shown), F.lit(True).alias("__there"))
    both = frozen.select(key, *shown, F.lit(True).alias("__frozen")).join(d, key, "full")
    changed = F.lit(False)
    for c in shown:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    rule = F.when(F.col("__there").isNull(), "missing").when(F.col("__frozen").isNull(), "unknown").when(changed, "changed")
    return both.select(key, rule.alias("rule")).where("rule is not null")


def probe_cases(groups: DataFrame) -> DataFrame:
    """Four cases of each accepted group: its text, a paraphrase, a contradiction and a present
    but irrelevant text, with a 24-digit id. ``groups``: group_id, target_text, paraphrase, flip, claim_text."""
    kinds = [(RELEVANT_KINDS[0], "supported", "target_text"), (RELEVANT_KINDS[1], "supported", "paraphrase"), (RELEVANT_KINDS[2], "contradicted", "flip"), (IRRELEVANT_KIND, "insufficient", "claim_text")]
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("expected_status"), F.col(c).alias("claim_text")) for k, s, c in kinds))
    out = groups.select("group_id", F.explode(rows).alias("c")).select("group_id", "c.*")
    return out.withColumn("case_id", F.substring(F.sha2(F.concat_ws(":", "group_id", "kind"), 256), 1, 24))


def misplaced_claims(cases: DataFrame) -> DataFrame:
    """Claims of absent kinds that stand in their source, and of present kinds that do not."""
    stands = F.instr("source_text", F.col("claim_text")) > 0
    present = F.col("kind").isin(RELEVANT_KINDS[0], IRRELEVANT_KIND)
    return cases.where(stands != present)


def paraphrase_overlap(cases: DataFrame, a: str, b: str) -> DataFrame:
    """H21 as a column ``overlap``."""
    return cases.withColumn("overlap", lexical_overlap(F.col(a), F.col(b)))


def promote(annotations: DataFrame) -> DataFrame:
    """Accepted annotations as seeds."""
    return annotations.where("decision = 'accepted'").drop("decision")


def dangling_relationships(annotations: DataFrame) -> DataFrame:
    """relationships of an annotation to ids that there are not."""
    links = annotations.select("annotation_id", F.explode("relationship_ids").alias("to"))
    return links.join(annotations.select(F.col("annotation_id").alias("to")), "to", "left_anti")


def perturb(text: Column, pairs: Column) -> Column:
    """Replaces each (old, new) of an array of structs, the longest old first (then as text)."""
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct((-F.length(p["old"])).alias("n"), p["old"].alias("old"), p["new"].alias("new"))))
    return F.aggregate(ordered, text, lambda t, p: F.replace(t, p["old"], p["new"]))


# What each kind of case must expect, and the provenance that it needs.
CASE_RULES = {
    "verbatim_supported": ("supported", ["attested"]),
    "paraphrase_supported": ("supported", ["authored", "model_authored"]),
    "contradicted": ("contradicted", ["derived"]),
    "present_irrelevant": ("insufficient", ["adjudicated"]),
}


def case_violations(cases: DataFrame) -> DataFrame:
    """``case_id, rule`` of cases with another status, provenance or span than their kind has, of derived
    cases without a parent, and of model-authored or adjudicated ones that nobody reviewed. Columns: kind, expected_status,
    provenance, parents, reviewers, original_start, original_end, original_text, claim_text, present_start, present_end."""
    kind, present = F.col("kind"), F.col("kind").isin("verbatim_supported", "present_irrelevant")
    wrong_status, wrong_source = F.lit(False), F.lit(False)
    for name, (status, sources) in CASE_RULES.items():
        wrong_status = wrong_status | ((kind == name) & (F.col("expected_status") != status))
        wrong_source = wrong_source | ((kind == name) & ~F.col("provenance").isin(sources))
    placed = F.col("present_start").isNotNull() & F.col("present_end").isNotNull()
    rules = {
        "unknown_kind": ~kind.isin(list(CASE_RULES)), "wrong_status": wrong_status, "wrong_provenance": wrong_source,
        "no_parent": (F.col("provenance") == "derived") & (F.size("parents") < 1),
        "not_reviewed": F.col("provenance").isin("model_authored", "adjudicated") & (F.size("reviewers") < 1),
        "span_length": F.length("original_text") != F.col("original_end") - F.col("original_start"),
        "claim_offsets": (present != placed) | (placed & (F.length("claim_text") != F.col("present_end") - F.col("present_start"))),
        "not_verbatim": (kind == "verbatim_supported") & ((F.col("claim_text") != F.col("original_text")) | (F.col("present_start") != F.col("original_start"))),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return cases.select("case_id", F.explode(found).alias("rule"))


def span_violations(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows whose source has another hash, or another text between ``start`` and ``end``. Rows: source_id,
    source_sha256, start, end, span_text; docs: source_id, text."""
    held = F.expr("substring(text, int(start) + 1, int(end - start))") == F.col("span_text")
    good = (F.sha2("text", 256) == F.col("source_sha256")) & held
    return rows.join(docs.select("source_id", "text"), "source_id", "left").where(~F.coalesce(good, F.lit(False))).drop("text")


def relevance_strata(claims: DataFrame, anchors: DataFrame) -> DataFrame:
    """M9: claims with an excerpt as cases of a stratum named by how their anchor came out."""
    rows = claims.where(F.length(F.trim("excerpt")) > 0).join(anchors.select("claim_id", "anchor"), "claim_id", "left")
    return rows.select(F.col("claim_id").alias("case_id"), F.col("text").alias("query_text"), F.col("excerpt").alias("evidence_text"), F.concat(F.lit("anchor_"), F.coalesce("anchor", F.lit("null"))).alias("stratum"))
