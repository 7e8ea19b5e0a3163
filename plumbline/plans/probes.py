"""Seeds, candidates and probe cases made of spans of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import jaccard, word_tokens
from plumbline.operators import probes as P
from plumbline.plans.tools import Plans, table
from plumbline.stored import stored

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql

_SEEDS = """
spans AS (SELECT doc_id, text, i, (length(text) * i // 4)::INTEGER AS s, least(length(text), length(text) * i // 4 + CASE WHEN i = 1 THEN length(text) // 3 + 1 ELSE length(text) // 5 + 1 END)::INTEGER AS e FROM documents, range(3) r(i) WHERE length(text) > 0),
seeds AS (SELECT 'd' || doc_id AS source_id, sha256(text) AS source_sha256, s, e, substr(text, s + 1, e - s) AS span_text, 'q' || i AS question,
  substr(sha256(sha256(text) || chr(0) || s || chr(0) || e || chr(0) || 'q' || i), 1, 20) AS seed_id FROM spans)"""


def seeds(spark, sf_dir):
    """Three spans of each text that is not empty, at its start, from its first quarter on and from its middle on."""
    corpus, tests = corpus_and_tests(spark, sf_dir)
    return P.import_seeds(tests, corpus)


def corpus_and_tests(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    corpus = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "text")
    n = F.length("text")
    start = F.expr("int(length(text) * i div 4)")
    end = F.least(n, start + F.when(F.col("i") == 1, F.expr("int(length(text) div 3)")).otherwise(F.expr("int(length(text) div 5)")) + 1)
    rows = corpus.select("source_id", "text", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    tests = rows.select(F.concat(F.lit("q"), "i").alias("query"), F.array(F.struct(F.col("source_id").alias("file_path"), F.array(start, end).cast("array<long>").alias("span"))).alias("snippets"))
    return corpus, tests


@plans.add(f"WITH {_SEEDS} SELECT seed_id, source_id, span_text FROM seeds")
def span_seeds(spark, sf_dir):
    return seeds(spark, sf_dir).where("problem is null").select("seed_id", "source_id", "span_text")


@plans.add(
    f"""WITH {_SEEDS} SELECT substr(sha256(t.source_sha256 || chr(0) || t.seed_id || chr(0) || d.seed_id), 1, 20) AS candidate_id, t.source_id
FROM seeds t JOIN seeds d USING (source_id, source_sha256) WHERE t.seed_id <> d.seed_id AND t.question <> d.question AND t.span_text <> d.span_text AND NOT (t.s < d.e AND d.s < t.e)"""
)
def candidate_pairs(spark, sf_dir):
    return P.candidate_pairs(seeds(spark, sf_dir).drop("problem")).select("candidate_id", "source_id")


_PAIRS = f"""{_SEEDS}, pairs AS (SELECT substr(sha256(t.source_sha256 || chr(0) || t.seed_id || chr(0) || d.seed_id), 1, 20) AS candidate_id, t.source_id, t.span_text AS target_text, t.s, t.e, d.s AS d_s, d.e AS d_e
FROM seeds t JOIN seeds d USING (source_id, source_sha256) WHERE t.seed_id <> d.seed_id AND t.question <> d.question AND t.span_text <> d.span_text AND NOT (t.s < d.e AND d.s < t.e))"""


@plans.add(
    f"""WITH {_PAIRS}, o AS (SELECT *, sha256('991:' || candidate_id) AS place FROM pairs WHERE greatest(e, d_e) - least(s, d_s) <= 400 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY place) = 1)
SELECT candidate_id, source_id, place FROM o ORDER BY place LIMIT 20"""
)
def sampled_candidates(spark, sf_dir):
    """The report of a review batch: 20 candidates in seeded order, one for each source."""
    pairs = P.candidate_pairs(seeds(spark, sf_dir).drop("problem"))
    return P.sample_candidates(pairs, 20, 991, envelope=400, shuffle="digest").select("candidate_id", "source_id", "place")


@plans.add(
    f"""WITH {_PAIRS}, f AS (FROM pairs), d AS (SELECT 'd' || doc_id AS source_id, length(text) AS n FROM documents),
o AS (SELECT f.*, n, sha256('5:' || candidate_id) AS place FROM f JOIN d USING (source_id) WHERE greatest(e, d_e) - least(s, d_s) <= 700 AND regexp_matches(regexp_replace(target_text, '[^\\x00-\\x7F]', 'x', 'g'), '(?i)\\b(shall|must|will|should|may|can|is|are|was|were|has|have|had)\\b')
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY place) = 1),
c AS (SELECT *, row_number() OVER (ORDER BY place) AS number FROM o ORDER BY place LIMIT 20)
SELECT candidate_id, number::INTEGER AS number, CASE WHEN number <= 15 THEN 'target' ELSE 'reserve' END AS role, greatest(0, least(least(s, d_s) - (700 - (greatest(e, d_e) - least(s, d_s))) // 2, n - 700))::INTEGER AS context_start FROM c"""
)
def review_manifest(spark, sf_dir):
    """15 candidates and five in reserve; letters beyond ASCII are spelled x (DuckDB's word boundaries do not know them)."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), "text")
    pairs = P.candidate_pairs(seeds(spark, sf_dir).drop("problem")).withColumn("target_text", F.regexp_replace("target_text", r"[^\x00-\x7F]", "x"))
    return P.review_manifest(pairs, docs, 15, 5, 5, 700, shuffle="digest").select("candidate_id", "number", "role", "context_start")


@plans.add(f"WITH {_SEEDS} SELECT seed_id FROM seeds WHERE source_sha256 NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def seeds_without_holdout(spark, sf_dir):
    """Seeds of sources whose text is not held out."""
    corpus, tests = corpus_and_tests(spark, sf_dir)
    held = table(spark, sf_dir, "documents").where("doc_id % 10 = 0").select(F.sha2("text", 256).alias("sha256"))
    return P.import_seeds(tests, corpus, held).select("seed_id")


@plans.add("SELECT doc_id AS annotation_id, lang FROM documents WHERE doc_id % 3 = 1")
def promoted_annotations(spark, sf_dir):
    """Accepted annotations."""
    decision = F.element_at(F.array(*map(F.lit, ["rejected", "accepted", "pending"])), (F.col("doc_id") % 3 + 1).cast("int"))
    return P.promote(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("annotation_id"), "lang", decision.alias("decision")))


@plans.add(
    """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\pL\\pN_]+')) AS t FROM documents)
SELECT a.doc_id, round(len(list_intersect(a.t, b.t))::DOUBLE / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) AS overlap FROM w a JOIN w b ON b.doc_id = a.doc_id + 1"""
)
def lexical_overlap(spark, sf_dir):
    """Each document against the next one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = stored(docs.select("doc_id", word_tokens(F.col("text")).alias("a")))
    others = words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    return words.join(others, "doc_id").select("doc_id", F.round(F.coalesce(jaccard(F.col("a"), F.col("b")), F.lit(1.0)), 6).alias("overlap"))


_FLIP_TEXT = "regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') || [' It shall not pass.', ' It is not so.', ' It may pass.', ' It was so.', ''][doc_id % 5 + 1]"


@plans.add(
    f"""WITH t AS (SELECT doc_id, {_FLIP_TEXT} AS t FROM documents),
r AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, '(?i)\\b(shall|must|will|should|may|can)\\s+not\\b') THEN 1 WHEN regexp_matches(t, '(?i)\\b(is|are|was|were|has|have|had)\\s+not\\b') THEN 2
  WHEN regexp_matches(t, '(?i)\\b(shall|must|will|should|may|can)\\b') THEN 3 WHEN regexp_matches(t, '(?i)\\b(is|are|was|were|has|have|had)\\b') THEN 4 END AS rule FROM t)
SELECT doc_id, rule, CASE rule WHEN 1 THEN regexp_replace(t, '(?i)\\b(shall|must|will|should|may|can)\\s+not\\b', '\\1') WHEN 2 THEN regexp_replace(t, '(?i)\\b(is|are|was|were|has|have|had)\\s+not\\b', '\\1')
  WHEN 3 THEN regexp_replace(t, '(?i)\\b(shall|must|will|should|may|can)\\b', '\\1 not') WHEN 4 THEN regexp_replace(t, '(?i)\\b(is|are|was|were|has|have|had)\\b', '\\1 not') END AS flip FROM r"""
)
def negation_flip(spark, sf_dir):
    """Letters beyond ASCII are spelled x: DuckDB's word boundaries do not know them."""
    tail = F.element_at(F.array(*map(F.lit, [" It shall not pass.", " It is not so.", " It may pass.", " It was so.", ""])), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", "x"), tail).alias("t"))
    flip, rule = P.negation_flip(F.col("t"))
    return rows.select("doc_id", rule.alias("rule"), flip.alias("flip"))


@plans.add("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)")
def duplicate_content_holdout_antijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.join(docs.where("doc_id % 10 = 0").select("sha").distinct(), "sha", "left_anti").select("doc_id")


@plans.add(
    """SELECT doc_id, to_json(list_filter([CASE WHEN doc_id % 4 = 1 THEN 'irrelevance_rejected' END, CASE WHEN doc_id % 5 = 1 THEN 'contradiction_unsure' END,
  CASE WHEN doc_id % 10 NOT BETWEEN 2 AND 8 THEN 'paraphrase_overlap_outside_frozen_band' END, CASE WHEN doc_id % 6 = 0 THEN 'paraphrase_present_in_context' END], lambda x: x IS NOT NULL))::VARCHAR AS reasons FROM documents"""
)
def screened_suggestions(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 4 == 1, "rejected").otherwise("accepted").alias("irrelevant_decision"), F.when(d % 5 == 1, "unsure").otherwise("accepted").alias("contradiction_decision"),
        (d % 10 / 10).alias("overlap"), (d % 6 != 0).alias("absent"),
    )
    return P.screen(rows, 0.2, 0.8).select("doc_id", F.to_json("reasons").alias("reasons"))


@plans.add("SELECT conv_id, replace(replace(text, 'the', 'THE'), 'an', 'AN') AS text, turn FROM conversations")
def perturbed_texts(spark, sf_dir):
    pairs = F.array(F.struct(F.lit("an").alias("old"), F.lit("AN").alias("new")), F.struct(F.lit("the").alias("old"), F.lit("THE").alias("new")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.perturb(F.col("text"), pairs).alias("text"))
