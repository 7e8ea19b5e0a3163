"""Recorded runs, exploratory runs and groups of cases, made of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import scoring
from plumbline.plans.tools import Plans, table

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@plans.add(
    """WITH c AS (SELECT doc_id // 4 AS group_id, ['verbatim_supported', 'paraphrase_supported', 'contradicted', 'present_irrelevant'][CASE WHEN doc_id % 28 = 3 THEN 1 ELSE doc_id % 4 + 1 END] AS kind,
  CASE WHEN doc_id % 36 = 5 THEN 'other' ELSE 's' END AS source_id FROM documents)
SELECT group_id FROM c GROUP BY group_id HAVING list_sort(list(kind)) <> ['contradicted', 'paraphrase_supported', 'present_irrelevant', 'verbatim_supported'] OR count(DISTINCT source_id) <> 1"""
)
def group_shapes(spark, sf_dir):
    """Groups of four documents; in some a kind stands twice, in some the origins differ."""
    kinds, d = F.array(*map(F.lit, [*scoring.RELEVANT_KINDS, scoring.IRRELEVANT_KIND])), F.col("doc_id")
    kind = F.element_at(kinds, F.when(d % 28 == 3, 1).otherwise(d % 4 + 1).cast("int"))
    cases = documents(spark, sf_dir).select(F.expr("doc_id div 4").alias("group_id"), kind.alias("kind"), F.when(d % 36 == 5, "other").otherwise("s").alias("source_id"), F.lit(0).alias("original_start"), F.lit(9).alias("original_end"))
    return scoring.group_shapes(cases).select("group_id")


@plans.add(
    """SELECT run_id::BIGINT AS run_id, problem FROM (VALUES (1, 'repeated_context'), (2, 'malformed_context'), (2, 'other_source'), (3, 'other_cases'), (4, 'other_score'), (5, 'other_completeness')) v(run_id, problem)
WHERE run_id IN (SELECT doc_id % 6 FROM documents WHERE doc_id % 12 < 6)"""
)
def run_problems(spark, sf_dir):
    """Six recorded runs, all but the first with one thing that does not hold."""
    d, run = F.col("doc_id"), (F.col("doc_id") % 6).alias("run_id")
    docs, case = documents(spark, sf_dir).where(F.length("text") > 0), F.concat(F.lit("c"), F.col("doc_id").cast("string"))
    status, odd = F.when(d % 4 == 0, "contradicted").otherwise("supported"), d % 12
    gold = docs.where("doc_id % 12 <> 3").select(run, case.alias("case_id"), F.lit("supported").alias("expected_status"))
    predictions = docs.select(run, case.alias("claim_id"), status.alias("status"), F.sha2("text", 256).alias("source_sha256"))
    contexts = docs.select(run, case.alias("case_id"), F.when(odd == 2, "xyz").otherwise(F.sha2("text", 256)).alias("sha256"), F.length("text").alias("characters"), F.when(odd == 1, 2).otherwise(1).alias("copies"))
    contexts = contexts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
    held = docs.where("doc_id % 12 <> 3").groupBy(run).agg(F.avg((status == "supported").cast("double")).alias("accuracy"))
    runs = held.select("run_id", F.when(F.col("run_id") == 4, F.col("accuracy") / 2 + 0.01).otherwise(F.col("accuracy")).alias("accuracy"), (~F.col("run_id").isin(3, 5)).alias("complete"))
    return scoring.revalidated(runs, gold, predictions, contexts)


@plans.add(
    """WITH r AS (SELECT 'r' || k AS run_id, CASE WHEN doc_id % 3 = 0 THEN 'supported' WHEN doc_id % 3 = 1 THEN 'contradicted' ELSE 'insufficient' END AS expected,
  ['supported', 'contradicted', 'insufficient'][(n_chars * (k + 1) + doc_id) % 3 + 1] AS actual FROM documents, range(3) t(k))
SELECT run_id, count(*) AS cases, round(avg((expected = actual)::INTEGER), 9) AS three_way_accuracy, round(avg(((expected = 'supported') = (actual = 'supported'))::INTEGER), 9) AS binary_accuracy,
  round(avg((actual = 'supported')::INTEGER) FILTER (expected = 'supported'), 9) AS supported_recall, round(avg((actual <> 'supported')::INTEGER) FILTER (expected <> 'supported'), 9) AS unsupported_recall FROM r GROUP BY run_id"""
)
def compared_runs(spark, sf_dir):
    """Three runs over the same cases."""
    d = F.col("doc_id")
    rows = documents(spark, sf_dir).select("doc_id", F.col("n_chars").cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    expected = F.when(d % 3 == 0, "supported").when(d % 3 == 1, "contradicted").otherwise("insufficient")
    actual = F.element_at(F.array(*map(F.lit, ["supported", "contradicted", "insufficient"])), ((F.col("n") * (F.col("k") + 1) + d) % 3 + 1).cast("int"))
    out = scoring.compared_runs(rows.select(F.concat(F.lit("r"), "k").alias("run_id"), d.alias("case_id"), F.lit("kind").alias("kind"), expected.alias("expected_status"), actual.alias("actual")))
    return out.withColumns({c: F.round(c, 9) for c in out.columns[2:]})
