"""Scores over labelled documents: the expected status comes from a label, the actual one from the
document itself; documents without a prediction count as missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import scoring as S
from plumbline.plans.tools import Plans, table

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql

_CASES = """
cases AS (SELECT l.doc_id AS case_id, CASE WHEN quality = 1 THEN 'supported' WHEN toxic = 1 THEN 'contradicted' ELSE 'insufficient' END AS expected_status,
  'k' || (l.doc_id % 3) AS kind,
  CASE WHEN l.doc_id % 13 = 0 THEN 'missing' WHEN n_chars % 3 = 0 THEN 'insufficient' WHEN n_chars % 7 = 0 THEN 'contradicted' ELSE 'supported' END AS actual
  FROM labels l JOIN documents d USING (doc_id))"""


def cases(spark, sf_dir):
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = labels.join(docs, "doc_id")
    want = F.when(F.col("quality") == 1, "supported").when(F.col("toxic") == 1, "contradicted").otherwise("insufficient")
    gold = rows.select(F.col("doc_id").alias("case_id"), want.alias("expected_status"), F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string")).alias("kind"))
    got = F.when(F.col("n_chars") % 3 == 0, "insufficient").when(F.col("n_chars") % 7 == 0, "contradicted").otherwise("supported")
    return S.judged(gold, rows.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("claim_id"), got.alias("status")))


@plans.add(f"WITH {_CASES} SELECT expected_status AS expected, actual, count(*) AS n FROM cases GROUP BY ALL")
def support_confusion(spark, sf_dir):
    return S.confusion(cases(spark, sf_dir))


@plans.add(
    f"""WITH {_CASES}, a AS (SELECT expected_status AS status, count(*) AS support, count(*) FILTER (actual = expected_status) AS tp FROM cases GROUP BY 1),
b AS (SELECT actual AS status, count(*) AS predicted FROM cases GROUP BY 1),
s AS (SELECT status, support, tp::DOUBLE / nullif(coalesce(predicted, 0), 0) AS precision, tp::DOUBLE / support AS recall FROM a LEFT JOIN b USING (status))
SELECT status, precision, recall, coalesce(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 0.0) AS f1, support FROM s"""
)
def support_status_scores(spark, sf_dir):
    return S.status_scores(S.confusion(cases(spark, sf_dir)))


@plans.add(f"WITH {_CASES} SELECT kind, count(*) AS total, count(*) FILTER (actual = expected_status) AS correct, avg((actual = expected_status)::INTEGER) AS accuracy FROM cases GROUP BY kind")
def accuracy_by_kind(spark, sf_dir):
    return S.accuracy_by(cases(spark, sf_dir), "kind")


@plans.add(
    f"""WITH {_CASES} SELECT avg(((expected_status = 'supported') = (actual = 'supported'))::INTEGER) AS binary_accuracy,
  avg((actual = 'supported')::INTEGER) FILTER (expected_status = 'supported') AS supported_recall, avg((actual <> 'supported')::INTEGER) FILTER (expected_status <> 'supported') AS unsupported_recall FROM cases"""
)
def binary_recall(spark, sf_dir):
    return S.binary_scores(cases(spark, sf_dir))


_SCORED = "scored AS (SELECT doc_id AS case_id, (n_chars % 97) / 97.0::DOUBLE AS score, quality = 1 AS relevant FROM labels JOIN documents USING (doc_id))"


def scored(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.col("doc_id").alias("case_id"), (F.col("n_chars") % 97 / F.lit(97.0)).alias("score"), (F.col("quality") == 1).alias("relevant"))


@plans.add(f"WITH {_SCORED} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 9) AS roc_auc FROM scored p, scored n WHERE p.relevant AND NOT n.relevant")
def roc_auc(spark, sf_dir):
    return S.roc_auc(scored(spark, sf_dir)).select(F.round("roc_auc", 9).alias("roc_auc"))


@plans.add(
    f"""WITH {_SCORED}, r AS (SELECT relevant, row_number() OVER w AS rank, count(*) FILTER (relevant) OVER w AS hits FROM scored WINDOW w AS (ORDER BY score DESC, case_id ROWS UNBOUNDED PRECEDING))
SELECT round(avg(hits::DOUBLE / rank), 9) AS average_precision FROM r WHERE relevant"""
)
def average_precision(spark, sf_dir):
    return S.average_precision(scored(spark, sf_dir)).select(F.round("average_precision", 9).alias("average_precision"))


_GROUPS = """
g AS (SELECT doc_id // 4 AS group_id, ['verbatim_supported', 'paraphrase_supported', 'contradicted', 'present_irrelevant'][doc_id % 4 + 1] AS kind, n_chars AS score FROM documents),
w AS (SELECT group_id, max(score) FILTER (kind = 'verbatim_supported') AS v, max(score) FILTER (kind = 'paraphrase_supported') AS p, max(score) FILTER (kind = 'contradicted') AS c, max(score) FILTER (kind = 'present_irrelevant') AS i FROM g GROUP BY group_id)"""


@plans.add(
    f"""WITH {_GROUPS} SELECT count(*) FILTER (v IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL AND i IS NOT NULL) AS groups, count(*) FILTER (v IS NULL OR p IS NULL OR c IS NULL OR i IS NULL) AS incomplete,
  count(*) FILTER (v > i AND p > i AND c > i) AS all_above,
  round(avg(CASE WHEN v > i THEN 1.0 WHEN v = i THEN 0.5 ELSE 0 END) FILTER (v IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL AND i IS NOT NULL), 9) AS win_verbatim_supported,
  round(avg(CASE WHEN p > i THEN 1.0 WHEN p = i THEN 0.5 ELSE 0 END) FILTER (v IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL AND i IS NOT NULL), 9) AS win_paraphrase_supported,
  round(avg(CASE WHEN c > i THEN 1.0 WHEN c = i THEN 0.5 ELSE 0 END) FILTER (v IS NOT NULL AND p IS NOT NULL AND c IS NOT NULL AND i IS NOT NULL), 9) AS win_contradicted FROM w"""
)
def paired_ranking(spark, sf_dir):
    kinds = F.array(*map(F.lit, [*S.RELEVANT_KINDS, S.IRRELEVANT_KIND]))
    rows = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("group_id"), F.element_at(kinds, (F.col("doc_id") % 4 + 1).cast("int")).alias("kind"), F.col("n_chars").alias("score"))
    out = S.paired_ranking(rows)
    return out.select("groups", "incomplete", "all_above", *(F.round(f"win_{k}", 9).alias(f"win_{k}") for k in S.RELEVANT_KINDS))


@plans.add("SELECT source AS stratum, count(*) AS n, min(n_chars) AS least, quantile_cont(n_chars, 0.5) AS median, round(avg(n_chars), 9) AS mean, max(n_chars) AS greatest FROM documents GROUP BY source")
def stratum_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("stratum"), F.col("n_chars").alias("score"))
    return S.stratum_summary(rows).withColumn("mean", F.round("mean", 9))


@plans.add(
    f"""WITH {_CASES}, x AS (SELECT *, CASE WHEN case_id % 4 = 0 THEN expected_status ELSE actual END AS better FROM cases),
k AS (SELECT kind, avg((actual = expected_status)::INTEGER) AS b, avg((better = expected_status)::INTEGER) AS c FROM x GROUP BY kind),
o AS (SELECT round(avg((better = expected_status)::INTEGER) - avg((actual = expected_status)::INTEGER), 12) AS improvement FROM x)
SELECT improvement, (SELECT count(*) FILTER (c < b) FROM k)::INTEGER AS regressed, improvement >= 0.05 AND (SELECT count(*) FILTER (c < b) FROM k) = 0 AS passed FROM o"""
)
def admission_gate(spark, sf_dir):
    rows = cases(spark, sf_dir)
    better = rows.withColumn("actual", F.when(F.col("case_id") % 4 == 0, F.col("expected_status")).otherwise(F.col("actual")))
    out = S.admission(S.accuracy_by(rows, "kind"), S.accuracy_by(better, "kind"), "kind", "accuracy", 0.05)
    return out.select("improvement", F.size("regressed").alias("regressed"), "passed")
