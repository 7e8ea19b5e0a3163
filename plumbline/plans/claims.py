"""Verification, support, authority and shadow outcomes over claims that cite the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import engine, policies
from plumbline.functions.text import normalise_anchor
from plumbline.operators import anchor, decisions
from plumbline.plans.tools import Plans, norm_sql, table

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql

# Claims are made of documents: the remainder of doc_id by 7 says what is wrong with a claim.
# 0 cites nothing; 1 has no excerpt; 2 has its blanks doubled; 3 is a text backwards; 4 is the whole text with its first e
# or every 20th character replaced; 5 cites a paywalled source; 6 one that there is not. Excerpts come from anywhere in the text.
KINDS = ["unclassified", "company_assertion", "analyst_calculation", "analyst_inference"]


def claims_and_sources(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    m = F.col("doc_id") % 7
    source = F.concat(F.lit("s"), F.col("doc_id").cast("string"))
    uri = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    place = (F.col("doc_id") * 37 % F.greatest(F.lit(1), F.length("text") - 120)).cast("int") + 1
    part, long = F.substring(F.col("text"), place, F.lit(120)), F.length("text") >= 200
    often = F.regexp_replace("text", r"(?s)(.{19}).", "$1q")
    excerpt = (
        F.when(m == 1, F.lit(None).cast("string")).when(m == 2, F.replace(part, F.lit(" "), F.lit("  ")))
        .when(m == 3, F.reverse(part)).when((m == 4) & long & (F.col("doc_id") % 21 == 4), often).when((m == 4) & long, F.regexp_replace("text", "(?s)^([^e]*)e", "$1q"))
        .otherwise(part)
    )
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("doc_id") % 4 + 1).cast("int"))
    claims = docs.select(
        F.col("doc_id").alias("claim_id"), F.when(m != 0, source).alias("source_id"), F.when(m != 0, uri).alias("uri"), excerpt.alias("excerpt"),
        F.when(F.col("doc_id") % 14 == 1, "page 1").alias("locator"), kind.alias("provenance_class"), "lang", (F.col("doc_id") % 8 == 2).alias("has_lineage"),
    )
    sources = docs.where(m != 6).select(source.alias("source_id"), uri.alias("uri"), F.when(m != 5, F.col("text")).alias("text"), F.when(m == 5, "source_paywalled").alias("failure"))
    return claims, sources


_CLAIMS = f"""
claims AS (
  SELECT doc_id AS claim_id, lang, text,
         CASE WHEN doc_id % 7 <> 0 THEN 's' || doc_id END AS source_id,
         CASE WHEN doc_id % 7 = 1 THEN NULL WHEN doc_id % 7 = 2 THEN replace(part, ' ', '  ') WHEN doc_id % 7 = 3 THEN reverse(part)
              WHEN doc_id % 7 = 4 AND length(text) >= 200 AND doc_id % 21 = 4 THEN regexp_replace(text, '(?s)(.{{19}}).', '\\1q', 'g')
              WHEN doc_id % 7 = 4 AND length(text) >= 200 THEN regexp_replace(text, '(?s)^([^e]*)e', '\\1q') ELSE part END AS excerpt,
         CASE WHEN doc_id % 14 = 1 THEN 'page 1' END AS locator,
         ['unclassified', 'company_assertion', 'analyst_calculation', 'analyst_inference'][doc_id % 4 + 1] AS provenance_class,
         doc_id % 8 = 2 AS has_lineage
  FROM (SELECT *, substr(text, (doc_id * 37 % greatest(1, length(text) - 120))::INTEGER + 1, 120) AS part FROM documents)
), placed AS (
  SELECT *, {norm_sql("excerpt")} AS n, {norm_sql("text")} AS h FROM claims
), verified AS (
  SELECT claim_id, lang, source_id, excerpt, provenance_class, has_lineage,
    CASE WHEN source_id IS NULL THEN CASE WHEN provenance_class <> 'unclassified' THEN 'provenance' ELSE 'no_source' END
         WHEN claim_id % 7 IN (5, 6) THEN 'fetch_failed'
         WHEN coalesce(excerpt, '') = '' THEN CASE WHEN locator IS NOT NULL THEN 'locator' ELSE 'no_excerpt' END
         WHEN n = '' OR h = '' OR contains(h, n) THEN 'exact' ELSE 'fuzzy' END AS method,
    CASE WHEN source_id IS NULL OR claim_id % 7 IN (5, 6) OR coalesce(excerpt, '') = '' THEN NULL
         WHEN n <> '' AND h <> '' AND contains(h, n) THEN 'found'
         WHEN claim_id % 7 = 4 AND length(text) >= 200 THEN CASE WHEN claim_id % 21 = 4 THEN 'ambiguous' ELSE 'found' END ELSE 'not_found' END AS anchor,
    CASE WHEN source_id IS NULL THEN NULL WHEN claim_id % 7 = 5 THEN 'source_paywalled' WHEN claim_id % 7 = 6 THEN 'source_unreachable' END AS failure
  FROM placed
)"""

_COUNTS = """
    count(*) AS detected_claims, count(source_id) AS cited_claims,
    count(*) FILTER (source_id IS NOT NULL AND method <> 'fetch_failed') AS readable_citations,
    count(*) FILTER (source_id IS NOT NULL AND coalesce(excerpt, '') <> '') AS excerpt_claims,
    count(*) FILTER (anchor = 'found') AS anchored_excerpts,
    count(*) FILTER (anchor = 'found' AND method = 'exact') AS exact_found,
    count(*) FILTER (anchor = 'found' AND method = 'fuzzy') AS fuzzy_found,
    count(*) FILTER (anchor = 'ambiguous') AS fuzzy_ambiguous,
    count(*) FILTER (anchor = 'not_found' AND method = 'fuzzy') AS fuzzy_not_found,
    count(*) FILTER (method = 'locator') AS locator_only, count(*) FILTER (method = 'no_excerpt') AS no_excerpt,
    count(*) FILTER (method = 'fetch_failed') AS fetch_failed, count(*) FILTER (method = 'no_source') AS no_source,
    count(*) FILTER (method = 'provenance') AS typed_provenance,
    count(*) FILTER (provenance_class = 'analyst_calculation') AS calculations,
    count(*) FILTER (provenance_class = 'analyst_calculation' AND has_lineage) AS calculations_with_lineage"""


@plans.add(f"WITH {_CLAIMS} SELECT claim_id, method, anchor, failure FROM verified")
def verify_claims(spark, sf_dir):
    return anchor.verify_claims(*claims_and_sources(spark, sf_dir)).select("claim_id", "method", "anchor", "failure")


@plans.add(
    f"""WITH {_CLAIMS}, c AS (SELECT {_COUNTS} FROM verified), r AS (
  SELECT unnest([{{'name': 'citation_coverage', 'a': cited_claims, 'b': detected_claims}}, {{'name': 'source_accessibility', 'a': readable_citations, 'b': cited_claims}},
    {{'name': 'excerpt_anchoring', 'a': anchored_excerpts, 'b': excerpt_claims}}, {{'name': 'exact_anchor_share', 'a': exact_found, 'b': anchored_excerpts}},
    {{'name': 'fuzzy_anchor_share', 'a': fuzzy_found, 'b': anchored_excerpts}}, {{'name': 'calculation_lineage_coverage', 'a': calculations_with_lineage, 'b': calculations}}]) AS x FROM c)
SELECT x.name AS name, x.a AS numerator, x.b AS denominator, CASE WHEN x.b > 0 THEN x.a::DOUBLE / x.b END AS value FROM r"""
)
def verification_metrics(spark, sf_dir):
    verified = anchor.verify_claims(*claims_and_sources(spark, sf_dir))
    return anchor.rate_envelopes(anchor.verification_counts(verified))


@plans.add(f"WITH {_CLAIMS} SELECT provenance_class, {_COUNTS} FROM verified GROUP BY provenance_class")
def metrics_by_provenance(spark, sf_dir):
    return anchor.verification_counts(anchor.verify_claims(*claims_and_sources(spark, sf_dir)), ["provenance_class"])


@plans.add(f"WITH {_CLAIMS} SELECT lang, method, count(*) AS n FROM verified GROUP BY GROUPING SETS ((), (lang), (lang, method))")
def method_grouping_sets(spark, sf_dir):
    verified = anchor.verify_claims(*claims_and_sources(spark, sf_dir))
    return verified.groupingSets([[], ["lang"], ["lang", "method"]], "lang", "method").agg(F.count("*").alias("n"))


@plans.add(
    f"""SELECT item_id, doc_id FROM (SELECT item_id, {norm_sql("text")} AS n FROM benchmark) b
JOIN (SELECT doc_id, {norm_sql("text")} AS h FROM documents) d ON n <> '' AND contains(h, n)"""
)
def exact_anchor_pairs(spark, sf_dir):
    needles = table(spark, sf_dir, "benchmark").select("item_id", normalise_anchor(F.col("text")).alias("needle"))
    docs = table(spark, sf_dir, "documents").select("doc_id", normalise_anchor(F.col("text")).alias("haystack"))
    return anchor.substring_join(needles, docs, "needle", "haystack", "doc_id").select("item_id", "doc_id")


@plans.add(
    f"""SELECT doc_id, CASE WHEN {norm_sql("text")} = '' THEN 'not_found' WHEN length(text) < 200 THEN 'found' WHEN doc_id % 2 = 0 THEN 'ambiguous' ELSE 'found' END AS anchor,
  CASE WHEN length(text) < 200 OR (doc_id % 2 = 1 AND NOT contains(text, 'e')) THEN 'exact' ELSE 'fuzzy' END AS method FROM documents"""
)
def fuzzy_anchor(spark, sf_dir):
    """Whole texts in themselves: every 20th character replaced (even ids), the first e (odd ids), short ones as they are."""
    even = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("text", r"(?s)(.{19}).", "$1q")).otherwise(F.regexp_replace("text", "(?s)^([^e]*)e", "$1q"))
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") >= 200, even).otherwise(F.col("text")).alias("excerpt"), F.col("text").alias("source_text"))
    return anchor.anchor_excerpts(pairs).select("doc_id", "anchor", "method")


_SHARE = """SELECT id, s, 2.0 * sum(least(have, c)) / any_value(ln + w - 2) AS share FROM (
  SELECT a.id, a.s, g.g, any_value(g.c) AS c, count(*) AS have, any_value(a.ln) AS ln, any_value(a.w) AS w FROM {starts} a JOIN grams g ON g.id = a.id AND g.i BETWEEN a.s + 1 AND a.s + a.w - 1 GROUP BY a.id, a.s, g.g) GROUP BY id, s"""


@plans.add(
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {norm_sql("text")} AS h FROM conversations WHERE text IS NOT NULL),
x AS (SELECT id, h, regexp_replace(substr(h, length(h) // 3 + 1, length(h) // 3), '(.{{8}}).', '\\1q', 'g') AS raw FROM t),
p AS (SELECT id, h, {norm_sql("raw")} AS n FROM x),
q AS (SELECT *, length(n) AS ln, least(length(h), floor(length(n) * 1.2 + 0.999999)::INTEGER) AS w, greatest(1, length(n) // 4) AS stride FROM p WHERE length(n) >= 2 AND NOT contains(h, n)),
need AS (SELECT id, substr(n, i, 2) AS g, count(*) AS c FROM (SELECT id, n, unnest(generate_series(1, ln - 1)) AS i FROM q) GROUP BY ALL),
grams AS (SELECT id, i, g, c FROM (SELECT id, i, substr(h, i, 2) AS g FROM (SELECT id, h, unnest(generate_series(1, length(h) - 1)) AS i FROM q)) JOIN need USING (id, g)),
coarse AS (SELECT id, ln, w, unnest(generate_series(0, length(h) - w, stride)) AS s FROM q),
walked AS ({_SHARE.format(starts="coarse")}),
best AS (SELECT id, max(share) AS share, arg_min(s, (-share, s)) AS place FROM walked GROUP BY id),
fine AS (SELECT id, ln, w, unnest(generate_series(greatest(0, coalesce(place, 0) - stride), least(length(h) - w, coalesce(place, 0) + stride), 7)) AS s FROM q LEFT JOIN best USING (id) WHERE length(h) > w),
near AS (SELECT id, max(share) AS share FROM ({_SHARE.format(starts="fine")}) GROUP BY id)
SELECT p.id, CASE WHEN n = '' OR h = '' OR contains(h, n) THEN 'exact' ELSE 'fuzzy' END AS method,
  round(CASE WHEN n <> '' AND contains(h, n) THEN 1.0 WHEN n = '' OR h = '' THEN 0.0 ELSE greatest(coalesce(best.share, 0), coalesce(near.share, 0)) END, 9)::DOUBLE AS score
FROM p LEFT JOIN best USING (id) LEFT JOIN near USING (id)"""
)
def fuzzy_scores(spark, sf_dir):
    """The middle third of each turn, every ninth character replaced, in the whole turn: the score itself."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), normalise_anchor(F.col("text")).alias("source_text"))
    third = F.floor(F.length("source_text") / 3).cast("int")
    excerpt = F.regexp_replace(F.substring(F.col("source_text"), third + 1, third), "(?s)(.{8}).", "$1q")
    return anchor.anchor_excerpts(turns.withColumn("excerpt", excerpt)).select("id", "method", F.round("score", 9).alias("score"))


_NUMBERS = "list_filter(regexp_extract_all(n, '[$£€]?\\pN[\\pN,.]*%?'), lambda t: NOT contains(h, t))"


@plans.add(
    f"""WITH p AS (SELECT doc_id, {norm_sql("text || CASE WHEN length(text) >= 100 THEN ' cost 1239 units' ELSE ' cost 1234 units' END")} AS n, {norm_sql("text || ' cost 1234 units'")} AS h FROM documents)
SELECT doc_id, CASE WHEN contains(h, n) OR len({_NUMBERS}) = 0 THEN 'found' ELSE 'ambiguous' END AS anchor, CASE WHEN contains(h, n) THEN 'exact' ELSE 'fuzzy' END AS method FROM p"""
)
def numeric_guard(spark, sf_dir):
    """An excerpt that is the source but for one digit of an amount is not found."""
    amount = F.when(F.length("text") >= 100, " cost 1239 units").otherwise(" cost 1234 units")
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", amount).alias("excerpt"), F.concat("text", F.lit(" cost 1234 units")).alias("source_text"))
    return anchor.anchor_excerpts(pairs).select("doc_id", "anchor", "method")


@plans.add(
    f"""WITH {_CLAIMS}, s AS (SELECT CASE WHEN contains({norm_sql("text")}, {norm_sql("excerpt")}) AND {norm_sql("excerpt")} <> '' THEN 'supported' ELSE 'insufficient' END AS status
  FROM claims WHERE excerpt IS NOT NULL)
SELECT v.status, count(s.status) AS n FROM (VALUES ('contradicted'), ('insufficient'), ('not_assessed'), ('source_unavailable'), ('supported')) v(status)
LEFT JOIN s USING (status) GROUP BY v.status"""
)
def exact_support_status_counts(spark, sf_dir):
    claims, _ = claims_and_sources(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("source_text"))
    rows = claims.where("excerpt is not null").join(docs, "claim_id").withColumnRenamed("excerpt", "claim_text")
    return decisions.status_counts(decisions.exact_support(rows), "label", decisions.SUPPORT_STATUSES)


@plans.add(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not_assessed' WHEN doc_id % 5 = 1 THEN 'source_unavailable' WHEN doc_id % 11 = 3 THEN 'not_assessed'
       WHEN doc_id % 3 = 0 OR (doc_id % 10) / 10.0 < 0.5 THEN 'insufficient' ELSE 'supported' END AS status,
  CASE WHEN doc_id % 5 = 0 THEN 'no_source' WHEN doc_id % 5 = 1 THEN 'source_changed' WHEN doc_id % 11 = 3 THEN 'detector_error:ValueError' END AS failure
FROM documents"""
)
def support_assessment(spark, sf_dir):
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (d % 5 != 0).alias("cited"), (d % 5 != 1).alias("resolved"), F.when(d % 5 == 1, "source_changed").alias("source_failure"),
        F.when(d % 11 == 3, "ValueError").alias("detector_error"), F.lit("supported").alias("label"), F.when(d % 3 != 0, (d % 10) / 10).alias("confidence"),
    )
    return decisions.assess_support(rows, 0.5).select("doc_id", "status", "failure")


@plans.add(
    f"""WITH {_CLAIMS}, d AS (SELECT doc_id AS claim_id, CASE WHEN toxic = 1 THEN 'independent_secondary' ELSE 'independent_primary' END AS kind FROM labels WHERE quality = 0)
SELECT claim_id, coalesce(kind, CASE WHEN provenance_class IN ('analyst_calculation', 'analyst_inference') THEN 'analyst_derived'
    WHEN provenance_class = 'company_assertion' THEN 'subject_provided' ELSE 'unknown_authority' END) AS kind,
  CASE WHEN kind IS NOT NULL THEN 'source_metadata' WHEN provenance_class <> 'unclassified' THEN 'artifact_declaration' ELSE 'unassigned' END AS basis
FROM claims LEFT JOIN d USING (claim_id)"""
)
def authority_assignment(spark, sf_dir):
    claims, _ = claims_and_sources(spark, sf_dir)
    kind = F.when(F.col("toxic") == 1, "independent_secondary").otherwise("independent_primary")
    declared = table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("claim_id"), kind.alias("kind"), F.lit("source_metadata").alias("basis"), F.lit("reviewer").alias("assigned_by"))
    return decisions.assign_authority(claims, declared).select("claim_id", "kind", "basis")


@plans.add(
    f"""WITH {_CLAIMS} SELECT claim_id,
  CASE WHEN source_id IS NULL THEN 'not_assessed' WHEN failure IS NOT NULL THEN 'source_unavailable' WHEN anchor IS DISTINCT FROM 'found' THEN 'needs_validation' ELSE 'withheld' END AS outcome,
  CASE WHEN source_id IS NULL THEN 'claim_has_no_external_source' WHEN failure IS NOT NULL THEN failure WHEN anchor IS DISTINCT FROM 'found' THEN 'anchor_' || coalesce(anchor, 'not_assessed')
       WHEN claim_id % 3 = 0 THEN 'missing_verification_question' ELSE 'no_semantic_component_admitted' END AS reason
FROM verified"""
)
def shadow_outcomes(spark, sf_dir):
    verified = anchor.verify_claims(*claims_and_sources(spark, sf_dir))
    question = F.when(F.col("claim_id") % 3 == 0, " ").otherwise("Is it so?")
    rows = verified.withColumn("cited", F.col("source_id").isNotNull()).withColumn("question", question)
    return decisions.shadow_outcomes(rows).select("claim_id", "outcome", "reason")


@plans.add(ORACLE_SQL["verification_metrics"])
def checked_rates(spark, sf_dir):
    """The rates of a whole run under a policy."""
    claims, sources = claims_and_sources(spark, sf_dir)
    more = {c: F.lit(None).cast("string") for c in ("text", "question") if c not in claims.columns}
    policy = policies.SupportPolicy("exact", "1", "2024-01-01", policies.Detector("exact", "normalised-substring", "1"), 1.0)
    return engine.check(claims.withColumns(more), sources, policy)["rates"]
