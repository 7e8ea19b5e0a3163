r"""Findings, coverage and their scoring. Predictions and gold are made of the documents' lines: every line is
a found quote, every second one cut short; the lines of labelled documents are gold, but for every fifth one."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import merge_key
from plumbline.operators import extraction as X
from plumbline.plans.tools import Plans, table

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql

CATEGORIES = ["c0", "c1", "c2", "c3"]

_LINES = """
lines AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS ord, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
pred AS (SELECT doc_id AS doc, 'c' || (ord % 4) AS category, ord, CASE WHEN ord % 2 = 1 THEN substr(line, 1, 25) ELSE line END AS quote FROM lines),
gold AS (SELECT doc_id AS doc, 'c' || (ord % 4) AS category, ord, line AS span FROM lines WHERE doc_id IN (SELECT doc_id FROM labels) AND ord % 5 <> 4)"""


def lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ord", "line")).withColumn("category", F.concat(F.lit("c"), (F.col("ord") % 4).cast("string")))


def predictions(spark, sf_dir):
    quote = F.when(F.col("ord") % 2 == 1, F.substring("line", 1, 25)).otherwise(F.col("line"))
    return lines(spark, sf_dir).select("doc", "category", "ord", quote.alias("quote"))


def gold(spark, sf_dir):
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc")).distinct()
    return lines(spark, sf_dir).where("ord % 5 <> 4").join(labelled, "doc", "left_semi").select("doc", "category", "ord", F.col("line").alias("span"))


_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_MATCH = f"""
pt AS (SELECT *, {_TOKENS.format("quote")} AS t FROM pred), gt AS (SELECT *, {_TOKENS.format("span")} AS t FROM gold),
hits AS (SELECT p.doc, p.category, p.ord AS p_ord, g.ord AS g_ord FROM pt p JOIN gt g USING (doc, category)
  WHERE len(p.t) > 0 AND len(g.t) > 0 AND len(list_intersect(p.t, g.t))::DOUBLE / (len(p.t) + len(g.t) - len(list_intersect(p.t, g.t))) >= 0.5),
pc AS (SELECT category, count(*) FILTER (h) AS tp, count(*) FILTER (NOT h) AS fp FROM (SELECT category, EXISTS (SELECT 1 FROM hits WHERE hits.doc = pred.doc AND hits.category = pred.category AND hits.p_ord = pred.ord) AS h FROM pred) GROUP BY category),
gc AS (SELECT category, count(*) FILTER (NOT h) AS fn FROM (SELECT category, EXISTS (SELECT 1 FROM hits WHERE hits.doc = gold.doc AND hits.category = gold.category AND hits.g_ord = gold.ord) AS h FROM gold) GROUP BY category),
counts AS (SELECT category, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM pc FULL JOIN gc USING (category)),
scores AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM counts),
prf AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM scores)"""


@plans.add(f"WITH {_LINES}, {_MATCH} SELECT category, tp, fp, fn, precision, recall, f1 FROM prf")
def jaccard_prf_by_category(spark, sf_dir):
    return X.precision_recall(X.match_counts(predictions(spark, sf_dir), gold(spark, sf_dir))).select("category", "tp", "fp", "fn", "precision", "recall", "f1")


_NORM = "lower(trim(regexp_replace(translate({}, '‘’“”–— ', '''''\"\"-- '), '\\s+', ' ', 'g')))"
_GROUND = f"ground AS (SELECT p.*, contains({_NORM.format('d.text')}, {_NORM.format('p.quote')}) AS grounded FROM pred p JOIN documents d ON d.doc_id = p.doc WHERE trim(quote) <> '')"


@plans.add(f"WITH {_LINES}, {_GROUND} SELECT count(*) FILTER (grounded) AS grounded, count(*) AS quotes FROM ground")
def grounding_rate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return X.grounding(predictions(spark, sf_dir), docs).agg(F.count_if("grounded").alias("grounded"), F.count("*").alias("quotes"))


@plans.add(f"WITH {_LINES}, {_MATCH} SELECT coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp FROM counts WHERE category IN ('c2', 'c3')")
def high_severity_precision(spark, sf_dir):
    severity = spark.createDataFrame([("c0", 1), ("c1", 3), ("c2", 4), ("c3", 5)], "category string, severity int")
    return X.severe_precision(predictions(spark, sf_dir), gold(spark, sf_dir), severity)


@plans.add(
    f"""WITH {_LINES}, {_MATCH}, {_GROUND}, v AS (SELECT (SELECT avg(f1) FROM prf WHERE tp + fp + fn > 0) AS macro_f1,
  (SELECT count(*) FILTER (grounded)::DOUBLE / count(*) FROM ground) AS grounding, (SELECT sum(tp)::DOUBLE / sum(tp + fp) FROM counts WHERE category IN ('c2', 'c3')) AS severe)
SELECT 'macro_f1' AS criterion, macro_f1 AS value, coalesce(macro_f1 >= 0.55, false) AS passed FROM v
UNION ALL SELECT 'grounding', grounding, coalesce(grounding >= 0.95, false) FROM v
UNION ALL SELECT 'severe_precision', severe, coalesce(severe >= 0.70, false) FROM v
UNION ALL SELECT 'probe_gap', NULL, false"""
)
def macro_f1_gate(spark, sf_dir):
    """The matches are counted once; the severe categories are a sum over some of the counts."""
    scores = X.precision_recall(X.match_counts(predictions(spark, sf_dir), gold(spark, sf_dir)))
    severe = F.col("category").isin("c2", "c3")
    scores = scores.agg(F.avg(F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col("f1"))).alias("macro_f1"), *(F.coalesce(F.sum(F.when(severe, F.col(c))), F.lit(0)).alias(c) for c in ("tp", "fp")))
    row = scores.crossJoin(grounding_rate(spark, sf_dir))  # one row each
    return X.gate(row.withColumn("probe_gap", F.lit(None).cast("double")))


@plans.add(
    f"""WITH {_LINES}, {_MATCH} SELECT doc, category, count(*) AS n FROM gold g
WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.doc = g.doc AND hits.category = g.category AND hits.g_ord = g.ord) GROUP BY doc, category"""
)
def unmatched_gold(spark, sf_dir):
    """H8: gold that no prediction matches."""
    return X.unmatched_gold(predictions(spark, sf_dir), gold(spark, sf_dir))


@plans.add(
    f"""WITH {_LINES}, {_MATCH} SELECT DISTINCT doc, category FROM gold g
WHERE NOT EXISTS (SELECT 1 FROM hits WHERE hits.doc = g.doc AND hits.category = g.category AND hits.g_ord = g.ord) ORDER BY doc, category LIMIT 20"""
)
def missed_pairs(spark, sf_dir):
    """I4: the report of the first 20 (doc, category) with missed gold."""
    return X.missed_pairs(predictions(spark, sf_dir), gold(spark, sf_dir))


_ALTERED = "CASE WHEN ord % 3 = 0 THEN quote || ' not there' ELSE quote END"


@plans.add(
    f"""WITH {_LINES}, q AS (SELECT doc, category, {_ALTERED} AS quote FROM pred WHERE trim({_ALTERED}) <> '')
SELECT q.doc, category, substr(trim(regexp_replace(quote, '\\s+', ' ', 'g')), 1, 80) AS head FROM q JOIN documents d ON d.doc_id = q.doc
WHERE NOT contains({_NORM.format('d.text')}, {_NORM.format('quote')}) ORDER BY 1, 2, 3 LIMIT 10"""
)
def ungrounded_report(spark, sf_dir):
    """The report of the first ten quotes that their document does not hold."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    altered = F.when(F.col("ord") % 3 == 0, F.concat("quote", F.lit(" not there"))).otherwise(F.col("quote"))
    return X.ungrounded(X.grounding(predictions(spark, sf_dir).withColumn("quote", altered), docs))


@plans.add(f"WITH {_LINES} SELECT doc, category, ord::INTEGER AS ord FROM pred WHERE category IN ('c1', 'c3')")
def allowed_findings(spark, sf_dir):
    """Findings of a pack that has two of the four categories."""
    pack = spark.createDataFrame([("c1",), ("c3",), ("other",), ("c1",)], "category string")
    return X.allowed(predictions(spark, sf_dir), pack).select("doc", "category", "ord")


@plans.add(
    """WITH a AS (SELECT conv_id AS file, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS l FROM conversations), b AS (SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS g FROM documents)
SELECT DISTINCT file FROM (SELECT * FROM a WHERE length(l) >= 25) JOIN (SELECT DISTINCT substr(g, (length(g) // 3)::INTEGER + 1, 40) AS g FROM b UNION SELECT l || ' and more' FROM a WHERE file % 5 = 0) ON length(g) >= 25 AND (contains(l, g) OR contains(g, l))"""
)
def literal_overlap(spark, sf_dir):
    """Conversations as files of literals, 40 characters out of the middle of each document and some longer texts as gold."""
    literals = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("text").alias("literal"))
    low = merge_key(F.col("text"))
    spans = table(spark, sf_dir, "documents").select(F.substring(low, (F.length(low) / 3).cast("int") + 1, F.lit(40)).alias("span"))
    longer = literals.where("file % 5 = 0").select(F.concat(merge_key(F.col("literal")), F.lit(" and more")).alias("span"))
    return X.literal_overlap(literals, spans.union(longer))


@plans.add("SELECT conv_id AS file, count(*) AS literals FROM conversations WHERE length(text) >= 12 GROUP BY 1 HAVING count(*) > 4")
def over_capacity(spark, sf_dir):
    """Conversations as files with more than four literals."""
    return X.over_capacity(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file"), F.col("text").alias("literal")), 4)


@plans.add(
    """WITH l AS (SELECT doc_id AS doc, generate_subscripts(p, 1) - 1 AS ord, unnest(p) AS quote FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
k AS (SELECT *, 'c' || ((ord + 1) % 2) AS category FROM l)
SELECT doc, category, ord::INTEGER AS ord FROM k QUALIFY row_number() OVER (PARTITION BY doc, category, lower(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) ORDER BY ord) = 1"""
)
def merge_findings_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("ord", "quote"))
    found = found.withColumn("category", F.concat(F.lit("c"), ((F.col("ord") + 1) % 2).cast("string"))).withColumn("segment", F.lit(0))
    return X.merge_findings(found).select("doc", "category", "ord")


@plans.add(
    """WITH s AS (SELECT doc_id AS doc, seg, CASE WHEN (doc_id + seg) % 9 <> 0 THEN list_filter(['c0', 'c1', 'c2', 'c3'], lambda c: (doc_id + seg + c[2]::INTEGER) % 5 <> 0 OR doc_id % 2 = 0) END AS checked FROM documents, range(3) r(seg)),
t AS (SELECT doc, count(*) AS total, count(checked) AS completed FROM s GROUP BY doc),
c AS (SELECT unnest(['c0', 'c1', 'c2', 'c3']) AS category),
k AS (SELECT doc, category, count(*) FILTER (list_contains(checked, category)) AS ticked FROM s, c GROUP BY doc, category)
SELECT doc, category, CASE WHEN doc % 10 = 3 AND category = 'c1' THEN 'risk_found' WHEN completed = total AND ticked = total THEN 'checked_clear' ELSE 'incomplete' END AS status FROM t JOIN k USING (doc)"""
)
def coverage_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    segments = docs.select("doc", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("segment"))
    names = F.array(*map(F.lit, CATEGORIES))
    ticked = F.filter(names, lambda c: ((F.col("doc") + F.col("segment") + F.substring(c, 2, 1).cast("int")) % 5 != 0) | (F.col("doc") % 2 == 0))
    segments = segments.withColumn("checked", F.when((F.col("doc") + F.col("segment")) % 9 != 0, ticked))
    found = docs.where("doc % 10 = 3").withColumn("category", F.lit("c1"))
    return X.coverage(segments, found, spark.createDataFrame([(c,) for c in CATEGORIES], "category string")).select("doc", "category", "status")


@plans.add("SELECT role AS backend, 'm' || (turn % 2) AS model, count(*) AS calls, sum(greatest(1, length(text) // 4))::BIGINT AS in_tokens, sum(turn)::BIGINT AS out_tokens FROM conversations GROUP BY ALL")
def usage_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    usage = rows.select(F.col("role").alias("backend"), F.concat(F.lit("m"), (F.col("turn") % 2).cast("string")).alias("model"), X.token_estimate(F.col("text")).alias("in_tokens"), F.col("turn").alias("out_tokens"))
    return X.usage_totals(usage)


@plans.add(
    """SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 3) THEN text END AS quote, CASE WHEN doc_id % 4 = 0 THEN 1 END AS checked FROM
(SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS text FROM documents)"""
)
def reply_parse(spark, sf_dir):
    """Replies in prose, broken ones and bare ones around an object."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z ]", "").alias("t"))
    quote = F.col("t")
    whole = F.concat(F.lit('Sure: {"findings": {"c": ["'), quote, F.lit('"]}, "checked_categories": ["c"]} done'))
    part = F.concat(F.lit('{"findings": {"c": ["'), quote, F.lit('"]}}'))
    reply = F.when(F.col("doc_id") % 4 == 0, whole).when(F.col("doc_id") % 4 == 1, "no object here").when(F.col("doc_id") % 4 == 2, '{"findings": {"c": [').otherwise(part)
    parsed = X.parse_findings(docs.withColumn("reply", reply))
    return parsed.select("doc_id", F.col("findings")["c"][0].alias("quote"), F.nullif(F.size("checked"), F.lit(-1)).alias("checked"))
