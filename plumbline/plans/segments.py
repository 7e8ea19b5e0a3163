"""Windows, offsets, intervals and their measures over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import sentences_of_text
from plumbline.operators import spans
from plumbline.plans.tools import Plans, table

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql

SIZE, OVERLAP = 500, 50

_WINDOWS = f"""
starts AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - {SIZE}) / {SIZE - OVERLAP}.0)::BIGINT))) AS seq FROM documents WHERE length(text) > 0),
windows AS (SELECT doc_id, seq::INTEGER AS seq, (seq * {SIZE - OVERLAP})::INTEGER AS s, least(seq * {SIZE - OVERLAP} + {SIZE}, length(text))::INTEGER AS e, text FROM starts)"""


def windows_of(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, spans.fixed_windows(docs, "doc_id", size=SIZE, overlap=OVERLAP)


@plans.add(f"WITH {_WINDOWS} SELECT doc_id, seq, s AS start, e AS \"end\", substr(text, s + 1, e - s) AS segment FROM windows")
def fixed_windows(spark, sf_dir):
    return windows_of(spark, sf_dir)[1]


@plans.add(
    f"""WITH {_WINDOWS}, kept AS (SELECT * FROM windows WHERE seq % 3 <> 2),
f AS (SELECT *, greatest(s, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS fresh FROM kept),
m AS (SELECT doc_id, count(*) AS segments, max(e - s) AS longest, sum(e - s) AS characters, sum(greatest(0, e - fresh)) AS covered, sum(length(regexp_replace(substr(text, fresh + 1, greatest(0, e - fresh)), '\\s', '', 'g'))) AS solid FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(segments, 0) AS segments, coalesce(segments, 0) > 1 AS several, coalesce(longest, 0) AS longest, round(coalesce(covered / nullif(length(text), 0)::DOUBLE, 1), 9) AS covered_ratio,
  round(coalesce(solid / nullif(length(regexp_replace(text, '\\s', '', 'g')), 0)::DOUBLE, 1), 9) AS covered_solid_ratio, coalesce(characters - covered, 0)::BIGINT AS overlap_excess FROM documents LEFT JOIN m USING (doc_id)"""
)
def segment_measures(spark, sf_dir):
    """H20 over windows of which every third one is left out."""
    docs, windows = windows_of(spark, sf_dir)
    rows = spans.segment_measures(docs, windows.where("seq % 3 <> 2"), "doc_id")
    return rows.withColumns({c: F.round(c, 9) for c in ("covered_ratio", "covered_solid_ratio")})


def intervals(spark, sf_dir):
    """Intervals of a document's windows, every third one left out."""
    return windows_of(spark, sf_dir)[1].where("seq % 3 <> 2").select("doc_id", "start", "end")


@plans.add(
    f"""WITH {_WINDOWS}, i AS (SELECT doc_id, s, e FROM windows WHERE seq % 3 <> 2),
f AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM i),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s, e) AS island FROM f)
SELECT doc_id, min(s) AS start, max(e) AS "end" FROM g GROUP BY doc_id, island"""
)
def merged_intervals(spark, sf_dir):
    return spans.merge_intervals(intervals(spark, sf_dir), "doc_id")


@plans.add("SELECT doc_id, (len(p) - 1)::INTEGER AS n, list_reduce(list_transform(p[:-2], lambda x: length(x)), lambda a, b: a + b)::INTEGER + 4 * (len(p) - 2)::INTEGER AS last_start FROM (SELECT doc_id, string_split(text, 'tion') AS p FROM documents) WHERE len(p) > 1")
def quote_offsets_nonoverlapping(spark, sf_dir):
    found = spans.offsets(F.col("text"), F.lit("tion"))
    rows = table(spark, sf_dir, "documents").select("doc_id", found.alias("o")).where(F.size("o") > 0)
    return rows.select("doc_id", F.size("o").alias("n"), F.element_at("o", -1).alias("last_start"))


@plans.add("SELECT doc_id, len(list_filter(generate_series(1, length(text)), lambda i: substr(text, i, 2) = 'ee'))::INTEGER AS n FROM documents WHERE contains(text, 'ee')")
def quote_occurrences_overlapping(spark, sf_dir):
    found = spans.overlapping_offsets(F.col("text"), F.lit("ee"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n")).where("n > 0")


def quotes(spark, sf_dir):
    """Where the 80 characters from each document's middle on stand."""
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0).withColumn("quote", F.expr("substring(text, int(length(text) div 2) + 1, 80)"))
    found = docs.withColumn("found", spans.offsets(F.col("text"), F.col("quote")))
    found = found.select("doc_id", F.sha2("quote", 256).alias("quote_sha256"), F.length("quote").alias("n"), F.posexplode("found").alias("occurrence", "start"))
    return found.withColumnRenamed("quote_sha256", "quote").withColumn("end", F.col("start") + F.col("n"))


@plans.add(
    f"""WITH {_WINDOWS}, q AS (SELECT doc_id, text, substr(text, length(text) // 2 + 1, 80) AS quote FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, quote, string_split(text, quote) AS parts FROM q),
o AS (SELECT doc_id, quote, i, (list_sum(list_transform(parts[:i], lambda x: length(x))) + (i - 1) * length(quote))::INTEGER AS s FROM (SELECT *, unnest(generate_series(1, len(parts) - 1)) AS i FROM p)),
h AS (SELECT o.doc_id, i, count(*) FILTER (w.s <= o.s AND o.s + length(o.quote) <= w.e) AS n FROM o JOIN windows w USING (doc_id) GROUP BY o.doc_id, i)
SELECT doc_id, (SELECT count(DISTINCT o.quote) FROM o WHERE o.doc_id = h.doc_id) AS grounded, (max(n) > 0)::BIGINT AS contained, (max(n) = 0)::BIGINT AS cut, (CASE WHEN max(n) > 0 THEN sum(greatest(n - 1, 0)) ELSE 0 END)::BIGINT AS duplicate_exposures FROM h GROUP BY doc_id"""
)
def quote_boundary_cuts(spark, sf_dir):
    found = quotes(spark, sf_dir).select("doc_id", "quote", "occurrence", "start", "end")
    return spans.quote_measures(found, windows_of(spark, sf_dir)[1], "doc_id", "quote")


@plans.add(f"WITH {_WINDOWS} SELECT doc_id, seq FROM windows WHERE s < length(text) // 3 + 270 AND length(text) // 3 < e")
def span_overlap_pairs(spark, sf_dir):
    docs, windows = windows_of(spark, sf_dir)
    targets = docs.select("doc_id", F.expr("int(length(text) div 3)").alias("b_start"), F.expr("int(length(text) div 3) + 270").alias("b_end"))
    return spans.overlapping_pairs(windows, targets, "doc_id").select("doc_id", "seq")


@plans.add(
    """WITH d AS (SELECT doc_id, text, length(text) AS n, length(text) // 2 AS s, least(length(text), length(text) // 2 + 120) AS e FROM documents),
h AS (SELECT *, least(n, greatest(0, s - greatest(0, 200 - (e - s)) // 2) + greatest(200, e - s)) AS high FROM d)
SELECT doc_id, greatest(0, high - greatest(200, e - s))::INTEGER AS low, high::INTEGER AS high, substr(text, greatest(0, high - greatest(200, e - s)) + 1, high - greatest(0, high - greatest(200, e - s))) AS context FROM h"""
)
def context_windows(spark, sf_dir):
    """200 characters around the 120 from each document's middle on."""
    docs = table(spark, sf_dir, "documents")
    start = F.expr("int(length(text) div 2)")
    low, high, text = spans.context_window(F.col("text"), start, F.least(F.length("text"), start + 120), 200)
    return docs.select("doc_id", low.alias("low"), high.alias("high"), text.alias("context"))


@plans.add(
    """WITH s AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda x: trim(x)), lambda x: length(x) > 10) AS l FROM documents),
n AS (SELECT doc_id, CASE WHEN len(l) > 0 THEN l ELSE [text] END AS l, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS words FROM s),
k AS (SELECT doc_id, l, greatest(1, len(l) // (words // 350 + 1)) AS each FROM n)
SELECT doc_id, (i - 1)::INTEGER AS n, array_to_string(l[(i - 1) * each + 1:i * each], ' ') AS chunk FROM (SELECT *, unnest(generate_series(1, ceil(len(l) / each::DOUBLE)::BIGINT)) AS i FROM k)"""
)
def even_chunks(spark, sf_dir):
    """Each document's sentences in equal runs."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", spans.even_chunks(F.col("text"), sentences_of_text(F.col("text"))).alias("chunks"))
    return docs.select("doc_id", F.posexplode("chunks").alias("n", "chunk"))
