"""Acquisition, hashes, page texts, claims of artifacts, parity."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import canonical
from plumbline.operators import decisions, parity
from plumbline.plans.tools import Plans, ascii_json_sql, entities_sql, space_sql, table
from plumbline.sources import artifacts, readers

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql


@plans.add("SELECT doc_id, sha256(text) AS sha256, length(text) AS characters, substr(sha256('doc:' || doc_id), 1, 24) AS snapshot_key FROM documents")
def source_hashes(spark, sf_dir):
    key = canonical.snapshot_key(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("characters"), key.alias("snapshot_key"))


@plans.add(
    """SELECT 'p' || page_id AS source_id, CASE WHEN page_id % 4 = 0 THEN 'snapshot' WHEN page_id % 4 = 1 THEN 'snapshot_invalid' WHEN page_id % 8 = 2 THEN 'live_archived' ELSE 'live_failed' END AS strategy,
  CASE WHEN page_id % 4 = 1 THEN 'source_changed' WHEN page_id % 4 = 0 OR page_id % 8 = 2 THEN NULL WHEN page_id % 8 = 6 THEN 'source_paywalled' ELSE 'source_unreachable' END AS failure, page_id % 4 >= 2 AS live_attempted FROM pages"""
)
def acquisition_strategy(spark, sf_dir):
    pages, p = table(spark, sf_dir, "pages").withColumn("uri", F.concat("url", F.lit("#"), F.col("page_id").cast("string"))), F.col("page_id")
    source = F.concat(F.lit("p"), p.cast("string"))
    snapshots = pages.where("page_id % 4 < 2").select(source.alias("source_id"), "uri", F.col("html").alias("text"), F.sha2(F.when(p % 4 == 0, F.col("html")).otherwise(F.lit("other")), 256).alias("sha256"))
    live = pages.where("page_id % 2 = 0").select("uri", F.when(p % 8 != 6, F.col("html")).alias("text"), F.when(p % 8 == 6, "source_paywalled").alias("failure"))
    return decisions.acquire(pages.select(source.alias("source_id"), "uri"), snapshots, live, "snapshot_preferred").select("source_id", "strategy", "failure", "live_attempted")


@plans.add("SELECT page_id, [NULL, 'source_paywalled', 'source_unreachable', 'pdf_unsupported'][page_id % 4 + 1] AS failure FROM pages")
def fetch_failures(spark, sf_dir):
    p = F.col("page_id")
    status = F.when(p % 4 == 1, 403).when(p % 4 == 2, 404).otherwise(200)
    return table(spark, sf_dir, "pages").select("page_id", decisions.http_failure(status, F.when(p % 4 == 3, "application/pdf").otherwise("text/html")).alias("failure"))


_SAID = r"regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<!--.*?-->|<[a-z/!?][^>]*>', ' ', 'g')"


@plans.add(f"SELECT page_id, {space_sql(entities_sql(_SAID))} AS text FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", readers.html_to_text(F.col("html")).alias("text"))


@plans.add("""SELECT page_id, len(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1))::INTEGER AS links FROM pages""")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(artifacts.links_of(F.col("html"))).alias("links"))


@plans.add()
def page_claims(spark, sf_dir):
    """The pages' links are relative, so they are first made absolute on the page's url."""
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)
    html = F.expr("regexp_replace(html, 'href=\"/', concat('href=\"', base, '/'))")
    docs = table(spark, sf_dir, "pages").withColumn("base", base).select(F.col("page_id").alias("doc"), html.alias("text"))
    return artifacts.extract_html(docs)


@plans.add(
    """SELECT doc_id AS doc, 'c1' AS claim_id, 'https://x.org/' || doc_id AS uri, CASE WHEN doc_id % 2 = 0 THEN t END AS excerpt, CASE WHEN doc_id % 2 = 1 THEN t END AS locator, CASE WHEN doc_id % 3 = 0 THEN 'Why so?' END AS question
FROM (SELECT doc_id, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS t FROM documents) WHERE t <> ''"""
)
def markdown_claims(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("t")).where("t <> ''")
    kind = F.when(F.col("doc") % 2 == 0, "quote").otherwise("locator")
    question = F.when(F.col("doc") % 3 == 0, "<!-- evidence-question: Why so? -->").otherwise("")
    text = F.concat(F.lit("# Head\nA **claim** [label](https://x.org/"), F.col("doc").cast("string"), F.lit(")<!-- evidence-"), kind, F.lit(": "), "t", F.lit(" -->"), question, F.lit(" end."))
    return artifacts.extract_markdown(docs.select("doc", text.alias("text"))).select("doc", "claim_id", "uri", "excerpt", "locator", "question")


@plans.add(
    """SELECT doc_id AS doc, 'c1' AS claim_id, CASE WHEN doc_id % 3 = 1 THEN 'a calculation names unknown claims' WHEN doc_id % 3 = 2 THEN 'a calculation names its own claim' END AS error FROM documents
UNION ALL SELECT doc_id, 'k2', NULL FROM documents"""
)
def structured_claims(spark, sf_dir):
    inputs = F.when(F.col("doc_id") % 3 == 0, "k2").when(F.col("doc_id") % 3 == 1, "zz").otherwise("c1")
    text = F.concat(F.lit('{"claims": [{"claim_text": "one", "calculation": {"formula": "a", "inputs": [{"name": "a", "value": "1", "source_claim_ids": ["'), inputs, F.lit('"]}]}}, {"claim_id": "k2", "claim_text": "two", "source_url": "https://x.org"}]}'))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), text.alias("text"))
    return artifacts.extract_structured(docs).select("doc", "claim_id", "error")


@plans.add("SELECT false AS equal, min(conv_id * 1000 + turn) FILTER (length(text) > 200) AS first_difference FROM conversations")
def render_first_difference(spark, sf_dir):
    """Two renderings of all turns in order, of which the second cuts texts of more than 200 characters."""
    left = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("position"), "role", "text")
    right = left.withColumn("text", F.when(F.length("text") > 200, F.substring("text", 1, 200)).otherwise(F.col("text")))
    return parity.first_difference(left, right, "position", ["role", "text"])


@plans.add("SELECT conv_id * 1000 + turn AS id, turn % 3 <> 0 AS equal FROM conversations")
def parity_projection(spark, sf_dir):
    left = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", "role", "text")
    right = left.withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).withColumn("role", F.lit("other"))
    return parity.projected_equal(left, right, "id", ["role"])


@plans.add(
    f"""SELECT conv_id, turn, sha256('{{"claim_text":' || coalesce({ascii_json_sql("text")}, 'null') || ',"question":"Is it so?","source_sha256":' || coalesce('"' || sha256(text) || '"', 'null') || '}}') AS input_sha256 FROM conversations"""
)
def claim_hashes(spark, sf_dir):
    """What a detector's input and a component's input are known by."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.sha2("text", 256).alias("sha"), F.lit("Is it so?").alias("question"))
    return rows.select("conv_id", "turn", canonical.input_sha256("text", "question", "sha").alias("input_sha256"))


@plans.add(
    """WITH h AS (SELECT sha256('{"doc_id":' || coalesce(doc_id::VARCHAR, 'null') || ',"quality":' || coalesce(quality::VARCHAR, 'null') || ',"toxic":' || coalesce(toxic::VARCHAR, 'null') || '}') AS h FROM labels),
d AS (SELECT greatest(0, ceil(log2(greatest(1, count(*)) / 4096.0) / 4))::INTEGER AS digits FROM h), g AS (SELECT substr(h, 1, digits) AS part, sha256(string_agg(h, '' ORDER BY h)) AS h, any_value(digits) AS digits FROM h, d GROUP BY 1)
SELECT CASE WHEN max(digits) = 0 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY part)) END AS sha256 FROM g"""
)
def unordered_table_hash(spark, sf_dir):
    return canonical.unordered_sha256(table(spark, sf_dir, "labels"), "doc_id", "quality", "toxic")


_CLASSES = ["company_assertion", "analyst_calculation", "analyst_inference", "recommendation"]


@plans.add(
    f"""WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, length(text) AS n, trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) AS t FROM documents),
d AS (SELECT *, 'https://x.org/' || doc_id AS link, {_CLASSES}[n % 4 + 1] AS a, {_CLASSES}[length(t) % 4 + 1] AS b FROM t WHERE t <> ''),
e AS (SELECT *, CASE WHEN lang = 'es' THEN 'unsupported suffix: txt' WHEN lang = 'de' AND a <> b THEN 'conflicting provenance classes: ' || least(a, b) || ', ' || greatest(a, b) END AS error FROM d)
SELECT doc_id AS doc, CASE WHEN error IS NULL THEN 'c1' END AS claim_id, CASE WHEN error IS NULL THEN link END AS uri, CASE WHEN error IS NULL THEN 'url:' || substr(sha256(link), 1, 16) END AS source_id,
  CASE WHEN error IS NULL AND lang <> 'de' THEN t END AS excerpt, CASE WHEN error IS NULL AND lang = 'de' THEN t END AS locator,
  CASE WHEN error IS NULL THEN CASE WHEN lang = 'de' THEN a ELSE '{artifacts.UNCLASSIFIED}' END END AS provenance_class, error FROM e"""
)
def mixed_artifacts(spark, sf_dir):
    """Each document's letters as evidence of a claim in a page (de), Markdown (fr), a suffix without a parser (es)
    or JSON. A page stands under two classes, which contradict each other where they differ."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.coalesce("lang", F.lit("")).alias("lang"), F.length("text").alias("n"), F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")).alias("t")).where("t <> ''")
    marks = F.array(*(F.lit(f"provenance-{x}") for x in ("company", "calculation", "inference", "recommendation")))
    link = F.concat(F.lit("https://x.org/"), F.col("doc").cast("string"))
    page = F.concat(F.lit('<p class="'), marks[F.col("n") % 4], F.lit(" "), marks[F.length("t") % 4], F.lit('">A claim <a href="'), link, F.lit('">label</a><!-- evidence-locator: '), "t", F.lit(" --> end.</p>"))
    marked = F.concat(F.lit("A **claim** [label]("), link, F.lit(")<!-- evidence-quote: "), "t", F.lit(" --> end."))
    record = F.to_json(F.struct(F.array(F.struct(F.lit("A claim.").alias("claim_text"), link.alias("source_url"), F.col("t").alias("source_excerpt"))).alias("claims")))
    lang = F.col("lang")
    path = F.when(lang == "de", "page.HTML").when(lang == "fr", "notes.md").when(lang == "es", "notes.txt").otherwise("claims.json")
    docs = rows.select("doc", path.alias("path"), F.when(lang == "de", page).when(lang == "fr", marked).otherwise(record).alias("text"))
    return artifacts.extract(docs).select("doc", "claim_id", "uri", "source_id", "excerpt", "locator", "provenance_class", "error")
