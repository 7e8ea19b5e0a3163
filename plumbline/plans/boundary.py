"""Extension points with functions of one's own, and records that are written and read again."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import engine, policies
from plumbline.functions import canonical
from plumbline.operators import decisions
from plumbline.plans.tools import Plans, table
from plumbline.sources import ledger, readers, web
from plumbline.stored import new_folder, remove, stored

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql

TEMPLATE = "{context}|{noun}|{categories}|{chunk}"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")


def numbered_pages(spark, sf_dir):
    """Pages with a uri that is theirs alone."""
    return table(spark, sf_dir, "pages").withColumn("uri", F.concat("url", F.lit("#"), F.col("page_id").cast("string")))


def _resolve(uri: str) -> str:
    number = int(uri.rsplit("#", 1)[1])
    if number % 3 == 1:
        raise PermissionError(uri)
    if number % 3 == 2:
        raise OSError(uri)
    return f"page {number}"


@plans.add(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'page ' || page_id END AS text, [NULL, 'source_paywalled', 'source_unreachable'][page_id % 3 + 1] AS failure
FROM pages WHERE url IS NOT NULL"""
)
def resolved_pages(spark, sf_dir):
    """A resolver that raises on two of three pages."""
    return readers.resolve_with(numbered_pages(spark, sf_dir).where("uri IS NOT NULL"), _resolve).select("page_id", "text", "failure")


def _answered(uri: str, timeout: float) -> tuple:
    """A server that answers by the number at a uri's end."""
    number = int(uri.rsplit("#", 1)[1])
    if number % 7 == 6:
        raise OSError(uri)
    return [
        (200, "text/html", f"<p>page <b>{number}</b><script>no</script></p>".encode()), (200, "text/plain", f"<p> {number}".encode()), (403, None, b""),
        (404, None, b""), (200, "application/pdf", b""), (200, "application/xhtml+xml", b"a&amp;b \xff<br/>"),
    ][number % 7]


@plans.add(
    """SELECT page_id, [200, 200, 403, 404, 200, 200, NULL][page_id % 7 + 1] AS status, CASE page_id % 7 WHEN 0 THEN 'page ' || page_id WHEN 1 THEN '<p> ' || page_id WHEN 5 THEN 'a&b ' || chr(65533) END AS text,
  CASE page_id % 7 WHEN 2 THEN 'source_paywalled' WHEN 3 THEN 'source_unreachable' WHEN 4 THEN 'pdf_unsupported' WHEN 6 THEN 'source_unreachable' END AS failure FROM pages WHERE url IS NOT NULL"""
)
def fetched_pages(spark, sf_dir):
    """Every page's uri asked through the source, by files of 50 requests."""
    pages, path = numbered_pages(spark, sf_dir).where("uri IS NOT NULL"), new_folder(spark, "requests")
    web.write_requests(pages, path, 50)
    found = stored(web.resolved(web.read_pages(spark, path, f"{__name__}:_answered")))
    remove(spark, path)
    return pages.select("page_id", "uri").join(found, "uri").select("page_id", "status", "text", "failure")


def _complete(prompt: str) -> str:
    if len(prompt) % 5 == 0:
        raise ValueError("no completion")
    return f"{len(prompt)}"


@plans.add(
    """WITH p AS (SELECT conv_id * 1000 + turn AS id, 'Read this.|turn|- A: one' || chr(10) || '- B|' || text AS prompt FROM conversations WHERE text IS NOT NULL)
SELECT id, sha256(prompt) AS prompt_sha256, CASE WHEN length(prompt) % 5 <> 0 THEN length(prompt)::VARCHAR END AS reply FROM p"""
)
def completed_prompts(spark, sf_dir):
    """A prompt for each turn and a completion function that fails on every fifth length."""
    chunks = turns(spark, sf_dir).where("text IS NOT NULL").select("id", F.col("text").alias("chunk"))
    asked = readers.prompts(chunks, "- A: one\n- B", "Read this.", "turn", TEMPLATE)
    return readers.with_backend(asked, _complete).select("id", F.sha2("prompt", 256).alias("prompt_sha256"), "reply")


@plans.add(
    """WITH c AS (SELECT DISTINCT lang, source FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL)
SELECT lang AS domain, string_agg('- ' || upper(source) || CASE WHEN length(source) > 4 THEN ': about ' || source ELSE '' END, chr(10) ORDER BY source) AS block FROM c GROUP BY lang"""
)
def prompt_blocks(spark, sf_dir):
    """M2: the sources of each language as categories; those with short keys lack a description."""
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.col("lang").alias("domain"), F.col("source").alias("category")).distinct()
    described = F.when(F.length("category") > 4, F.concat(F.lit("about "), "category")).otherwise(" ")
    return readers.prompt_block(rows.select("domain", "category", F.upper("category").alias("name"), described.alias("description")))


def _contained(source: str, claim: str, question: str | None) -> dict:
    if question is None:
        raise ValueError("no question")
    found = claim in source
    return {"label": "supported" if found else "contradicted", "confidence": 1.0 if found else 0.4, "reason": "substring"}


@plans.add(
    """WITH c AS (SELECT conv_id * 1000 + turn AS case_id, role AS kind, turn % 4 = 3 AS broken, contains(text, 'the') AS hit FROM conversations WHERE text IS NOT NULL)
SELECT case_id, kind, p AS policy_key, CASE WHEN broken THEN 'not_assessed' WHEN hit THEN 'supported' WHEN p = 'strict' THEN 'insufficient' ELSE 'contradicted' END AS actual
FROM c, (VALUES ('open'), ('strict')) v(p)"""
)
def detector_bakeoff(spark, sf_dir):
    """One detector under two policies over all turns; it fails where no question is asked."""
    question = F.when(F.element_at(F.split(F.lit("a,a,a,"), ","), (F.col("id") % 1000 % 4 + 1).cast("int")) != "", "Is it there?")
    cases = turns(spark, sf_dir).where("text IS NOT NULL").select(F.col("id").alias("case_id"), F.col("role").alias("kind"), F.lit("supported").alias("expected_status"), F.col("text").alias("source_text"), F.lit("the").alias("claim_text"), question.alias("question"))
    of = policies.Detector("substring", "contained", "1")
    runs = engine.bakeoff(cases, {key: (policies.SupportPolicy(key, "1", "2024-01-01", of, least), _contained) for key, least in (("open", None), ("strict", 0.5))})
    return runs.select("case_id", "kind", "policy_key", "actual")


def _share(question: str, evidence: str) -> float:
    return len(evidence) / len(question)


@plans.add(
    """SELECT a.conv_id, a.turn, CASE WHEN length(a.text) > 0 AND length(b.text) <= length(a.text) THEN length(b.text)::DOUBLE / length(a.text) END AS score
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""
)
def scored_answers(spark, sf_dir):
    """L3: a scorer of one's own for each turn and the next one; null where it fails or leaves [0, 1]."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.select("conv_id", "turn", F.col("text").alias("question"))
    answers = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("evidence"))
    return asked.join(answers, ["conv_id", "turn"]).select("conv_id", "turn", engine.scorer(_share)(F.col("question"), F.col("evidence")).alias("score"))


@plans.add(
    """SELECT page_id, CASE WHEN page_id % 5 = 0 OR page_id % 7 = 1 THEN NULL WHEN page_id % 3 = 0 THEN sha256(html || '!') ELSE sha256(html) END AS sha256,
  CASE WHEN page_id % 7 = 1 THEN 'source_unreachable' WHEN page_id % 5 = 0 THEN 'source_changed' END AS failure FROM pages WHERE url IS NOT NULL AND html IS NOT NULL"""
)
def loaded_snapshots(spark, sf_dir):
    """A4, A5: snapshots of all pages, a later one of every third; some references name another source, some an unknown uri."""
    pages, p = numbered_pages(spark, sf_dir).where("url IS NOT NULL AND html IS NOT NULL"), F.col("page_id")
    source, path = F.concat(F.lit("p"), p.cast("string")), new_folder(spark, "snapshots")
    rows = pages.select(source.alias("source_id"), "uri", F.col("html").alias("text"), F.lit("2024-01-01").alias("fetched_at"), F.lit(200).alias("status"), F.lit("text/html").alias("media_type"), "page_id")
    readers.write_snapshots(rows, path)
    readers.write_snapshots(rows.where("page_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!"))).withColumn("fetched_at", F.lit("2024-02-01")), path)
    uri = F.when(p % 7 == 1, F.concat("uri", F.lit("?"))).otherwise(F.col("uri"))
    references = pages.select("page_id", F.when(p % 5 == 0, "other").otherwise(source).alias("source_id"), uri.alias("uri"))
    found = stored(readers.load_snapshots(references, path).select("page_id", F.sha2("text", 256).alias("sha256"), "failure"))
    remove(spark, path)
    return found


@plans.add(
    """SELECT CASE WHEN NOT bad THEN doc_id END AS doc_id, CASE WHEN NOT bad THEN lang END AS lang, CASE WHEN bad THEN 'malformed' WHEN doc_id % 4 = 0 THEN 'unknown_fields' END AS problem
FROM (SELECT doc_id, lang, doc_id % 9 = 2 AS bad FROM documents WHERE doc_id IS NOT NULL)"""
)
def read_records(spark, sf_dir):
    """Records of all documents as JSON lines; some have a field that the schema lacks, some are no JSON, and a line stands blank."""
    docs, path = table(spark, sf_dir, "documents"), new_folder(spark, "records")
    readers.write_results(docs.where("doc_id % 9 <> 2").select("doc_id", "lang", F.when(F.col("doc_id") % 4 == 0, "more").alias("extra")), f"{path}/good")
    docs.where("doc_id % 9 = 2").select(F.lit('{"doc_id": no}\n').alias("value")).write.text(f"{path}/bad")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType())])
    found = stored(readers.read_jsonl(spark, f"{path}/*", schema, strict=True))
    remove(spark, path)
    return found


@plans.add(
    """SELECT doc_id, sha256('{"claim_text":' || coalesce('"' || lang || '"', 'null') || ',"question":"Is it so?","source_text":' || coalesce('"' || source || '"', 'null') || '}') AS sha256 FROM documents"""
)
def component_hashes(spark, sf_dir):
    """M3: what a component is given, by its hash."""
    rows = table(spark, sf_dir, "documents").withColumn("question", F.lit("Is it so?"))
    return rows.select("doc_id", canonical.component_sha256("source", "lang", "question").alias("sha256"))


@plans.add(
    """SELECT page_id, CASE WHEN page_id % 3 = 0 THEN sha256(html || '!') ELSE sha256(html) END AS sha256, CASE WHEN page_id % 3 = 0 THEN '2024-02-01' ELSE '2024-01-01' END AS fetched_at, NULL::VARCHAR AS failure
FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
UNION ALL SELECT -count(*), NULL, NULL, 'rows' FROM pages WHERE url IS NOT NULL AND html IS NOT NULL"""
)
def compacted_snapshots(spark, sf_dir):
    """A4: an archive with a later snapshot of every third page, compacted; all pages loaded from it, and the number of rows that it has left."""
    pages, path = numbered_pages(spark, sf_dir).where("url IS NOT NULL AND html IS NOT NULL"), new_folder(spark, "snapshots")
    rows = pages.select(F.lit("s").alias("source_id"), "uri", F.col("html").alias("text"), F.lit("2024-01-01").alias("fetched_at"), F.lit(200).alias("status"), F.lit("text/html").alias("media_type"), "page_id")
    readers.write_snapshots(rows, path)
    readers.write_snapshots(rows.where("page_id % 3 = 0").withColumn("text", F.concat("text", F.lit("!"))).withColumn("fetched_at", F.lit("2024-02-01")), path)
    readers.compact_snapshots(spark, path)
    loaded = readers.load_snapshots(rows.select("page_id", "source_id", "uri"), path).select("page_id", F.sha2("text", 256).alias("sha256"), "fetched_at", "failure")
    left = spark.read.parquet(path).agg((-F.count("*")).alias("page_id")).select("page_id", F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("fetched_at"), F.lit("rows").alias("failure"))
    found = stored(loaded.unionByName(left))
    remove(spark, path)
    return found


@plans.add("SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN 1 ELSE 2 END AS run, length(text)::INTEGER AS reply FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def resumed_run(spark, sf_dir):
    """A run over all documents in four batches that breaks off after two; a second one does the rest."""
    docs, path = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL"), new_folder(spark, "ledger")
    inputs = docs.select("doc_id", "text", F.sha2(F.concat_ws("\u0001", F.col("doc_id").cast("string"), "text"), 256).alias("input_sha256"))
    for number, most in ((1, 2), (2, None)):
        ledger.run(inputs, path, "policy", lambda rows, n=number: rows.select("input_sha256", "doc_id", F.lit(n).alias("run"), F.length("text").alias("reply")), F.col("doc_id") % 4, most)
    found = stored(ledger.outputs(inputs, path, "policy").select("doc_id", "run", "reply"))
    remove(spark, path)
    return found


_RAW = """CASE conv_id % 4 WHEN 0 THEN json_object('label', role, 'scores', json_object('support', length(text) / 1000.0))::VARCHAR WHEN 1 THEN json_object('label', role, 'spans', json_array(1, length(text)))::VARCHAR
  WHEN 2 THEN json_array(role, text)::VARCHAR ELSE '{broken ' || role END"""


@plans.add(
    f"""WITH s AS (SELECT conv_id, turn, conv_id % 4 = 3 AS broken, CASE WHEN conv_id % 4 < 3 THEN ({_RAW})::JSON END AS signal FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, broken, json_extract_string(signal, '$.label') AS label, json_extract(signal, '$.scores.support')::DOUBLE AS support, json_extract(signal, '$.spans[1]')::BIGINT AS last FROM s"""
)
def component_outputs(spark, sf_dir):
    """Outputs of four components of different shapes, one of them no JSON; what stands at a path is asked of all."""
    c = F.col("conv_id") % 4
    named = F.struct(F.col("role").alias("label"), F.struct((F.length("text") / 1000.0).alias("support")).alias("scores"))
    placed = F.struct(F.col("role").alias("label"), F.array(F.lit(1), F.length("text")).alias("spans"))
    raw = F.when(c == 0, F.to_json(named)).when(c == 1, F.to_json(placed)).when(c == 2, F.to_json(F.array("role", "text"))).otherwise(F.concat(F.lit("{broken "), "role"))
    rows = decisions.raw_signals(table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("raw", raw))
    at = decisions.signal_at
    return rows.select("conv_id", "turn", "broken", at("$.label", "string").alias("label"), at("$.scores.support", "double").alias("support"), at("$.spans[1]", "bigint").alias("last"))


@plans.add(
    """WITH p AS (SELECT conv_id * 1000 + turn AS doc, 'Read this.|turn|- A: one' || chr(10) || '- B|' || text AS prompt FROM conversations WHERE text IS NOT NULL)
SELECT 'own' AS backend, 'length' AS model, greatest(1, length(prompt) // 4)::BIGINT AS in_tokens, CASE WHEN length(prompt) % 5 <> 0 THEN greatest(1, length(length(prompt)::VARCHAR) // 4) ELSE 0 END::BIGINT AS out_tokens, doc FROM p"""
)
def usage_records(spark, sf_dir):
    """The usage log of a completion function over all turns, written and read again."""
    chunks, path = turns(spark, sf_dir).where("text IS NOT NULL").select(F.col("id").alias("doc"), F.col("text").alias("chunk")), new_folder(spark, "usage")
    replies = readers.with_backend(readers.prompts(chunks, "- A: one\n- B", "Read this.", "turn", TEMPLATE), _complete)
    readers.write_results(readers.usage_log(replies, "own", "length"), path)
    found = stored(spark.read.schema("backend string, model string, in_tokens long, out_tokens long, doc long").json(path))
    remove(spark, path)
    return found


@plans.add("SELECT conv_id * 1000 + turn AS id, role || chr(9) || '\"' || role AS role, text || chr(10) || 'a \"quoted\" end' AS text FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL")
def worksheet_rows(spark, sf_dir):
    """A worksheet of all turns whose cells have tabs, quotes and line ends, written and read again."""
    rows, path = turns(spark, sf_dir).where("text IS NOT NULL AND role IS NOT NULL"), new_folder(spark, "sheet")
    readers.write_worksheet(rows.select("id", F.concat("role", F.lit('\t"'), "role").alias("role"), F.concat("text", F.lit('\na "quoted" end')).alias("text")), path)
    found = stored(readers.read_worksheet(spark, path, "id long, role string, text string"))
    remove(spark, path)
    return found


@plans.add("SELECT DISTINCT lang AS domain, source AS category, upper(source) AS name, (1 + length(source) % 5)::INTEGER AS severity, 'about ' || source AS description FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def domain_categories(spark, sf_dir):
    """A pack for each language with the sources of its documents as categories, written as a folder of files and scanned."""
    rows, path = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("lang", "source").distinct(), new_folder(spark, "packs")
    category = F.struct(F.col("source").alias("key"), F.upper("source").alias("name"), (1 + F.length("source") % 5).alias("severity"), F.concat(F.lit("about "), "source").alias("description"))
    packs = rows.groupBy(F.col("lang").alias("key")).agg(F.sort_array(F.collect_list(category)).alias("categories"))
    packs.write.option("maxRecordsPerFile", 1).json(path)  # a file is a pack
    found = stored(readers.read_domains(spark, path))
    remove(spark, path)
    return found
