"""Validation, selection and set operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.text import sentences_of_text
from plumbline.operators import arena, decisions, extraction, navigation, parity, probes, scoring, spans
from plumbline.plans import navigation as nav
from plumbline.plans.arena import PROFILE
from plumbline.plans.tools import Plans, table

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def third():
    """Where the second third of a text begins."""
    return F.expr("int(length(text) div 3)")


def part(characters):
    """So many characters of a text from its second third on."""
    return F.substring(F.col("text"), third() + 1, F.lit(characters))


@plans.add(
    """WITH d AS (SELECT doc_id, length(text) AS n, length(text) // 10 AS low, length(text) // 2 + length(text) // 4 AS high FROM documents)
SELECT doc_id, i::INTEGER AS start, high - low <= 300 AS fits, CASE WHEN high - low <= 300 THEN greatest(0, least(low - floor((300 - (high - low)) / 2), n - 300))::INTEGER END AS window_start,
  CASE WHEN high - low <= 300 THEN least(n, greatest(0, least(low - floor((300 - (high - low)) / 2), n - 300)) + 300)::INTEGER END AS window_end FROM (SELECT *, unnest([low, n // 2]) AS i FROM d)"""
)
def shared_windows(spark, sf_dir):
    """One window of 300 characters for two spans of each document, at its tenth part and at its middle."""
    n = F.length("text")
    parts = F.array(*(F.struct(F.expr(f"int(length(text) div {k})").alias("start"), F.expr(end).alias("end")) for k, end in ((10, "int(length(text) div 10 + length(text) div 20)"), (2, "int(length(text) div 2 + length(text) div 4)"))))
    rows = documents(spark, sf_dir).select("doc_id", n.alias("length"), F.explode(parts).alias("p")).select("doc_id", "length", "p.start", "p.end")
    out = spans.shared_windows(rows, "doc_id", 300)
    return out.select("doc_id", "start", "fits", F.when(F.col("fits"), F.col("window_start")).alias("window_start"), F.when(F.col("fits"), F.col("window_end")).alias("window_end"))


@plans.add(f"WITH {nav._NODES} SELECT doc, node_id, 'n' || lpad((row_number() OVER (PARTITION BY doc ORDER BY s, node_id))::VARCHAR, 4, '0') AS handle FROM nodes")
def node_handles(spark, sf_dir):
    return navigation.handles(nav.nodes(spark, sf_dir).where("selectable")).select("doc", "node_id", "handle")


@plans.add(
    f"""WITH {nav._NODES}, {nav._CHOSEN}, t AS (SELECT case_id, c.text, s, e FROM top JOIN cases c USING (case_id))
SELECT case_id, sha256(string_agg(substr(text, s + 1, e - s), chr(10) || chr(10) ORDER BY s)) AS context_sha256, (sum(e - s) + 2 * (count(*) - 1))::INTEGER AS context_characters, 0::BIGINT AS changed FROM t GROUP BY case_id"""
)
def fetched_contexts(spark, sf_dir):
    n, c = nav.nodes(spark, sf_dir), nav.cases(spark, sf_dir)
    return navigation.fetch_nodes(navigation.select_lexical(n, c, 3), c, n, nav.documents(spark, sf_dir)).select("case_id", "context_sha256", "context_characters", "changed")


@plans.add(
    """SELECT 'q' || doc_id AS case_id, CASE WHEN doc_id % 6 = 5 THEN 'abstained' ELSE 'failed' END AS status,
  ['selector_error', 'budget', 'malformed', 'repeated', 'unknown_node', 'abstained'][doc_id % 6 + 1] AS reason FROM documents WHERE regexp_matches(text, '\\S')"""
)
def recorded_selections(spark, sf_dir):
    """Recorded outputs that fail in each way there is."""
    c, m = nav.cases(spark, sf_dir), F.col("doc") % 6
    ids = F.when(m == 2, F.lit(None)).when(m == 3, F.array(F.lit("x"), F.lit("x"))).when(m == 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    out = c.select("case_id", ids.cast("array<string>").alias("node_ids"), F.when(m == 1, 10**6).otherwise(10).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.when(m == 0, "timeout").alias("error"))
    return navigation.select_recorded(out, nav.nodes(spark, sf_dir), c, 5, 32_768).select("case_id", "status", "reason")


@plans.add("SELECT doc_id FROM documents WHERE contains(text, CASE WHEN doc_id % 2 = 0 THEN substr(text, length(text) // 3 + 1, 30) ELSE reverse(substr(text, length(text) // 3 + 1, 30)) END)")
def verbatim_quotes(spark, sf_dir):
    quote = F.when(F.col("doc_id") % 2 == 0, part(30)).otherwise(F.reverse(part(30)))
    return extraction.verbatim(documents(spark, sf_dir).withColumn("quote", quote), "text", "quote").select("doc_id")


@plans.add(
    r"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)\bno\w+') THEN 'absence' WHEN regexp_matches(t, '(?i)\b\w*ation\b') THEN 'derived' WHEN regexp_matches(t, '(?i)\bthe\b.*ing\b') THEN 'inferential' END AS kind
FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z ]', ' ', 'g') AS t FROM documents)"""
)
def task_triggers(spark, sf_dir):
    text = F.regexp_replace("text", "[^A-Za-z ]", " ")
    return documents(spark, sf_dir).select("doc_id", arena.trigger(text, PROFILE).alias("kind"))


@plans.add("SELECT doc_id, doc_id % 3 <> 0 AS valid FROM documents")
def detector_spans_valid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    span = F.struct(third().alias("start"), (third() + F.length(part(6))).alias("end"), F.when(F.col("doc_id") % 3 == 0, F.lit("##")).otherwise(part(6)).alias("text"))
    return docs.select("doc_id", decisions.spans_valid(F.array(span), F.col("text")).alias("valid"))


@plans.add("SELECT 'd' || doc_id AS source_id FROM documents WHERE doc_id % 4 IN (1, 2)")
def span_violations(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumn("source_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    m = F.col("doc_id") % 4
    rows = docs.select("source_id", F.sha2(F.when(m == 1, "other").otherwise(F.col("text")), 256).alias("source_sha256"), third().alias("start"), (third() + F.length(part(6))).alias("end"), F.when(m == 2, "##").otherwise(part(6)).alias("span_text"))
    return probes.span_violations(rows, docs).select("source_id")


@plans.add(
    """WITH rules(kind, status, sources, placed) AS (VALUES ('verbatim_supported', 'supported', ['attested'], true), ('paraphrase_supported', 'supported', ['authored', 'model_authored'], false),
  ('contradicted', 'contradicted', ['derived'], false), ('present_irrelevant', 'insufficient', ['adjudicated'], true)),
c AS (SELECT doc_id AS case_id, ['verbatim_supported', 'paraphrase_supported', 'contradicted', 'present_irrelevant', 'other'][doc_id % 5 + 1] AS kind, ['supported', 'contradicted', 'insufficient'][doc_id % 3 + 1] AS status,
  ['attested', 'authored', 'model_authored', 'derived', 'adjudicated'][doc_id // 5 % 5 + 1] AS provenance, doc_id % 8 < 4 AS orphan, doc_id % 7 < 3 AS unread, substr(text, 1, doc_id % 4 + 2) AS claim, substr(text, 1, 4) AS own,
  CASE WHEN doc_id % 6 < 4 THEN doc_id % 2 END AS s, CASE WHEN doc_id % 6 < 4 THEN doc_id % 2 + 4 END AS e FROM documents),
j AS (SELECT c.*, r.kind IS NOT NULL AS known, r.status AS want, r.sources, coalesce(r.placed, false) AS present FROM c LEFT JOIN rules r USING (kind))
SELECT case_id, 'unknown_kind' AS rule FROM j WHERE NOT known
UNION ALL SELECT case_id, 'wrong_status' FROM j WHERE known AND status <> want
UNION ALL SELECT case_id, 'wrong_provenance' FROM j WHERE known AND NOT list_contains(sources, provenance)
UNION ALL SELECT case_id, 'no_parent' FROM j WHERE provenance = 'derived' AND orphan
UNION ALL SELECT case_id, 'not_reviewed' FROM j WHERE provenance IN ('model_authored', 'adjudicated') AND unread
UNION ALL SELECT case_id, 'span_length' FROM j WHERE length(own) <> 4
UNION ALL SELECT case_id, 'claim_offsets' FROM j WHERE present <> (s IS NOT NULL) OR (s IS NOT NULL AND length(claim) <> e - s)
UNION ALL SELECT case_id, 'not_verbatim' FROM j WHERE kind = 'verbatim_supported' AND coalesce(claim <> own OR s <> 0, false)"""
)
def case_violations(spark, sf_dir):
    d = F.col("doc_id")

    def one_of(values, place):
        return F.element_at(F.array(*map(F.lit, values)), (place + 1).cast("int"))

    none, some = F.array().cast("array<string>"), F.array(F.lit("p"))
    placed = F.when(d % 6 < 4, d % 2)
    cases = documents(spark, sf_dir).select(
        d.alias("case_id"), one_of([*probes.CASE_RULES, "other"], d % 5).alias("kind"), one_of(["supported", "contradicted", "insufficient"], d % 3).alias("expected_status"),
        one_of(["attested", "authored", "model_authored", "derived", "adjudicated"], F.floor(d / 5) % 5).alias("provenance"), F.when(d % 8 < 4, none).otherwise(some).alias("parents"), F.when(d % 7 < 3, none).otherwise(some).alias("reviewers"),
        F.lit(0).alias("original_start"), F.lit(4).alias("original_end"), F.substring("text", 1, 4).alias("original_text"), F.substring(F.col("text"), F.lit(1), (d % 4 + 2).cast("int")).alias("claim_text"),
        placed.alias("present_start"), (placed + 4).alias("present_end"),
    )
    return probes.case_violations(cases)


@plans.add("SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda k: k <> 'a')), ',') AS extra, NOT list_contains(json_keys(props), 'a') AS lacks FROM events")
def foreign_keys(spark, sf_dir):
    extra, lacking = parity.foreign_keys("props", ["a"])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(extra), ",").alias("extra"), (F.size(lacking) > 0).alias("lacks"))


@plans.add(
    """SELECT substr(sha256('g' || doc_id || ':' || k.kind), 1, 24) AS case_id, k.kind AS kind, k.status AS expected_status, CASE k.kind WHEN 'verbatim_supported' THEN substr(text, length(text) // 3 + 1, 30) WHEN 'paraphrase_supported' THEN 'p' WHEN 'contradicted' THEN 'f' ELSE 'c' END AS claim_text
FROM documents, (VALUES ('verbatim_supported', 'supported'), ('paraphrase_supported', 'supported'), ('contradicted', 'contradicted'), ('present_irrelevant', 'insufficient')) k(kind, status)"""
)
def probe_cases(spark, sf_dir):
    groups = documents(spark, sf_dir).select(F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("group_id"), part(30).alias("target_text"), F.lit("p").alias("paraphrase"), F.lit("f").alias("flip"), F.lit("c").alias("claim_text"))
    return probes.probe_cases(groups).select("case_id", "kind", "expected_status", "claim_text")


@plans.add(
    """SELECT doc_id, CASE WHEN n_chars % 7 >= n_chars % 5 AND n_chars % 7 >= n_chars % 3 THEN 'supported' WHEN n_chars % 5 >= n_chars % 3 THEN 'insufficient' ELSE 'contradicted' END AS label,
  CASE WHEN n_chars % 10 >= 5 THEN 'supported' ELSE 'insufficient' END AS two_way FROM documents"""
)
def component_labels(spark, sf_dir):
    n = F.col("n_chars")
    label = decisions.component_label(F.array(n % 7, n % 5, n % 3), ["supported", "insufficient", "contradicted"])
    return documents(spark, sf_dir).select("doc_id", label.alias("label"), decisions.binary_support(n % 10 / 10, 0.5).alias("two_way"))


@plans.add(
    """WITH s AS (SELECT conv_id AS claim_id, role, 'h' || (CASE WHEN conv_id % 5 = 0 THEN turn ELSE 0 END) AS h, CASE WHEN conv_id % 7 = 0 THEN 1.5 ELSE 0.5 END AS x FROM conversations)
SELECT claim_id, count(DISTINCT h) > 1 AS mixed_inputs, count(*) > count(DISTINCT role) AS repeated, bool_or(x > 1) AS bad_scores FROM s GROUP BY claim_id HAVING mixed_inputs OR repeated OR bad_scores"""
)
def invalid_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    signals = rows.select(
        F.col("conv_id").alias("claim_id"), "role", F.lit("m").alias("component"), F.concat(F.lit("h"), F.when(F.col("conv_id") % 5 == 0, F.col("turn")).otherwise(0).cast("string")).alias("input_sha256"),
        F.create_map(F.lit("x"), F.when(F.col("conv_id") % 7 == 0, 1.5).otherwise(0.5)).alias("scores"),
    )
    return decisions.invalid_signals(signals)


@plans.add("SELECT item_id AS claim_id, coalesce((SELECT count(*) FROM conversations WHERE conv_id = item_id), 0) AS n FROM benchmark")
def attached_signals(spark, sf_dir):
    signals = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("claim_id"), F.col("role"), F.lit("m").alias("component"), F.lit("l").alias("label"))
    return decisions.attach_signals(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id")), signals).select("claim_id", F.size("signals").cast("long").alias("n"))


@plans.add("SELECT sha256(text) AS sha, count(*) AS count FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return scoring.duplicates(documents(spark, sf_dir).select(F.sha2("text", 256).alias("sha")), "sha")


@plans.add("SELECT doc_id, length(text)::INTEGER AS characters FROM documents ORDER BY characters DESC, doc_id LIMIT 10")
def largest_documents(spark, sf_dir):
    """The report of the ten largest documents."""
    return documents(spark, sf_dir).select("doc_id", F.length("text").alias("characters")).orderBy(F.desc("characters"), "doc_id").limit(10)


@plans.add(
    """WITH a AS (SELECT lang, source FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT lang, source FROM documents WHERE doc_id % 3 <> 1)
SELECT side, lang, source, count(*) AS n FROM (SELECT 'left' AS side, * FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT 'right', * FROM (FROM b EXCEPT ALL FROM a)) GROUP BY ALL"""
)
def run_differences(spark, sf_dir):
    docs = documents(spark, sf_dir)
    a, b = docs.where("doc_id % 3 <> 0").select("lang", "source"), docs.where("doc_id % 3 <> 1").select("lang", "source")
    return parity.set_differences(a, b).groupBy("side", "lang", "source").agg(F.count("*").alias("n"))


@plans.add("SELECT doc_id + 1 AS \"to\", doc_id AS annotation_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id = d.doc_id + 1)")
def dangling_relationships(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("annotation_id"), F.array(F.col("doc_id") + 1).alias("relationship_ids"))
    return probes.dangling_relationships(rows)


@plans.add(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'missing' WHEN doc_id % 3 = 2 AND doc_id % 5 = 0 THEN 'changed' END AS rule FROM documents WHERE doc_id % 3 = 1 OR (doc_id % 3 = 2 AND doc_id % 5 = 0)
UNION ALL SELECT -1 - doc_id, 'unknown' FROM documents WHERE doc_id % 50 = 0"""
)
def tampered_decisions(spark, sf_dir):
    frozen = documents(spark, sf_dir).select("doc_id", "lang", "source")
    decided = frozen.where("doc_id % 3 <> 1").withColumn("source", F.when((F.col("doc_id") % 3 == 2) & (F.col("doc_id") % 5 == 0), "edited").otherwise(F.col("source")))
    added = frozen.where("doc_id % 50 = 0").withColumn("doc_id", -1 - F.col("doc_id"))
    return probes.tampered_decisions(frozen, decided.unionByName(added), "doc_id", ["lang", "source"])


@plans.add("SELECT doc_id AS case_id, 'anchor_' || ['null', 'found', 'not_found'][doc_id % 3 + 1] AS stratum FROM documents WHERE doc_id % 4 <> 0")
def relevance_strata(spark, sf_dir):
    docs = documents(spark, sf_dir)
    claims = docs.select(F.col("doc_id").alias("claim_id"), "text", F.when(F.col("doc_id") % 4 != 0, "evidence").alias("excerpt"))
    anchors = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("claim_id"), F.when(F.col("doc_id") % 3 == 1, "found").otherwise("not_found").alias("anchor"))
    return probes.relevance_strata(claims, anchors).select("case_id", "stratum")


@plans.add(
    """WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda x: trim(x)), lambda x: length(x) > 10) AS l FROM documents),
n AS (SELECT doc_id, l, list_transform(l, lambda x: len(list_filter(string_split_regex(x, '\\s+'), lambda w: w <> ''))) AS w FROM s),
walk AS (SELECT doc_id, 1 AS i, 0 AS piece, 0::BIGINT AS words, NULL::VARCHAR AS text, l, w FROM n WHERE len(l) > 0
  UNION ALL SELECT doc_id, i + 1, CASE WHEN words > 0 AND words + w[i] > 100 THEN piece + 1 ELSE piece END, CASE WHEN words > 0 AND words + w[i] > 100 THEN w[i] ELSE words + w[i] END, l[i], l, w FROM walk WHERE i <= len(l))
SELECT doc_id, piece::INTEGER AS n, string_agg(text, ' ' ORDER BY i) AS piece FROM walk WHERE text IS NOT NULL GROUP BY doc_id, piece"""
)
def packed_sentences(spark, sf_dir):
    """Each document's sentences in pieces of up to 100 words."""
    docs = documents(spark, sf_dir).select("doc_id", spans.pack_sentences(sentences_of_text(F.col("text")), 100).alias("pieces"))
    return docs.select("doc_id", F.posexplode("pieces").alias("n", "piece"))


@plans.add("SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 = 0 ELSE doc_id % 4 = 3 END) AS misplaced FROM documents WHERE doc_id % 2 = 1 OR doc_id % 4 = 0 OR doc_id % 4 = 2")
def misplaced_claims(spark, sf_dir):
    """Present kinds whose claim is not in the source, absent kinds whose claim is."""
    d = F.col("doc_id")
    rows = documents(spark, sf_dir).select(
        "doc_id", F.col("text").alias("source_text"), F.when(d % 2 == 0, "verbatim_supported").otherwise("contradicted").alias("kind"),
        F.when((d % 4 == 2) | (d % 4 == 3), part(9)).otherwise(F.lit("\u0001never")).alias("claim_text"),
    )
    bad = probes.misplaced_claims(rows).select("doc_id", F.lit(True).alias("bad"))
    return rows.join(bad, "doc_id", "left").select("doc_id", F.coalesce("bad", F.lit(False)).alias("misplaced"))
