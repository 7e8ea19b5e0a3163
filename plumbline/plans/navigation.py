"""Navigation over the documents' lines: each line is a node, a question is made of words of a document."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.text import NAVIGATION_STOP, content_tokens
from plumbline.operators import navigation as N
from plumbline.operators.scoring import token_recall
from plumbline.plans.tools import Plans, table
from plumbline.stored import stored

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql


_ID = """substr(sha256('{"source_end":' || e || ',"source_sha256":"' || sha || '","source_start":' || s || ',"text_sha256":"' || sha256(piece) || '"}'), 1, 24)"""

_NODES = f"""
l AS (SELECT doc, text, sha256(text) AS sha, p, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (SELECT doc_id AS doc, text, string_split(text, chr(10)) AS p FROM documents)),
o AS (SELECT doc, text, sha, i, trim(line) AS piece, (coalesce(list_sum(list_transform(p[:i - 1], lambda x: length(x) + 1)), 0) + length(line) - length(ltrim(line)))::INTEGER AS s FROM l WHERE trim(line) <> ''),
k AS (SELECT *, (s + length(piece))::INTEGER AS e, row_number() OVER (PARTITION BY doc ORDER BY i) AS number, count(*) OVER (PARTITION BY doc) AS n FROM o),
nodes AS (SELECT doc, {_ID} AS node_id, n = 1 AND s = 0 AND e = length(text) AS single, number::INTEGER AS number, coalesce(nullif(substr(trim(regexp_replace(piece, '\\s+', ' ', 'g')), 1, 180), ''), 'Untitled source segment') AS title, s, e FROM k)"""

_WORDS = "list_filter(list_distinct(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-z0-9]+')), lambda t: NOT list_contains({}, t))"
_STOP = str(NAVIGATION_STOP)
_CHOSEN = f"""
cases AS (SELECT 'q' || doc_id AS case_id, doc_id AS doc, text, low, least(length(text), low + 80) AS high, {_WORDS.format("substr(text, low + 1, 80)", _STOP)} AS q
  FROM (SELECT *, (doc_id * 41 % greatest(1, length(text) - 80))::INTEGER AS low FROM documents WHERE regexp_matches(text, '\\S'))),
scored AS (SELECT case_id, node_id, s, e, len(list_intersect(q, {_WORDS.format("title", _STOP)}))::DOUBLE / len(q) AS score FROM cases JOIN nodes USING (doc) WHERE len(q) > 0),
top AS (SELECT * FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, s, node_id) <= 3),
chosen AS (SELECT case_id, count(node_id) AS selected, list(node_id ORDER BY s, node_id) FILTER (node_id IS NOT NULL) AS node_ids, coalesce(sum(e - s) + 2 * (count(node_id) - 1), 0) AS characters FROM cases LEFT JOIN top USING (case_id) GROUP BY case_id),
gold AS (SELECT case_id, list(node_id) AS gold, any_value(length(cases.text)) AS total FROM cases JOIN nodes USING (doc) WHERE s < high AND low < e GROUP BY case_id),
evaluated AS (SELECT case_id, CASE WHEN selected > 0 THEN 'selected' ELSE 'abstained' END AS status, selected::INTEGER AS selected, len(list_intersect(coalesce(node_ids, []), gold))::DOUBLE / len(gold) AS recall,
  len(list_intersect(coalesce(node_ids, []), gold)) = len(gold) AS exact, (selected - len(list_intersect(coalesce(node_ids, []), gold)))::INTEGER AS irrelevant, characters::DOUBLE / total AS context_ratio FROM chosen JOIN gold USING (case_id))"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def nodes(spark, sf_dir):
    """Every line is a node, however long; written out, as selection, gold and fetching all read them."""
    return stored(N.paragraph_nodes(documents(spark, sf_dir), LINE, lines=True))


#: Longer than any line.
LINE = 1 << 20


def cases(spark, sf_dir):
    """A case for each document that is not blank: its question are 80 characters from anywhere in it, high severity for every third."""
    docs = documents(spark, sf_dir).where(F.col("text").rlike(r"\S"))
    low = (F.col("doc") * 41 % F.greatest(F.lit(1), F.length("text") - 80)).cast("int")
    docs = docs.withColumn("gold_start", low).withColumn("gold_end", F.least(F.length("text"), low + 80))
    return docs.select(
        F.concat(F.lit("q"), F.col("doc").cast("string")).alias("case_id"), "doc", F.substring(F.col("text"), F.col("gold_start") + 1, F.lit(80)).alias("question"), "gold_start", "gold_end",
        F.when(F.col("doc") % 3 == 0, "high").otherwise("low").alias("severity"),
    )


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@plans.add(
    f"""WITH RECURSIVE p AS (SELECT doc, generate_subscripts(l, 1) AS i, unnest(l) AS part FROM (
  SELECT doc_id AS doc, string_split_regex(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n[ \t]*\n') AS l FROM documents)),
cut AS (
  SELECT doc, i, 0 AS k, '' AS piece, trim(part, {_SPACES}) AS rest FROM p
  UNION ALL
  SELECT doc, i, k + 1, substr(rest, 1, stop), ltrim(substr(rest, stop + 1), {_SPACES}) FROM (
    SELECT *, CASE WHEN length(rest) <= 256 THEN length(rest) WHEN contains(substr(rest, 129, 128), ' ') THEN 256 - strpos(reverse(substr(rest, 129, 128)), ' ') ELSE 256 END AS stop FROM cut WHERE rest <> '')
)
SELECT doc, count(*)::BIGINT AS nodes, sum(length(piece))::BIGINT AS characters, sha256(string_agg(piece, chr(1) ORDER BY i, k)) AS pieces FROM cut WHERE k > 0 GROUP BY doc"""
)
def paragraph_nodes(spark, sf_dir):
    """Paragraphs between blank lines, one after each sentence, those of more than 256 characters cut."""
    docs = documents(spark, sf_dir).select("doc", F.replace("text", F.lit(". "), F.lit(".\n \n")).alias("text"))
    found = N.paragraph_nodes(docs, 256).where("selectable").select("doc", "start", "end", "number")
    held = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("number", "start", "end"))).alias("spans"))
    pieces = F.transform("spans", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"]))
    rows = held.join(docs, "doc").select("doc", pieces.alias("pieces"))
    return rows.select("doc", F.size("pieces").cast("long").alias("nodes"), F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + F.length(p)).alias("characters"), F.sha2(F.array_join("pieces", "\u0001"), 256).alias("pieces"))


@plans.add()
def cut_nodes(spark, sf_dir):
    """Lines cut into nodes of at most 256 characters; what the pieces are is tested against a walk over each line."""
    return N.paragraph_nodes(documents(spark, sf_dir), 256, lines=True)


@plans.add(f'WITH {_NODES} SELECT doc, node_id, number, title, s AS start, e AS "end" FROM nodes')
def line_nodes(spark, sf_dir):
    return nodes(spark, sf_dir).where("selectable").select("doc", "node_id", "number", "title", "start", "end")


@plans.add(
    """SELECT doc_id AS doc, substr(sha256('{"source_end":' || length(text) || ',"source_sha256":"' || sha256(text) || '","source_start":0,"text_sha256":"' || sha256(text) || '"}'), 1, 24) AS node_id
FROM documents WHERE regexp_matches(text, '\\S')"""
)
def root_node_ids(spark, sf_dir):
    return N.root_ids(documents(spark, sf_dir))


@plans.add(
    f"""WITH {_NODES}, t AS (SELECT doc, number, node_id, s, e, max(number) OVER (PARTITION BY doc) AS n FROM nodes WHERE NOT single)
SELECT doc, 'outside_parent' AS rule, node_id FROM t WHERE number = 1 AND doc % 5 = 0
UNION ALL SELECT doc, 'unknown_parent', node_id FROM t WHERE number = 1 AND doc % 5 = 1
UNION ALL SELECT doc, 'repeated_id', node_id FROM t WHERE number = 1 AND doc % 5 = 2
UNION ALL SELECT doc, 'cycle', node_id FROM t WHERE number <= 2 AND n >= 2 AND doc % 5 = 3
UNION ALL SELECT doc, 'outside_parent', node_id FROM t WHERE number <= 2 AND n >= 2 AND doc % 5 = 3"""
)
def tree_integrity(spark, sf_dir):
    """Trees that are broken by the first or the first two children, in a way that doc_id says."""
    own, m = nodes(spark, sf_dir), F.col("doc") % 5
    of = Window.partitionBy("doc")
    rows = own.withColumns({c: F.max(F.when((F.col("number") == n) & F.col("parent_id").isNotNull(), F.col("node_id"))).over(of) for n, c in ((1, "one"), (2, "two"))})
    is_one, is_two = F.col("node_id") == F.col("one"), F.col("node_id") == F.col("two")
    child = F.col("parent_id").isNotNull()
    parent = F.when((m == 1) & is_one & child, "nowhere").when((m == 3) & F.col("two").isNotNull() & is_one & child, F.col("two")).when((m == 3) & is_two & child, F.col("one")).otherwise(F.col("parent_id"))
    rows = rows.withColumn("parent_id", parent).withColumn("end", F.when((m == 0) & is_one & child, F.col("end") + 10**8).otherwise(F.col("end"))).withColumn("copies", F.when((m == 2) & is_one & child, 2).otherwise(1))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return N.tree_violations(rows.select("doc", "node_id", "parent_id", "start", "end"))


@plans.add(
    f"""WITH {_NODES} SELECT doc, string_agg('["n",' || to_json(title)::VARCHAR || ',true,[]]', ',' ORDER BY s) AS inner_nodes FROM nodes WHERE NOT single GROUP BY doc"""
)
def tree_surfaces(spark, sf_dir):
    """The children of each document's tree, their handles left out (`node_handles` has those)."""
    own = N.tree_surface(nodes(spark, sf_dir)).where(~F.col("surface").endswith(",true,[]]]") | (F.length(F.regexp_extract("surface", r",false,\[(?s:.*)\]\]\]$", 0)) > 0))
    inner = F.regexp_extract("surface", r"(?s),false,\[(.*)\]\]\]$", 1)
    return own.where(F.length(inner) > 0).select("doc", F.regexp_replace(inner, '"n[0-9]+"', '"n"').alias("inner_nodes"))


@plans.add(f"WITH {_NODES}, {_CHOSEN} SELECT case_id, CASE WHEN selected > 0 THEN 'selected' ELSE 'abstained' END AS status, array_to_string(coalesce(node_ids, []), ',') AS node_ids FROM chosen")
def lexical_topk_nodes(spark, sf_dir):
    return N.select_lexical(nodes(spark, sf_dir), cases(spark, sf_dir), 3).withColumn("node_ids", F.array_join("node_ids", ","))


def evaluated(spark, sf_dir):
    n, c = nodes(spark, sf_dir), cases(spark, sf_dir)
    chosen = N.select_lexical(n, c, 3)
    return N.evaluate(chosen, N.gold_nodes(c, n), N.fetch_nodes(chosen, c, n, documents(spark, sf_dir)))


@plans.add(f"WITH {_NODES}, {_CHOSEN} SELECT case_id, status, selected, round(recall, 9) AS recall, exact, irrelevant, round(context_ratio, 9) AS context_ratio FROM evaluated")
def navigation_eval(spark, sf_dir):
    return evaluated(spark, sf_dir).withColumns({c: F.round(c, 9) for c in ("recall", "context_ratio")})


@plans.add(
    f"""WITH {_NODES}, {_CHOSEN} SELECT count(*) AS cases, count(*) FILTER (exact) AS exact_coverage, round(avg(recall), 9) AS mean_recall, round(avg(selected), 9) AS mean_selected, round(avg(irrelevant), 9) AS mean_irrelevant,
  round(avg(context_ratio), 9) AS mean_context_ratio, count(*) FILTER (status = 'selected') AS selected_cases, round(avg(selected) FILTER (status = 'selected'), 9) AS mean_selected_when_selected,
  count(*) FILTER (status = 'abstained') AS abstentions, 0::BIGINT AS failures FROM evaluated"""
)
def navigation_summary(spark, sf_dir):
    out = N.evaluation_summary(evaluated(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith("mean_")})


@plans.add(
    """WITH w AS (SELECT conv_id, turn, role, list_filter(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[a-z0-9]+')), lambda t: NOT list_contains(
  ['a','an','and','are','as','at','be','by','do','does','for','from','how','in','is','it','of','on','or','that','the','this','to','what','when','where','which','who','why','with'], t)) AS t FROM conversations)
SELECT q.conv_id, q.turn, coalesce(len(list_intersect(q.t, a.t))::DOUBLE / nullif(len(q.t), 0), 0.0) AS relevance FROM w q JOIN w a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'"""
)
def lexical_relevance(spark, sf_dir):
    """Share of a user turn's words that the assistant's next turn has."""
    turns = stored(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", content_tokens(F.col("text")).alias("t")))
    q = turns.where("role = 'user'").select("conv_id", "turn", "t")
    a = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("a"))
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", token_recall(F.col("t"), F.col("a")).alias("relevance"))


def by_navigator(spark, sf_dir):
    """Three navigators over every case: all nodes, the lexical one, and recorded outputs (every fourth fails, every fourth takes too many)."""
    n, c = nodes(spark, sf_dir), cases(spark, sf_dir)

    def recorded(nodes_, cases_):
        first = nodes_.where("selectable").groupBy("doc").agg(F.min_by("node_id", F.struct("start", "node_id")).alias("first"))
        rows, m = cases_.join(first, "doc"), F.col("doc") % 4
        ids = F.when(m == 0, F.lit(None)).when(m == 1, F.array("first")).when(m == 2, F.array().cast("array<string>")).otherwise(F.array("first", F.lit("x"), F.lit("y")))
        out = rows.select("case_id", ids.cast("array<string>").alias("node_ids"), F.lit(10).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.when(m == 0, "timeout").alias("error"))
        return N.select_recorded(out, nodes_, cases_, 2, 100)

    runs = stored(N.run_navigators(c, n, {"all": N.select_all, "lexical": lambda a, b: N.select_lexical(a, b, 3), "recorded": recorded}))
    fetched = N.fetch_nodes(runs, c, n, documents(spark, sf_dir))
    return N.evaluate(runs.join(c.select("case_id", "severity"), "case_id"), N.gold_nodes(c, n), fetched)


_RUNS = f"""
gold_ AS (SELECT case_id, doc, list(node_id) AS gold, any_value(length(cases.text)) AS total FROM cases JOIN nodes USING (doc) WHERE s < high AND low < e GROUP BY case_id, doc),
firsts AS (SELECT doc, arg_min(node_id, s) AS first, min(s) AS s, arg_min(e, s) AS e FROM nodes GROUP BY doc),
answers AS (
  SELECT case_id, 'all' AS navigator, 'selected' AS status, 'selected' AS reason, list(node_id) AS ids, sum(e - s) + 2 * (count(*) - 1) AS characters FROM cases JOIN nodes USING (doc) GROUP BY case_id
  UNION ALL SELECT case_id, 'lexical', CASE WHEN selected > 0 THEN 'selected' ELSE 'abstained' END, CASE WHEN selected > 0 THEN 'selected' ELSE 'abstained' END, coalesce(node_ids, []), characters FROM chosen
  UNION ALL SELECT case_id, 'recorded', ['failed', 'selected', 'abstained', 'failed'][doc % 4 + 1], ['selector_error', 'selected', 'abstained', 'too_many'][doc % 4 + 1], CASE WHEN doc % 4 = 1 THEN [first] ELSE [] END, CASE WHEN doc % 4 = 1 THEN e - s ELSE 0 END FROM cases JOIN firsts USING (doc)
), evaluated_ AS (SELECT case_id, navigator, status, reason, doc, len(ids) AS selected, len(list_intersect(ids, gold))::DOUBLE / len(gold) AS recall, len(list_intersect(ids, gold)) = len(gold) AS exact,
  len(ids) - len(list_intersect(ids, gold)) AS irrelevant, CASE WHEN len(ids) > 0 THEN characters::DOUBLE / total ELSE 0 END AS context_ratio FROM answers JOIN gold_ USING (case_id))"""


@plans.add(
    f"""WITH {_NODES}, {_CHOSEN}, {_RUNS} SELECT navigator, count(*) AS cases, count(*) FILTER (exact) AS exact_coverage, round(avg(recall), 9) AS mean_recall, round(avg(selected), 9) AS mean_selected, round(avg(irrelevant), 9) AS mean_irrelevant,
  round(avg(context_ratio), 9) AS mean_context_ratio, count(*) FILTER (status = 'selected') AS selected_cases, round(avg(selected) FILTER (status = 'selected'), 9) AS mean_selected_when_selected,
  count(*) FILTER (status = 'abstained') AS abstentions, count(*) FILTER (status = 'failed') AS failures, count(*) FILTER (doc % 3 = 0 AND NOT exact) AS high_severity_misses FROM evaluated_ GROUP BY navigator"""
)
def navigator_comparison(spark, sf_dir):
    """The summary of each navigator."""
    out = N.evaluation_summary(by_navigator(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.startswith("mean_")})


@plans.add(f"WITH {_NODES}, {_CHOSEN}, {_RUNS} SELECT navigator, reason, count(*) AS n FROM evaluated_ GROUP BY ALL")
def navigator_reasons(spark, sf_dir):
    """The histogram of reasons."""
    return N.histogram(by_navigator(spark, sf_dir), "reason")


@plans.add(f"WITH {_NODES}, {_CHOSEN} SELECT case_id, array_to_string(list(node_id ORDER BY s, node_id), ',') AS node_ids FROM cases JOIN nodes USING (doc) GROUP BY case_id")
def all_nodes(spark, sf_dir):
    """Full injection."""
    return N.select_all(nodes(spark, sf_dir), cases(spark, sf_dir)).select("case_id", F.array_join("node_ids", ",").alias("node_ids"))


@plans.add(
    f"""WITH {_NODES}, {_CHOSEN} SELECT case_id, len(gold)::INTEGER AS gold FROM gold ORDER BY sha256('7:' || case_id) LIMIT 25"""
)
def navigation_pack(spark, sf_dir):
    """A pack of 25 cases in seeded order."""
    docs = documents(spark, sf_dir)
    seeds = cases(spark, sf_dir).select(F.col("case_id").alias("seed_id"), F.col("doc").alias("source_id"), "question", F.col("gold_start").alias("start"), F.col("gold_end").alias("end"))
    chosen, _ = N.navigation_pack(seeds, docs, 25, 7, most=LINE, lines=True, shuffle="digest")
    return chosen.select("case_id", F.size("gold").alias("gold"))


@plans.add(
    f"""WITH {_NODES}, {_CHOSEN}
SELECT case_id, CASE WHEN c.doc % 3 = 0 THEN 'failed' ELSE 'selected' END AS status, CASE WHEN c.doc % 3 = 0 THEN 'selector_error' ELSE 'selected' END AS reason,
  CASE WHEN c.doc % 3 = 0 THEN '' ELSE (SELECT arg_min(n.node_id, (n.s, n.node_id)) FROM nodes n WHERE n.doc = c.doc) END AS node_ids FROM cases c"""
)
def replayed_selections(spark, sf_dir):
    """Recorded outputs found by their prompts' hashes; the prompts of every third document are other ones by now."""
    own, asked = nodes(spark, sf_dir), cases(spark, sf_dir)
    first = own.where("selectable").groupBy("doc").agg(F.min(F.struct("start", "node_id")).alias("f")).select("doc", F.array("f.node_id").alias("node_ids"))
    prompts = asked.select("doc", "case_id", F.concat_ws("|", "case_id", "question").alias("prompt"))
    recorded = prompts.join(first, "doc").select(F.sha2("prompt", 256).alias("prompt_sha256"), "node_ids", F.lit(10).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(None).cast("string").alias("error"))
    now = prompts.select("case_id", F.when(F.col("doc") % 3 == 0, F.concat("prompt", F.lit("?"))).otherwise(F.col("prompt")).alias("prompt"))
    return N.select_recorded(N.replayed(now, recorded), own, asked, 5, 32_768).select("case_id", "status", "reason", F.array_join("node_ids", ",").alias("node_ids"))


def _longest(question, nodes):
    """A selector that answers questions with an article by the longest line."""
    lengths = nodes["end"] - nodes["start"]
    return [nodes["node_id"][lengths.idxmax()]] if "the" in question else []


@plans.add(
    f"""WITH {_NODES}, {_CHOSEN}, r AS (SELECT case_id, contains(substr(text, low + 1, 80), 'the') AS asked, node_id FROM cases JOIN nodes USING (doc) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY e - s DESC, s, node_id) = 1)
SELECT case_id, CASE WHEN asked THEN 'selected' ELSE 'abstained' END AS status, CASE WHEN asked THEN node_id END AS node_id FROM r"""
)
def longest_nodes(spark, sf_dir):
    """L4: a selector of one's own over every document's lines."""
    out = N.select_with(nodes(spark, sf_dir), cases(spark, sf_dir), _longest)
    return out.select("case_id", "status", F.get("node_ids", F.lit(0)).alias("node_id"))
