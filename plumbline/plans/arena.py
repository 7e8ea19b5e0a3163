"""Sentences, tasks and adjudication. Attacks and rulings are made of the conversations' turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import arena as A
from plumbline.plans.tools import Plans, entities_sql, space_sql, table

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql

#: The documents are invented prose: their own word endings take the place of the English patterns.
PROFILE = A.Profile(inferential=[r"\bthe\b.*ing\b"], derived=[r"\w*ation\b"], absence=[r"\bno\w+"])

_SENTENCES = f"""
lines AS (SELECT doc_id AS doc, i, {space_sql("line")} AS line FROM (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(regexp_replace(text, '[*_`>|]', ' ', 'g'), chr(10)) AS l FROM documents))),
parts AS (SELECT doc, i, generate_subscripts(p, 1) AS j, trim(unnest(p)) AS text FROM (
  SELECT doc, i, string_split(regexp_replace(line, '([.!?])\\s+([A-Z$£€0-9''"])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM lines WHERE line <> '')),
sentences AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY i, j) AS ordinal, text FROM parts WHERE length(text) >= 8)"""


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


@plans.add(f"WITH {_SENTENCES} SELECT doc, 0::BIGINT AS section, ordinal::INTEGER AS ordinal, text FROM sentences")
def sentence_sections(spark, sf_dir):
    return A.sentences(documents(spark, sf_dir))


#: A boundary of a word on either side.
_EDGE = "[^\\pL\\pN_]"

_TASKS = f"""
triggered AS (SELECT doc, ordinal, text, CASE WHEN regexp_matches(text, '(?i)(^|{_EDGE})no[a-z0-9_]') THEN 'absence' WHEN regexp_matches(text, '(?i)ation($|{_EDGE})') THEN 'derived'
  WHEN regexp_matches(text, '(?i)(^|{_EDGE})the{_EDGE}.*ing($|{_EDGE})') THEN 'inferential' END AS trigger
  FROM sentences WHERE length(text) BETWEEN 30 AND 500 AND NOT regexp_matches(text, '(?i)^(prepared (by|for)\\b|data cutoff|confidential\\b|©|page \\d)|\\bthis (report|document|section|page) (will|suggests)\\b')),
once AS (SELECT * FROM triggered WHERE trigger IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9%$£€]+', ' ', 'g')) ORDER BY ordinal) = 1),
tasks AS (SELECT *, 'x' || row_number() OVER (PARTITION BY doc ORDER BY ordinal) AS task_id FROM once),
near AS (SELECT t.doc, t.ordinal AS target, s.ordinal, length(s.text) AS n, row_number() OVER (PARTITION BY t.doc, t.ordinal ORDER BY abs(s.ordinal - t.ordinal), s.ordinal) AS place
  FROM tasks t JOIN sentences s ON s.doc = t.doc AND s.ordinal <> t.ordinal),
walk AS (
  SELECT doc, ordinal AS target, 0::BIGINT AS place, 0::BIGINT AS used, 0 AS taken, NULL::BIGINT AS ordinal FROM tasks
  UNION ALL
  SELECT w.doc, w.target, min(c.place), w.used + arg_min(c.n, c.place), w.taken + 1, arg_min(c.ordinal, c.place) FROM walk w JOIN near c ON c.doc = w.doc AND c.target = w.target AND c.place > w.place AND w.used + c.n <= 2400
  WHERE w.taken < 14 GROUP BY w.doc, w.target, w.used, w.taken
),
context AS (SELECT w.doc, w.target, string_agg(s.text, ' ' ORDER BY s.ordinal) AS context FROM walk w JOIN sentences s ON s.doc = w.doc AND s.ordinal = w.ordinal GROUP BY ALL)"""


@plans.add(
    f"""WITH RECURSIVE {_SENTENCES}, {_TASKS} SELECT t.doc, task_id, text AS assertion, coalesce(context, '') AS context, 'sentence ' || ordinal || ', section 0' AS location, trigger, 0::BIGINT AS section
FROM tasks t LEFT JOIN context c ON c.doc = t.doc AND c.target = t.ordinal"""
)
def emitted_tasks(spark, sf_dir):
    return A.emit_tasks(documents(spark, sf_dir), PROFILE)


def _marked_sql() -> str:
    """The pages' lines with section marks (character 30), in DuckDB's SQL."""
    x = "html"
    for pattern, value in (
        ("(?is)<script.*?</script>|<style.*?</style>", "' '"),
        (r"(?i)<(?:section|article)\b[^>]*>", "chr(10) || chr(30)"),
        (r"""(?i)<div\b[^>]*class=["''][^"'']*\bslide\b[^"'']*["''][^>]*>""", "chr(10) || chr(30)"),
        (r"(?i)<h[1-6]\b[^>]*>", "chr(10) || chr(30)"),
        ("(?i)</(?:p|div|li|h[1-6]|td|th|tr|section|article|header|footer|blockquote)>", "chr(10)"),
        (r"(?i)<(?:br|hr)\s*/?>", "chr(10)"),
        ("<[^>]+>", "' '"),
    ):
        x = f"regexp_replace({x}, '{pattern}', {value}, 'g')"
    return entities_sql(x)


_PAGES = f"""
raw AS (SELECT doc, generate_subscripts(l, 1) AS i, unnest(l) AS raw FROM (SELECT page_id AS doc, string_split({_marked_sql()}, chr(10)) AS l FROM pages)),
lines AS (SELECT doc, i, sum(starts_with(ltrim(raw), chr(30))::INT) OVER (PARTITION BY doc ORDER BY i) AS section, {space_sql("replace(raw, chr(30), ' ')")} AS line FROM raw),
parts AS (SELECT doc, i, section, generate_subscripts(p, 1) AS j, trim(unnest(p)) AS text FROM (
  SELECT doc, i, section, string_split(regexp_replace(line, '([.!?])\\s+([A-Z$£€0-9''"])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM lines WHERE line <> ''))"""


@plans.add(f"WITH {_PAGES} SELECT doc, section::BIGINT AS section, (row_number() OVER (PARTITION BY doc ORDER BY i, j))::INTEGER AS ordinal, text FROM parts WHERE length(text) >= 8")
def page_sections(spark, sf_dir):
    return A.sentences(table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text")), html=True)


_ARENA = """
tasks AS (SELECT DISTINCT conv_id AS task_id FROM conversations),
attacks AS (SELECT conv_id AS task_id, 'l' || (turn % 3) AS lens, CASE WHEN (conv_id + turn) % 5 <> 0 THEN 'attack' END AS attack, 's' || turn AS session_id
  FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) = 1),
rulings AS (SELECT task_id, lens, k, CASE WHEN (task_id + k) % 4 = 0 THEN 'lands' WHEN task_id % 3 = 0 THEN 'glances' ELSE 'misses' END AS ruling, 'f' || k AS model_family, 'r' || k AS session_id
  FROM attacks, range(2) r(k) WHERE attack IS NOT NULL AND NOT (task_id % 11 = 0 AND k = 1)),
agreed AS (SELECT task_id, lens, CASE WHEN count(*) <> 2 THEN 'incomplete' WHEN count(DISTINCT ruling) > 1 THEN 'disagrees' ELSE min(ruling) END AS consensus FROM rulings GROUP BY ALL),
rows AS (SELECT a.task_id, CASE WHEN attack IS NULL THEN 'not_required' ELSE coalesce(consensus, 'incomplete') END AS c FROM attacks a LEFT JOIN agreed USING (task_id, lens)),
verdicts AS (SELECT task_id, count(c) AS attacks, CASE WHEN count(c) = 0 THEN 'unattacked' WHEN count(c) <> 3 THEN 'unruled' WHEN bool_or(c = 'incomplete') THEN 'unruled' WHEN bool_or(c = 'lands') THEN 'flagged'
  WHEN bool_or(c = 'glances') THEN 'contested' WHEN bool_or(c = 'disagrees') THEN 'withheld' ELSE 'stands' END AS verdict FROM tasks LEFT JOIN rows USING (task_id) GROUP BY task_id)"""


def findings(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("task_id"), "turn")
    lens = F.concat(F.lit("l"), (F.col("turn") % 3).cast("string"))
    attacks = turns.withColumn("lens", lens).groupBy("task_id", "lens").agg(F.min("turn").alias("turn"))
    attacks = attacks.withColumn("attack", F.when((F.col("task_id") + F.col("turn")) % 5 != 0, "attack")).withColumn("session_id", F.concat(F.lit("s"), F.col("turn").cast("string")))
    rulings = attacks.where("attack is not null").select("task_id", "lens", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("k")).where("NOT (task_id % 11 = 0 AND k = 1)")
    ruling = F.when((F.col("task_id") + F.col("k")) % 4 == 0, "lands").when(F.col("task_id") % 3 == 0, "glances").otherwise("misses")
    rulings = rulings.select("task_id", "lens", ruling.alias("ruling"), F.concat(F.lit("f"), "k").alias("model_family"), F.concat(F.lit("r"), "k").alias("session_id"))
    return A.adjudicate(turns.select("task_id").distinct(), attacks, rulings, ["l0", "l1", "l2"], 2)


@plans.add(f"WITH {_ARENA} SELECT task_id, attacks, verdict FROM verdicts")
def arena_adjudication(spark, sf_dir):
    return findings(spark, sf_dir)


@plans.add(f"WITH {_ARENA} SELECT count(*) AS tasks, count(*) FILTER (verdict = 'withheld') AS withheld, count(*) FILTER (verdict = 'withheld')::DOUBLE / count(*) AS withheld_density, bool_and(verdict = 'stands') AS passed FROM verdicts")
def withheld_density(spark, sf_dir):
    return A.arena_summary(findings(spark, sf_dir))


@plans.add(
    """WITH attacks AS (SELECT conv_id AS task_id, 'l' || turn AS lens, CASE WHEN (conv_id + turn) % 5 <> 0 THEN text END AS attack, 's' || (turn % 4) AS session_id FROM conversations),
rulings AS (SELECT conv_id AS task_id, 'l' || (turn + CASE WHEN conv_id % 7 = 0 THEN 1000 ELSE 0 END) AS lens, 's' || ((turn + k) % 4) AS session_id, k FROM conversations, range(3) r(k))
SELECT r.task_id, r.lens, r.session_id, k::INTEGER AS k FROM rulings r LEFT JOIN attacks a USING (task_id, lens) WHERE a.attack IS NULL OR r.session_id = a.session_id"""
)
def stopped_rulings(spark, sf_dir):
    """rulings on attacks that are not there or null, and those of the attack's own session."""
    turns, lens = table(spark, sf_dir, "conversations"), F.concat(F.lit("l"), F.col("turn").cast("string"))
    attack = F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.col("text"))
    attacks = turns.select(F.col("conv_id").alias("task_id"), lens.alias("lens"), attack.alias("attack"), F.concat(F.lit("s"), (F.col("turn") % 4).cast("string")).alias("session_id"))
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    rulings = turns.select("*", k.alias("k")).withColumn("turn_", F.col("turn") + F.when(F.col("conv_id") % 7 == 0, 1000).otherwise(0))
    rulings = rulings.select(F.col("conv_id").alias("task_id"), F.concat(F.lit("l"), F.col("turn_").cast("string")).alias("lens"), F.concat(F.lit("s"), ((F.col("turn") + F.col("k")) % 4).cast("string")).alias("session_id"), "k")
    return A.self_rulings(attacks, rulings)
