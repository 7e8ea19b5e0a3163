"""Text rules, chunks, readers and small records over the documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import canonical, text
from plumbline.operators import spans
from plumbline.plans.extraction import _NORM
from plumbline.plans.segments import _WINDOWS, SIZE, windows_of
from plumbline.plans.tools import Plans, space_sql, table
from plumbline.sources import readers

plans = Plans()
QUERIES, ORACLE_SQL = plans.queries, plans.sql


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "turn", "text")


@plans.add(
    """WITH t AS (SELECT conv_id * 1000 + turn AS id, CASE WHEN turn = 0 THEN '' ELSE text END AS text FROM conversations),
s AS (SELECT id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 500) / 450.0)::BIGINT))) AS seq FROM t)
SELECT id, seq::INTEGER AS seq, substr(text, (seq * 450 + 1)::INTEGER, 500) AS segment FROM s"""
)
def chunked_turns(spark, sf_dir):
    """Windows of 500 characters; an empty text is one empty window."""
    rows = turns(spark, sf_dir).withColumn("text", F.when(F.col("turn") == 0, "").otherwise(F.col("text")))
    return spans.fixed_windows(rows, "id", size=500, overlap=50, keep_empty=True).select("id", "seq", "segment")


@plans.add(f"WITH {_WINDOWS} SELECT doc_id, seq FROM windows WHERE (doc_id % 3 = 0 AND seq = 0) OR (doc_id % 3 = 1 AND seq = 1)")
def invalid_segments(spark, sf_dir):
    """D3: first windows with a character too many, second ones that say that they end later."""
    docs, windows = windows_of(spark, sf_dir)
    windows = windows.withColumn("segment", F.when((F.col("doc_id") % 3 == 0) & (F.col("seq") == 0), F.concat("segment", F.lit("#"))).otherwise(F.col("segment")))
    windows = windows.withColumn("end", F.when((F.col("doc_id") % 3 == 1) & (F.col("seq") == 1), F.col("end") + 1).otherwise(F.col("end")))
    return spans.invalid_segments(windows, docs, "doc_id", SIZE).select("doc_id", "seq")


@plans.add(
    f"""WITH {_WINDOWS}, q AS (SELECT doc_id, text, substr(text, length(text) // 2 + 1, 40) AS quote FROM documents WHERE length(text) > 0),
o AS (SELECT doc_id, unnest(list_filter(generate_series(1, length(text)), lambda i: substr(text, i, length(quote)) = quote)) - 1 AS spot, length(quote) AS n FROM q),
c AS (SELECT doc_id, (i * 400)::INTEGER AS s, least(i * 400 + 400, length(text))::INTEGER AS e FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 400)) AS i FROM documents WHERE length(text) > 0)),
both_ AS (SELECT 'baseline' AS segmenter, doc_id, s, e FROM windows UNION ALL SELECT 'candidate', doc_id, s, e FROM c),
h AS (SELECT segmenter, doc_id, spot, count(*) FILTER (s <= spot AND spot + n <= e) AS held FROM both_ JOIN o USING (doc_id) GROUP BY ALL),
m AS (SELECT segmenter, doc_id, max(held) AS most, sum(greatest(held - 1, 0)) AS extra FROM h GROUP BY ALL),
k AS (SELECT segmenter, doc_id, count(*) AS n FROM both_ GROUP BY ALL)
SELECT segmenter, count(*) FILTER (k.n > 1) AS several, 1.0::DOUBLE AS least_solid_ratio, sum(k.n)::BIGINT AS segments, count(most)::BIGINT AS grounded, count(*) FILTER (most > 0)::BIGINT AS contained, count(*) FILTER (most = 0)::BIGINT AS cut,
  sum(CASE WHEN most > 0 THEN extra ELSE 0 END)::BIGINT AS duplicate_exposures FROM k LEFT JOIN m USING (segmenter, doc_id) GROUP BY segmenter"""
)
def segmenter_comparison(spark, sf_dir):
    """Windows with overlap against pieces of 400 characters, for 40 characters out of the middle of each text."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    quotes = docs.where(F.length("text") > 0).select("doc_id", F.expr("substring(text, int(length(text) div 2) + 1, 40)").alias("quote"))
    rows = spans.compare_segmenters(docs, quotes, "doc_id", 500, 50, lambda t: [(i, min(i + 400, len(t))) for i in range(0, len(t), 400)])
    return spans.comparison_summary(rows)


@plans.add(f"SELECT doc_id, sha256(replace({_NORM.format('text')}, 'ß', 'ss')) AS sha FROM documents")
def folded_texts(spark, sf_dir):
    """C2."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(text.normalise_text(F.col("text")), 256).alias("sha"))


@plans.add("SELECT doc_id, array_to_string(regexp_extract_all(text, '[$£€]?[0-9][0-9,.]*%?'), '|') AS numbers FROM documents")
def numeric_tokens(spark, sf_dir):
    """C9."""
    return documents(spark, sf_dir).select("doc_id", F.array_join(text.numeric_tokens(F.col("text")), "|").alias("numbers"))


@plans.add(
    r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) > 10) AS p FROM documents)
SELECT doc_id, len(p)::INTEGER AS n, sha256(array_to_string(p, chr(1))) AS sha FROM p"""
)
def split_sentences(spark, sf_dir):
    """C11."""
    rows = documents(spark, sf_dir).select("doc_id", text.sentences_of_text(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.sha2(F.array_join("p", "\u0001"), 256).alias("sha"))


_READ = space_sql("('See label bold head code ' || translate(text, '#*`', '   '))")


@plans.add(f"SELECT conv_id * 1000 + turn AS id, {_READ} AS text FROM conversations")
def reading_texts(spark, sf_dir):
    """Turns behind a link, marks and an evidence comment."""
    head = F.lit('See [label](https://x.org/a "t") *bold* # head `code` <!-- evidence-quote: z -->')
    return turns(spark, sf_dir).select("id", text.reading_text(F.concat(head, F.lit(" "), "text")).alias("text"))


@plans.add(r"SELECT doc_id, sha256(regexp_replace(replace(text, '. ', chr(9) || '  .'), '[ \t]+', ' ', 'g')) AS sha FROM documents")
def reflowed_texts(spark, sf_dir):
    """C13."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(text.reflow(F.replace("text", F.lit(". "), F.lit("\t  ."))), 256).alias("sha"))


@plans.add("""SELECT doc_id, '{"findings":{"c":[' || CASE WHEN m <> '' THEN '"' || m || '"' ELSE '' END || ']}}' AS reply FROM (SELECT doc_id, regexp_extract(text, '[a-z]+ing', 0) AS m FROM documents)""")
def stub_replies(spark, sf_dir):
    """The backend without a model."""
    chunks = documents(spark, sf_dir).select("doc_id", F.col("text").alias("chunk"))
    return readers.stub_backend(chunks, "[a-z]+ing", "c").select("doc_id", "reply")


@plans.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unfinished_documents(spark, sf_dir):
    """Documents that no label is there for."""
    return readers.unfinished(documents(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@plans.add("SELECT CASE doc_id % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' ELSE 'placed' END AS status, count(*) AS n FROM documents GROUP BY 1")
def corpus_placement(spark, sf_dir):
    """A dataset that lacks every fourth text of its manifest and has other texts for every fourth."""
    docs, title = documents(spark, sf_dir), F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    manifest = docs.select(title.alias("title"), F.sha2("text", 256).alias("sha256"))
    dataset = docs.where("doc_id % 4 <> 0").select(title.alias("title"), F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return readers.restored_corpus(dataset, manifest).groupBy("status").agg(F.count("*").alias("n"))


_RECORD = """'{"doc_id":' || coalesce(doc_id::VARCHAR, 'null') || ',"quality":' || coalesce(quality::VARCHAR, 'null') || ',"toxic":' || coalesce(toxic::VARCHAR, 'null') || '}'"""


@plans.add(f"SELECT sha256('[' || string_agg({_RECORD}, ',' ORDER BY doc_id) || ']') AS sha256 FROM labels")
def labels_sha256(spark, sf_dir):
    """All labels as one set of records."""
    return canonical.records_sha256(table(spark, sf_dir, "labels"), "doc_id", "doc_id", "quality", "toxic")


@plans.add("SELECT conv_id * 1000 + turn AS id, sha256(text) AS question_sha256 FROM conversations")
def question_hashes(spark, sf_dir):
    """M6."""
    return turns(spark, sf_dir).select("id", canonical.text_sha256(F.col("text")).alias("question_sha256"))


@plans.add("SELECT DISTINCT lang, source FROM documents WHERE doc_id % 2 = 0 UNION SELECT DISTINCT lang, source FROM documents WHERE doc_id % 3 = 0")
def joined_holdouts(spark, sf_dir):
    """The union of two sets."""
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source")
    return docs.where("doc_id % 2 = 0").unionByName(docs.where("doc_id % 3 = 0")).select("lang", "source").distinct()


@plans.add("SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^a-z0-9%$£€]+', ' ', 'g'))) AS sha FROM documents")
def emission_keys(spark, sf_dir):
    """C6."""
    return documents(spark, sf_dir).select("doc_id", F.sha2(text.emission_key(F.col("text")), 256).alias("sha"))
