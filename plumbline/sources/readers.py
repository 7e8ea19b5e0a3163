"""Reading texts, records, snapshots and packs; writing worksheets and results."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.canonical import snapshot_key
from plumbline.sources.pages import page_text
from plumbline.stored import remove, stored


def read_texts(references: DataFrame, path: str) -> DataFrame:
    """A1: the text of each reference (source_id, uri = file name below ``path``); bytes that are no UTF-8 are
    replaced, a file that is not there is ``source_unreachable``."""
    spark = references.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    texts = files.select(name.alias("uri"), decoded(F.col("content")).alias("text"))
    rows = references.join(texts, "uri", "left")
    return rows.withColumn("failure", F.when(F.col("text").isNull(), "source_unreachable"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 with replacement."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="replace"))

    return run(content)


def html_to_text(html: Column) -> Column:
    """A3: what a page says: no scripts and styles, entities decoded, white space collapsed. Pages are large and read one by one, so they do not come in
    Arrow batches of thousands of rows."""
    return F.udf(page_text, "string", useArrow=False)(html)


def resolve_with(references: DataFrame, resolve) -> DataFrame:
    """L5, extension point: a resolver of one's own, called with each uri; it returns a text or raises. What it raises on is
    ``source_unreachable``, a PermissionError ``source_paywalled``."""

    @F.pandas_udf("struct<text:string,failure:string>")
    def run(uris: pd.Series) -> pd.DataFrame:
        out = []
        for uri in uris:
            try:
                text = resolve(uri)
                out.append((text, None if text is not None else "source_unreachable"))
            except PermissionError:
                out.append((None, "source_paywalled"))
            except Exception:  # noqa: BLE001  one source's failure is that row's outcome
                out.append((None, "source_unreachable"))
        return pd.DataFrame(out, columns=["text", "failure"])

    return references.withColumn("r", run("uri")).select("*", "r.text", "r.failure").drop("r")


#: Hex digits of a snapshot's key that its bucket is named by.
BUCKET_DIGITS = 2
_HELD = ("source_id", "uri", "text", "fetched_at", "status", "media_type", "sha256", "key", "bucket")


def _bucket(key: Column) -> Column:
    return F.substring(key, 1, BUCKET_DIGITS)


def write_snapshots(sources: DataFrame, path: str) -> None:
    """A4: source_id, uri, text, status, media_type as a table with each text's hash, in buckets by the first digits of the snapshot key. Rows are
    added; of those with one key the one fetched last counts."""
    rows = sources.withColumn("sha256", F.sha2("text", 256)).withColumn("key", snapshot_key(F.col("uri"))).withColumn("bucket", _bucket(F.col("key"))).select(*_HELD)
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def _newest(rows: DataFrame) -> DataFrame:
    last = Window.partitionBy("bucket", "key").orderBy(F.desc("fetched_at"), "source_id", "sha256")
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


_BUCKETS = "source_id string, uri string, text string, fetched_at string, status int, media_type string, sha256 string, key string, bucket string"


def compact_snapshots(spark: SparkSession, path: str) -> None:
    """A4: leaves the newest row of each key, bucket by bucket. The new table is written beside the old one and takes its place by a rename; the
    old one goes when it stands."""
    new, old = f"{path}-new-{uuid.uuid4().hex}", f"{path}-old-{uuid.uuid4().hex}"
    _newest(spark.read.schema(_BUCKETS).parquet(path)).repartition("bucket").write.partitionBy("bucket").parquet(new)
    place = spark._jvm.org.apache.hadoop.fs.Path
    store = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for a, b in ((path, old), (new, path)):
        if not store.rename(place(a), place(b)):
            raise OSError(f"{a} could not be renamed")
    remove(spark, old)


def load_snapshots(references: DataFrame, path: str) -> DataFrame:
    """A5: each reference with its snapshot's text, or why there is none. Only the buckets and keys that are asked for are read; of what they hold
    the newest row counts, so the history of other keys is not looked at."""
    keyed = references.withColumn("__key", snapshot_key(F.col("uri"))).withColumn("__bucket", _bucket(F.col("__key")))
    asked = keyed.where("uri is not null").select(F.col("__bucket").alias("bucket"), F.col("__key").alias("key")).distinct()
    s = _newest(references.sparkSession.read.schema(_BUCKETS).parquet(path).join(asked, ["bucket", "key"], "left_semi"))
    s = s.select(F.col("key").alias("__key"), F.col("uri").alias("s_uri"), F.col("source_id").alias("s_id"), F.col("text"), "sha256", "fetched_at")
    rows = keyed.join(s, "__key", "left")
    bad = (F.col("s_id") != F.col("source_id")) | F.col("text").isNull() | (F.sha2("text", 256) != F.col("sha256")) | (F.col("s_uri") != F.col("uri"))
    failure = F.when(F.col("s_id").isNull(), "source_unreachable").when(bad, "source_changed")
    return rows.withColumn("failure", failure).withColumn("text", F.when(F.col("failure").isNull(), F.col("text"))).drop("s_id", "sha256", "s_uri", "__key", "__bucket")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: the lines of text files, numbered from 1 in each file, blank ones too. Lines keep their order within a part of a file that a
    task reads, so a line's number is its place there and the number of lines in the parts before, of which there are few."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"))
    rows = stored(rows)
    parts = rows.groupBy("file", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(parts, ["file", "part"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False, numbered: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. Lines that are no object of the schema, or with ``strict`` have
    other fields, come back with ``problem``; with ``numbered`` each row has its ``file`` and ``line``."""
    lines = (numbered_lines(spark, path) if numbered else spark.read.text(path)).where(F.length(F.trim("value")) > 0)
    rows = lines.withColumn("row", F.from_json("value", T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]), {"mode": "PERMISSIVE"}))
    foreign = F.array_except(F.json_object_keys("value"), F.array(*(F.lit(f.name) for f in schema.fields)))
    problem = F.when(F.col("row._corrupt_record").isNotNull() | F.json_object_keys("value").isNull(), "malformed")
    if strict:
        problem = problem.when(F.size(foreign) > 0, "unknown_fields")
    return rows.select(*(F.col(f"row.{f.name}").alias(f.name) for f in schema.fields), problem.alias("problem"), *(["file", "line"] if numbered else []))


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """Domain packs of a folder as categories: ``domain, category, name, severity``; a key that two packs
    claim is an error, an unknown one has no fallback."""
    schema = "key string, categories array<struct<key:string,name:string,severity:int,description:string>>"
    packs = spark.read.schema(schema).option("multiLine", "true").json(path)
    if packs.groupBy("key").count().where("count > 1").limit(1).count():
        raise ValueError("two domain packs have one key")
    return packs.select(F.col("key").alias("domain"), F.explode("categories").alias("c")).select("domain", F.col("c.key").alias("category"), "c.name", "c.severity", "c.description")


def prompt_block(categories: DataFrame) -> DataFrame:
    """M2: each domain's categories as lines of a prompt, in the order of their keys; a description stands
    after a colon if there is one."""
    tail = F.when(F.length(F.trim("description")) > 0, F.concat(F.lit(": "), "description")).otherwise("")
    line = F.concat(F.lit("- "), "name", tail)
    return categories.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", line.alias("line")))), lambda x: x["line"]), "\n").alias("block"))


#: What a completion is asked for; a profile may bring its own.
TEMPLATE = """{context}

Find text for each category below. Copy it from the {noun} word by word, one sentence for one finding.
Answer with one JSON object: "findings" maps a category to a list of the copied texts, and
"checked_categories" lists every category that you looked for.

Categories:
{categories}

The {noun}:
{chunk}
"""


def prompts(chunks: DataFrame, block: str, context: str, noun: str, template: str = TEMPLATE) -> DataFrame:
    """Adds ``prompt`` to each ``chunk``."""
    before, after = template.format(context=context, noun=noun, categories=block, chunk="\0").split("\0")
    return chunks.withColumn("prompt", F.concat(F.lit(before), "chunk", F.lit(after)))


def restored_corpus(dataset: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each manifest row (title, sha256) as ``placed``, ``changed`` or ``missing``."""
    d = dataset.select("title", F.sha2("text", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").otherwise("placed")
    return manifest.join(d, "title", "left").withColumn("status", status)


def unfinished(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """What has no output yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def stub_backend(chunks: DataFrame, pattern: str, category: str) -> DataFrame:
    """A backend without a model: the first match of a pattern as a finding of one category."""
    hit = F.regexp_extract("chunk", pattern, 0)
    return chunks.withColumn("reply", F.to_json(F.struct(F.create_map(F.lit(category), F.when(hit != "", F.array(hit)).otherwise(F.array().cast("array<string>"))).alias("findings"))))


def with_backend(chunks: DataFrame, complete, schema: str = "reply string") -> DataFrame:
    """A completion function of one's own, called with each prompt; an error leaves a null reply."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        out = []
        for p in prompts:
            try:
                out.append(complete(p))
            except Exception:  # noqa: BLE001  one prompt's failure is that segment's, not the job's
                out.append(None)
        return pd.Series(out, dtype="object")

    return chunks.withColumn("reply", run("prompt"))


def usage_log(replies: DataFrame, backend: str, model: str, doc: str = "doc") -> DataFrame:
    """``backend, model, in_tokens, out_tokens, doc`` of each call of ``prompt, reply``; a call that failed has used nothing up on the way out."""
    size = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")
    return replies.select(F.lit(backend).alias("backend"), F.lit(model).alias("model"), size("prompt").alias("in_tokens"), F.when(F.col("reply").isNull(), F.lit(0).cast("long")).otherwise(size("reply")).alias("out_tokens"), F.col(doc).alias("doc"))


_SHEET = {"sep": "\t", "header": "true", "quote": '"', "escape": '"'}


def write_worksheet(rows: DataFrame, path: str) -> None:
    """A tab-separated worksheet with a header; quotes in a cell are doubled."""
    rows.write.options(**_SHEET, quoteAll="true").csv(path)


def read_worksheet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A worksheet with the columns of ``schema``, cells of several lines too. A header with other names is an error."""
    rows = spark.read.schema(schema).options(**_SHEET, multiLine="true", enforceSchema="false", emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false").csv(path)
    return rows


def write_results(rows: DataFrame, path: str, by: str | None = None) -> None:
    """JSON results, a folder for each value of ``by``."""
    writer = rows.write.partitionBy(by) if by else rows.write
    writer.json(path)
