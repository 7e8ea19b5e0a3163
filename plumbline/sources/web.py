"""Pages as a source that Spark scans: requests in, what came back out.

``write_requests`` deals references out into files of a bounded number of requests, those of one host in as few files as that allows.
The source lists the files' names only; each is a partition, whose task opens its uris one after the other. So a task
that is lost repeats its own requests alone, and no host is asked by more tasks at once than its requests fill files. Filters
on ``uri`` (equal, in) reach the scan: other requests are not made.
"""

from __future__ import annotations

import importlib
import re
import socket
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from plumbline.operators.decisions import http_failure
from plumbline.sources.readers import html_to_text

SCHEMA = "uri string, status int, media_type string, body string, error string"
PER_FILE = 500
PAGES = ("text/html", "application/xhtml+xml")

Answer = tuple[int | None, str | None, bytes]


def open_url(uri: str, timeout: float) -> Answer:
    """Status, media type and bytes of what a server answers; a PDF is not read."""
    request = urllib.request.Request(uri, headers={"User-Agent": "source-check/1", "Accept": "text/html,text/plain,*/*;q=0.1"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            kind = answer.headers.get_content_type()
            return answer.status, kind, b"" if kind == "application/pdf" else answer.read()
    except urllib.error.HTTPError as refused:
        return refused.code, None, b""


def named(path: str) -> Callable[[str, float], Answer]:
    """The function that ``module:name`` names."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path) if ":" in path else f"file://{path}")


class Requests(InputPartition):
    def __init__(self, file: str):
        self.file = file


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.opener, self.timeout = options["path"], options.get("opener", f"{__name__}:open_url"), float(options.get("timeout", 20))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("uri",):
                uris = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = uris if self.wanted is None else self.wanted & uris
            else:
                yield f

    def partitions(self) -> list[Requests]:
        store, folder = _store(self.path)
        found = store.get_file_info(pyarrow.fs.FileSelector(folder))
        return [Requests(x.path) for x in sorted(found, key=lambda x: x.path) if x.base_name.endswith(".parquet")]

    def read(self, partition: Requests) -> Iterator[tuple]:
        ask, (store, _) = named(self.opener), _store(self.path)
        with store.open_input_file(partition.file) as file:
            for batch in pyarrow.parquet.ParquetFile(file).iter_batches(columns=["uri"]):
                for uri in batch.column("uri").to_pylist():
                    if self.wanted is None or uri in self.wanted:
                        yield uri, *self.answered(ask, uri)

    def answered(self, ask: Callable[[str, float], Answer], uri: str) -> tuple:
        try:
            status, kind, raw = ask(uri, self.timeout)
        except (OSError, ValueError, socket.timeout) as failed:  # one source's failure is that row's outcome
            return None, None, None, type(failed).__name__
        return status, kind, raw.decode("utf-8", errors="replace"), None


class Pages(DataSource):
    """``spark.read.format("requested_pages").option("opener", "module:function").load(folder of requests)``"""

    @classmethod
    def name(cls) -> str:
        return "requested_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def write_requests(references: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """The distinct uris of ``references`` as files of about ``per_file`` requests. A host with more is dealt into as many chunks as it fills."""
    rows = references.select("uri").where("uri is not null").distinct().withColumn("host", F.lower(F.regexp_extract("uri", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)))
    sizes = rows.groupBy("host").agg(F.ceil(F.count("*") / per_file).alias("chunks"))
    files = max(1, -(-rows.count() // per_file))
    rows = rows.join(sizes, "host").withColumn("chunk", F.pmod(F.xxhash64("uri"), F.col("chunks")))
    rows.repartition(files, "host", "chunk").sortWithinPartitions("host", "uri").select("uri").write.option("maxRecordsPerFile", 2 * per_file).parquet(path)


def read_pages(spark: SparkSession, path: str, opener: str | None = None, timeout: float = 20) -> DataFrame:
    """``uri, status, media_type, body, error`` of each request of a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)
    reader = spark.read.format("requested_pages").option("timeout", str(timeout))
    return (reader.option("opener", opener) if opener else reader).load(path)


def resolved(pages: DataFrame) -> DataFrame:
    """A2: ``uri, status, media_type, text, failure``: a page's text, a text as it is, or what the fetch failed of."""
    rows = pages.withColumn("failure", http_failure(F.col("status"), F.coalesce("media_type", F.lit(""))))
    kept = F.when(F.col("failure").isNull(), F.col("body"))
    html = F.col("media_type").isin(*PAGES)
    text = F.when(html, html_to_text(F.when(html, kept))).otherwise(kept)
    return rows.select("uri", "status", "media_type", text.alias("text"), "failure")
