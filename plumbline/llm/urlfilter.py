"""URL rules by a sort-merge range join with a stack of nested rules (operator 3).

A host's labels in reverse order, each ended by a dot, are its key: the hosts below a rule's
host are then one interval of keys. Pages are sorted by key within their partitions; rules are
sorted by the start of their interval. One sweep over both keeps the intervals that hold the present
key on a stack (intervals nest or are apart). Of the rules on the stack whose path begins the
page's path, the longest (host and path together, then the longer host) decides.

Pages need no exchange: every partition sweeps its own rows, so a host with a third of all pages
stays spread as it is stored. A pass takes at most ``MAX_RULES`` rules along; longer lists are swept in
several passes that keep the longest match so far.

Defined results: a null url and one without ``://`` have an empty host and path; where no rule
fits, ``rule`` is null and ``verdict`` the default; repeated rows are judged each on their own;
an empty table gives no rows; without rules all pages get the default; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import prepare, table

MAX_RULES = 100_000
DEFAULT = "allow"

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


#: The rules that the query applies.
RULES = [
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
]


def key_of(host: str) -> str:
    """``blog.example.net`` -> ``net.example.blog.``"""
    return "".join(f"{label}." for label in reversed(host.split(".")))


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _AZ, _az)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _sweep(rules: list[Rule]):
    """Rows sorted by key; one pass over rows and rules."""
    starts = sorted(((key_of(r.host), r) for r in rules), key=lambda x: (x[0], x[1].path))

    def run(batches):
        at, stack = 0, []
        last, active = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "path", "rule", "verdict", "width", "host_width")]
            found = []
            for key, path, rule, verdict, width, host_width in zip(*columns, strict=True):
                if key != last:
                    while at < len(starts) and starts[at][0] <= key:
                        while stack and not starts[at][0].startswith(stack[-1][0]):
                            stack.pop()
                        stack.append(starts[at])
                        at += 1
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                    last, active = key, [r for _, r in stack]
                best = (width, host_width)
                for r in active:
                    if path.startswith(r.path) and (size := (len(r.host) + len(r.path), len(r.host))) > best:
                        best, rule, verdict = size, r.host + r.path, r.verdict
                found.append((rule, verdict, *best))
            new = list(zip(*found, strict=True)) if found else [[], [], [], []]
            out = [batch.column(c) for c in ("page_id", "host", "path", "key")]
            yield pa.record_batch(
                [*out, pa.array(new[0], pa.string()), pa.array(new[1], pa.string()), pa.array(new[2], pa.int32()), pa.array(new[3], pa.int32())],
                names=["page_id", "host", "path", "key", "rule", "verdict", "width", "host_width"],
            )

    return run


def judge(pages: DataFrame, rules: Iterable[Rule], default: str = DEFAULT, max_rules: int = MAX_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of each row of ``pages(page_id, url)``."""
    prepare(pages.sparkSession)
    rules = list(rules)
    if any(r.host != r.host.translate(str.maketrans(_AZ, _az)) for r in rules):
        raise ValueError("rule hosts are lower case")
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("__url"))
    host, path = parts(F.col("__url"))
    key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit("."))
    rows = (
        urls.select("page_id", host.alias("host"), path.alias("path"))
        .select("page_id", "host", "path", key.alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(-1).alias("width"), F.lit(-1).alias("host_width"))
        .sortWithinPartitions("key")
    )
    schema = "page_id long, host string, path string, key string, rule string, verdict string, width int, host_width int"
    for i in range(0, len(rules), max_rules):
        # a pass keeps the order of its rows, so the next one needs no sort
        rows = rows.mapInArrow(_sweep(rules[i : i + max_rules]), schema)
    return rows.select("page_id", "host", "path", "rule", "verdict")


def op3_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


OP3_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM rest
), rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict
FROM parts LEFT JOIN rules
  ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rhost) + length(rpath) DESC NULLS LAST, length(rhost) DESC) = 1
"""
