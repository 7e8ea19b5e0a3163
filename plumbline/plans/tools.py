"""Small helpers of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Plans:
    """Queries by name, and their SQL."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return register


def norm_sql(x: str) -> str:
    """The C1 normaliser in DuckDB's SQL, for texts whose only expanding letter is the German sharp s."""
    quotes = "translate(replace(lower(" + x + "), 'ß', 'ss'), '‘’‛“”–—', '\'\'\'\'\'\'\"\"--')"
    kept = f"regexp_replace({quotes}, '[^\\pL\\pN_$%£€.,\'\'\"-]+', ' ', 'g')"
    return f"trim(regexp_replace(replace({kept}, '_', ' '), ' +', ' ', 'g'))"


def space_sql(x: str) -> str:
    """White space collapsed, in DuckDB's SQL."""
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def entities_sql(x: str) -> str:
    """Decodes the entities of the pages, with or without their semicolon, in DuckDB's SQL."""
    for name, sign in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("#39", "''"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{sign}', 'g')"
    return x


def ascii_json_sql(x: str) -> str:
    """A text as a JSON string of ASCII characters, in DuckDB's SQL."""
    pair = "'\\u' || to_hex(55296 + (unicode(c) - 65536) // 1024) || '\\u' || to_hex(56320 + (unicode(c) - 65536) % 1024)"
    sign = f"CASE WHEN unicode(c) < 127 THEN c WHEN unicode(c) < 65536 THEN '\\u' || lower(lpad(to_hex(unicode(c)), 4, '0')) ELSE lower({pair}) END"
    return f"array_to_string(list_transform(string_split(to_json({x})::VARCHAR, ''), lambda c: {sign}), '')"
