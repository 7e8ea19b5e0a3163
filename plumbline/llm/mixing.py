"""Mixing sources to target weights by Poisson replication (operator 10).

A source's mean repetition rate is its target share of the output over its share of the input.
Each document gets a number u in [0, 1) from a hash of the seed and its doc_id, and as many
copies as the inverse of the Poisson distribution with that mean has at u. Above a mean of ``MAX_DRAW``,
where exp(-mean) nears the end of doubles, the number is a sum of draws with equal smaller means, each from a
hash of its own; a sum of independent Poisson numbers is one with the summed mean. The copies are
put in a global order by a second hash: the partition comes from the leading bits of the key
(no sampling pass), rows are sorted within it. Everything runs in the JVM.

Rates have no bound: a source of one row in a large table has a high one. A row with more than ``SPREAD`` copies is
first cut into runs of that many, which are dealt out, so that no task makes all copies of such a row.

The table of rates has a row for each source. It is broadcast only up to ``MAX_BROADCAST``
sources; beyond that it is joined by shuffle, where adaptive execution splits hot sources.

Defined results: a null source is a source of its own; a null doc_id hashes as the empty text;
repeated rows get equal numbers of copies; a source that the weights leave out has the weight ``other``, with weight zero it has no
copies; an empty table gives no rows; all other columns are carried along. Where the input has a column
``copy`` or ``shuffle_key`` of its own, the added one has an underscore more at its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, prepare, table

MAX_BROADCAST = 10_000
DRAW = 500.0
MAX_DRAW = 700.0
SPREAD = 4096
SEED = "mix-1"

#: The target mix of the query: shares of the sources before they are scaled, 1 for every other source.
WEIGHTS = {"src0": 4.0, "src1": 0.25, "src2": 2.5, "src3": 0.5, "src4": 12.0}
OTHER = 1.0


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... as an array, far enough that the rest is below 2**-53."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    p0 = F.exp(-rate)
    first = F.struct(F.array(p0).alias("cdf"), p0.alias("p"), p0.alias("c"))

    def step(acc, k):
        p = acc["p"] * rate / k
        return F.struct(F.concat(acc["cdf"], F.array(acc["c"] + p)).alias("cdf"), p.alias("p"), (acc["c"] + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), first, step, lambda acc: acc["cdf"])


def rates(docs: DataFrame, weights: dict | None = None, epochs: float = 1.0, other: float = 0.0) -> DataFrame:
    """``source, rate`` of each source; ``weights`` None means equal weights, else the sources'
    shares (scaled to add up to one over the sources that there are), ``other`` for those that are left out. The output has about
    ``epochs`` times as many rows as the input."""
    sizes = cut(docs.groupBy("source").agg(F.count("*").alias("size")).coalesce(8))  # a row for each source
    if weights is None:
        weight = F.lit(1.0)
    else:
        given = sorted((str(k), float(v)) for k, v in weights.items())
        weight = F.coalesce(F.create_map(*[F.lit(x) for pair in given for x in pair])[F.col("source")] if given else F.lit(None), F.lit(float(other)))
    sizes = sizes.withColumn("weight", weight)
    rows, weight_sum = sizes.agg(F.sum("size"), F.sum("weight")).first()
    if not weight_sum:
        return sizes.select("source", F.lit(0.0).alias("rate"))
    return sizes.select("source", (F.col("weight") / weight_sum * (rows * epochs) / F.col("size")).alias("rate"))


def _uniform(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: dict | None = None, epochs: float = 1.0, seed: str = SEED, partitions: int | None = None, other: float = 0.0) -> DataFrame:
    """The copies in their global order: the columns of ``docs``, then ``copy`` (from 1) and
    ``shuffle_key`` (16 hex digits; a partition's keys follow those of the one before)."""
    spark = docs.sparkSession
    prepare(spark)
    taken = {c.lower() for c in docs.columns}
    copy, key = (next(n for n in (name + "_" * i for i in range(len(taken) + 1)) if n not in taken) for name in ("copy", "shuffle_key"))
    table_ = cut(rates(docs, weights, epochs, other).where("rate > 0"))
    highest, count = table_.agg(F.max("rate"), F.count("*")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def counted(of: DataFrame) -> DataFrame:
        rate = F.col("rate")
        draws = F.when(rate <= MAX_DRAW, 1).otherwise(F.ceil(rate / DRAW)).cast("int")
        of = of.select(F.col("source").alias("__plumbline_source"), draws.alias("__plumbline_draws"), poisson_cdf(rate / draws).alias("__plumbline_cdf"))
        if count <= MAX_BROADCAST:
            of = F.broadcast(of)
        ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
        at = lambda u: F.size(F.filter("__plumbline_cdf", lambda c: c <= u))
        more = F.aggregate(
            F.sequence(F.lit(1), F.col("__plumbline_draws")),
            F.lit(0),
            lambda n, k: n + at(_uniform(F.concat(F.lit(seed + ":"), ident, F.lit(":draw:"), k.cast("string")))),
        )
        copies = F.when(F.col("__plumbline_draws") == 1, at(F.col("__plumbline_u"))).otherwise(more)
        rows = docs.join(of, docs["source"].eqNullSafe(F.col("__plumbline_source"))).withColumn("__plumbline_u", _uniform(F.concat(F.lit(seed + ":"), ident)))
        return rows.withColumn("__plumbline_n", copies).where("__plumbline_n > 0").drop("__plumbline_u", "__plumbline_cdf", "__plumbline_draws", "__plumbline_source")

    own = [F.col(f"`{c}`") for c in docs.columns]
    often = SPREAD / 2  # no row of a source with at most this rate has more than SPREAD copies
    rows = counted(table_.where(F.col("rate") <= often)).select(*own, F.explode(F.sequence(F.lit(1), F.col("__plumbline_n"))).alias(copy))
    if count and highest > often:
        runs = counted(table_.where(F.col("rate") > often))
        runs = runs.withColumn("__plumbline_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("__plumbline_n") - 1) / SPREAD).cast("int"))))
        runs = runs.repartition(parts, F.col("__plumbline_run"), F.col("doc_id"))
        first = F.col("__plumbline_run") * SPREAD
        rows = rows.union(runs.select(*own, F.explode(F.sequence(first + 1, F.least(first + SPREAD, F.col("__plumbline_n")))).alias(copy)))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.withColumn(key, F.substring(F.md5(F.concat(F.lit(seed + ":"), ident, F.lit(":"), F.col(copy).cast("string"))), 1, 16))
    n = partitions or parts
    lead = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return rows.repartitionById(n, F.shiftright(lead * n, 32).cast("int")).sortWithinPartitions(key, "doc_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, other=OTHER)


_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + f" ELSE {OTHER}::DOUBLE END"

OP10_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS size, {_WEIGHT} AS weight FROM documents GROUP BY source),
rates AS (
  SELECT source, rate, CASE WHEN rate <= {MAX_DRAW} THEN 1 ELSE ceil(rate / {DRAW})::INTEGER END AS draws
  FROM (SELECT source, weight / (sum(weight) OVER ()) * (sum(size) OVER ())::DOUBLE / size AS rate FROM sizes) WHERE rate > 0
), cdf AS (
  SELECT source, draws, rate / draws AS rate, 0 AS k, exp(-rate / draws) AS p, exp(-rate / draws) AS c FROM rates
  UNION ALL
  SELECT source, draws, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
  WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), numbered AS MATERIALIZED (SELECT *, row_number() OVER () AS plumbline_row FROM documents),
cuts AS (SELECT source, any_value(draws) AS draws, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
drawn AS (SELECT d.*, cdf, unnest(CASE WHEN draws = 1 THEN [''] ELSE list_transform(range(1, draws + 1), lambda k: ':draw:' || k) END) AS draw
  FROM numbered d JOIN cuts ON d.source IS NOT DISTINCT FROM cuts.source),
counted AS (
  SELECT plumbline_row, sum(len(list_filter(cdf, lambda x: x <= ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || draw), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)))::BIGINT AS n
  FROM drawn GROUP BY plumbline_row
), copies AS (
  SELECT d.* EXCLUDE (plumbline_row), unnest(range(1, n + 1))::INTEGER AS copy
  FROM numbered d JOIN counted USING (plumbline_row)
)
SELECT *, substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 16) AS shuffle_key FROM copies
"""
