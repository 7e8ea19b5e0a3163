"""Scores of decisions and rankings: confusion, AUC, average precision, paired groups, strata, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import content_tokens
from plumbline.stored import stored


def judged(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """each gold case with its predicted status, ``missing`` where there is none."""
    p = predictions.select(F.col("claim_id").alias("case_id"), F.col("status").alias("actual"))
    return gold.join(p, "case_id", "left").withColumn("actual", F.coalesce("actual", F.lit("missing")))


def confusion(rows: DataFrame) -> DataFrame:
    """``expected, actual, n``."""
    return rows.groupBy(F.col("expected_status").alias("expected"), "actual").agg(F.count("*").alias("n"))


def status_scores(matrix: DataFrame) -> DataFrame:
    """``status, precision, recall, f1, support`` of the expected labels; precision is null where nothing was predicted."""
    support = matrix.groupBy(F.col("expected").alias("status")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("expected") == F.col("actual"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = matrix.groupBy(F.col("actual").alias("status")).agg(F.sum("n").alias("predicted"))
    rows = support.join(predicted, "status", "left").fillna(0, ["predicted"])
    p, r = F.try_divide("tp", "predicted"), F.try_divide("tp", "support")
    return rows.select("status", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def accuracy_by(rows: DataFrame, *by: str) -> DataFrame:
    """``total, correct, accuracy`` of each group."""
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("actual") == F.col("expected_status")).alias("correct"))
    return out.withColumn("accuracy", F.try_divide("correct", "total"))


def binary_scores(rows: DataFrame) -> DataFrame:
    """Accuracy of supported or not, and the recall of either."""
    want, got = F.col("expected_status") == "supported", F.col("actual") == "supported"
    return rows.agg(
        F.avg((want == got).cast("double")).alias("binary_accuracy"), F.avg(F.when(want, got.cast("double"))).alias("supported_recall"),
        F.avg(F.when(~want, (~got).cast("double"))).alias("unsupported_recall"),
    )


def running(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds for each of ``sums`` (new name: column) the sum over all rows up to and with each one in the order. Rows are dealt out by
    ranges of the order, equal leading values too, and stored; a task adds up its own range, to which the sums of the ranges
    before it are added, of which there are as many as shuffle partitions."""
    spark = rows.sparkSession
    dealt = stored(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{name}") for name, c in sums.items()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("__range", *(F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in sums))
    own = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(offsets), "__range")
    return out.withColumns({name: F.sum(c).over(own) + F.col(f"__{name}") for name, c in sums.items()}).drop("__range", *(f"__{name}" for name in sums))


def roc_auc(scored: DataFrame, score: str = "score", relevant: str = "relevant") -> DataFrame:
    """H15 from counts of equal scores: a win for each irrelevant row below, half a win for each equal one."""
    counts = scored.groupBy(score).agg(F.count_if(F.col(relevant)).alias("pos"), F.count_if(~F.col(relevant)).alias("neg"))
    below = running(counts, [F.col(score)], {"upto": "neg"})
    won = below.select(F.col("pos") * (F.col("upto") - F.col("neg") / 2), "pos", "neg").toDF("won", "pos", "neg")
    return won.agg(F.try_divide(F.sum("won"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def average_precision(scored: DataFrame, case: str = "case_id", score: str = "score", relevant: str = "relevant") -> DataFrame:
    """Mean precision at the relevant ranks; score falling, ties by case id, so that a score that many rows share is cut too."""
    rows = scored.select(score, case, F.col(relevant).cast("long").alias("hit"), F.lit(1).cast("long").alias("one"))
    ranked = running(rows, [F.desc(score), F.asc(case)], {"rank": "one", "hits": "hit"})
    return ranked.where("hit = 1").agg(F.avg(F.col("hits") / F.col("rank")).alias("average_precision"))


# The kinds of case of a group.
RELEVANT_KINDS = ["verbatim_supported", "paraphrase_supported", "contradicted"]
IRRELEVANT_KIND = "present_irrelevant"


def paired_ranking(scored: DataFrame) -> DataFrame:
    """Groups, those with all relevant kinds above the irrelevant one, and each kind's win rate.
    ``group_id, kind, score``; groups that lack a kind count as ``incomplete``."""
    wide = scored.groupBy("group_id").pivot("kind", [*RELEVANT_KINDS, IRRELEVANT_KIND]).agg(F.max("score"))
    whole = F.lit(True)
    for k in [*RELEVANT_KINDS, IRRELEVANT_KIND]:
        whole = whole & F.col(k).isNotNull()
    won = {k: F.when(F.col(k) > F.col(IRRELEVANT_KIND), 1.0).when(F.col(k) == F.col(IRRELEVANT_KIND), 0.5).otherwise(0.0) for k in RELEVANT_KINDS}
    above = whole
    for k in RELEVANT_KINDS:
        above = above & (won[k] == 1.0)
    return wide.agg(
        F.count_if(whole).alias("groups"), F.count_if(~whole).alias("incomplete"), F.count_if(above).alias("all_above"),
        *(F.avg(F.when(whole, won[k])).alias(f"win_{k}") for k in RELEVANT_KINDS),
    )


def medians(scored: DataFrame, stratum: str, score: str) -> DataFrame:
    """``stratum, median`` by exact selection. Equal scores of a stratum are one row with their number; running sums over the
    order of (stratum, score) say which ranks a row holds, and the one or two rows that hold a stratum's middle ranks are kept. Ranges of the
    order are by score too, so no task holds a stratum. Strata without a score have no row."""
    counts = scored.where(F.col(score).isNotNull()).groupBy(F.col(stratum).alias("s"), F.col(score).alias("x")).agg(F.count("*").alias("c"))
    ranked = stored(running(counts, [F.col("s"), F.col("x")], {"upto": "c"}))
    ends = ranked.groupBy(F.col("s").alias("of")).agg(F.min(F.col("upto") - F.col("c")).alias("low"), F.max("upto").alias("high"))
    rows = ranked.join(ends, F.col("s").eqNullSafe(F.col("of")))
    last, size = F.col("upto") - F.col("low"), F.col("high") - F.col("low")
    first = last - F.col("c") + 1
    middle = [F.when(at.between(first, last), F.col("x")) for at in (F.floor((size + 1) / 2), F.floor(size / 2) + 1)]
    rows = rows.select(F.col("s").alias(stratum), middle[0].alias("a"), middle[1].alias("b")).where("a is not null or b is not null")
    return rows.groupBy(stratum).agg(((F.max("a") + F.max("b")) / 2).alias("median"))


def stratum_summary(scored: DataFrame, stratum: str = "stratum", score: str = "score") -> DataFrame:
    """Count, least, interpolated median, mean, greatest."""
    whole = scored.groupBy(stratum).agg(F.count("*").alias("n"), F.min(score).alias("least"), F.avg(score).alias("mean"), F.max(score).alias("greatest"))
    middle = medians(scored, stratum, score).withColumnRenamed(stratum, "__of")
    return whole.join(middle, F.col(stratum).eqNullSafe(F.col("__of")), "left").select(stratum, "n", "least", "median", "mean", "greatest")


def admission(baseline: DataFrame, candidate: DataFrame, by: str, metric: str, minimum: float) -> DataFrame:
    """One row: improvement (12 digits), kinds that regressed, and whether the candidate passes.
    Both inputs are single-metric tables ``by, metric, total, correct``; a run is complete if nothing is missing."""
    b = baseline.select(by, F.col(metric).alias("b"), F.col("total").alias("b_total"), F.col("correct").alias("b_correct"))
    c = candidate.select(by, F.col(metric).alias("c"), F.col("total").alias("c_total"), F.col("correct").alias("c_correct"))
    both = b.join(c, by, "full")
    overall = both.agg(
        F.round(F.sum("c_correct") / F.sum("c_total") - F.sum("b_correct") / F.sum("b_total"), 12).alias("improvement"),
        F.array_sort(F.collect_list(F.when(F.coalesce(F.col("c") < F.col("b"), F.lit(True)), F.col(by)))).alias("regressed"),
    )
    return overall.withColumn("passed", (F.col("improvement") >= minimum) & (F.size("regressed") == 0))


def group_shapes(cases: DataFrame) -> DataFrame:
    """Groups that do not have each kind once and one origin."""
    kinds = F.array_sort(F.collect_list("kind"))
    want = F.array(*map(F.lit, sorted([*RELEVANT_KINDS, IRRELEVANT_KIND])))
    return cases.groupBy("group_id").agg(kinds.alias("kinds"), F.count_distinct("source_id", "original_start", "original_end").alias("origins")).where((F.col("kinds") != want) | (F.col("origins") != 1))


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that are not unique."""
    return rows.groupBy(*keys).count().where("count > 1")


def query_token_recall(question: Column, evidence: Column) -> Column:
    """The lexical relevance scorer: the share of a question's content words that the evidence has; 0 without any."""
    return token_recall(content_tokens(question), content_tokens(evidence))


def token_recall(wanted: Column, held: Column) -> Column:
    """G34 on token arrays."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(wanted, held)), F.size(wanted)), F.lit(0.0))


def revalidated(runs: DataFrame, gold: DataFrame, predictions: DataFrame, contexts: DataFrame) -> DataFrame:
    """``run_id, problem`` of recorded runs that do not hold: a repeated or malformed context, a prediction whose source hash is not its context's,
    contexts and gold of different cases, a score or a completeness that the recorded rows do not give.

    ``runs``: run_id, accuracy, complete; ``gold``: run_id, case_id, expected_status; ``predictions``: run_id, claim_id, status, source_sha256;
    ``contexts``: run_id, case_id, sha256, characters.
    """
    digest = F.col("sha256").rlike("^[0-9a-f]{64}$")
    repeated = contexts.groupBy("run_id", "case_id").count().where("count > 1").select("run_id", F.lit("repeated_context").alias("problem"))
    malformed = contexts.where(~F.coalesce(digest & (F.col("characters") >= 1) & (F.length(F.trim("case_id")) > 0), F.lit(False))).select("run_id", F.lit("malformed_context").alias("problem"))
    c = contexts.select("run_id", "case_id", F.col("sha256").alias("context_sha256")).distinct()
    moved = predictions.withColumnRenamed("claim_id", "case_id").join(c, ["run_id", "case_id"], "left").where("NOT (source_sha256 <=> context_sha256)").select("run_id", F.lit("other_source").alias("problem"))
    sides = gold.select("run_id", "case_id", F.lit(1).alias("g")).distinct().join(c.select("run_id", "case_id", F.lit(1).alias("c")), ["run_id", "case_id"], "full")
    apart = sides.where("g is null OR c is null").select("run_id", F.lit("other_cases").alias("problem"))
    judged_ = gold.join(predictions.select("run_id", F.col("claim_id").alias("case_id"), F.col("status").alias("actual")), ["run_id", "case_id"], "full")
    correct = F.coalesce(F.col("expected_status") == F.col("actual"), F.lit(False))
    known = F.coalesce(F.col("actual").isin("supported", "contradicted", "insufficient") & F.col("expected_status").isNotNull(), F.lit(False))
    found = judged_.groupBy("run_id").agg((F.count_if(correct) / F.count("expected_status")).alias("again"), F.bool_and(known).alias("whole"))
    both = runs.join(found, "run_id", "left")
    score = both.where("NOT (round(accuracy, 9) <=> round(again, 9))").select("run_id", F.lit("other_score").alias("problem"))
    complete = both.where("NOT (complete <=> whole)").select("run_id", F.lit("other_completeness").alias("problem"))
    out = repeated
    for more in (malformed, moved, apart, score, complete):
        out = out.unionByName(more)
    return out.distinct()


def compared_runs(rows: DataFrame) -> DataFrame:
    """One row for each run of ``rows`` (run_id, case_id, kind, expected_status, actual): three-way and binary accuracy, and the recalls. Runs over other cases than
    the first run are an error."""
    cases = rows.select("run_id", F.xxhash64("case_id", "kind", "expected_status").cast("decimal(38,0)").alias("h")).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("h").alias("sum"))
    one = cases.agg(F.count_distinct("n", "sum").alias("sets"))
    want, got = F.col("expected_status") == "supported", F.coalesce(F.col("actual") == "supported", F.lit(False))
    scores = rows.groupBy("run_id").agg(
        F.count("*").alias("cases"), F.avg(F.coalesce(F.col("expected_status") == F.col("actual"), F.lit(False)).cast("double")).alias("three_way_accuracy"), F.avg((want == got).cast("double")).alias("binary_accuracy"),
        F.avg(F.when(want, got.cast("double"))).alias("supported_recall"), F.avg(F.when(~want, (~got).cast("double"))).alias("unsupported_recall"),
    )
    same = F.when(F.col("sets") > 1, F.raise_error(F.lit("runs use different cases")).cast("boolean")).otherwise(True)
    return scores.crossJoin(F.broadcast(one)).where(same).drop("sets")  # one row
