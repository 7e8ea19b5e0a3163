"""Checklist extraction: parsing replies, keeping verbatim quotes, merging, coverage, and its scoring."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import collapse, match_tokens, merge_key, normalise_grounding
from plumbline.stored import stored


def reply_object(reply: Column) -> Column:
    """The text from the first ``{`` to the last ``}``; null without them."""
    first, last = F.instr(reply, "{"), F.length(reply) - F.instr(F.reverse(reply), "}") + 1
    return F.when((first > 0) & (F.instr(reply, "}") > 0) & (last >= first), F.substring(reply, first, last - first + 1))


def parse_findings(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``findings`` (map of arrays) and ``checked`` (array); both null where the reply is
    no object, so that a segment counts as incomplete and not as empty."""
    body = F.from_json(reply_object(F.col(reply)), "findings map<string,array<string>>, checked_categories array<string>")
    return replies.withColumn("__b", body).withColumn("findings", F.col("__b.findings")).withColumn("checked", F.col("__b.checked_categories")).drop("__b")


def verbatim(findings: DataFrame, chunk: str, quote: str) -> DataFrame:
    """Quotes that stand in their own chunk as they are."""
    return findings.where(F.instr(F.col(chunk), F.col(quote)) > 0)


def allowed(findings: DataFrame, categories: DataFrame) -> DataFrame:
    """Findings of known categories."""
    return findings.join(categories.select("category").distinct(), "category", "left_semi")


def merge_findings(findings: DataFrame) -> DataFrame:
    """H6: of quotes that differ in white space or case only, the first one of (doc, category) stays."""
    of = Window.partitionBy("doc", "category", merge_key(F.col("quote"))).orderBy("segment", "ord")
    return findings.withColumn("__n", F.row_number().over(of)).where("__n = 1").drop("__n")


def coverage(segments: DataFrame, findings: DataFrame, categories: DataFrame) -> DataFrame:
    """Status of each (doc, category). ``segments``: doc, segment, checked (null if incomplete);
    ``findings``: doc, category. Findings win over incompleteness."""
    totals = segments.groupBy("doc").agg(F.count("*").alias("total"), F.count("checked").alias("completed"))
    ticks = segments.select("doc", "segment", F.explode(F.array_distinct("checked")).alias("category")).groupBy("doc", "category").agg(F.count("*").alias("ticked"))
    found = findings.groupBy("doc", "category").agg(F.count("*").alias("found"))
    rows = totals.join(categories.select("category"), how="cross")  # a row for each pair is the result asked for
    rows = rows.join(ticks, ["doc", "category"], "left").join(found, ["doc", "category"], "left").fillna(0, ["ticked", "found"])
    full = (F.col("total") > 0) & (F.col("completed") == F.col("total")) & (F.col("ticked") == F.col("total"))
    status = F.when(F.col("found") > 0, "risk_found").when(full, "checked_clear").otherwise("incomplete")
    return rows.withColumn("full", full).withColumn("status", status)


def token_match(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Jaccard of C4 tokens reaches the threshold; texts without tokens match nothing."""
    x, y = match_tokens(a), match_tokens(b)
    both = F.size(F.array_intersect(x, y))
    return (F.size(x) > 0) & (F.size(y) > 0) & (both / (F.size(x) + F.size(y) - both) >= threshold)


_TOKEN = re.compile("[a-z0-9]+")


def similar_sides(left: list[str], right: list[str], threshold: float = 0.5) -> tuple[int, int]:
    """F11 as a prefix-filtered join of the lower-cased texts of two sides: how many of either have a similar one on the other side.

    Equal token sets are one. Tokens are put in one order: those of one side only first, then by the number of sets that hold them. Two sets
    that reach the threshold share a token among the first ``size - ceil(threshold * size) + 1`` of either, so only those are compared, if
    their sizes allow it, until a set has been found similar to one.
    """
    sides = [Counter(frozenset(_TOKEN.findall(t)) for t in texts) for texts in (left, right)]
    for side in sides:
        side.pop(frozenset(), None)
    found = [sides[0].keys() & sides[1].keys() for _ in sides]
    if all(sides) and (len(found[0]) < len(sides[0]) or len(found[1]) < len(sides[1])):
        often = [Counter(chain.from_iterable(side)) for side in sides]
        order = sorted(often[0].keys() | often[1].keys(), key=lambda t: (t in often[0] and t in often[1], often[0][t] + often[1][t], t))
        rank = {t: i for i, t in enumerate(order)}
        alone = len(order) - len(often[0].keys() & often[1].keys())

        def prefix(tokens: frozenset) -> list[int]:
            return [r for r in sorted(rank[t] for t in tokens)[: len(tokens) - math.ceil(len(tokens) * threshold) + 1] if r >= alone]

        for own, other in ((0, 1), (1, 0)):
            wanting, index = [x for x in sides[own] if x not in found[own]], {}
            if wanting:
                for y in sides[other]:
                    for r in prefix(y):
                        index.setdefault(r, []).append(y)
            for x in wanting:
                for y in chain.from_iterable(index.get(r, ()) for r in prefix(x)):
                    if len(x) >= len(y) * threshold and len(y) >= len(x) * threshold and (both := len(x & y)) / (len(x) + len(y) - both) >= threshold:
                        found[own].add(x)
                        break
    return tuple(sum(side[x] for x in hits) for side, hits in zip(sides, found, strict=True))


def _similar_sides(left: Column, right: Column) -> Column:
    @F.pandas_udf("p long, g long")
    def run(lefts: pd.Series, rights: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(0, 0) if a is None else similar_sides(a, b) for a, b in zip(lefts, rights, strict=True)], columns=["p", "g"])

    return run(left, right)


def _judged(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """``doc, category, tp, fp, fn``. The texts of both sides of a (doc, category), which is a part of a document, meet in one row by one shuffle;
    where a side is missing they are only counted."""
    rows = predictions.select("doc", "category", F.lit(True).alias("own"), F.lower("quote").alias("t")).union(gold.select("doc", "category", F.lit(False), F.lower("span")))
    held = rows.groupBy("doc", "category").agg(
        F.count_if("own").alias("n_p"), F.count_if(~F.col("own")).alias("n_g"), F.collect_list(F.when(F.col("own"), F.col("t"))).alias("p"), F.collect_list(F.when(~F.col("own"), F.col("t"))).alias("g")
    )
    meet = F.col("doc").isNotNull() & F.col("category").isNotNull() & (F.size("p") > 0) & (F.size("g") > 0)
    hits = held.select("doc", "category", "n_p", "n_g", _similar_sides(F.when(meet, F.col("p")), F.when(meet, F.col("g"))).alias("h"))
    return hits.select("doc", "category", F.col("h.p").alias("tp"), (F.col("n_p") - F.col("h.p")).alias("fp"), (F.col("n_g") - F.col("h.g")).alias("fn"))


def unmatched_gold(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """H8: ``doc, category, n`` of the gold spans that no prediction matches."""
    return _judged(predictions, gold).where("fn > 0").select("doc", "category", F.col("fn").alias("n"))


def match_counts(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """H8: ``category, tp, fp, fn``, many to many: a prediction counts once if any gold span matches it,
    a gold span is missed if no prediction does. ``doc, category, quote`` / ``doc, category, span``.
    Quotes with the same tokens are compared once."""
    return _judged(predictions, gold).groupBy("category").agg(*(F.sum(name).alias(name) for name in ("tp", "fp", "fn")))


def precision_recall(counts: DataFrame) -> DataFrame:
    """H9: adds ``precision, recall, f1``; nothing over nothing is 0."""
    p = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def grounding(predictions: DataFrame, docs: DataFrame) -> DataFrame:
    """Each non-blank quote of a document that there is, with ``grounded``. A text is normalised once and meets
    all quotes of its document together."""
    quotes = predictions.where(F.length(F.trim("quote")) > 0)
    others = [c for c in predictions.columns if c != "doc"]
    held = quotes.groupBy("doc").agg(F.collect_list(F.struct(*others)).alias("__rows"))
    rows = held.join(docs.select("doc", normalise_grounding(F.col("text")).alias("__t")), "doc")
    found = F.transform("__rows", lambda r: F.struct(r.alias("r"), (F.instr(F.col("__t"), normalise_grounding(r["quote"])) > 0).alias("grounded")))
    rows = rows.select("doc", F.explode(found).alias("__f"))
    return rows.select(*(F.col("doc") if c == "doc" else F.col(f"__f.r.{c}").alias(c) for c in predictions.columns), F.col("__f.grounded").alias("grounded"))


def ungrounded(grounded: DataFrame, cap: int = 10) -> DataFrame:
    """The report of the first ``cap`` quotes that are not in their document, the first 80 characters of each."""
    rows = grounded.where("NOT grounded").select("doc", "category", F.substring(collapse(F.col("quote")), 1, 80).alias("head"))
    return rows.orderBy("doc", "category", "head").limit(cap)


def missed_pairs(predictions: DataFrame, gold: DataFrame, cap: int = 20) -> DataFrame:
    """I4: the report of the first ``cap`` (doc, category) with a gold span that no prediction matches."""
    return unmatched_gold(predictions, gold).select("doc", "category").distinct().orderBy("doc", "category").limit(cap)


def severe_precision(predictions: DataFrame, gold: DataFrame, severity: DataFrame, least: int = 4) -> DataFrame:
    """``tp, fp`` over categories of at least that severity, as one row."""
    high = severity.where(F.col("severity") >= least).select("category")
    counts = match_counts(predictions.join(high, "category", "left_semi"), gold.join(high, "category", "left_semi"))
    return counts.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("fp"), F.lit(0)).alias("fp"))


# The bars of the gate.
BARS = {"macro_f1": 0.55, "grounding": 0.95, "severe_precision": 0.70, "probe_gap": 0.05}


def gate(row: DataFrame) -> DataFrame:
    """``criterion, value, passed`` from ``macro_f1, grounded, quotes, tp, fp, probe_gap``; what is not
    measured fails, and the gap is bounded above only."""
    grounded, severe = F.try_divide("grounded", "quotes"), F.try_divide("tp", F.col("tp") + F.col("fp"))
    values = [
        ("macro_f1", F.col("macro_f1"), F.col("macro_f1") >= BARS["macro_f1"]),
        ("grounding", grounded, grounded >= BARS["grounding"]),
        ("severe_precision", severe, severe >= BARS["severe_precision"]),
        ("probe_gap", F.col("probe_gap"), F.col("probe_gap") <= BARS["probe_gap"]),
    ]
    each = F.array(*(F.struct(F.lit(n).alias("criterion"), v.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("passed")) for n, v, ok in values))
    return row.select(F.explode(each).alias("c")).select("c.*")


def winnowed(text: str, least: int) -> np.ndarray:
    """Winnowing: hashes of runs of 3/5 of ``least`` characters, the smallest one of each stretch of ``least`` characters. Texts that share
    such a stretch share its hash; about two of ``2/5 least + 1`` runs are kept."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    width = least * 3 // 5
    count, span = len(points) - width + 1, least - width + 1
    if count < span:
        return np.zeros(0, np.int64)
    hashes = np.zeros(count, np.uint64)
    for j in range(width):
        hashes = hashes * _STEP + points[j : j + count]
    hashes = (hashes ^ (hashes >> np.uint64(31))) * _STEP
    hashes ^= hashes >> np.uint64(29)
    small = hashes[: count - span + 1].copy()
    for j in range(1, span):
        np.minimum(small, hashes[j : j + len(small)], out=small)
    return np.unique(small).view(np.int64)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _fingerprints(text: Column, least: int) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: winnowed(t, least), na_action="ignore")

    return run(text)


def literal_overlap(literals: DataFrame, gold: DataFrame, least: int = 25) -> DataFrame:
    """Files with a string literal of at least that length that holds a gold text or stands in one. The first ``least`` characters
    of the shorter text stand in the longer one, so the one fingerprint of the former is one of the latter's; what meets is compared.
    Fingerprints travel with the number of their text, each distinct text once; their tables are many times what Spark estimates from the
    texts' files, so those joins are merges."""
    files = literals.select("file", merge_key(F.col("literal")).alias("l")).where(F.length("l") >= least)
    a = stored(files.select("l").distinct().withColumn("l_id", F.monotonically_increasing_id()))
    b = stored(gold.select(merge_key(F.col("span")).alias("g")).where(F.length("g") >= least).distinct().withColumn("g_id", F.monotonically_increasing_id()))

    def keyed(rows: DataFrame, text: str, head: bool) -> DataFrame:
        return rows.select(f"{text}_id", F.explode(_fingerprints(F.substring(text, 1, least) if head else F.col(text), least)).alias("k")).hint("merge")

    met = [keyed(a, "l", head).join(keyed(b, "g", not head), "k").select("l_id", "g_id") for head in (False, True)]
    pairs = met[0].union(met[1]).distinct().hint("merge").join(a, "l_id").hint("merge").join(b, "g_id")
    hits = pairs.where((F.instr("l", F.col("g")) > 0) | (F.instr("g", F.col("l")) > 0)).select("l").distinct()
    return files.join(hits.hint("merge"), "l", "left_semi").select("file").distinct()


def over_capacity(literals: DataFrame, per_file: int = 40, least: int = 12) -> DataFrame:
    """Files with more than ``per_file`` string literals of ``least`` characters or more."""
    return literals.where(F.length("literal") >= least).groupBy("file").agg(F.count("*").alias("literals")).where(F.col("literals") > per_file)


def usage_totals(usage: DataFrame) -> DataFrame:
    """Calls and tokens of each backend and model."""
    return usage.groupBy("backend", "model").agg(F.count("*").alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens"))


def token_estimate(text: Column) -> Column:
    """A token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")
