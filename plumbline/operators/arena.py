"""Adversarial review: sentence streams, task emission with context, and adjudication."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import collapse, emission_key, sentences_of_line
from plumbline.operators.decisions import first_match
from plumbline.sources.pages import page_lines
from plumbline.stored import stored

SECTION = "\x1e"

# The default profile's patterns and limits.
INFERENTIAL = [
    r"\btherefore\b",
    r"\b(?:thus|hence)\b",
    r"\bthis (?:means|implies|suggests|indicates)\b",
    r"\b(?:suggests?|implies?|likely|unlikely|probably)\b",
    r"\bwe (?:believe|assess|estimate|expect|conclude)\b",
    r"\b(?:positioned|poised|on track) to\b",
    r"\b(?:appears?|seems?) (?:to|that)\b",
    r"\bdepends? (?:entirely|heavily|largely) on\b",
]
DERIVED = [
    r"\breconstruct\w*\b",
    r"\bbottom[-\s]?up estimate\w*\b",
    r"\bextrapolat\w*\b",
    r"\bannuali[sz]\w*\b",
    r"\brun[-\s]?rate\b",
    r"\bimplied (?:actual )?(?:revenue|cost|margin|rate|throughput|capacity|valuation|value|multiple)\b",
    r"\b(?:needs?|requires?)\s+(?:(?:a|an)\s+)?~?\d+(?:\.\d+)?\s?[x×](?=\s|$|[.,;:])",
]
ABSENCE = [
    r"\b(?:with\s+)?no\s+(?:(?:named|identified|documented)\s+)?(?:successor|record|filing|award|contract|plan|financials?|audit\w*|registration|disclosure|renewal)\b",
    r"\bno\s+(?:[\w-]+\s+){1,3}(?:on record|on file|filed|disclosed|found|identified|recorded)\b",
    r"\bnot (?:found|listed|disclosed|recorded) (?:in|on|at)\b",
    r"\bnothing (?:on record|filed|disclosed)\b",
]
META = r"^(prepared (?:by|for)\b|data cutoff|confidential\b|©|page \d)|\bthis (?:report|document|section|page) (?:will|suggests)\b"


@dataclass(frozen=True)
class Profile:
    """What is a task, as data."""

    inferential: list[str] = field(default_factory=lambda: INFERENTIAL)
    derived: list[str] = field(default_factory=lambda: DERIVED)
    absence: list[str] = field(default_factory=lambda: ABSENCE)
    least: int = 30
    most: int = 500
    context_sentences: int = 14
    context_characters: int = 2400


def plain_lines(text: Column, html: bool) -> Column:
    """Markup to lines; a heading, section or slide starts a line with the section mark."""
    if html:
        return _page_lines(text)
    # A heading, a link, the marks that are dropped.
    for pattern, value in ((r"(?m)^#{1,6}\s+", SECTION), (r'\[([^\]]+)\]\((?:https?://[^\s)"]+)(?:\s+"[^"]*")?\)', "$1"), (r"[*_`>|]", " ")):
        text = F.regexp_replace(text, pattern, value)
    return F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1d\x{85}\x{2028}\x{2029}]")


def _page_lines(html: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: page_lines(page, SECTION))

    return run(html)


def sentences(docs: DataFrame, html: bool = False, key: str = "doc") -> DataFrame:
    """``key, section, ordinal, text``. Sections count headings so far, ordinals sentences from 1."""
    lines = docs.select(key, F.posexplode(plain_lines(F.col("text"), html)).alias("line", "raw"))
    # the costly white-space rules come behind the exchange, where a document's lines are spread
    lines = lines.withColumn("head", F.ltrim("raw").startswith(SECTION).cast("int"))
    section = F.sum("head").over(Window.partitionBy(key).orderBy("line"))
    lines = lines.withColumn("section", section).withColumn("raw", collapse(F.replace("raw", F.lit(SECTION), F.lit(" ")))).where(F.length("raw") > 0)
    parts = lines.select(key, "section", "line", F.posexplode(sentences_of_line(F.col("raw"))).alias("part", "text"))
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("line", "part"))
    return parts.withColumn("ordinal", ordinal).select(key, "section", "ordinal", "text")


def trigger(text: Column, profile: Profile) -> Column:
    """E5: absence before derived before inferential."""
    def any_of(patterns):
        return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else None

    rules = [(any_of(p), name) for name, p in (("absence", profile.absence), ("derived", profile.derived), ("inferential", profile.inferential))]
    return first_match([(c, n) for c, n in rules if c is not None])


class Ladder:
    """The least length of each stretch of 1, 2, 4, ... lengths. ``ahead(at, room)`` is the first place from ``at`` on whose length fits,
    found in as many steps as there are stretches of different sizes; the number of lengths if none fits."""

    def __init__(self, lengths: np.ndarray):
        self.size, self.least = len(lengths), [lengths]
        while 2 << len(self.least) - 1 <= self.size:
            step = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-step], self.least[-1][step:]))

    def ahead(self, at: int, room: int) -> int:
        for k in range(len(self.least) - 1, -1, -1):
            if at + (1 << k) <= self.size and self.least[k][at] > room:
                at += 1 << k
        return at


def nearest_that_fit(lengths: np.ndarray, targets: list[int], most: int, room: int) -> list[list[int]]:
    """For each target the places nearest to it, the left one of two equally near, whose lengths fit one after the other into what room is left.
    Room only shrinks, so a place that was passed over never fits later."""
    right, left, end, out = Ladder(lengths), Ladder(lengths[::-1]), len(lengths), []
    for target in targets:
        taken, rest, before, after = [], room, target - 1, target + 1
        while len(taken) < most:
            before, after = end - 1 - left.ahead(end - 1 - before, rest), right.ahead(after, rest)
            if before < 0 and after >= end:
                break
            if before >= 0 and (after >= end or target - before <= after - target):
                place, before = before, before - 1
            else:
                place, after = after, after + 1
            taken.append(place)
            rest -= int(lengths[place])
        out.append(sorted(taken))
    return out


def contexts(stream: DataFrame, targets: DataFrame, profile: Profile, key: str = "doc") -> DataFrame:
    """The nearest sentences of a target's section (by distance, then place), skipping those that
    would pass the characters, joined in text order. ``targets``: key, section, ordinal.

    A section's sentences stand in one array and its targets in another, so neither is copied for the other; only lengths and places
    go to Python, where each sentence that is taken costs two lookups in a table of least lengths.
    """

    @F.pandas_udf("array<array<int>>")
    def places(lengths: pd.Series, asked: pd.Series) -> pd.Series:
        found = [nearest_that_fit(np.asarray(n, np.int64), list(a), profile.context_sentences, profile.context_characters) for n, a in zip(lengths, asked, strict=True)]
        return pd.Series(found, dtype=object)

    whole = stream.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("own"))
    asked = targets.groupBy(key, "section").agg(F.collect_list("ordinal").alias("asked"))
    first = F.get("own", F.lit(0))["ordinal"]
    rows = whole.join(asked, [key, "section"]).withColumn("places", places(F.transform("own", lambda r: F.length(r["text"])), F.transform("asked", lambda t: t - first)))
    text = lambda z: F.array_join(F.transform(z["places"], lambda i: F.get("own", i)["text"]), " ")
    found = F.transform(F.arrays_zip("asked", "places"), lambda z: F.struct(z["asked"].alias("ordinal"), text(z).alias("context")))
    joined = rows.select(key, F.explode(found).alias("c")).select(key, "c.ordinal", "c.context")
    return targets.join(joined, [key, "ordinal"], "left").withColumn("context", F.coalesce("context", F.lit("")))


def emit_tasks(docs: DataFrame, profile: Profile, html: bool = False, key: str = "doc") -> DataFrame:
    """``key, task_id, assertion, context, location, trigger, section`` of each triggered sentence, the
    first of those with one C6 key, numbered in text order."""
    stream = stored(sentences(docs, html, key))
    rows = stream.where(F.length("text").between(profile.least, profile.most) & ~F.col("text").rlike(f"(?i){META}"))
    rows = rows.withColumn("trigger", trigger(F.col("text"), profile)).where("trigger is not null")
    first = Window.partitionBy(key, emission_key(F.col("text"))).orderBy("ordinal")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    rows = stored(rows.withColumn("task_id", F.concat(F.lit("x"), F.row_number().over(Window.partitionBy(key).orderBy("ordinal")).cast("string"))))
    with_context = contexts(stream, rows.select(key, "section", "ordinal"), profile, key).drop("section")
    location = F.format_string("sentence %d, section %d", "ordinal", "section")
    return rows.join(with_context, [key, "ordinal"]).select(key, "task_id", F.col("text").alias("assertion"), "context", location.alias("location"), "trigger", "section")


def consensus(rulings: DataFrame, required: int) -> DataFrame:
    """``task_id, lens, consensus``: the common ruling of exactly so many rulings by as many families
    and sessions, else ``incomplete`` or ``disagrees``."""
    whole = (F.count("*") == required) & (F.count_distinct("model_family") == required) & (F.count_distinct("session_id") == required)
    value = F.when(~whole, "incomplete").when(F.count_distinct("ruling") > 1, "disagrees").otherwise(F.min("ruling"))
    return rulings.groupBy("task_id", "lens").agg(value.alias("consensus"))


def self_rulings(attacks: DataFrame, rulings: DataFrame) -> DataFrame:
    """rulings on no attack, on a null attack, or by the attack's own session."""
    a = attacks.select("task_id", "lens", "attack", F.col("session_id").alias("a_session"))
    return rulings.join(a, ["task_id", "lens"], "left").where("attack is null OR session_id = a_session").select(rulings.columns)


def adjudicate(tasks: DataFrame, attacks: DataFrame, rulings: DataFrame, lenses: list[str], required: int) -> DataFrame:
    """``task_id, attacks, verdict``. A ruling on no attack, on a null one, or by the attack's own session
    stops the adjudication."""
    a = attacks.select("task_id", "lens", "attack", F.col("session_id").alias("a_session"))
    own = F.col("attack").isNull() | F.coalesce(F.col("session_id") == F.col("a_session"), F.lit(False))
    guard = F.when(own, F.raise_error(F.concat(F.lit("no ruling is possible here: "), F.coalesce(F.col("task_id").cast("string"), F.lit("?")), F.lit(" "), F.coalesce("lens", F.lit("?")))).cast("boolean"))
    agreed = consensus(rulings.join(a, ["task_id", "lens"], "left").where(guard.otherwise(True)).select(rulings.columns), required)
    rows = attacks.where(F.col("lens").isin(lenses)).join(agreed, ["task_id", "lens"], "left")
    rows = rows.withColumn("consensus", F.when(F.col("attack").isNull(), "not_required").otherwise(F.coalesce("consensus", F.lit("incomplete"))))
    any_of = {c: F.bool_or(F.col("consensus") == c).alias(c) for c in ("incomplete", "lands", "glances", "disagrees")}
    per_task = rows.groupBy("task_id").agg(F.count("*").alias("attacks"), *any_of.values())
    verdict = first_match(
        [
            (F.col("attacks") == 0, "unattacked"), (F.col("attacks") != len(lenses), "unruled"), (F.col("incomplete"), "unruled"),
            (F.col("lands"), "flagged"), (F.col("glances"), "contested"), (F.col("disagrees"), "withheld"),
        ],
        "stands",
    )
    return tasks.select("task_id").join(per_task, "task_id", "left").fillna(0, ["attacks"]).select("task_id", "attacks", verdict.alias("verdict"))


def arena_summary(findings: DataFrame) -> DataFrame:
    """H4, H5: tasks, withheld, their density, and whether all stand (an empty report does not pass)."""
    n, withheld = F.count("*"), F.count_if(F.col("verdict") == "withheld")
    passed = F.coalesce(F.bool_and(F.col("verdict") == "stands"), F.lit(False))
    return findings.agg(n.alias("tasks"), withheld.alias("withheld"), F.try_divide(withheld, n).alias("withheld_density"), passed.alias("passed"))
