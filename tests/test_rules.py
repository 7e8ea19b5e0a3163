"""Operators against their rules stated again: pages, cut nodes, joins, sums, hashes, extension points."""

import random
import re
import time
from collections import Counter
from html import unescape
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import engine
from plumbline.functions import canonical
from plumbline.functions.text import casefold, normalise_anchor, sentences_of_text
from plumbline.operators import anchor, arena, extraction, navigation, scoring, spans
from plumbline.sources import artifacts, pages, readers

PAGES = Path("/root/testdata/sf0.001/pages.parquet")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


class Parsed(HTMLParser):
    """What the library's own parser finds while no silent element is open, whichever closes."""

    def reset(self):
        super().reset()
        self.data, self.open = [], 0

    def handle_starttag(self, tag, attrs):
        self.open += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.open -= tag in ("script", "style", "noscript") and self.open > 0

    def handle_data(self, data):
        if self.open == 0:
            self.data.append(data)


def some_pages():
    odd = ["", "a <3 b &copy; 2 &#8212; x &amp;amp; y", "<p>a<br>b</p><!-- <b>no</b> --> c", "<style>p{}</style><noscript>n</noscript>d <a title='x > y'>e</a>", "plain &lt;b&gt; text", "<DIV Class='a'>x</DIV\n>y<img/>z", "<script>if (a < b) '</p>'</script>t"]
    return odd + (pd.read_parquet(PAGES)["html"].tolist() if PAGES.exists() else [])


SILENT_CASES = {
    "<noscript>a<noscript>b</noscript>c</noscript>d": "d", "<noscript>a</style>b</noscript>c": "b c", '<a "x>y</a>z': "y z", "<script>a</script><br/>b<style/>c</style>d": "b c d",
    "a</noscript>b<noscript/>c": "a b c", "a <b": "a", "x<script>y": "x", "<noscript>a<style>b</style>c": "", "a<![if x]>b<![ 9]>c": "a b c",
}
PIECES = ["<noscript>", "</noscript>", "<script>", "</script >", "<style>", "</STYLE>", "<style/>", "<br/>", "<p a='>'>", "</p", "<a \"x", ">", "<", "&amp;", "&lt", "text", " ", "<!-- x -->", "<!--", "<!doctype x>", "<?php ?>", "'", '"', "</", "é\n"]


def drawn(pieces, n=800, most=14):
    rng = random.Random(3)
    return ["".join(rng.choices(pieces, k=rng.randint(1, most))) for _ in range(n)]


def test_page_text_equals_the_parser_of_the_library():
    for page, text in SILENT_CASES.items():
        assert pages.page_text(page) == text, page
    for page in some_pages() + drawn(PIECES):
        own = Parsed()
        own.feed(page)
        assert pages.page_text(page) == " ".join(" ".join(own.data).split()), page[:200]
    assert pages.page_text(None) is None


def lines_by_substitution(page, mark):
    """D6 by one substitution after the other over the whole page."""
    for pattern, value in (
        (r"<script[\s\S]*?</script>|<style[\s\S]*?</style>", " "), (r"<(?:section|article)\b[^>]*>", f"\n{mark}"), (r"""<div\b[^>]*class=["'][^"']*\bslide\b[^"']*["'][^>]*>""", f"\n{mark}"),
        (r"<h[1-6]\b[^>]*>", f"\n{mark}"), (r"</(?:p|div|li|h[1-6]|td|th|tr|section|article|header|footer|blockquote)>", "\n"), (r"<(?:br|hr)\s*/?>", "\n"), (r"<[^>]+>", " "),
    ):
        page = re.sub(pattern, value, page, flags=re.I)
    return re.split("\r\n|[\n\r\x0b\x0c\x1c\x1d\x85\u2028\u2029]", unescape(page))


TAGS = ["<script", "</script>", "<style>", "</style>", "<section ", "<article>", "<div ", "<DIV class='a slide'", 'class="slide"', "class='b", "slide", " class=\"x > slide y\"", "'", '"', ">", "<", "<h1", "<h2>", "</p>", "</td>", "<br/>", "<hr", " ", "w", "&amp;", "<b>", "\n", "\u2028", "\x85 "]


def test_page_lines_equal_the_substitutions():
    for page in some_pages() + drawn(TAGS, 3000, 18):
        assert pages.page_lines(page, "#%") == lines_by_substitution(page, "#%"), page[:300]
    marked = pages.page_lines("<h1>One &middot; two</h1><p>three<br>four</p><div class='big slide'>five</div><section>six", "#")
    assert [x.strip() for x in marked if x.strip()] == ["#One · two", "three", "four", "#five", "#six"]
    assert pages.page_lines(None, "#") is None and pages.page_lines("a#b", "#") == ["a", "b"]


@pytest.mark.parametrize("unit", ["<a ", "<", "</", "<!--", "<a '", "<script>", "<script", "<style <script", "<section ", "<div ", "<div class='", "class='slide' ", "<div class='slide' ", "<br ", "<h1 ", "<![", "&#", "<a b=c ", "<div class='x > slide"])
@pytest.mark.parametrize("end", ["", "<section>", "</script>"])
def test_a_broken_page_of_a_megabyte_takes_no_time(unit, end):
    page = unit * (1_000_000 // len(unit)) + end
    for read in (pages.page_text, lambda p: pages.page_lines(p, "\x1e")):
        began = time.process_time()
        read(page)
        assert time.process_time() - began < 3


def walk(text, start, end, most):
    """Up to the last blank in the second half of what fits, else all that fits; then past white space."""
    out = []
    while end > start:
        stop = end
        if end - start > most:
            blanks = [i for i in range(start + most // 2, start + most) if text[i] == " "]
            stop = blanks[-1] if blanks else start + most
        out.append((start, stop))
        start = stop
        while start < end and text[start].isspace():
            start += 1
    return out


def odd_texts():
    rng = random.Random(3)
    return ["".join(rng.choices("abc  \n\n\t.é", k=rng.randint(0, 3000))) for _ in range(25)] + ["x" * 1500, " " * 900 + "y", "a " * 800, "a\n" + "b" * 256 + " " + "c" * 300, "　z \x1c\n\xa0"]


def test_cut_lines_equal_a_walk(spark):
    texts = odd_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {i: [] for i in range(len(texts))}
    for r in navigation.line_spans(docs, 256).orderBy("doc", "number").collect():
        got[r.doc].append((r.start, r.start + len(r.piece)))
        assert texts[r.doc][r.start : r.start + len(r.piece)] == r.piece
    for i, text in enumerate(texts):
        want, at = [], 0
        for line in text.split("\n"):
            if line.strip():
                want += walk(text, at + len(line) - len(line.lstrip()), at + len(line.rstrip()), 256)
            at += len(line) + 1
        assert got[i] == want


def test_cut_paragraphs_equal_a_walk():
    for text in odd_texts():
        want = []
        for m in re.finditer(r"\S[\s\S]*?(?=\r?\n[ \t]*\r?\n|\Z)", text):
            want += walk(text, m.start(), m.start() + len(m.group().rstrip()), 256)
        assert navigation.paragraph_spans(text, 256) == want


def test_tree_surface_nests_children(spark):
    nodes = [("d", "r", None, 0, 9, "Root", False), ("d", "a", "r", 0, 4, 'A "q"', True), ("d", "b", "r", 5, 9, "B", True), ("d", "c", "a", 1, 2, "C", True), ("e", "s", None, 0, 1, "S", True)]
    got = navigation.tree_surface(spark.createDataFrame(nodes, "doc string, node_id string, parent_id string, start int, end int, title string, selectable boolean"))
    assert rows(got, "doc", "surface") == [("d", '[["n0002","Root",false,[["n0001","A \\"q\\"",true,[["n0003","C",true,[]]]],["n0004","B",true,[]]]]]'), ("e", '[["n0001","S",true,[]]]')]


def test_substring_join_with_short_needles(spark):
    texts = ["the cat sat on the mat", "category theory", "a b c", "no hit at all", "x", ""]
    needles = ["cat", "at", "a", "he c", "cat sat on", "mat", "theory", "the cat sat on the mat", "zz", "", "b c"]
    got = anchor.substring_join(spark.createDataFrame([(n,) for n in needles], "n string"), spark.createDataFrame(list(enumerate(texts)), "i int, h string"), "n", "h", "i")
    assert sorted((r.i, r.n) for r in got.collect()) == sorted((i, n) for i, h in enumerate(texts) for n in needles if n and n in h)


def test_literal_overlap_holds_both_ways(spark):
    a = spark.createDataFrame([("f", "x" * 10 + "The quick brown fox jumps over"), ("g", "quick brown fox jumps over the"), ("h", "nothing in common with these at all"), ("i", "short")], "file string, literal string")
    b = spark.createDataFrame([("the quick  brown fox JUMPS over",), ("He said: Quick brown fox jumps over the dog",), ("short",)], "span string")
    assert rows(extraction.literal_overlap(a, b), "file") == [("f",), ("g",)]


def test_literal_overlap_broadcasts_no_fingerprints(spark):
    a = spark.createDataFrame([("f", "The quick brown fox jumps over the lazy dog"), ("g", "the quick brown fox jumps over THE lazy dog"), ("h", "nothing in common with these at all")], "file string, literal string")
    got = extraction.literal_overlap(a, spark.createDataFrame([("brown fox jumps over the lazy",)], "span string"))
    assert rows(got, "file") == [("f",), ("g",)]
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_running_sums_cross_ranges(spark):
    data = [(i, i % 7, 1) for i in range(500)]
    got = scoring.running(spark.createDataFrame(data, "i int, k int, one int"), [F.col("k"), F.col("i")], {"n": "one"})
    assert sorted((r.k, r.i, r.n) for r in got.collect()) == [(k, i, n) for n, (k, i) in enumerate(sorted((k, i) for i, k, _ in data), 1)]


def test_average_precision_of_one_score_for_all(spark):
    """All ties: the order is that of the ids, over as many tasks as there are ranges."""
    df = spark.range(100_000).selectExpr("id AS case_id", "0.5D AS score", "id % 4 = 0 AS relevant")
    want = sum((i // 4 + 1) / (i + 1) for i in range(0, 100_000, 4)) / 25_000
    assert scoring.average_precision(df).first().average_precision == pytest.approx(want)
    assert scoring.roc_auc(df).first().roc_auc == pytest.approx(0.5)


def test_tree_hash_follows_the_rows(spark):
    big = spark.range(9_000).selectExpr("id AS i")
    one = canonical.unordered_sha256(big, "i").first().sha256
    assert one == canonical.unordered_sha256(big.orderBy(F.desc("i")).repartition(5), "i").first().sha256
    assert one != canonical.unordered_sha256(big.where("i <> 7"), "i").first().sha256
    assert canonical.unordered_sha256(big.limit(0), "i").first().sha256


def test_self_rulings_stop_the_adjudication(spark):
    tasks = spark.createDataFrame([("a",)], "task_id string")
    attacks = spark.createDataFrame([("a", "l1", "x", "s0")], "task_id string, lens string, attack string, session_id string")
    own = spark.createDataFrame([("a", "l1", "lands", "f1", "s0")], "task_id string, lens string, ruling string, model_family string, session_id string")
    with pytest.raises(Exception, match="no ruling is possible"):
        arena.adjudicate(tasks, attacks, own, ["l1"], 1).collect()


def test_navigators_answer_each_case_once(spark):
    nodes = spark.createDataFrame([("d", "n1", "price", 0, 5, True)], "doc string, node_id string, title string, start int, end int, selectable boolean")
    cases = spark.createDataFrame([("q", "d", "price?"), ("z", "d", "other")], "case_id string, doc string, question string")
    got = navigation.run_navigators(cases, nodes, {"lexical": navigation.select_lexical, "all": navigation.select_all})
    assert rows(got, "case_id", "navigator", "status") == [("q", "all", "selected"), ("q", "lexical", "selected"), ("z", "all", "selected"), ("z", "lexical", "abstained")]
    with pytest.raises(Exception, match="not one answer"):
        navigation.run_navigators(cases, nodes, {"some": lambda n, c: navigation.select_all(n, c.where("case_id = 'q'"))}).collect()


def test_segmenters_must_hold(spark):
    docs = spark.createDataFrame([("d", "x" * 30 + "TARGET" + "y" * 14)], "doc string, text string")
    quotes = spark.createDataFrame([("d", "TARGET"), ("d", "absent")], "doc string, quote string")
    got = spans.compare_segmenters(docs, quotes, "doc", 20, 5, lambda t: [(0, 20), (20, 33), (33, len(t))])
    assert rows(got, "segmenter", "segments", "grounded", "contained", "cut") == [("baseline", 3, 1, 1, 0), ("candidate", 3, 1, 0, 1)]
    with pytest.raises(ValueError):
        spans.compare_segmenters(docs, quotes, "doc", 20, 5, lambda t: [(0, 40)])


def test_segmenters_are_compared_within_a_row(spark):
    """No segment is a row, no text is joined again; all occurrences of a text of one word count."""
    texts = [("a", "roreer " * 400, ["roreer roreer"]), ("b", "x \u00a0é😀" * 30 + "end", ["😀x", "end", "none", ""]), ("c", "", ["x"]), ("d", None, None)]
    docs = spark.createDataFrame([r[:2] for r in texts], "doc string, text string")
    quotes = spark.createDataFrame([(k, q) for k, _, own in texts for q in own or []] * 2, "doc string, quote string")

    def segment(t):
        return [(i, min(i + 30, len(t))) for i in range(0, len(t), 40)][::-1] + [(0, 1)] * bool(t)

    got = spans.compare_segmenters(docs, quotes, "doc", 50, 20, segment)
    assert not any(x in planned(got) for x in ("Join", "Window", "Exchange"))
    expected = []
    for k, t, own in texts:
        t = t or ""
        for name, parts in (("baseline", [(i, min(i + 50, len(t))) for i in range(0, max(len(t) - 20, 1), 30)] if t else []), ("candidate", segment(t))):
            covered = {i for a, b in parts for i in range(a, b)}
            held = {q: h for q in own or [] if q and (h := [sum(a <= i and i + len(q) <= b for a, b in parts) for i in range(len(t)) if t.startswith(q, i)])}
            solid, whole = (sum(not t[i].isspace() for i in x) for x in (covered, range(len(t))))
            expected.append((
                k, name, len(parts), max((b - a for a, b in parts), default=0), len(covered) / len(t) if t else 1.0, solid / whole if whole else 1.0, sum(b - a for a, b in parts) - len(covered),
                len(held), sum(max(h) > 0 for h in held.values()), sum(max(h) == 0 for h in held.values()), sum(max(n - 1, 0) for h in held.values() for n in h),
            ))
    columns = ("doc", "segmenter", "segments", "longest", "covered_ratio", "covered_solid_ratio", "overlap_excess", "grounded", "contained", "cut", "duplicate_exposures")
    assert rows(got, *columns) == sorted(expected)


def test_extension_points(spark):
    df = spark.createDataFrame([("s", "c", "q"), ("t", "boom", "q")], "s string, c string, q string")

    def assess(source, claim, question):
        if claim == "boom":
            raise ValueError
        return {"label": "supported", "confidence": 0.5}, {"b": 1, "a": "é"}

    got = {r.c: r.d for r in df.withColumn("d", engine.detector(assess)(F.col("s"), F.col("c"), F.col("q"))).collect()}
    assert got["c"].signal == '{"a":"\\u00e9","b":1}' and got["boom"].error == "ValueError" and got["boom"].signal is None

    def resolve(uri):
        if uri == "p":
            raise PermissionError
        return {"a": "text"}[uri]

    refs = spark.createDataFrame([("a",), ("p",), ("z",)], "uri string")
    assert rows(readers.resolve_with(refs, resolve), "uri", "text", "failure") == [("a", "text", None), ("p", None, "source_paywalled"), ("z", None, "source_unreachable")]
    assert canonical.profile_sha256(arena.Profile()) != canonical.profile_sha256(arena.Profile(least=31))


def test_snapshots_of_one_key(spark, tmp_path):
    for text, at in (("old", "2024-01-01"), ("new", "2024-02-01")):
        readers.write_snapshots(spark.createDataFrame([("1", "u", text, at, 200, "text/plain")], "source_id string, uri string, text string, fetched_at string, status int, media_type string"), str(tmp_path / "s"))
    refs = spark.createDataFrame([("1", "u")], "source_id string, uri string")
    assert rows(readers.load_snapshots(refs, str(tmp_path / "s")), "uri", "text", "failure") == [("u", "new", None)]


def test_casefold_paths(spark):
    texts = ["Plain ASCII", "Größe ÄÖÜ ß", "ﬁ ſ ŉ ǰ ΐ", "Σίσυφος ΣΑΣ", "İstanbul", "Ꭰ ꭰ", "日本 ÉÈ – “x”", "", None]
    got = {r.i: r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", casefold(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else t.casefold() for t in texts]


def test_substring_join_with_a_hot_word_and_many_needles(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(["the", *rng.choices(words, k=40), "the"]) for _ in range(80)] + ["the the the"] * 5 + [""]
    needles = list({" ".join(t.split()[i : i + k]) for t in texts for i, k in [(rng.randint(0, 38), rng.randint(1, 5))]}) + ["the the the", "q the q", "the", "w1", "w1 w", ""]
    long = [t[3:] + " x" for t in texts[:3]] + [texts[0], texts[1][1:]]
    frames = spark.createDataFrame([(n, k) for k, n in enumerate(needles + long)], "n string, k int"), spark.createDataFrame(list(enumerate(texts)), "i int, h string")
    want = sorted((i, k) for i, h in enumerate(texts) for k, n in enumerate(needles + long) if n and n in h)
    assert sorted((r.i, r.k) for r in anchor.substring_join(*frames, "n", "h", "i").collect()) == want
    assert anchor.substring_join(frames[0].limit(0), frames[1], "n", "h", "i").count() == 0


def test_substring_join_in_several_lists(spark, monkeypatch):
    monkeypatch.setattr(anchor, "AT_ONCE", 40)
    needles = [f"a{i} b c{i}" for i in range(50)]
    text = " ".join(needles)
    got = anchor.substring_join(spark.createDataFrame([(n,) for n in needles], "n string"), spark.createDataFrame([(1, text), (2, "a1 b c2")], "i int, h string"), "n", "h", "i")
    assert sorted((r.i, r.n) for r in got.collect()) == sorted((1, n) for n in needles)


def test_an_automaton_finds_what_stands_in_a_text():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices("ab ", k=60))
        needles = list({"".join(rng.choices("ab ", k=rng.randint(1, 6))) for _ in range(30)})
        assert sorted(anchor.held(text, needles)) == sorted(n for n in needles if n in text)


def similar(a, b):
    return bool(a and b) and len(a & b) / len(a | b) >= 0.5


def test_token_matches_equal_brute_force(spark):
    rng = random.Random(4)

    def side(n):
        return [(rng.choice("de"), rng.choice("xy"), " ".join(rng.choices([f"t{i}" for i in range(14)], k=rng.randint(0, 7)))) for _ in range(n)]

    p, g = [*side(150), ("d", "z", "alone")], [*side(150), ("e", "w", "other"), ("d", "x", "")]
    got = extraction.match_counts(spark.createDataFrame(p, "doc string, category string, quote string"), spark.createDataFrame(g, "doc string, category string, span string"))
    want = {}
    for own, other, hit, miss in ((p, g, 0, 1), (g, p, None, 2)):
        for doc, c, t in own:
            k = hit if any((doc, c) == (d, e) and similar(set(t.split()), set(u.split())) for d, e, u in other) else miss
            counts = want.setdefault(c, [0, 0, 0])
            if k is not None:
                counts[k] += 1
    assert {r.category: [r.tp, r.fp, r.fn] for r in got.collect()} == want


def test_token_matches_of_one_long_document(spark):
    """100,000 lines on each side that share a frequent word, every tenth similar to one of the other side."""
    line = "concat('the ', 'a', id, ' b', id, ' c', id % 1000, ' d', id % 7)"
    p = spark.range(100_000).selectExpr("'d' AS doc", "'c' AS category", f"{line} AS quote")
    g = spark.range(100_000).selectExpr("'d' AS doc", "'c' AS category", f"CASE WHEN id % 10 = 0 THEN {line} ELSE concat('the ', 'e', id, ' f', id, ' d', id % 7) END AS span")
    assert rows(extraction.match_counts(p, g), "tp", "fp", "fn") == [(10_000, 90_000, 90_000)]


def test_token_matches_shuffle_texts_once(spark):
    p = spark.createDataFrame([("d", "x", "a b c d"), ("d", "x", "A b"), ("d", "x", None), ("e", "x", "q"), (None, "x", "a")], "doc string, category string, quote string")
    g = spark.createDataFrame([("d", "x", "a b c"), ("d", "x", "z"), (None, "x", "a"), ("f", "y", "q")], "doc string, category string, span string")
    got = extraction.unmatched_gold(p, g)
    assert rows(got, "doc", "category", "n") == [("d", "x", 1), ("f", "y", 1), (None, "x", 1)]
    assert rows(extraction.match_counts(p, g), "category", "tp", "fp", "fn") == [("x", 2, 3, 2), ("y", 0, 0, 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange ") == 1 and "explode" not in plan


def test_winnowing_meets_in_every_shared_stretch():
    rng = random.Random(6)
    for _ in range(300):
        inner = "".join(rng.choices("ab c", k=rng.randint(25, 40)))
        outer = "".join(rng.choices("ab c", k=rng.randint(0, 90))) + inner + "".join(rng.choices("ab c", k=rng.randint(0, 90)))
        assert set(extraction.winnowed(inner[:25], 25)) <= set(extraction.winnowed(outer, 25)) and len(extraction.winnowed(inner[:25], 25)) == 1
    text = "".join(rng.choices("abcdefgh ", k=60_000))
    assert len(extraction.winnowed(text, 25)) < len(text) / 5
    assert len(extraction.winnowed("x" * 24, 25)) == 0 and len(extraction.winnowed("x" * 5000, 25)) == 1


def test_medians_are_selected_exactly(spark):
    rng = random.Random(7)
    data = [(s, None if rng.random() < 0.1 else float(rng.choice([rng.randint(0, 9), rng.random()]))) for s in ["a"] * 301 + ["b"] * 40 + [None] * 21 + ["c"] for _ in range(3)] + [("none", None)]
    df = spark.createDataFrame(data, "stratum string, score double")
    want = df.groupBy("stratum").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.percentile("score", 0.5).alias("median"), F.max("score").alias("greatest"))
    assert rows(scoring.stratum_summary(df), "stratum", "n", "least", "median", "greatest") == rows(want, "stratum", "n", "least", "median", "greatest")


NODE = "doc string, node_id string, parent_id string, start int, end int, title string, selectable boolean"


def test_tree_surface_of_a_chain_of_any_depth(spark):
    depth = 10_000
    nodes = [("d", f"x{i}", f"x{i - 1}" if i else None, i, depth, "t", True) for i in range(depth)] + [("e", "a", None, 0, 1, "t", True), ("e", "b", None, 2, 3, "u", True)]
    got = dict(rows(navigation.tree_surface(spark.createDataFrame(nodes, NODE)), "doc", "surface"))
    assert got["d"] == "[" + ",".join(f'["n{i:04d}","t",true,[' for i in range(1, depth + 1)).replace("[,", "[") + "]]" * depth + "]"
    assert got["e"] == '[["n0001","t",true,[]],["n0002","u",true,[]]]'


@pytest.mark.parametrize("parent", ["b", "nowhere"])
def test_tree_surface_stops_at_nodes_without_a_root(spark, parent):
    nodes = [("d", "r", None, 0, 9, "R", True), ("d", "a", parent, 1, 2, "A", True), ("d", "b", "a", 1, 2, "B", True)]
    with pytest.raises(Exception, match="no root leads to|no node"):
        navigation.tree_surface(spark.createDataFrame(nodes, NODE)).collect()


def walked(lengths, target, most, room):
    """Every place by distance, then place; those that fit are taken."""
    taken = []
    for i in sorted((i for i in range(len(lengths)) if i != target), key=lambda i: (abs(i - target), i)):
        if len(taken) < most and sum(lengths[j] for j in taken) + lengths[i] <= room:
            taken.append(i)
    return sorted(taken)


def test_the_nearest_that_fit_equal_a_walk_over_all():
    rng = random.Random(8)
    for _ in range(300):
        lengths = [rng.choice([rng.randint(8, 90), rng.randint(200, 3000)]) for _ in range(rng.randint(1, 70))]
        targets = rng.choices(range(len(lengths)), k=4)
        most, room = rng.randint(1, 14), rng.choice([10, 100, 700, 2400])
        assert arena.nearest_that_fit(np.array(lengths), targets, most, room) == [walked(lengths, t, most, room) for t in targets]


def test_a_section_of_a_hundred_thousand_sentences_takes_no_time():
    lengths = np.full(100_000, 3000)
    lengths[::30_000] = 10
    began = time.process_time()
    found = arena.nearest_that_fit(lengths, list(range(0, 100_000, 100)), 14, 2400)
    assert all(found) and time.process_time() - began < 3


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_even_chunks_split_a_text_once(spark):
    df = spark.createDataFrame([("One sentence here. " * 50,)], "t string")
    chunks = df.select(spans.even_chunks(F.col("t"), sentences_of_text(F.col("t")), 6).alias("p"))
    assert planned(chunks).count("(?<=[.!?])") <= 2
    assert [len(r.p) for r in chunks.collect()] == [50]


def test_trees_are_walked_in_one_row_of_a_document(spark):
    nodes = spark.createDataFrame([("d", "r", None, 0, 9, "R", True), ("d", "a", "r", 1, 2, "A", True), ("d", "x", "y", 1, 2, "X", True), ("d", "y", "x", 1, 12, "Y", True), ("d", "z", "x", 0, 2, "Z", True)], NODE)
    found = navigation.tree_violations(nodes)
    assert rows(found, "rule", "node_id") == [("cycle", "x"), ("cycle", "y"), ("cycle", "z"), ("outside_parent", "y"), ("outside_parent", "z")]
    assert "Join" not in planned(found) and "Join" not in planned(navigation.tree_surface(nodes))


def test_selectors_get_the_nodes_of_their_case_in_order(spark):
    nodes = spark.createDataFrame([(d, f"{d}{i}", None, 9 - i, 10, f"t{i}", i != 1) for d in "de" for i in range(4)], NODE)
    cases = spark.createDataFrame([("p", "d", "2"), ("q", "e", "9"), ("s", "e", "3")], "case_id string, doc string, question string")
    out = navigation.select_with(nodes, cases, lambda question, table: list(table[table["start"] > int(question)]["node_id"])[:2])
    assert rows(out, "case_id", "status", "node_ids") == [("p", "selected", ["d3", "d2"]), ("q", "abstained", []), ("s", "selected", ["e3", "e2"])]
    assert "FlatMapGroups" not in planned(out)


def test_pages_are_read_without_arrow_batches(spark):
    read = spark.createDataFrame([("<p>a &amp; b</p>",), (None,)], "h string").select(readers.html_to_text(F.col("h")).alias("t"))
    assert rows(read, "t") == [("a & b",), (None,)] and "ArrowEvalPython" not in planned(read)
    assert "MapInPandas" not in planned(artifacts.extract_html(spark.createDataFrame([(1, "<p>a</p>")], "doc long, text string")))


def test_anchoring_reads_texts_once_and_one_by_one(spark):
    """No pass of single characters through a map, none for runs of spaces of their own, no Arrow batches of whole texts."""
    rng = random.Random(3)
    texts = ["".join(rng.choices("aB9é_ -,;:\n\u00a0’“”–—$£€%ßİﬁ😀", k=rng.randint(0, 40))) for _ in range(300)] + ["_", "  ", "a _ b", "a  b", " a", "(a) (b)", "a_b__c"]

    def plain(t):
        folded = re.sub(r"[^\w$%£€.,'\"-]+", " ", t.casefold().translate(str.maketrans("‘’‛“”–—", "'''\"\"--")).replace("\u0307", " "))
        return " ".join(folded.replace("_", " ").split())

    df = spark.createDataFrame([(i, t, t + "x") for i, t in enumerate(texts)], "i int, excerpt string, source_text string")
    normal = df.select("i", normalise_anchor(F.col("excerpt")).alias("n"))
    assert [r.n for r in normal.orderBy("i").collect()] == [plain(t) for t in texts]
    found = anchor.anchor_excerpts(df)
    assert found.where("anchor is null").isEmpty()
    assert "ArrowEvalPython" not in planned(found) and "‘’‛“”–—" not in planned(normal)


def test_similarity_of_few_and_of_many_different_characters():
    rng = random.Random(4)
    for alphabet in ("ab é", [chr(0x4E00 + i) for i in range(900)]):
        for _ in range(20):
            n = "".join(rng.choices(alphabet, k=300))
            h = "".join(c if rng.random() < 0.9 else rng.choice(alphabet) for c in n)
            a, b = (Counter(zip(t, t[1:], strict=False)) for t in (n, h))
            assert anchor.window_similarity(n, h) == 2 * (a & b).total() / (len(n) + len(h) - 2)
