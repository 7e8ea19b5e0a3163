"""Normalisers against Python's own string functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import anchor, spans

SAMPLES = [
    "", " ", "Straße ﬁn ΣΑΣ ς İI ŉ", "‘a’ ‛b‛ “c” – — d", "A_b  c d\x1ce\x85f", "$14.2M (net), 5% & €3,000.50!", "Hello. World! Is it? 9 yes. no",
    "ÀÉÎ õ ß ẞ ΐ ᾳ Ꭰ ꭰ", "tab\there\nnew\r\nline", "x" * 300 + "ß" * 5, "日本語 テキスト 😀 end", "a.b-c'd\"e,f", "naïve café №5 ①②",
]


def apply(spark, function, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", function(F.col("t")).alias("o")).orderBy("i").collect()]


def test_casefold_is_pythons(spark):
    letters = [chr(p) for p in range(0x20, 0x3000) if chr(p).isprintable()]
    values = SAMPLES + ["".join(letters[i : i + 50]) for i in range(0, len(letters), 50)]
    assert apply(spark, T.casefold, values) == [v.casefold() for v in values]


def test_normalise_anchor(spark):
    fold = str.maketrans({"‘": "'", "’": "'", "‛": "'", "“": '"', "”": '"', "–": "-", "—": "-"})

    def want(v):
        return " ".join(re.sub(r"[^\w$%£€.,'\"-]+", " ", v.casefold().translate(fold)).replace("_", " ").split())

    assert apply(spark, T.normalise_anchor, SAMPLES) == [want(v) for v in SAMPLES]


def test_normalise_text_and_grounding(spark):
    fold = str.maketrans({"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "})
    base = [re.sub(r"\s+", " ", v.translate(fold)).strip() for v in SAMPLES]
    assert apply(spark, T.normalise_text, SAMPLES) == [v.casefold() for v in base]
    assert apply(spark, T.merge_key, SAMPLES) == [" ".join(v.split()).lower() for v in SAMPLES]
    assert apply(spark, T.collapse, SAMPLES) == [" ".join(v.split()) for v in SAMPLES]


def test_tokens(spark):
    got = apply(spark, T.match_tokens, SAMPLES)
    assert [set(x) for x in got] == [set(re.findall("[a-z0-9]+", v.lower())) for v in SAMPLES]
    got = apply(spark, T.word_tokens, SAMPLES)
    assert [set(x) for x in got] == [set(re.findall(r"\w+", v.casefold())) for v in SAMPLES]
    assert apply(spark, T.numeric_tokens, SAMPLES) == [re.findall(r"[$£€]?\d[\d,.]*%?", v) for v in SAMPLES]
    got = apply(spark, lambda c: T.content_tokens(c), ["What is the price of a thing?"])
    assert got == [["price", "thing"]]


def test_sentences(spark):
    text = "First one here. Second one there? no split. 9 lives it has! ok"
    assert apply(spark, T.sentences_of_line, [text]) == [[s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z$£€0-9'\"])", text) if len(s.strip()) >= 8]]


@pytest.mark.parametrize("seed", range(3))
def test_offsets(spark, seed):
    rng = random.Random(seed)
    rows = [("".join(rng.choices("abé.", k=rng.randint(0, 60))), "".join(rng.choices("abé.", k=rng.randint(0, 3)))) for _ in range(60)] + [(r"x\Ey\E", r"\E"), ("aaaa", "aa"), ("😀a😀a", "a")]

    def find(t, q, step):
        out, at = [], t.find(q) if q else -1
        while at >= 0:
            out.append(at)
            at = t.find(q, at + (len(q) if step else 1))
        return out

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, q string")
    got = df.select("i", spans.offsets(F.col("t"), F.col("q")).alias("a"), spans.overlapping_offsets(F.col("t"), F.col("q")).alias("b")).orderBy("i").collect()
    assert [r.a for r in got] == [find(t, q, True) for t, q in rows]
    assert [r.b for r in got] == [find(t, q, False) for t, q in rows]


def dice(a, b):
    if len(a) < 2 or len(b) < 2:
        return 0.0
    pairs = [b[i : i + 2] for i in range(len(b) - 1)]
    both = 0
    for i in range(len(a) - 1):
        if a[i : i + 2] in pairs:
            pairs.remove(a[i : i + 2])
            both += 1
    return 2 * both / (len(a) + len(b) - 2)


def test_window_similarity_is_the_walk():
    rng = random.Random(1)
    for _ in range(60):
        n, h = ("".join(rng.choices("abcd ", k=rng.randint(0, k))) for k in (20, 120))
        w = min(len(h), int(len(n) * 1.2 + 0.999999))
        if len(h) <= w:
            assert anchor.window_similarity(n, h) == dice(n, h)
            continue
        step = max(1, len(n) // 4)
        best, at = 0.0, 0
        for i in range(0, len(h) - w + 1, step):
            if (s := dice(n, h[i : i + w])) > best:
                best, at = s, i
        best = max([best] + [dice(n, h[i : i + w]) for i in range(max(0, at - step), min(len(h) - w, at + step) + 1, 7)])
        assert anchor.window_similarity(n, h) == best


def test_anchor_table(spark):
    rows = [
        (0, "Revenue was $14.2M.", "Revenue was $14.2M."), (1, "REVENUE  WAS  $14.2M — audited", "Revenue was $14.2M - audited"),
        (2, "Revenue was $14.2M for the period.", "Revenue was $4.2M for the period."), (3, "The group will consolidate its results for the year.", "The group will consolidated its results for the year."),
        (4, "...", "text"), (5, "a", ""), (6, "unrelated words entirely", "nothing of the kind stands in here at all"),
    ]
    got = {r.i: (r.anchor, r.method) for r in anchor.anchor_excerpts(spark.createDataFrame(rows, "i int, excerpt string, source_text string")).collect()}
    assert got[0] == got[1] == ("found", "exact")
    assert got[2][0] != "found" and got[3] == ("found", "fuzzy")
    assert got[5] == ("not_found", "exact") and got[6] == ("not_found", "fuzzy")


def test_sentences_keep_digits_at_their_ends(spark):
    """A function of two parameters would get an element's index as the second one."""
    line = spark.createDataFrame([("0 is first, then 100. Ends in 41. 2 begins 32.",)], "t string")
    assert line.select(T.sentences_of_line(F.col("t"))).first()[0] == ["0 is first, then 100.", "Ends in 41.", "2 begins 32."]
    assert line.select(T.sentences_of_text(F.col("t"))).first()[0] == ["0 is first, then 100.", "Ends in 41.", "2 begins 32."]
