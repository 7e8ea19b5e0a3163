"""Operator 1 against brute force, and planted passages."""

import random
import re

import numpy as np
import pytest

from plumbline.llm import substring_dedup as D

_CUT = re.compile(r"(?<=[.!?])[ \t\r\x0b\f]+|\s*\n\s*", re.ASCII)


def cut(text):
    """The sentences of a text, by a regular expression."""
    return [" ".join(s.split()) for s in _CUT.split(text or "") if s.strip()]


def repeated(rows, lengths, least_words=0):
    """Sentences of each row in any run of so many sentences and words that stood before, by comparing the runs themselves."""
    first, where = {}, []
    for n in sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n)):
        own = cut(rows[n][1])
        for i in range(len(own)):
            for j in range(i, len(own)):
                if j - i + 1 in lengths and sum(len(s.split()) for s in own[i : j + 1]) >= least_words:
                    where.append((n, i, j, first.setdefault(tuple(own[i : j + 1]), (n, i))))
    gone = [set() for _ in rows]
    for n, i, j, origin in where:
        if origin != (n, i):
            gone[n].update(range(i, j + 1))
    return gone


def brute(rows, sentences, least_words):
    """Sentences that stay in each row, from the definition."""
    out = []
    for (_, text), gone in zip(rows, repeated(rows, [sentences]), strict=True):
        own, drop = cut(text), set()
        for i in sorted(gone):
            if i - 1 not in gone:
                stretch = [i]
                while stretch[-1] + 1 in gone:
                    stretch.append(stretch[-1] + 1)
                if sum(len(own[k].split()) for k in stretch) >= least_words:
                    drop.update(stretch)
        out.append(([s for i, s in enumerate(own) if i not in drop], len(drop)))
    return out


def stored(spark, folder, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return spark.read.parquet(str(folder / "documents.parquet"))


def some_rows(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["ü", "日本", "a b"]

    def sentence():
        return " ".join(rng.choices(vocabulary, k=rng.randint(1, 9))) + rng.choice(".!?")

    shared = [[sentence() for _ in range(rng.randint(2, 7))] for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [sentence() for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(parts))
            parts[at:at] = rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n", "  ", " \n\t"]).join(parts)))
    rows += [(100, None), (101, ""), (102, "  \n "), (3, rows[3][1]), (None, rows[5][1])]
    return rows + [(200 + i, " ".join(shared[0])) for i in range(30)] + [(300, "of. " * 30), (301, "no end of it")]


@pytest.mark.parametrize(("sentences", "least_words"), [(2, 15), (2, 1), (3, 8), (1, 5)])
def test_equals_brute_force(spark, tmp_path, sentences, least_words):
    rows = some_rows(sentences)
    docs = stored(spark, tmp_path, [(d, t, 1, "r") for d, t in rows], "doc_id long, text string, row int, firsts string")
    got = D.substring_dedup(docs, sentences, least_words, long=None).collect()
    want = [(str(rows[n][0]), kept, count) for n, (kept, count) in enumerate(brute(rows, sentences, least_words))]
    assert sorted((str(r.doc_id), cut(r.text), r.removed) for r in got) == sorted(want)
    assert sum(count for *_, count in want) > 100
    assert {r.doc_id: r.text for r in got if r.doc_id in (100, 101, 102)} == {100: None, 101: "", 102: "  \n "}


def test_no_long_run_that_stood_before_is_left(spark, tmp_path):
    rows = some_rows(9)
    got = D.substring_dedup(stored(spark, tmp_path, [(n, t) for n, (_, t) in enumerate(rows)]), long=None).collect()
    left = {r.doc_id: cut(r.text) for r in got}
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    every = repeated(rows, range(2, 40), D.WORDS)
    assert sum(map(len, every)) > 100
    for (n, text), gone in zip(rows, every, strict=True):
        kept = [s for i, s in enumerate(cut(text)) if i not in gone]
        assert len(left[n]) <= len(kept) and set(left[n]) <= set(kept)


def test_a_planted_passage_leaves_the_first_document_only(spark, tmp_path):
    passage = "Alpha beta gamma delta epsilon zeta. Eta theta iota kappa lambda mu nu xi. Omicron pi rho sigma tau upsilon phi chi psi omega."
    rows = [(1, f"Clean start here. {passage} Clean end here."), (2, f"Another one begins {passage}\nAnd ends."), (3, "Nothing shared at all. In this text here.")]
    got = {r.doc_id: r for r in D.substring_dedup(stored(spark, tmp_path, rows)).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1]
    assert "kappa" not in got[2].text and got[2].removed == 2 and "begins" in got[2].text and got[2].text.endswith("And ends.")
    assert [(s.start, s.stop) for s in got[2].removed_spans] == [(rows[1][1].index("Eta"), rows[1][1].index("And ends"))]


def test_code_points_of_what_is_removed(spark, tmp_path):
    passage = "Größe und Maß sind hier ganz gleich. Übrigens gilt das auch für alle anderen Fälle, die es gibt."
    rows = [(1, passage), (2, f"Vorn steht übrigens anderes. {passage} Ähnlich am Ende.")]
    got = {r.doc_id: r for r in D.substring_dedup(stored(spark, tmp_path, rows)).collect()}
    (spot,) = got[2].removed_spans
    assert rows[1][1][spot.start : spot.stop].strip() == passage and got[2].text == rows[1][1][: spot.start] + rows[1][1][spot.stop :]


def test_short_shared_lines_go_unless_they_are_to_stay(spark, tmp_path):
    line = "All rights are reserved here. Ask before you copy it."
    passage = " ".join(f"Sentence {w} of the passage that repeats has some ten words." for w in "one two three four five six".split())
    rows = [(i, f"Document {i} begins so. {line} Number {i} has its own words. " + (passage if i % 2 else "")) for i in range(8)]
    docs = stored(spark, tmp_path, rows)
    assert {r.doc_id: r.removed for r in D.substring_dedup(docs, least_words=D.WORDS).collect()} == {i: 6 * (i % 2 and i > 1) for i in range(8)}
    assert {r.doc_id: r.removed for r in D.substring_dedup(docs).collect()} == {i: 2 * (i > 0) + 6 * (i % 2 and i > 1) for i in range(8)}


def test_first_places_are_sums_of_no_sorted_spans(spark, tmp_path, capfd):
    """Hashes are counted in a hash table; only the places of repeated ones are sorted for their minimum."""
    docs = stored(spark, tmp_path, some_rows(1))
    found = docs.selectExpr("0L AS row", "doc_id", "text").mapInArrow(D._spans(2, 20), D._SPANS)
    found.groupBy("hi", "lo").count().where("count > 1").explain()
    plan = capfd.readouterr().out
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_empty_table(spark, tmp_path):
    assert D.substring_dedup(stored(spark, tmp_path, [])).count() == 0


def op1(spark, folder, texts):
    stored(spark, folder, list(enumerate(texts)))
    return [r.text for r in sorted(D.op1_substring_dedup(spark, str(folder)).collect(), key=lambda r: r.doc_id)]


def test_the_query_finds_passages_of_long_sentences(spark, tmp_path):
    rng = random.Random(2)
    passage, other = ([f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(2))
    own = [[f"own{i}x{k}" for k in range(30)] for i in range(5)]
    line = " ".join(other)
    texts = [" ".join(own[0] + passage + own[1]), " ".join(own[2] + passage + own[3]) + ".", line, line, f"Begins here so. {line} " + " ".join(own[4]), "same " * 60, "same " * 60]
    got = op1(spark, tmp_path, texts)
    assert got[0] == texts[0] and got[2] == texts[2] and got[3] == "" and got[5] == texts[5] and got[6].strip() == ""
    assert len(set(passage) & set(got[1].split())) <= 16 and set(own[2][:-8] + own[3][8:-1]) <= set(got[1].split())
    assert len(set(other) & set(got[4].split())) <= 16 and set(own[4][8:]) <= set(got[4].split())


def test_the_query_finds_passages_of_fifty_words_wherever_they_stand(spark, tmp_path):
    """Unpunctuated passages in the middle of unpunctuated lines: of 50 words at most the ends may be left."""
    rng = random.Random(5)
    texts, passages = [], []
    for k in range(40):
        passage = [f"p{k}w{j}" for j in range(51)]
        passages.append(set(passage))
        for side in range(2):
            texts.append(" ".join([f"t{k}s{side}a{rng.random()}" for _ in range(25)] + passage + [f"t{k}s{side}b{rng.random()}" for _ in range(25)]))
    got = op1(spark, tmp_path, texts)
    assert [got[2 * k] for k in range(40)] == texts[::2]
    left = [len(p & set(got[2 * k + 1].split())) for k, p in enumerate(passages)]
    assert sum(n < 51 for n in left) >= 39 and sum(left) / 40 < 18
    assert all(sum(w.startswith("t") for w in t.split()) == 50 or n < 51 for t, n in zip(got[1::2], left, strict=True))


def test_the_query_removes_the_end_of_a_passage(spark, tmp_path):
    passage = " ".join(" ".join(f"s{i}w{j}" for j in range(n)) + "." for i, n in enumerate([18, 18, 4, 4, 4]))
    got = op1(spark, tmp_path, [f"{passage} One text ends so.", f"{passage} Another text has its own end."])
    assert got == [f"{passage} One text ends so.", "Another text has its own end."]


def test_blocks_give_the_same_sentences(monkeypatch):
    texts = [(t or "").encode() for _, t in some_rows(4)]
    whole = D.units(texts)
    monkeypatch.setattr(D, "BLOCK", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, D.units(texts), strict=True))
    assert [b"\n".join(texts)[a:b].split() for a, b in zip(whole.start, whole.stop, strict=True) if b - a < 40][:5]
