"""The pipeline's stages on a small table, each against brute force over what its predecessor kept."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_mixing import draws, quantile, uniform
from test_near_dedup import brute_kept
from tokenizers import Tokenizer

import corpus_pipeline as C
from plumbline.llm import mixing
from plumbline.llm.tokens import TOKENIZER

SYLLABLES = {"en": "th er on an re he in ed".split(), "de": "ch ei sch ung lich be ge en".split(), "fr": "eau que oi tion ai ment le".split(), "es": "cion os que ado ez ra mente".split()}


def documents():
    rng, rows = random.Random(12), []
    for i in range(160):
        lang = rng.choice(list(SYLLABLES))
        text = " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(30, 90)))
        rows.append([i, text, lang, f"s{min(i % 7, 3)}"])
    for i in range(40):
        words = rows[i][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append([200 + i, " ".join(words), rows[i][2], "s1"])
    rows += [[300 + i, rows[5][1].replace(" ", "  " if i % 2 else " "), "en", "s2"] for i in range(30)]
    rows += [[400, None, "en", "s0"], [401, "", "en", "s0"], [402, "12 $$ 9", "en", None], [None, rows[3][1] + " and words of its own here at the end", "en", None], rows[0]]
    return [(*r, len(r[1] or ""), f"row{n}") for n, r in enumerate(rows)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long, copy string").repartition(3).write.parquet(str(folder / "documents.parquet"))
    docs, out = spark.read.parquet(str(folder / "documents.parquet")), []
    columns = docs.columns
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(folder)).write.parquet(str(folder / str(k)))
        docs = spark.read.parquet(str(folder / str(k)))
        assert k == 4 or docs.columns == columns
        out.append([r.asDict() for r in docs.collect()])
    return folder, out


def norm(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


def test_language_drops_texts_without_a_letter_only(stages):
    _, (kept, *_) = stages
    assert Counter(r["copy"] for r in kept) == Counter(r[5] for r in documents() if r[1] and any(map(str.isalpha, r[1])))


def test_exact_keeps_the_longest_then_smallest(stages):
    _, (before, kept, *_) = stages
    groups = defaultdict(list)
    for r in before:
        groups[norm(r["text"])].append(r)
    assert len(kept) == len(groups)
    for r in kept:
        own = groups[norm(r["text"])]
        best = min(own, key=lambda x: (-len(x["text"]), x["doc_id"] is None, x["doc_id"] or 0))
        assert (len(r["text"]), r["doc_id"]) == (len(best["text"]), best["doc_id"])


def test_near_keeps_one_of_each_component(stages):
    _, (_, before, kept, *_) = stages
    before = sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    want = brute_kept([(n, r["text"]) for n, r in enumerate(before)])
    assert sorted(r["copy"] for r in kept) == sorted(before[n]["copy"] for n in want)
    assert len(kept) < len(before) - 20


def test_mixing_repeats_by_the_distribution(stages):
    _, (_, _, before, mixed, _) = stages
    sizes = Counter(r["source"] for r in before)
    want = Counter({r["copy"]: quantile(len(before) / len(sizes) / sizes[r["source"]], uniform(mixing.SEED, r["doc_id"])) for r in before})
    assert Counter(r["copy"] for r in mixed) == +want


def test_packing_holds_every_token(stages):
    _, (*_, before, pieces) = stages
    exact = Tokenizer.from_file(TOKENIZER)
    want, got, sizes = Counter(), Counter(), Counter()
    for r in before:
        want.update(exact.encode(r["text"], add_special_tokens=False).ids + [1])
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"]
        got.update(ids)
        sizes[p["sequence_id"]] += p["length"]
    assert got == want and max(sizes.values()) <= 2048


def test_run_is_the_stages(spark, stages):
    folder, (*_, pieces) = stages
    got = C.run(spark, str(folder)).collect()
    assert Counter((r.doc_id, r.start, r.doc_tokens) for r in got if r.start == 0) == Counter((p["doc_id"], p["start"], p["doc_tokens"]) for p in pieces if p["start"] == 0)


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_a_source_of_one_row_and_no_language_at_all(spark, tmp_path):
    """Equal weights give the lone row a third of the output; without a learned language all texts with a letter stay."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(9000)}" for _ in range(12)), None, "big" if i > 1 else f"small{i}", 1) for i in range(3000)] + [(5000, "12 !", None, "big", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.start) for r in C.run(spark, str(tmp_path)).where("start = 0").collect())
    assert {i: got[(i, 0)] for i in (0, 1)} == {i: draws(1000, i) for i in (0, 1)} and (5000, 0) not in got and sum(got.values()) > 2500
