"""Operator 7: an exact round trip and the limits."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from plumbline.llm import packing as P
from plumbline.llm.tokens import TOKENIZER, encoder

TEXTS = ["", None, "One two three.", "x" * 9000, "Ünïcode ß 12,5 €", "<|endoftext|> spelled", "日本語 text", "a b c\x85d\x1ce", "word " * 5000, "tiny", "tiny"]


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(TOKENIZER)


def test_ids_equal_the_tokenizer_on_odd_texts(exact):
    rng = np.random.default_rng(3)
    points = [*range(1, 0x250), *range(0x2010, 0x205F), 0x20AC]
    texts = [t for t in TEXTS if t] + ["".join(map(chr, rng.choice(points, 60))) for _ in range(300)]
    for t in texts:
        assert encoder().encode(t).tolist() == exact.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("text", [" " * 1_200_000, "word" + " " * 1_200_000 + "end.", "\n" * 1_200_000, "ab " * 400_000, "z" * 1_200_000])
def test_ids_equal_the_tokenizer_on_long_runs(exact, text):
    ids = encoder().encode(text)
    assert np.array_equal(ids, exact.encode(text, add_special_tokens=False).ids)
    assert exact.decode(ids.tolist(), skip_special_tokens=False) == text


def expected(exact, text, prompt=None):
    head = exact.encode(prompt, add_special_tokens=False).ids if prompt else []
    return head + exact.encode(text or "", add_special_tokens=False).ids + [1], len(head)


@pytest.mark.parametrize("limits", [{}, {"max_tokens": 64, "max_segments": 3, "max_loss_tokens": 40}])
def test_round_trip_and_limits(spark, exact, limits):
    rows = [(i, t, "Prompt text here" if i % 3 == 0 else None, 5) for i, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt string, length int").repartition(2)
    pieces = [r.asDict() for r in P.pack(df, **limits).collect()]
    tokens, segments, loss = (limits.get(k, d) for k, d in (("max_tokens", 2048), ("max_segments", 512), ("max_loss_tokens", 2048)))
    docs, sequences = {}, {}
    for p in pieces:
        p["ids"] = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(p["ids"]) == p["length"] > 0
        docs.setdefault(p["doc_id"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert set(docs) == {r[0] for r in rows}
    for i, text, prompt, _ in rows:
        parts, (want, free) = sorted(docs[i], key=lambda p: p["start"]), expected(exact, text, prompt)
        assert sum((p["ids"] for p in parts), []) == want
        assert {p["doc_tokens"] for p in parts} == {len(want)}
        assert [p["start"] for p in parts] == np.cumsum([0, *(p["length"] for p in parts)])[:-1].tolist()
        assert sum(p["loss_tokens"] for p in parts) == len(want) - free
    for own in sequences.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == np.cumsum([0, *(p["length"] for p in own)])[:-1].tolist()
        assert sum(p["length"] for p in own) <= tokens and len(own) <= segments
        assert sum(p["loss_tokens"] for p in own) <= loss
    if not limits:
        sizes = [sum(p["length"] for p in own) for own in sequences.values()]
        assert all(n == 2048 or n & (n - 1) == 0 for n in sizes)


def test_dot_product_prefers_the_roomier_bin():
    packer = P.Packer(10, 4, 10)
    for n in (6, 8, 3):
        assert not list(packer.add(P.Example(n, np.zeros(n, np.uint32), 0)))
    assert [s.tokens for s in packer.open] == [9, 8]


def test_empty_table_and_bad_limits(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        P.Packer(0, 1, 1)
