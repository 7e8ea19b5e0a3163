"""Operator 13 against the tokenizers themselves and a plain computation."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import alignment as L
from plumbline.llm import queries
from plumbline.llm.tokens import TOKENIZER

DATA = Path("/root/testdata/sf0.01/documents.parquet")
TEXTS = [
    None, "", " ", "  ", "\n", "a", "One two three.", "x" * 3000, "Ünïcode ß 12,5 €", "<|endoftext|> spelled <s> <unk> <0x0A>", "日本語 text 🙂", "has ▁ in it", "▁", "a b c\x85d\x1ce f", "tab\t\tand\r\n  lines \n\n end ",
    "word " * 300, "One two three.", "don't  we'll\n\nl'été", "　wide space \xa0nbsp", "\x00nul \x1f\x1e x", "é ́ a", "ﬁ № ①", "\t", " lead", "trail ", "हिन्दी العربية",
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(TOKENIZER)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=L.PIECES), L.entry_bytes(a.get_vocab())


def tokens(both, text):
    """(id, bytes) of both tokenizers' tokens, none where the bytes are not those of the text."""
    a, b, entries = both
    if not text:
        return [], []
    of_a = [(i, entries[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    of_b = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        of_b.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    return (of_a, of_b) if b"".join(x for _, x in of_a) == whole == b"".join(x for _, x in of_b) else ([], [])


def placed(toks):
    at, out = 0, []
    for i, x in toks:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(both, rows):
    docs = []
    for doc_id, text in rows:
        a, b = map(placed, tokens(both, text))
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, i, j, links = [], 0, 0, []
        for e in ends:
            x, y = i, j
            while i < len(a) and a[i][2] <= e:
                i += 1
            while j < len(b) and b[j][2] <= e:
                j += 1
            groups.append(",".join(str(t[0]) for t in a[x:i]) + "|" + ",".join(str(t[0]) for t in b[y:j]))
            links += [(s[0], t[0]) for s in a[x:i] for t in b[y:j] if s[1] < t[2] and t[1] < s[2]]
        docs.append((doc_id, len(a), len(b), groups, links))
    counts = Counter(p for d in docs for p in set(d[4]))
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return sorted(
        ((i, n_a, n_b, len(g), len(k), sum(counts[p] == highest[p[0]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "") for i, n_a, n_b, g, k in docs),
        key=repr,
    )


def test_chunks_give_the_ids_of_whole_texts(both):
    rng = np.random.default_rng(4)
    points = [*range(0, 0x250), *range(0x2000, 0x2070), 0x20AC, 0x3000, 0x2581, 0x1F642, 0xE0, 0x301, *[32] * 60, *[10] * 20]
    texts = [t for t in TEXTS if t] + ["".join(map(chr, rng.choice(points, 50))) for _ in range(400)]
    known = L.aligner()
    for text in texts:
        spans = list(known.spans(text))
        a, b = tokens(both, text)
        if None in spans:
            assert not a and not b, repr(text)
        else:
            assert np.concatenate([s[0] for s in spans]).tolist() == [i for i, _ in a], repr(text)
            assert np.concatenate([s[1] for s in spans]).tolist() == [i for i, _ in b], repr(text)


def test_spans_and_forgetting_change_nothing(monkeypatch):
    text = " ".join(str(x) for x in np.random.default_rng(1).integers(0, 10**6, 900)) + "  tail " * 70
    whole = L.Aligner(L.TOKENIZER, L.RANKS, L.PIECES).align(text, True)
    monkeypatch.setattr(L, "SPAN", 40)
    monkeypatch.setattr(L, "REMEMBERED", 3)
    parts = L.Aligner(L.TOKENIZER, L.RANKS, L.PIECES).align(text, True)
    assert (parts.n_groups, parts.n_links, parts.groups, parts.groups_sha256) == (whole.n_groups, whole.n_links, whole.groups, whole.groups_sha256)
    assert np.array_equal(parts.pairs, whole.pairs) and np.array_equal(parts.times, whole.times)
    assert hashlib.sha256(whole.groups.encode()).hexdigest() == whole.groups_sha256


@pytest.mark.parametrize("size", [L.BLOCK, 100])
def test_align_equals_the_plain_computation(spark, both, size):
    rows = [*enumerate(TEXTS), (None, "One two three."), (3, "One two four."), (3, "One two four.")]
    docs = spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, block string, pairs int")
    got = L.align(docs, block_chars=size)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(both, rows)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_op13(spark, both):
    rows = pq.read_table(DATA, columns=["doc_id", "text"])
    got = queries.QUERIES["op13_alignment"](spark, str(DATA.parent))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(both, list(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True)))


def test_an_empty_table_gives_no_rows(spark):
    assert L.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = L.align(spark.createDataFrame([(1, "ab c"), (2, None)], "doc_id long, text string"), keep_groups=True).collect()
    assert {r.doc_id: bool(r.groups) for r in kept} == {1: True, 2: False}
