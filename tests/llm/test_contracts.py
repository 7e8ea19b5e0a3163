"""What the queries of the contract return, each called as the driver calls it."""

import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from test_classifiers import corpus
from test_exact_dedup import TEXTS, brute, key
from test_urlfilter import brute as judged
from test_urlfilter import urls
from tokenizers import Tokenizer

from plumbline.llm import queries, urlfilter
from plumbline.llm.tokens import TOKENIZER, encoder

DATA = Path("/root/testdata/sf0.01/documents.parquet")


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def test_op3(spark, tmp_path):
    rows = list(enumerate(urls()))
    spark.createDataFrame([(i, u, "h", "block") for i, u in rows], "page_id long, url string, host string, verdict string").write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op3_urlfilter"](spark, str(tmp_path))
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted((i, *judged(u, urlfilter.RULES)) for i, u in rows)


def test_op4(spark, tmp_path):
    rows = corpus(300)
    odd = [(900, None), (901, ""), (None, "a b"), (5, rows[5][1])]
    spark.createDataFrame([(r[0], r[1], 0.1, "x") for r in rows] + [(i, t, 0.9, "x") for i, t in odd], "doc_id long, text string, score double, held_out string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], r[3], 0) for r in rows] + [(7, None, 1), (None, 1, 1)]
    held = [r[0] for r in rows if crc(r[0]) % 4 == 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.QUERIES["op4_quality"](spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert Counter(r.doc_id for r in found) == Counter([r[0] for r in rows] + [i for i, _ in odd])
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    good = {r[0]: r[3] for r in rows}
    assert len(held) > 40 and np.mean([r.predicted == good[r.doc_id] for r in found if r.doc_id in held]) > 0.9
    # labels of held-out rows change nothing
    (tmp_path / "other").mkdir()
    spark.createDataFrame([(i, 1 - q if i in held and q is not None else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "other" / "labels.parquet"))
    spark.read.parquet(str(tmp_path / "documents.parquet")).write.parquet(str(tmp_path / "other" / "documents.parquet"))
    again = Counter((r.doc_id, round(r.score, 6)) for r in queries.QUERIES["op4_quality"](spark, str(tmp_path / "other")).collect())
    assert again == Counter((r.doc_id, round(r.score, 6)) for r in found)


def test_op5(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "ab"), (1, "ab"), (1, "ab")]
    spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, keep_id int").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op5_exact_dedup"](spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=key) == sorted(brute(rows), key=key)


def test_op6(spark, tmp_path):
    rows = corpus(300)
    odd = [(900, None, "en"), (901, "", None), (902, "12 !!", "de"), (None, rows[1][1], None), (7, rows[7][1], rows[7][2])]
    every = [(r[0], r[1], None if r[0] % 10 == 3 else r[2]) for r in rows] + odd
    spark.createDataFrame([(*r, "s", 2.0) for r in every], "doc_id long, text string, lang string, source string, score double").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op6_language"](spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in every)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found if r.held_out and r.doc_id in truth]) > 0.95
    assert {r.doc_id: (r.lang_pred, r.score) for r in found if r.doc_id in (900, 901, 902)} == {i: ("und", 0.0) for i in (900, 901, 902)}
    assert len({(r.lang_pred, r.score) for r in found if r.doc_id == 7}) == 1


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_op7_on_the_driver_table(spark):
    """Every id of every document, as the tokenizer file gives it, in exactly one piece."""
    got = queries.QUERIES["op7_packing"](spark, str(DATA.parent))
    assert got.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(str(DATA)).collect()}
    exact = Tokenizer.from_file(TOKENIZER)
    names = sorted(docs)
    ids = {i: [*e.ids, 1] for i, e in zip(names, exact.encode_batch([docs[i] for i in names], add_special_tokens=False), strict=True)}
    fast = encoder().encode
    assert all(fast(docs[i]).tolist() == ids[i][:-1] for i in names)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    assert sorted(pieces) == names
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.01 * sum(map(len, ids.values())) and math.isfinite(padding)
