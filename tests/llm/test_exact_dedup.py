"""Operator 5 against brute force."""

import hashlib
from collections import defaultdict

import pytest

from plumbline.llm import exact_dedup as E

TEXTS = ["a b", "ab", "a b", "", None, " \n", "long " * 3000, "long" * 3000, "long" * 3000 + "x", "long" * 2999 + "lonx", "é" * 5000, "é " * 5000, "ab"] + ["hot copy of one text"] * 60


def brute(rows):
    groups = defaultdict(list)
    for n, (doc_id, text) in enumerate(rows):
        norm = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups[norm].append((-len(text or ""), doc_id is None, doc_id or 0, n))
    out = []
    for norm, own in groups.items():
        keep = min(own)
        for x in own:
            out.append((rows[x[3]][0], rows[keep[3]][0], len(own), x == keep, hashlib.sha256(norm.encode()).hexdigest()))
    return out


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize("size", [7, 4096])
def test_equals_brute_force(spark, size):
    rows = [(i, t) for i, t in enumerate(TEXTS)][::-1] + [(None, "ab"), (1, "ab"), (1, "ab")]
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, name string, n int")
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in E.exact_dedup(docs, size).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    kept = E.keep_exact(docs, size)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[3] for r in got)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert E.exact_dedup(docs).count() == 0 and E.keep_exact(docs).count() == 0


def test_blocks_with_one_key_get_others(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    import xxhash

    def digest(block, seed):
        return bytes(16) if seed == 0 else xxhash.xxh3_128_digest(block, seed=seed)

    plain, other = ({(r.row, r.n): r.name for r in E.identities(docs, 7, **kw).collect()} for kw in ({}, {"digest": digest}))
    assert len(set(plain.values())) > 3 and plain.keys() == other.keys()
    assert len({(plain[k], other[k], k[1]) for k in plain}) == len({(x, k[1]) for k, x in plain.items()})
