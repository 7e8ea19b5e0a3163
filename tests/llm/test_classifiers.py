"""Operators 4 and 6: held-out accuracy, and what they do with odd inputs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import language as L
from plumbline.llm import quality as Q

SYLLABLES = {"en": "th er on an re he in ed".split(), "de": "ch ei sch ung lich be ge en".split(), "fr": "eau que oi tion é ai ment le".split(), "es": "ción os que ado ez ñ ra mente".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def corpus(n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text, good = prose(rng, lang, rng.randint(20, 80)), rng.random() < 0.7
        if not good:
            text = " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in text.split())
        rows.append((i, text, lang, int(good)))
    return rows


def test_quality_learns_and_is_calibrated(spark):
    rows = corpus()
    docs = spark.createDataFrame([(r[0], r[1], "x", 2.0) for r in rows] + [(900, None, "x", 1.0), (901, "", "x", 1.0), (902, "A" * 300_000, "x", 1.0)], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows if r[0] % 4 != 2] + [(1, None), (None, 1)], "doc_id long, label int")
    got = {r.doc_id: r.score for r in Q.classify(docs, labels).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= s <= 1 for s in got.values())
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([(got[r[0]] >= 0.5) == r[3] for r in held]) > 0.95
    assert got[900] == got[901]
    again = {r.doc_id: r.score for r in Q.classify(docs.repartition(7), labels).collect()}
    assert again == pytest.approx(got, abs=1e-6)


def test_quality_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert [r.score for r in Q.classify(docs, labels).collect()] == [0.5, 0.5]
    assert {r.score for r in Q.classify(docs, spark.createDataFrame([(1, 1)], "doc_id long, label int")).collect()} == {1.0}
    assert Q.classify(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0


def naive_tokens(text):
    """Runs of letters (all bytes beyond ASCII are letters), digits or symbols, as bucket numbers, one byte after the other."""
    kinds, runs = {}, []
    for b in range(256):
        c = chr(b)
        kinds[b] = 1 if b >= 128 or c.isalpha() and b < 128 else 2 if c.isdigit() and b < 128 else 3 if 33 <= b < 128 else 0
    for b in text.encode():
        if runs and runs[-1][0] == kinds[b]:
            runs[-1][1].append(b)
        else:
            runs.append((kinds[b], [b]))
    out = []
    for kind, own in runs:
        if kind:
            h = sum(((b + 32 if 65 <= b <= 90 else b) + 1) * pow(Q._BASE, i, 1 << 64) for i, b in enumerate(own)) % (1 << 64)
            h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9) % (1 << 64)
            capitals = sum(65 <= b <= 90 for b in own)
            shape = 3 if kind != 1 else 2 if capitals == len(own) > 1 else 1 if capitals else 0
            out.append(shape * (Q.BUCKETS // 4) + (h >> 32) % (Q.BUCKETS // 4))
    return out


def test_quality_equals_a_plain_computation(spark, monkeypatch):
    """Random indexing, pooling and the network's forward pass, token by token."""
    rows = corpus(60)
    texts = [r[1] for r in rows] + ["", "One", "ÄÖ ß 12-34 ABC abc Abc", "same same same"]
    dims, signs = Q.index_vectors()
    vectors = np.zeros((Q.BUCKETS, Q.DIMS))
    for text in texts:
        own = naive_tokens(text)
        for i, t in enumerate(own):
            for j in range(max(0, i - Q.WINDOW), min(len(own), i + Q.WINDOW + 1)):
                if j != i:
                    for d, s in zip(dims[own[j]], signs[own[j]], strict=True):
                        vectors[t, d] += s
    vectors = np.array([v / max(math.sqrt(sum(x * x for x in v)), 1e-9) for v in vectors])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert np.allclose(Q.word_vectors(docs), vectors, atol=1e-6)
    pooled = []
    for text in texts:
        own = [vectors[t] for t in naive_tokens(text)]
        n = max(1, len(own))
        mean = sum(own, np.zeros(Q.DIMS)) / n
        spread = np.sqrt(np.maximum(sum((v * v for v in own), np.zeros(Q.DIMS)) / n - mean**2, 0))
        near = sum(float(a @ b) for a, b in zip(own, own[1:])) / max(1, len(own) - 1)
        pooled.append([*mean, *spread, near, math.log1p(len(own))])
    fitted = []
    fit = Q.Network.fit
    monkeypatch.setattr(Q.Network, "fit", lambda self, *a: fitted.append(fit(self, *a)) or self)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, label int")
    got = {r.doc_id: r.score for r in Q.classify(docs, labels).collect()}
    (net,) = fitted
    a, b, c, d = net.weights
    for i, x in enumerate(pooled):
        z = [(v - m) / s for v, m, s in zip(x, net.mean, net.scale, strict=True)]
        hidden = [math.tanh(sum(z[k] * a[k, h] for k in range(len(z))) + b[h]) for h in range(Q.HIDDEN)]
        logit = sum(u * w for u, w in zip(hidden, c, strict=True)) + d[0]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-logit / net.temperature)), abs=1e-3)


def test_the_temperature_has_the_least_loss():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, Q.POOLED))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    held = np.arange(400) % 5 == 4
    net = Q.Network().fit(x, y, held)

    def loss(t):
        p = 1 / (1 + np.exp(-net._logits(x[held]) / t))
        return -np.mean(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p))

    assert loss(net.temperature) <= min(loss(t) for t in (0.5, 1.0, 2.0, 4.0)) + 1e-3


def test_one_labelled_id_in_very_many_rows(spark):
    """The rows of one id reach the driver as one."""
    rows = corpus(40)
    many = spark.range(20_000).selectExpr("7L AS doc_id", f"'{rows[7][1]}' AS text")
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string").union(many)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, label int")
    once = {r.doc_id: r.score for r in Q.classify(docs, labels).groupBy("doc_id").agg(Q.F.max("score").alias("score")).collect()}
    assert len(once) == 40
    lang = docs.withColumn("lang", Q.F.when(Q.F.col("doc_id") % 2 == 0, "en").otherwise("fr"))
    model = L.learn(lang)
    assert model.top.classes and L.learn(lang.dropDuplicates(["doc_id"])).top.planes.tolist() == model.top.planes.tolist()


def test_tokens_are_runs_of_one_kind_and_rows_stay_apart():
    texts = [b"ab cd", b"", b"AB!!12", b"ab"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0, *map(len, texts)])
    bucket, row = Q.tokens(data, bounds)
    assert row.tolist() == [0, 0, 2, 2, 2, 3]
    assert bucket[0] == bucket[5] != bucket[1]
    assert (bucket // (Q.BUCKETS // 4)).tolist() == [0, 0, 2, 3, 3, 0]


def test_language_on_held_out_rows(spark):
    rows = corpus()
    odd = [(900, None), (901, ""), (902, "12 !! 7"), (903, "che " * 100_000)]
    docs = spark.createDataFrame([(r[0], r[1], "q", 0.1) for r in rows] + [(i, t, "q", 0.1) for i, t in odd], "doc_id long, text string, lang_pred string, score double")
    labelled = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows if r[0] % 3 != 1] + [(903, odd[3][1], None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.identify(docs, labelled).collect()}
    assert np.mean([got[r[0]].lang_pred == r[2] for r in rows if r[0] % 3 == 1]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in SYLLABLES
    kept = L.keep_identified(docs, labelled)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got) - {900, 901, 902}


def naive_features(text):
    """Hashed one- to three-byte runs of the lower-cased letters, anything else as a space."""
    own = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    counts = [0] * L.FEATURES
    for n in (1, 2, 3):
        for i in range(len(own) - n + 1):
            gram = 0
            for j, b in enumerate(reversed(own[i : i + n])):
                gram += b * 257**j
            # the newest byte has the factor 1, older ones 257 each
            counts[(gram * (0x9E3779B97F4A7C15 + 2 * n) % (1 << 64)) >> 53] += 1
    root = [math.sqrt(c) for c in counts]
    norm = max(math.sqrt(sum(r * r for r in root)), 1e-9)
    return [r / norm for r in root]


def test_language_equals_a_plain_computation():
    """Features, the machines' descent, the votes and the two levels, each from its definition."""
    rows = corpus(24)
    texts = [r[1][:60] for r in rows]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.cumsum([0, *(len(t.encode()) for t in texts)])
    x = L.features(data, bounds)
    assert np.allclose(x, [naive_features(t) for t in texts], atol=1e-5)
    languages = np.array([r[2] for r in rows], dtype=object)
    # one machine: squared hinge loss, both sides of equal weight, by accelerated gradient
    side = np.where(languages == "en", 1.0, -1.0)
    w = ahead = np.zeros(L.FEATURES + 1)
    for step in range(L.STEPS):
        grad = L.RIDGE * ahead
        for v, s in zip(x, side, strict=True):
            v = np.append(v, 1.0)
            slack = max(0.0, 1 - s * float(v @ ahead))
            grad = grad - 2 * (0.5 / max(1, (side == s).sum())) * slack * s * v
        new = ahead - 0.2 * grad
        ahead, w = new + step / (step + 3) * (new - w), new
    assert np.allclose(L.machine(x, side), w, atol=1e-4)
    model = L.Hierarchy().fit(x, languages)
    assert model.top.classes == ["germanic", "romance"] and model.below["romance"].classes == ["es", "fr"]

    def decided(votes, v):
        if not votes.pairs:
            return votes.classes[0], 1 / (1 + math.exp(-4 * 20.0))
        wins, sums, least = Counter(), Counter(), {}
        for (a, b), plane in zip(votes.pairs, votes.planes, strict=True):
            m = float(v @ plane[:-1] + plane[-1])
            wins[a if m >= 0 else b] += 1
            for c, own in ((a, m), (b, -m)):
                sums[c] += own
                least[c] = min(least.get(c, 20.0), own)
        best = max(range(len(votes.classes)), key=lambda c: (wins[c], sums[c]))
        return votes.classes[best], 1 / (1 + math.exp(-4 * least[best]))

    names, scores = model.predict(x)
    for i, v in enumerate(x):
        kin, sure = decided(model.top, v)
        name, score = decided(model.below[kin], v)
        assert names[i] == name and scores[i] == pytest.approx(sure * score, abs=1e-4)


def test_every_language_is_learned_and_machines_grow_with_their_number(spark):
    """300 names beside four languages: all are learned, in levels of at most ``WIDE`` classes; the frequent ones are still told apart."""
    rows = corpus(240)
    dirty = [(1000 + i, prose(random.Random(i), "en", 9), f"x{i}") for i in range(300)]
    labelled = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows if r[0] % 3 != 1] + dirty, "doc_id long, text string, lang string")
    model = L.learn(labelled)
    assert model.languages == sorted([*SYLLABLES, *(f"x{i}" for i in range(300))])
    assert max(len(v.classes) for v in model.votes.values()) <= L.WIDE and sum(len(v.pairs) for v in model.votes.values()) < 10 * 304
    assert all(np.abs(v.planes).max(axis=1).min() > 0 for v in model.votes.values() if v.pairs)  # no machine is left unfitted
    held = [r for r in rows if r[0] % 3 == 1 and r[2] != "en"]
    names, _ = model.predict(np.array([L.scaled(L.grams(np.frombuffer(r[1].encode(), np.uint8))) for r in held], np.float32))
    assert np.mean([a == r[2] for a, r in zip(names, held, strict=True)]) > 0.9


def test_machines_of_tasks_equal_those_fitted_here(spark, monkeypatch):
    """Flat families and, with a small ``WIDE``, levels of groups; an id in several rows counts once, whatever its other rows are."""
    rows = corpus(80)
    rows += [(i, t, f"own{i % 5}", 1) for i, t, _, _ in corpus(120)[80:]]
    labelled = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows] + [(0, None, "en"), (None, "abc", "en"), (rows[1][0], rows[1][1], rows[1][2])], "doc_id long, text string, lang string")
    x = np.array([L.scaled(L.grams(np.frombuffer(r[1].encode(), np.uint8))) for r in rows], np.float32)
    for wide in (16, 3):
        monkeypatch.setattr(L, "WIDE", wide)
        here = L.Hierarchy().fit(x, np.array([r[2] for r in rows], dtype=object))
        there = L.learn(labelled)
        assert there.votes.keys() == here.votes.keys() and (max(map(len, here.votes)) > 1) == (wide == 3)
        for path, votes in here.votes.items():
            assert there.votes[path].classes == votes.classes
            assert np.allclose(there.votes[path].planes, votes.planes, atol=1e-3)


def test_texts_of_no_language_go_from_the_pipeline(spark):
    """Far from every language the machines disagree: the score, not the letters, decides."""
    rows = corpus()
    labelled = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "doc_id long, text string, lang string")
    strange = [(5000 + i, " ".join("qxzj" [i % 4] * 9 for _ in range(40))) for i in range(4)]
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + strange, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in L.identify(docs, labelled).collect()}
    bar = (max(scores[i] for i, _ in strange) + min(scores[r[0]] for r in rows)) / 2
    assert {r.doc_id for r in L.keep_identified(docs, labelled, bar).collect()} == {i for i, s in scores.items() if s >= bar}
    assert {r[0] for r in rows} <= {r.doc_id for r in L.keep_identified(docs, labelled).collect()}


def test_language_with_few_or_no_languages(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(docs, none).orderBy("doc_id").collect()] == ["und", "und"]
    one = spark.createDataFrame([(1, "abc", "xx")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in L.identify(docs, one).orderBy("doc_id").collect()] == ["xx", "und"]
    assert L.identify(none.select("doc_id", "text"), one).count() == 0


def test_features_do_not_depend_on_chunks(monkeypatch):
    data = np.frombuffer(("Some text, and more " * 50).encode(), np.uint8)
    whole = L.features(data, np.array([0, len(data)]))
    monkeypatch.setattr(L, "_CHUNK", 37)
    assert np.allclose(whole, L.features(data, np.array([0, len(data)])))


def test_rows_stay_where_no_language_was_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, None), (3, "12 !", None), (4, "d", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in L.keep_identified(docs, docs).collect()) == [1, 4]
