"""Whole runs on small tables."""

import datetime
import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import EqualTo, In

from plumbline import cli, engine, policies
from plumbline.functions.canonical import hash_holds, with_hash
from plumbline.operators import decisions, probes, spans
from plumbline.sources import ledger, readers, web
from plumbline.streaming import claims as streaming

POLICY = policies.SupportPolicy("p", "1", "2024-01-01", policies.Detector("exact", "m", "1"), 0.5)
CLAIM = "claim_id string, text string, question string, source_id string, uri string, excerpt string, locator string, provenance_class string"


def tables(spark):
    claims = spark.createDataFrame(
        [
            ("a", "Revenue was 5.", "How much?", "s", "u", "revenue WAS 5", None, "unclassified"), ("b", "Costs fell.", None, "s", "u", "Costs rose a lot in that year", None, "company_assertion"),
            ("c", "Own view.", None, None, None, None, None, "analyst_inference"), ("d", "Gone.", None, "t", "v", "x", None, "unclassified"), ("e", "Boom now.", None, "s", "u", None, "p. 1", "unclassified"),
        ],
        CLAIM,
    )
    sources = spark.createDataFrame([("s", "u", "Revenue was 5. Other things stand here too.", None), ("t", "v", None, "source_paywalled")], "source_id string, uri string, text string, failure string")
    return claims, sources


def test_check(spark):
    run = engine.check(*tables(spark), POLICY)
    got = {r.claim_id: (r.method, r.anchor, r.status, r.kind, r.outcome) for r in run["accounts"].collect()}
    assert got == {
        "a": ("exact", "found", "supported", "unknown_authority", "withheld"), "b": ("fuzzy", "not_found", "insufficient", "subject_provided", "needs_validation"),
        "c": ("provenance", None, "not_assessed", "analyst_derived", "not_assessed"), "d": ("fetch_failed", None, "source_unavailable", "unknown_authority", "source_unavailable"),
        "e": ("locator", None, "insufficient", "unknown_authority", "needs_validation"),
    }
    assert {r.name: (r.numerator, r.denominator) for r in run["rates"].collect()}["citation_coverage"] == (4, 5)
    assert {r.status: r.n for r in run["support_counts"].collect()} == {"supported": 1, "insufficient": 2, "not_assessed": 1, "source_unavailable": 1, "contradicted": 0}


def test_a_failing_detector_stays_in_its_row(spark):
    def assess(source, claim, question):
        if "Boom" in claim:
            raise KeyError("x")
        wrong = [{"start": 0, "end": 3, "text": "zzz"}] if "Costs" in claim else []
        return {"label": "supported", "confidence": 0.9, "spans": wrong}

    run = engine.check(*tables(spark), POLICY, assess)
    got = {r.claim_id: (r.status, r.support_failure) for r in run["accounts"].collect()}
    assert got["a"] == ("supported", None) and got["e"] == ("not_assessed", "detector_error:KeyError") and got["b"] == ("not_assessed", "detector_error:SpanMismatch")


def test_analyse(spark):
    pack = policies.DomainPack("k", "1", "K", "contract", "Look.", (policies.Category("a", "Alpha", 5), policies.Category("b", "Beta", 2, "second")))
    docs = spark.createDataFrame([("d", "one alpha here. " + "x" * 40 + " two alpha there."), ("e", "")], "doc string, text string")

    def complete(rows):
        def reply(prompt):
            chunk = prompt.rsplit("The contract:\n", 1)[1]
            if "two" in chunk:
                return "no json"
            return "so: " + json.dumps({"findings": {"Alpha": [w for w in ("one alpha", "never said") if w in chunk or "never" in w], "Other": ["one"]}, "checked_categories": ["Alpha", "Beta"]})

        return readers.with_backend(rows, reply)

    run = engine.analyse(docs, pack, complete, size=40, overlap=5)
    assert [(r.doc, r.category, r.quote, r.severity, r.offsets) for r in run["findings"].collect()] == [("d", "Alpha", "one alpha", 5, [0])]
    assert {(r.doc, r.category): r.status for r in run["coverage"].collect()} == {("d", "Alpha"): "risk_found", ("d", "Beta"): "incomplete", ("e", "Alpha"): "checked_clear", ("e", "Beta"): "checked_clear"}
    assert pack.job_sha256 != pack.manifest_sha256
    assert pack.block() == "- Alpha\n- Beta: second"


def test_bakeoff_and_manifest(spark):
    cases = spark.createDataFrame([("1", "src", "a", None, "supported", "k"), ("2", "src", "b", None, "contradicted", "k")], "case_id string, source_text string, claim_text string, question string, expected_status string, kind string")
    yes, low = (lambda *_: {"label": "supported", "confidence": 0.9}), (lambda *_: {"label": "supported", "confidence": 0.1})
    runs = engine.bakeoff(cases, {"yes": (POLICY, yes), "low": (POLICY, low)})
    assert {r.policy_key: r.correct for r in engine.bakeoff_scores(runs).collect()} == {"yes": 1, "low": 0}
    one = engine.manifest({"runs": runs}, policy=POLICY.sha256)
    assert hash_holds(one) and one == engine.manifest({"runs": runs.orderBy(F.desc("case_id"))}, policy=POLICY.sha256)
    with pytest.raises(ValueError):
        engine.bakeoff(cases, {})


def test_scorers(spark):
    df = spark.createDataFrame([("a", "b"), ("x", "y"), ("big", "z")], "q string, e string")
    rate = engine.scorer(lambda q, e: {"a": 0.5, "big": 7.0}[q])
    assert [r.s for r in df.select(rate(F.col("q"), F.col("e")).alias("s")).collect()] == [0.5, None, None]


def test_policies(tmp_path):
    with pytest.raises(ValueError):
        policies.Detector("a", "m", "latest")
    with pytest.raises(ValueError):
        policies.ArenaPolicy("k", "1", ("a", "a"))
    plan = policies.Plan("p", "accuracy", 0.1, ("base",), ("new",), "h")
    plan.admits("base", "new", "h")
    for wrong in (("new", "new", "h"), ("base", "new", "other")):
        with pytest.raises(ValueError):
            plan.admits(*wrong)
    path = tmp_path / "pack.json"
    path.write_text(json.dumps(with_hash({"cases": [{"case_id": "1"}]})))
    assert policies.load_pack(path, 1) == [{"case_id": "1"}]
    with pytest.raises(ValueError):
        policies.load_pack(path, 2)
    (tmp_path / "a.py").write_text("x = 1")
    first = policies.source_tree_sha256(tmp_path)
    (tmp_path / "a.py").write_text("x = 2")
    assert policies.source_tree_sha256(tmp_path) != first


def test_process(spark, tmp_path):
    claims, sources = tables(spark)
    claims.write.parquet(str(tmp_path / "c"))
    sources.write.parquet(str(tmp_path / "s"))
    request = {"claims": str(tmp_path / "c"), "sources": str(tmp_path / "s"), "output": str(tmp_path / "o"), "policy": {"key": "p", "version": "1", "frozen_at": "2024", "min_confidence": 1.0}}
    response = cli.execute(spark, request)
    assert hash_holds(response) and len(response["rates"]) == 6
    with pytest.raises(ValueError):
        cli.execute(spark, {"claims": "x"})


def test_sentence_packing(spark):
    df = spark.createDataFrame([(["a b c", "d e", "f g h i j k", "l"], "a b c d e f g h i j k l"), ([], "no sentence")], "s array<string>, t string")
    got = [r.p for r in df.select(spans.pack_sentences(F.col("s"), 5).alias("p")).collect()]
    assert got == [["a b c d e", "f g h i j k", "l"], []]
    got = [r.p for r in df.select(spans.even_chunks(F.col("t"), F.col("s"), 6).alias("p")).collect()]
    assert got == [["a b c", "d e", "f g h i j k", "l"], ["no sentence"]]


def test_case_rules(spark):
    schema = "case_id string, kind string, expected_status string, provenance string, parents array<string>, reviewers array<string>, original_start int, original_end int, original_text string, claim_text string, present_start int, present_end int"
    good = ("1", "verbatim_supported", "supported", "attested", [], [], 0, 3, "abc", "abc", 0, 3)
    bad = ("2", "contradicted", "supported", "derived", [], [], 0, 3, "abc", "x", 5, 6)
    got = {(r.case_id, r.rule) for r in probes.case_violations(spark.createDataFrame([good, bad], schema)).collect()}
    assert got == {("2", "wrong_status"), ("2", "no_parent"), ("2", "claim_offsets")}
    rows = spark.createDataFrame([("d", 0, 3, "abc"), ("d", 1, 3, "zz"), ("q", 0, 1, "x")], "source_id string, start int, end int, span_text string").withColumn("source_sha256", F.sha2(F.lit("abcdef"), 256))
    docs = spark.createDataFrame([("d", "abcdef")], "source_id string, text string")
    assert sorted(r.span_text for r in probes.span_violations(rows, docs).collect()) == ["x", "zz"]


def test_stream(spark, tmp_path):
    claims, sources = tables(spark)
    stamped = claims.withColumn("arrived", F.lit(datetime.datetime(2024, 1, 1)).cast("timestamp"))
    for part in ("1", "2"):
        stamped.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streaming.verify_stream(stream, sources, lambda df, n: seen.extend(df.collect()), str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert sorted(r.claim_id for r in seen) == ["a", "b", "c", "d", "e"]
    assert {r.claim_id: r.method for r in seen}["a"] == "exact"


def asked(uri, timeout):
    """A server that notes what it is asked."""
    with open(os.environ["ASKED"], "a") as log:
        log.write(uri + "\n")
    if "bad" in uri:
        raise TimeoutError(uri)
    return 200, "text/plain", uri.encode()


def test_requests_are_bounded_by_file_and_filters_reach_the_scan(spark, tmp_path, monkeypatch):
    log = tmp_path / "asked"
    monkeypatch.setenv("ASKED", str(log))
    opener = "plumbline.sources.web:open_url"
    uris = [f"http://Hot.org/{i}" for i in range(230)] + [f"https://h{i}.net/?bad" for i in range(20)] + ["http://hot.org/1", None]
    web.write_requests(spark.createDataFrame([(u,) for u in uris], "uri string"), str(tmp_path / "r"), 40)
    sizes = [pq.read_metadata(f).num_rows for f in (tmp_path / "r").glob("*.parquet")]
    assert sum(sizes) == 251 and max(sizes) <= 80
    reader = web.PageReader({"path": str(tmp_path / "r"), "opener": opener})
    monkeypatch.setattr(web, "named", lambda _: asked)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 251 and sum(r[4] == "TimeoutError" for r in rows) == 20 and {r[3] for r in rows if r[3]} == {u for u in uris if u and "bad" not in u}
    log.unlink()
    only = web.PageReader({"path": str(tmp_path / "r")})
    kept = list(only.pushFilters([In(("uri",), ("http://Hot.org/3", "http://Hot.org/4")), EqualTo(("uri",), "http://Hot.org/4"), EqualTo(("status",), 200)]))
    assert kept == [EqualTo(("status",), 200)]
    assert [r[0] for p in only.partitions() for r in only.read(p)] == ["http://Hot.org/4"] and log.read_text().split() == ["http://Hot.org/4"]


def test_the_source_is_read_through_spark(spark, tmp_path):
    web.write_requests(spark.createDataFrame([("http://127.0.0.1:9/x",), ("no uri",)], "uri string"), str(tmp_path / "r"))
    pages = web.read_pages(spark, str(tmp_path / "r"), timeout=1)
    assert sorted((r.uri, r.status, r.error) for r in pages.collect()) == [("http://127.0.0.1:9/x", None, "URLError"), ("no uri", None, "ValueError")]
    assert [r.failure for r in web.resolved(pages.where("uri = 'no uri'")).collect()] == ["source_unreachable"]


def test_a_run_that_broke_off_goes_on(spark, tmp_path):
    def inputs(texts):
        return spark.createDataFrame(list(texts.items()), "id int, text string").withColumn("input_sha256", F.sha2(F.concat_ws("|", F.col("id").cast("string"), "text"), 256))

    def work(tag, broken=()):
        def of(rows):
            log.append(sorted(r.id for r in rows.collect()))
            if any(i in broken for i in log[-1]):
                raise RuntimeError("broken off")
            return rows.select("input_sha256", "id", F.concat(F.lit(tag), "text").alias("out"))

        return of

    def run(frame, folder, step):
        return ledger.run(frame, str(tmp_path / folder), "p", step, F.col("id") % 5)

    log, texts = [], {i: f"t{i}" for i in range(40)}
    assert run(inputs(texts), "whole", work("x")) == 5
    want = sorted(map(tuple, ledger.outputs(inputs(texts), str(tmp_path / "whole"), "p").select("id", "out").collect()))
    log.clear()
    with pytest.raises(RuntimeError):
        run(inputs(texts), "broken", work("x", broken=[2]))
    with pytest.raises(Exception, match="still pending"):
        ledger.outputs(inputs(texts), str(tmp_path / "broken"), "p").collect()
    assert run(inputs(texts), "broken", work("x")) == 3
    done = [i for batch in log[:2] + log[3:] for i in batch]
    assert sorted(done) == list(range(40)) and log[2] == log[3]
    assert sorted(map(tuple, ledger.outputs(inputs(texts), str(tmp_path / "broken"), "p").select("id", "out").collect())) == want
    log.clear()
    assert run(inputs(texts), "broken", work("y")) == 0 and log == []
    assert run(inputs({**texts, 7: "new"}), "broken", work("y")) == 1 and log == [[7]]
    assert ledger.run(inputs({1: "a"}), str(tmp_path / "broken"), "other policy", work("z"), F.lit(0)) == 1


def test_a_compacted_archive_keeps_the_newest_and_reads_the_keys_asked_for(spark, tmp_path):
    path = str(tmp_path / "archive")
    schema = "source_id string, uri string, text string, fetched_at string, status int, media_type string"
    for day in range(3):
        readers.write_snapshots(spark.createDataFrame([("s", f"u{i}", f"{i} on {day}", f"2024-01-0{day + 1}", 200, "text/plain") for i in range(40) if i % 3 >= day], schema), path)
    refs = spark.createDataFrame([(i, "s", f"u{i}") for i in range(42)] + [(50, "t", "u1"), (51, "s", None)], "i int, source_id string, uri string")
    before = sorted(map(tuple, readers.load_snapshots(refs, path).select("i", "text", "failure", "fetched_at").collect()))
    assert [(t, f) for i, t, f, _ in before if i in (4, 41, 50, 51)] == [("4 on 1", None), (None, "source_unreachable"), (None, "source_changed"), (None, "source_unreachable")]
    readers.compact_snapshots(spark, path)
    assert spark.read.parquet(path).count() == 40
    assert sorted(map(tuple, readers.load_snapshots(refs, path).select("i", "text", "failure", "fetched_at").collect())) == before
    assert len(list((tmp_path / "archive").glob("bucket=*"))) > 20 and [p.name for p in tmp_path.iterdir()] == ["archive"]


def test_raw_signals_keep_any_shape(spark):
    raw = ['{"a": [1, {"b": "x"}]}', "[]", "7", '"s"', "null", "{", "", None, '{"a": "no list"}']
    rows = decisions.raw_signals(spark.createDataFrame(list(enumerate(raw)), "i int, raw string"))
    got = rows.select("i", "broken", decisions.signal_at("$.a[1].b", "string").alias("b"), decisions.signal_at("$", "int").alias("n")).orderBy("i").collect()
    assert [r.broken for r in got] == [False] * 5 + [True, True, False, False]
    assert [r.b for r in got] == ["x"] + [None] * 8 and [r.n for r in got if r.n is not None] == [7]
    shapes = decisions.signal_shapes(rows.withColumn("of", F.lit("c")), "of").first()
    assert shapes.signals == 6 and shapes.broken == 2 and shapes["shape"]


def test_lines_keep_their_numbers_across_parts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = {}
    for name, n in (("a", 3000), ("b", 1), ("c", 700)):
        lines = ["" if i % 7 == 3 else '{"id": no}' if i % 11 == 5 else f'{{"id": {i}}}' for i in range(1, n + 1)]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")
        want |= {(name, i): x for i, x in enumerate(lines, 1)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 5
        got = {(r.file.rsplit("/", 1)[1], r.line): r.value for r in readers.numbered_lines(spark, str(tmp_path / "in")).collect()}
        bad = readers.read_jsonl(spark, str(tmp_path / "in"), T.StructType([T.StructField("id", T.LongType())]), numbered=True).where("problem is not null")
        assert {(r.file.rsplit("/", 1)[1], r.line) for r in bad.collect()} == {k for k, x in want.items() if "no" in x}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_configurations_are_known_by_what_they_do():
    a = policies.Renderer("html", "1", {"wide": True, "fonts": ["x"]})
    assert a.configuration_sha256 == policies.Renderer("pdf", "2", {"fonts": ["x"], "wide": True}).configuration_sha256 != policies.Renderer("html", "1").configuration_sha256
    for wrong in (lambda: policies.Renderer(" ", "1"), lambda: policies.Renderer("h", "1", {"x": float("nan")}), lambda: policies.Segmenter("k", "1", ()), lambda: policies.Segmenter("k", "1", (("md", "a"), ("md", "b"))), lambda: policies.Segmenter("k", "1", (("md", " "),))):
        with pytest.raises(ValueError):
            wrong()
    assert policies.Segmenter("k", "1", (("md", "a"), ("html", "b"))).sha256 == policies.Segmenter("k", "1", (("html", "b"), ("md", "a"))).sha256


def test_a_plan_is_frozen_after_its_review():
    of = policies.Detector("a", "m", "1")
    base, new = policies.SupportPolicy("base", "1", "d", of), policies.SupportPolicy("new", "1", "d", of, 0.5)
    plan = policies.freeze("p", "2024-01-01", "macro_f1", 0.1, [base], [new], "h", 30, 30)
    plan.admits("base", "new", "h", (base, new))
    assert plan.sha256 != policies.freeze("p", "2024-01-01", "macro_f1", 0.1, [base], [policies.SupportPolicy("new", "2", "d", of, 0.5)], "h", 30, 30).sha256
    for wrong in (
        lambda: policies.freeze("p", "d", "macro_f1", 0.1, [base], [new], "h", 30, 29), lambda: policies.freeze("p", "d", "macro_f1", 0.1, [base], [base], "h", 1, 1),
        lambda: policies.freeze("p", "d", "macro_f1", 0.1, [], [new], "h", 1, 1), lambda: plan.admits("base", "new", "h", (policies.SupportPolicy("new", "1", "d", of, 0.6),)),
    ):
        with pytest.raises(ValueError):
            wrong()


def test_a_worksheet_with_another_header_is_refused(spark, tmp_path):
    readers.write_worksheet(spark.createDataFrame([(1, "x")], "id int, other string"), str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)header|schema"):
        readers.read_worksheet(spark, str(tmp_path / "s"), "id int, decision string").collect()
