"""Operators on small tables, by their rules."""

import json
import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from plumbline.functions import canonical
from plumbline.operators import arena, decisions, extraction, navigation, parity, probes, scoring, spans
from plumbline.sources import artifacts, readers


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- decisions ---------------------------------------------------------------------------------


def test_support_table(spark):
    df = spark.createDataFrame(
        [
            (1, False, False, None, None, "supported", 1.0), (2, True, False, None, None, "supported", 1.0), (3, True, True, "source_changed", None, "supported", 1.0),
            (4, True, True, None, "ValueError", "supported", 1.0), (5, True, True, None, None, "supported", None), (6, True, True, None, None, "contradicted", 0.9), (7, True, True, None, None, "supported", 0.1),
        ],
        "i int, cited boolean, resolved boolean, source_failure string, detector_error string, label string, confidence double",
    )
    assert rows(decisions.assess_support(df, 0.5), "i", "status", "failure") == [
        (1, "not_assessed", "no_source"), (2, "source_unavailable", "source_unreachable"), (3, "source_unavailable", "source_changed"),
        (4, "not_assessed", "detector_error:ValueError"), (5, "insufficient", None), (6, "contradicted", None), (7, "insufficient", None),
    ]
    assert rows(decisions.assess_support(df, None).where("i = 5"), "status", "label") == [("supported", "supported")]


@pytest.mark.parametrize(
    ("mode", "want"),
    [
        ("replay_only", {"a": "snapshot", "b": "snapshot_invalid", "c": "snapshot_missing", "d": "snapshot_missing"}),
        ("snapshot_preferred", {"a": "snapshot", "b": "snapshot_invalid", "c": "live_archived", "d": "live_failed"}),
        ("refresh", {"a": "live_failed", "b": "live_archived", "c": "live_archived", "d": "live_failed"}),
    ],
)
def test_acquisition_modes(spark, mode, want):
    refs = spark.createDataFrame([(s, f"u{s}") for s in "abcd"], "source_id string, uri string")
    snaps = spark.createDataFrame([("a", "ua", "text"), ("b", "ub", "text")], "source_id string, uri string, text string").withColumn("sha256", F.sha2(F.when(F.col("source_id") == "a", F.col("text")).otherwise("x"), 256))
    live = spark.createDataFrame([("ub", "new", None), ("uc", "new", None), ("ud", None, "source_paywalled")], "uri string, text string, failure string")
    got = decisions.acquire(refs, snaps, live, mode)
    assert dict(rows(got, "source_id", "strategy")) == want
    assert got.where("(text is null) = (failure is null)").count() == 0
    with pytest.raises(ValueError):
        decisions.acquire(refs, snaps, None, "refresh")
    with pytest.raises(ValueError):
        decisions.acquire(refs, snaps, live, "other")


def test_authority_and_unknown_declarations(spark):
    claims = spark.createDataFrame([(1, "analyst_inference"), (2, "company_assertion"), (3, "unclassified"), (4, "recommendation")], "claim_id int, provenance_class string")
    declared = spark.createDataFrame([(4, "independent_primary", "source_metadata", "x"), (9, "subject_provided", "b", "y")], "claim_id int, kind string, basis string, assigned_by string")
    assert rows(decisions.assign_authority(claims, declared), "claim_id", "kind") == [(1, "analyst_derived"), (2, "subject_provided"), (3, "unknown_authority"), (4, "independent_primary")]
    assert rows(decisions.unknown_declarations(claims, declared), "claim_id") == [(9,)]


def test_signals(spark):
    df = spark.createDataFrame([(1, "support", "m", "a", {"x": 0.5}), (1, "support", "m", "a", {"x": 0.2}), (2, "support", "m", "a", {"x": 1.5}), (3, "relevance", "m", "a", {"x": 0.5})], "claim_id int, role string, component string, input_sha256 string, scores map<string,double>")
    assert rows(decisions.invalid_signals(df), "claim_id") == [(1,), (2,)]
    claims = spark.createDataFrame([(1,), (5,)], "claim_id int")
    held = {r.claim_id: len(r.signals) for r in decisions.attach_signals(claims, df.withColumn("label", F.lit("l"))).collect()}
    assert held == {1: 2, 5: 0}


# --- extraction --------------------------------------------------------------------------------


def test_matches_are_many_to_many(spark):
    p = spark.createDataFrame([("d", "c", "a b c d"), ("d", "c", "a b c e"), ("d", "c", "zz"), ("d", "c", "!!"), ("e", "x", "q")], "doc string, category string, quote string")
    g = spark.createDataFrame([("d", "c", "a b c d"), ("d", "c", "other words"), ("f", "y", "lost")], "doc string, category string, span string")
    assert rows(extraction.precision_recall(extraction.match_counts(p, g)), "category", "tp", "fp", "fn", "precision") == [("c", 2, 2, 1, 0.5), ("x", 0, 1, 0, 0.0), ("y", 0, 0, 1, 0.0)]


def test_gate_fails_what_was_not_measured(spark):
    row = spark.createDataFrame([(0.6, 0, 0, 0, 0, None)], "macro_f1 double, grounded int, quotes int, tp int, fp int, probe_gap double")
    assert dict(rows(extraction.gate(row), "criterion", "passed")) == {"macro_f1": True, "grounding": False, "severe_precision": False, "probe_gap": False}
    row = spark.createDataFrame([(0.55, 95, 100, 7, 3, -0.9)], "macro_f1 double, grounded int, quotes int, tp int, fp int, probe_gap double")
    assert all(r.passed for r in extraction.gate(row).collect())


def test_merging_keeps_the_first_spelling(spark):
    f = spark.createDataFrame([("d", "c", 1, 0, "A  b"), ("d", "c", 0, 1, "a B"), ("d", "k", 0, 0, "a b")], "doc string, category string, segment int, ord int, quote string")
    assert rows(extraction.merge_findings(f), "category", "quote") == [("c", "a B"), ("k", "a b")]


def test_coverage(spark):
    s = spark.createDataFrame([("d", 0, ["a", "zz"]), ("d", 1, ["a", "b"]), ("e", 0, None), ("e", 1, ["a"])], "doc string, segment int, checked array<string>")
    f = spark.createDataFrame([("e", "a")], "doc string, category string")
    c = spark.createDataFrame([("a",), ("b",)], "category string")
    assert rows(extraction.coverage(s, f, c), "doc", "category", "status") == [("d", "a", "checked_clear"), ("d", "b", "incomplete"), ("e", "a", "risk_found"), ("e", "b", "incomplete")]


# --- scoring -----------------------------------------------------------------------------------


def test_ranking_metrics_equal_the_definition(spark):
    rng = random.Random(2)
    data = [(i, rng.randint(0, 6) / 6, rng.random() < 0.4) for i in range(80)]
    df = spark.createDataFrame(data, "case_id int, score double, relevant boolean")
    pos, neg = [s for _, s, r in data if r], [s for _, s, r in data if not r]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert scoring.roc_auc(df).first().roc_auc == pytest.approx(wins / (len(pos) * len(neg)))
    hits, total = 0, 0.0
    for rank, (_, _, r) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1):
        hits += r
        total += r * hits / rank
    assert scoring.average_precision(df).first().average_precision == pytest.approx(total / len(pos))
    assert scoring.roc_auc(df.where("relevant")).first().roc_auc is None


def test_missing_predictions_count(spark):
    gold = spark.createDataFrame([(1, "supported", "k"), (2, "supported", "k"), (3, "contradicted", "k")], "case_id int, expected_status string, kind string")
    pred = spark.createDataFrame([(1, "supported"), (2, "contradicted")], "claim_id int, status string")
    matrix = scoring.confusion(scoring.judged(gold, pred))
    assert rows(matrix, "expected", "actual", "n") == [("contradicted", "missing", 1), ("supported", "contradicted", 1), ("supported", "supported", 1)]
    assert rows(scoring.status_scores(matrix), "status", "precision", "recall", "f1") == [("contradicted", 0.0, 0.0, 0.0), ("supported", 1.0, 0.5, 2 / 3)]


def test_admission_names_regressions(spark):
    b = spark.createDataFrame([("k1", 1.0, 10, 10), ("k2", 0.1, 10, 1)], "kind string, accuracy double, total long, correct long")
    c = spark.createDataFrame([("k1", 0.9, 10, 9), ("k2", 0.9, 10, 9)], "kind string, accuracy double, total long, correct long")
    r = scoring.admission(b, c, "kind", "accuracy", 0.1).first()
    assert (r.improvement, r.regressed, r.passed) == (0.35, ["k1"], False)
    assert scoring.admission(b, b, "kind", "accuracy", 0.0).first().passed


# --- arena -------------------------------------------------------------------------------------


def test_verdicts(spark):
    lenses = ["l1", "l2"]
    tasks = spark.createDataFrame([(t,) for t in "abcdefg"], "task_id string")
    attacks = [("b", "l1", "x"), ("c", "l1", "x"), ("c", "l2", None), ("d", "l1", "x"), ("d", "l2", None), ("e", "l1", None), ("e", "l2", None), ("f", "l1", "x"), ("f", "l2", "x"), ("g", "l1", "x"), ("g", "l2", None)]
    attacks = spark.createDataFrame([(*a, "s0") for a in attacks], "task_id string, lens string, attack string, session_id string")
    given = {("c", "l1"): ["lands", "lands"], ("d", "l1"): ["lands", "misses"], ("f", "l1"): ["misses", "misses"], ("f", "l2"): ["glances", "glances"], ("g", "l1"): ["misses"]}
    rulings = [(t, lens, r, f"f{i}", f"s{i + 1}") for (t, lens), rs in given.items() for i, r in enumerate(rs)]
    rulings = spark.createDataFrame(rulings, "task_id string, lens string, ruling string, model_family string, session_id string")
    got = dict(rows(arena.adjudicate(tasks, attacks, rulings, lenses, 2), "task_id", "verdict"))
    assert got == {"a": "unattacked", "b": "unruled", "c": "flagged", "d": "withheld", "e": "stands", "f": "contested", "g": "unruled"}
    assert arena.self_rulings(attacks, rulings).count() == 0
    same = rulings.withColumn("session_id", F.lit("s0"))
    assert arena.self_rulings(attacks, same).count() == rulings.count()
    assert not arena.arena_summary(spark.createDataFrame([], "task_id string, verdict string")).first().passed


def test_emission(spark):
    text = "# One\nThis therefore means that the margin will hold. Sales annualised at 9 were high in that year. No record was ever found of it on file anywhere.\n## Two\nThis therefore means that the Margin will hold! Nothing else stands in this section at all.\nPrepared by someone who therefore knows a lot about it."
    got = rows(arena.emit_tasks(spark.createDataFrame([("d", text)], "doc string, text string"), arena.Profile()), "task_id", "trigger", "section", "location", "context")
    assert [(t, k, s) for t, k, s, *_ in got] == [("x1", "inferential", 1), ("x2", "derived", 1), ("x3", "absence", 1)]
    assert got[0][3] == "sentence 1, section 1" and got[0][4].startswith("Sales annualised") and "Nothing else" not in got[0][4]


def test_context_skips_what_does_not_fit(spark):
    text = "\n".join(["Target sentence of the text.", "x" * 50 + ".", "Short one.", "Another short one."])
    stream = arena.sentences(spark.createDataFrame([("d", text)], "doc string, text string"))
    target = stream.where("ordinal = 1").select("doc", "section", "ordinal")
    got = arena.contexts(stream, target, arena.Profile(context_characters=30, context_sentences=5)).first().context
    assert got == "Short one. Another short one."


def test_html_sections(spark):
    page = "<h1>Head line</h1><p>First text here. Second text &amp; more.</p><script>var x = 'never seen';</script><section><div>Third text here</div></section>"
    got = arena.sentences(spark.createDataFrame([("d", page)], "doc string, text string"), html=True)
    assert rows(got, "section", "ordinal", "text") == [(1, 1, "Head line"), (1, 2, "First text here."), (1, 3, "Second text & more."), (2, 4, "Third text here")]


# --- navigation --------------------------------------------------------------------------------


def test_paragraphs_and_tree(spark):
    text = "  First paragraph here. \n\nSecond one\nof two lines.\r\n \r\nThird " + "word " * 100
    nodes = navigation.paragraph_nodes(spark.createDataFrame([("d", text), ("e", "Only one"), ("f", " \n ")], "doc string, text string"), 256)
    parts = [(r.start, r.end) for r in nodes.where("doc = 'd' and parent_id is not null").orderBy("number").collect()]
    assert parts[:2] == [(2, 23), (26, 50)] and all(b - a <= 256 for a, b in parts) and len(parts) == 4
    assert rows(nodes.where("doc = 'e'"), "title", "selectable", "parent_id") == [("Only one", True, None)]
    assert nodes.where("doc = 'f'").count() == 0
    assert navigation.tree_violations(nodes).count() == 0
    bad = spark.createDataFrame([("d", "a", None, 0, 9), ("d", "a", None, 0, 9), ("d", "b", "zz", 0, 3), ("d", "c", "a", 5, 12), ("d", "x", "y", 0, 1), ("d", "y", "x", 0, 1)], "doc string, node_id string, parent_id string, start int, end int")
    assert {r.rule for r in navigation.tree_violations(bad).collect()} == {"repeated_id", "several_roots", "unknown_parent", "outside_parent", "cycle"}
    assert {r.node_id for r in navigation.unreachable(bad).collect()} == {"x", "y"}


def test_selectors(spark):
    nodes = spark.createDataFrame([("d", f"n{i}", t, i * 10, i * 10 + 9, True) for i, t in enumerate(["price of wheat", "price list", "weather"])] + [("d", "root", "price", 0, 30, False)], "doc string, node_id string, title string, start int, end int, selectable boolean")
    cases = spark.createDataFrame([("q", "d", "What is the wheat price?"), ("z", "d", "of the"), ("y", "d", "unknown")], "case_id string, doc string, question string")
    got = {r.case_id: (r.status, r.node_ids) for r in navigation.select_lexical(nodes, cases, 2).collect()}
    assert got == {"q": ("selected", ["n0", "n1"]), "z": ("abstained", []), "y": ("abstained", [])}
    out = spark.createDataFrame(
        [("q", None, 10, 1, None), ("z", ["n0", "n0"], 1, 1, None), ("y", ["n0"], 10**6, 1, None), ("q", ["nope"], 1, 1, None), ("q", [], 1, 1, None), ("q", ["n1"], 1, 1, None), ("q", ["n1"], 1, 1, "boom")],
        "case_id string, node_ids array<string>, input_tokens int, output_tokens int, error string",
    )
    reasons = sorted(r.reason for r in navigation.select_recorded(out, nodes, cases, 5, 1000).collect())
    assert reasons == ["abstained", "budget", "malformed", "repeated", "selected", "selector_error", "unknown_node"]
    own = navigation.select_with(nodes, cases.where("case_id = 'q'"), lambda question, table: list(table["node_id"][:1]))
    assert rows(own, "case_id", "status", "node_ids") == [("q", "selected", ["n0"])]
    assert [r.handle for r in navigation.handles(nodes).orderBy("start", "node_id").collect()] == ["n0001", "n0002", "n0003", "n0004"]


# --- probes ------------------------------------------------------------------------------------


def test_negation_flip_is_once_and_in_order(spark):
    cases = {"It shall not pass and must not go.": "It shall pass and must not go.", "It is not so; it may be.": "It is so; it may be.", "He may go, he may stay.": "He may not go, he may stay.", "It WAS so.\nIt was.": "It WAS not so.\nIt was.", "Canary island": None}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    flip, rule = probes.negation_flip(F.col("t"))
    assert {r.t: r.f for r in df.select("t", flip.alias("f")).collect()} == cases


def test_candidates_and_sampling(spark):
    seeds = spark.createDataFrame([(f"s{i}", "src", "h", f"q{i % 3}", f"text {i}", i * 10, i * 10 + 12) for i in range(6)], "seed_id string, source_id string, source_sha256 string, question string, span_text string, start int, end int")
    pairs = probes.candidate_pairs(seeds)
    want = {(f"s{a}", f"s{b}") for a in range(6) for b in range(6) if a % 3 != b % 3 and not (a * 10 < b * 10 + 12 and b * 10 < a * 10 + 12)}
    assert {(r.target_id, r.distractor_id) for r in pairs.collect()} == want
    assert probes.sample_candidates(pairs, 5, 7).count() == 1
    ids = sorted(r.candidate_id for r in pairs.collect())
    random.Random(7).shuffle(ids)
    assert [r.candidate_id for r in probes.sample_candidates(pairs, 5, 7, unique_sources=False).collect()] == ids[:5]


def test_seeds_report_problems(spark):
    tests = spark.createDataFrame([("q", [("a", [0, 3]), ("a", [2, 99]), ("../b", [0, 1])])], "query string, snippets array<struct<file_path:string,span:array<long>>>")
    corpus = spark.createDataFrame([("a", "hello"), ("../b", "x")], "source_id string, text string")
    got = rows(probes.import_seeds(tests, corpus), "source_id", "span_text", "problem")
    assert got == [("../b", "x", "path_escape"), ("a", "hel", None), ("a", "llo", "span_out_of_bounds")]
    held = corpus.where("source_id = 'a'").select(F.sha2("text", 256).alias("sha256"))
    assert probes.import_seeds(tests, corpus, held).where("source_id = 'a'").count() == 0


def test_tampering_shows(spark):
    frozen = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id int, s string, t string")
    decided = spark.createDataFrame([(1, "a", None), (2, "b", "z"), (9, "c", "y")], "id int, s string, t string")
    assert rows(probes.tampered_decisions(frozen, decided, "id", ["s", "t"]), "id", "rule") == [(2, "changed"), (3, "missing"), (9, "unknown")]


def test_probe_cases(spark):
    groups = spark.createDataFrame([("g", "t", "p", "f", "c")], "group_id string, target_text string, paraphrase string, flip string, claim_text string")
    got = probes.probe_cases(groups)
    assert {r.kind: (r.expected_status, r.claim_text) for r in got.collect()} == {"verbatim_supported": ("supported", "t"), "paraphrase_supported": ("supported", "p"), "contradicted": ("contradicted", "f"), "present_irrelevant": ("insufficient", "c")}
    whole = got.withColumn("source_id", F.lit("s")).withColumn("original_start", F.lit(0)).withColumn("original_end", F.lit(1))
    assert scoring.group_shapes(whole).count() == 0
    assert scoring.group_shapes(whole.where("kind <> 'contradicted'")).count() == 1


# --- spans and parity ---------------------------------------------------------------------------


def test_windows(spark):
    df = spark.createDataFrame([("d", "x" * 50), ("e", ""), ("f", "x" * 20)], "doc string, text string")
    w = spans.fixed_windows(df, "doc", size=20, overlap=5)
    assert rows(w, "doc", "start", "end") == [("d", 0, 20), ("d", 15, 35), ("d", 30, 50), ("f", 0, 20)]
    assert spans.invalid_segments(w, df, "doc", 20).count() == 0
    assert spans.invalid_segments(w.withColumn("segment", F.lit("y")), df, "doc", 20).count() == 4
    assert spans.fixed_windows(df, "doc", size=20, overlap=5, keep_empty=True).where("doc = 'e'").count() == 1


def test_shared_windows(spark):
    df = spark.createDataFrame([("g", 10, 20, 100), ("g", 40, 50, 100), ("h", 0, 10, 100), ("h", 90, 100, 100)], "g string, start int, end int, length int")
    got = rows(spans.shared_windows(df, "g", 60), "g", "fits", "window_start", "window_end")
    assert got[0] == ("g", True, 0, 60) and not got[2][1]


def test_first_difference(spark):
    a = spark.createDataFrame([(0, "u", None), (1, "v", "x")], "pos int, uri string, excerpt string")
    assert parity.first_difference(a, a, "pos", ["uri", "excerpt"]).first().equal
    b = spark.createDataFrame([(0, "u", None)], "pos int, uri string, excerpt string")
    assert parity.first_difference(a, b, "pos", ["uri", "excerpt"]).first().first_difference == 1
    assert rows(parity.set_differences(a, b), "pos", "side") == [(1, "left")]


# --- canonical forms ------------------------------------------------------------------------------


def test_hashes(spark):
    payload = {"b": [1, 2.5, None], "a": "é"}
    held = canonical.with_hash(payload)
    assert canonical.hash_holds(held) and not canonical.hash_holds({**held, "a": "e"})
    with pytest.raises(ValueError):
        canonical.canonical_json(float("nan"))
    df = spark.createDataFrame([(1, "é", [1.5]), (2, None, [])], "i int, s string, x array<double>")
    got = [r.j for r in df.select("i", canonical.row_json("i", "s", "x").alias("j")).orderBy("i").collect()]
    assert got == ['{"i":1,"s":"\\u00e9","x":[1.5]}', '{"i":2,"s":null,"x":[]}']
    one = canonical.unordered_sha256(df, "i", "s").first().sha256
    assert one == canonical.unordered_sha256(df.orderBy(F.desc("i")).repartition(3), "i", "s").first().sha256
    assert one != canonical.unordered_sha256(df.where("i = 1"), "i", "s").first().sha256


# --- sources --------------------------------------------------------------------------------------


def test_the_hash_of_a_whole_set_of_records(spark):
    df = spark.range(20_000).selectExpr("id * 7919 % 20000 AS k", "concat('é', id % 3) AS v").repartition(7)
    want = sha256(("[" + ",".join(canonical.canonical_json({"k": k, "v": v}) for k, v in sorted((i * 7919 % 20_000, f"é{i % 3}") for i in range(20_000))) + "]").encode()).hexdigest()
    got = canonical.records_sha256(df, "k", "k", "v")
    assert [r.sha256 for r in got.collect()] == [want] and "collect_list" not in got._jdf.queryExecution().toString()


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes("café".encode() + b"\xff")
    refs = spark.createDataFrame([("1", "a.txt"), ("2", "b.txt")], "source_id string, uri string")
    assert rows(readers.read_texts(refs, str(tmp_path / "t")), "source_id", "text", "failure") == [("1", "café�", None), ("2", None, "source_unreachable")]
    src = spark.createDataFrame([("1", "u", "text", "now", 200, "text/plain")], "source_id string, uri string, text string, fetched_at string, status int, media_type string")
    readers.write_snapshots(src, str(tmp_path / "s"))
    refs = spark.createDataFrame([("1", "u"), ("9", "u"), ("1", "v")], "source_id string, uri string")
    assert rows(readers.load_snapshots(refs, str(tmp_path / "s")), "source_id", "uri", "failure") == [("1", "u", None), ("1", "v", "source_unreachable"), ("9", "u", "source_changed")]
    (tmp_path / "l").write_text('{"a": 1}\n\n{"a": 2, "b": 3}\nnot json\n')
    schema = spark.createDataFrame([], "a int").schema
    assert rows(readers.read_jsonl(spark, str(tmp_path / "l"), schema, strict=True), "a", "problem") == [(1, None), (2, "unknown_fields"), (None, "malformed")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text(json.dumps({"key": "k", "categories": [{"key": "b", "name": "B", "severity": 2, "description": "two"}, {"key": "a", "name": "A", "severity": 5, "description": "one"}]}))
    assert readers.prompt_block(readers.read_domains(spark, str(tmp_path / "d"))).first().block == "- A: one\n- B: two"


def test_page_text():
    assert readers.page_text("<p>a &amp; b</p><script>x</script><noscript>y</noscript>\n<b>c</b>") == "a & b c"


def test_backends(spark):
    df = spark.createDataFrame([(1, "find me here"), (2, "nothing")], "i int, chunk string").withColumn("prompt", F.col("chunk"))
    stub = extraction.parse_findings(readers.stub_backend(df, "me", "c"))
    assert {r.i: r.findings for r in stub.collect()} == {1: {"c": ["me"]}, 2: {"c": []}}

    def fail(prompt):
        if "nothing" in prompt:
            raise OSError
        return "ok"

    assert rows(readers.with_backend(df, fail), "i", "reply") == [(1, "ok"), (2, None)]


def test_markdown(spark):
    text = "# T\nSales *rose* [14%](https://x.org/a \"note | quote: rose by 14%\") and [p. 3](https://x.org/b)<!-- evidence-locator: page 3 --><!-- evidence-question: Did it? --> end.\nNo link.\n[[here]](https://x.org/c)"
    got = artifacts.extract_markdown(spark.createDataFrame([("d", text)], "doc string, text string"))
    assert rows(got, "claim_id", "uri", "excerpt", "locator", "question", "location")[:2] == [("c1", "https://x.org/a", "rose by 14%", None, None, "line 2"), ("c2", "https://x.org/b", None, "page 3", "Did it?", "line 2")]
    assert got.where("claim_id = 'c1'").first().text == "Sales rose 14% and p. 3 end."
    twice = "[a](https://x.org)<!-- evidence-quote: x --><!-- evidence-quote: y -->"
    assert "two markers" in artifacts.extract_markdown(spark.createDataFrame([("d", twice)], "doc string, text string")).first().error


def test_html_claims(spark):
    page = (
        '<p>Sales rose <a href="https://x.org/a" title="quote: up 14%">14%</a> in May.</p><p class="provenance-calculation">Margin is 3%.</p>'
        '<ul class="references"><li><a href="https://x.org/z">ref</a></li></ul><p>See <a href="https://x.org/b">this</a><!-- evidence-locator: p. 9 --> and <a href="/rel">that</a>.</p><p>Plain.</p>'
    )
    got = artifacts.extract_html(spark.createDataFrame([("d", page)], "doc string, text string"))
    assert rows(got, "claim_id", "text", "uri", "excerpt", "locator", "provenance_class") == [
        ("c1", "Sales rose 14% in May.", "https://x.org/a", "up 14%", None, "unclassified"), ("c2", "Margin is 3%.", None, None, None, "analyst_calculation"),
        ("c3", "See this and that.", "https://x.org/b", None, "p. 9", "unclassified"),
    ]
    clash = '<p class="provenance-company provenance-calculation">x</p>'
    assert "conflicting" in artifacts.extract_html(spark.createDataFrame([("d", clash)], "doc string, text string")).first().error


def test_dispatch(spark):
    docs = spark.createDataFrame([("a", "x/a.md", "[l](https://x.org)"), ("b", "b.JSON", '{"claims": [{"claim_text": "t", "source_url": "https://x.org"}]}'), ("c", "c.pdf", ""), ("d", "d.json", "{}")], "doc string, path string, text string")
    got = {r.doc: (r.claim_id, r.uri, r.error) for r in artifacts.extract(docs).collect()}
    assert got == {"a": ("c1", "https://x.org", None), "b": ("c1", "https://x.org", None), "c": (None, None, "unsupported suffix: pdf"), "d": (None, None, "no array of claims")}
