"""Operators on small rows: each branch of the rules, null and empty inputs."""

import datetime as dt
from functools import reduce
from math import sqrt

import pytest
from pyspark.sql import functions as F

from changelens.operators import events as EV
from changelens.operators import history as H
from changelens.operators import links as L
from changelens.operators import memory as M
from changelens.operators import metrics as X
from changelens.operators import research as RS
from changelens.operators import retrieval as R
from changelens.operators import statements as ST
from changelens.operators import states as S
from changelens.operators.pages import quality_gate

QUOTES = "map<string,array<struct<input_field:string,excerpt:string>>>"
DECISION = (
    "id int, decision string, event_type string, event_subject string, change_action string, event_time string, effective_time string, affected_scope string, "
    f"change_items array<struct<item:string,previous_state:string,current_state:string>>, citations {QUOTES}, previous_state string, current_state string, relevant_source_context string, "
    "detection_path string, evidence_status string, source_credibility string, previous_observed_at timestamp, current_observed_at timestamp"
)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_previous_is_strictly_earlier(spark):
    df = spark.createDataFrame([("u", 1, 1, "a"), ("u", 1, 2, "b"), ("u", 2, 3, "c"), ("v", 1, 4, "d"), (None, 1, 5, "e")], "url string, at int, id int, h string")
    got = {r.id: (r.previous_h, r.is_first_scan) for r in H.previous_strict(df, ["url"], "at", "id", ["h"]).collect()}
    assert got == {1: (None, True), 2: (None, True), 3: ("b", False), 4: (None, True), 5: (None, True)}


def test_change_tri_state(spark):
    df = spark.createDataFrame([(1, 1, "a", "v"), (2, 2, "a", "v"), (3, 3, "b", "v"), (4, 4, "b", "w"), (5, 5, "b", None), (6, 6, "b", None)], "id int, at int, content_hash string, extraction_version string").withColumn("url", F.lit("u"))
    got = {r.id: (r.changed, r.reason) for r in H.detect_changes(df, ["url"], "at", "id").collect()}
    version = "extraction_version_changed"
    assert got == {1: (None, None), 2: (False, None), 3: (True, None), 4: (None, version), 5: (None, version), 6: (False, None)}


def test_state_matching_and_fold(spark):
    p = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, h string")
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, h string")
    full = S.match_states(p, c, ["k"], "h", F.lit(True), F.lit(True))
    assert rows(full, "k", "status") == [("a", "unchanged"), ("b", "modified"), ("c", "previous_only"), ("d", "current_only")]
    part = S.match_states(p, c, ["k"], "h", F.lit(True), F.lit(False))
    assert rows(part, "k", "changed") == [("a", False), ("b", True), ("c", None), ("d", None)]
    folded = S.fold(part.withColumn("g", F.when(F.col("k") == "a", "x").when(F.col("k") == "b", "y").otherwise("z")), ["g"])
    assert rows(folded, "g", "changed") == [("x", False), ("y", True), ("z", None)]


def test_eligibility_bounds_and_scopes(spark):
    s = spark.createDataFrame([("a", None), ("a", True), ("b", False)], "k string, comparison_eligible boolean")
    ok, report = S.collect(s, ["k"])
    assert ok.count() == 2 and rows(report, "k", "excluded", "duplicate") == [("a", 0, True), ("b", 1, False)]
    tabs = spark.createDataFrame([("p", "g", k, k == 0, 1) for k in range(8)] + [("p", "h", 0, False, 3)], "page string, grp string, pos int, is_default boolean, depth int")
    kept = S.bounded_tabs(tabs, ["page", "grp"], "pos", "is_default", ["page"])
    assert kept.where("kept").count() == 6 and not kept.where("grp = 'h'").first().kept
    b = spark.createDataFrame([("p", "/", 0, "1"), ("p", "/a", 1, "1"), ("p", "/a/b", 2, "1")], "page string, path string, depth int, fp string")
    a = b.withColumn("fp", F.lit("2"))
    assert S.nearest_changed_ancestor(b, a, ["page"], "path", "depth", "fp").first().scope == "/a/b"
    parents = spark.createDataFrame([("p", "/x"), ("p", "/a/b/c")], "page string, path string")
    assert rows(S.own_content(parents, spark.createDataFrame([("p", "/a")], "page string, path string"), ["page"], "path"), "path") == [("/x",)]


def test_keyed_rows(spark):
    p = spark.createDataFrame([(1, "a", 1, None), (1, "b", 2, 2)], "t int, k string, x int, y int")
    c = spark.createDataFrame([(1, "a", 1, 5), (1, "c", 2, 2)], "t int, k string, x int, y int")
    got = S.keyed_row_diff(p, c, ["t"], "k", ["x", "y"])
    assert {r.k: (r.status, r.changed_cells) for r in got.collect()} == {"a": ("modified", ["y"]), "b": ("deleted", ["x", "y"]), "c": ("added", ["x", "y"])}
    assert S.is_keyed(p.unionByName(p), ["t"], "k").first().is_keyed is False


def test_quality_gate_branches(spark):
    cases = [("", 0, "FAIL", ["empty_content", "no_valid_blocks"]), (" \n", 3, "FAIL", ["empty_content"]), ("Loading", 2, "FAIL", ["dynamic_placeholder"]), ("loading " * 40, 2, "PASS", []), ("short", 2, "WARNING", ["sparse_content"]), ("short", 3, "PASS", [])]
    df = spark.createDataFrame([(k, c, n) for k, (c, n, _, _) in enumerate(cases)], "id int, c string, n int")
    got = {r.id: (r.q.status, r.q.reasons) for r in quality_gate(df, "c", "n").select("id", F.col("quality").alias("q")).collect()}
    assert got == {k: (s, r) for k, (_, _, s, r) in enumerate(cases)}


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("pending", "state_comparison", "official", "comparable", "a", "b", 1), "uncertain"),
        (("confirmed", "explicit_statement", "official", None, None, None, 0), None),
        (("confirmed", "explicit_statement", "unverified", None, None, None, 0), "uncertain"),
        (("confirmed", "state_comparison", "official", "baseline", None, None, 0), "no_event"),
        (("confirmed", "state_comparison", "official", "comparable", "a", "b", 1), None),
        (("confirmed", "state_comparison", "official", "comparable", "a", "", 1), "uncertain"),
        (("confirmed", "state_comparison", "official", None, "a", "b", 1), "uncertain"),
    ],
)
def test_event_gate(spark, args, want):
    cols = [F.lit(a).cast("int" if k == 6 else "string") for k, a in enumerate(args)]
    assert spark.range(1).select(EV.gate(*cols).alias("g")).first().g == want


def decision(k, **change):
    base = dict(
        id=k, decision="event", event_type="pricing", event_subject="Pro", change_action=None, event_time=None, effective_time=None, affected_scope=None,
        change_items=[("price", "10", "12")],
        citations={
            "event_type": [("current_state", "price 12")], "event_subject": [("current_state", "Pro")], "change_items.0.item": [("current_state", "price")],
            "change_items.0.previous_state": [("previous_state", "price 10")], "change_items.0.current_state": [("current_state", "price 12")],
        },
        previous_state="Pro price 10", current_state="Pro price 12", relevant_source_context=None, detection_path="state_comparison", evidence_status="confirmed",
        source_credibility="official", previous_observed_at=dt.datetime(2024, 1, 1), current_observed_at=dt.datetime(2024, 1, 2),
    )
    base["citations"] = base["citations"] | change.pop("cite", {})
    for f in change.pop("uncite", ()):
        base["citations"].pop(f)
    return tuple((base | change).values())


def test_claim_rules(spark):
    cases = [
        (decision(0), None), (decision(1, uncite=["event_type"]), "citation_missing"), (decision(2, cite={"event_time": [("current_state", "x")]}), "invalid_reference"),
        (decision(3, cite={"event_subject": []}), "citation_empty"), (decision(4, cite={"event_subject": [("current_state", "Max")]}), "excerpt_not_found"),
        (decision(5, cite={"change_items.0.previous_state": [("current_state", "price 12")]}), "invalid_input_field"), (decision(6, cite={"change_items.0.current_state": [("current_state", "Pro")]}), "claim_not_verbatim"),
        (decision(7, evidence_status="pending"), "unconfirmed_input"), (decision(8, change_items=[("price", None, "12")], uncite=["change_items.0.previous_state"]), "comparison_side_missing"),
        (decision(9, change_items=[("price", "10", "10")], cite={"change_items.0.current_state": [("current_state", "price 12")]}, current_state="Pro price 12, was price 10"), "claim_not_verbatim"),
        (decision(10, detection_path="explicit_statement", source_credibility="unverified"), "unofficial_statement"),
    ]
    df = spark.createDataFrame([c for c, _ in cases], DECISION)
    got = {r.id: r.rule for r in EV.first_violation(EV.claim_violations(df, ["id"]), ["id"]).collect()}
    assert got == {k: rule for k, (_, rule) in enumerate(cases) if rule}


def test_evidence_rows(spark):
    e = {r.input_field: r for r in EV.build_evidence(spark.createDataFrame([decision(0)], DECISION), ["id"]).collect()}
    assert set(e) == {"previous_state", "current_state"} and e["previous_state"].relevant_excerpt == "price 10"
    assert set(e["current_state"].relevant_excerpt.split("\n")) == {"price 12", "Pro", "price"} and len(e["current_state"].evidence_id) == 64
    doubt = EV.build_evidence(spark.createDataFrame([decision(0, decision="uncertain")], DECISION), ["id"])
    assert {r.evidence_status for r in doubt.collect()} == {"pending"}
    a = spark.createDataFrame([(1, "x"), (2, "y")], "seq int, c string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (3, "z")], "seq int, c string")
    assert rows(EV.union_distinct(a, b, [], ["c"], "seq"), "seq", "c") == [(1, "x"), (2, "y"), (2, "z")]


def test_dedup_and_normalisation(spark):
    v = spark.createDataFrame([(1, "NEW_EVENT"), (2, "SAME_EVENT"), (3, "SAME_EVENT"), (3, "SAME_EVENT"), (4, "UNCERTAIN"), (4, "SAME_EVENT")], "c int, v string")
    assert rows(EV.verdict_fold(v, ["c"], "v"), "c", "verdict") == [(1, "NEW_EVENT"), (2, "SAME_EVENT"), (3, "UNCERTAIN"), (4, "UNCERTAIN")]
    d = spark.createDataFrame([(1, "event", "pricing"), (1, "uncertain", None), (2, "event", "a"), (2, "event", "b"), (3, "no_event", None)], "case int, decision string, event_type string")
    d = d.select("*", *[F.lit(None).cast("string").alias(f) for f in EV.FACTS if f != "event_type"])
    assert rows(EV.normalize_decisions(d, "case"), "case", "decision", "event_type") == [(1, "event", "pricing"), (2, "event", None), (3, "no_event", None)]


def test_memory_policy_and_chain(spark):
    cases = [("prefer dark mode", "preference", "I prefer dark mode", "user", None), ("x", "goal", "plan x", "event", "fact_source"), ("y", "goal", "plan x", "user", "not_verbatim"), ("token: abc", "goal", "plan token: abc", "user", "source_secret"), ("run it today", "goal", "plan: run it today", "user", "temporary"), ("blue", "goal", "blue", "user", "no_signal"), ("supports SSO", "goal", "our goal: supports SSO", "user", "fact_only")]
    df = spark.createDataFrame([(k, *c[:4]) for k, c in enumerate(cases)], "id int, content string, kind string, source string, source_kind string")
    got = {r.id: r.v for r in df.select("id", M.candidate_violation(F.col("content"), F.col("kind"), F.col("source"), F.col("source_kind")).alias("v")).collect()}
    assert got == {k: c[4] for k, c in enumerate(cases)}
    log = spark.createDataFrame([(1, "k", 1, "a"), (2, "k", 2, "a"), (3, "k", 3, "b"), (4, "k", 4, "a")], "id int, k string, at int, c string")
    assert rows(M.supersession(log, ["k"], ["at"], ["c"], "id"), "id", "supersedes", "active") == [(1, None, False), (3, 1, False), (4, 3, True)]


def test_statement_plan(spark):
    day = dt.date(2024, 5, 1)
    ex = spark.createDataFrame([("w", "old", day, True), ("w", "far", dt.date(2023, 1, 1), True), ("w", "none", None, True), ("w", "new", day, False), ("w", "seen", day, False), ("w", "retry", day, False), ("w", "done", day, False)], "workspace string, statement_id string, statement_date date, initial_backfill boolean")
    seen = spark.createDataFrame([("w", "seen")], "workspace string, statement_id string")
    states = spark.createDataFrame([("w", "retry", "pending", "normal_monitoring"), ("w", "done", "processed", "historical_backfill")], "workspace string, statement_id string, state string, origin string")
    plan = ST.plan(ex, seen, states, F.lit(day))
    assert rows(plan, "statement_id", "origin") == [("new", "normal_monitoring"), ("old", "historical_backfill"), ("retry", "retry")]
    full = states.unionByName(spark.createDataFrame([("w", f"s{k}", "processed", "historical_backfill") for k in range(19)], states.schema))
    assert "old" not in {r.statement_id for r in ST.plan(ex, seen, full, F.lit(day)).collect()}


def test_candidates_and_sources(spark):
    c = spark.createDataFrame([("k", "page_link", "", None, "u1", 1), ("k", "user_input", "T", "s", "u2", 2), ("k", "web_search", "S", "t", "u3", 3)], "key string, provenance string, title string, snippet string, url string, seq int")
    assert rows(L.merge_candidates(c, "key", "seq"), "provenance", "title", "snippet", "url") == [("user_input", "T", "s", "u1")]
    pages = spark.createDataFrame([("r1", "f1", "PASS"), ("r2", "f2", "FAIL"), ("r3", "f3", "PASS")], "requested_url string, final_url string, quality_status string")
    kept, missing = L.verified_sources(spark.createDataFrame([("f1",), ("f2",), ("f3",)], "url string"), pages, spark.createDataFrame([("r1",), ("r2",)], "url string"))
    assert rows(kept, "url") == [("f1",)] and rows(missing, "url") == [("f2",), ("f3",)]


def test_retrieval_ties_filters_and_conflicts(spark):
    v = spark.createDataFrame([("b", [1.0, 0.0], 1), ("a", [2.0, 0.0], 1), ("c", [0.0, 1.0], 1), ("z", [0.0, 0.0], 1), ("d", [1.0], 1), ("e", [1.0, 0.0], 2)], "id string, v array<double>, dom int")
    assert [r.id for r in R.search(v, [1.0, 0.0], 2, "id", "v", F.col("dom") == 1).collect()] == ["a", "b"]
    cur = spark.createDataFrame([("d", "p", "1", "h1", "Name"), ("d", "p", "2", "h2", "Other")], "domain string, product_id string, document_id string, content_hash string, display_name string")
    new = spark.createDataFrame([("d", "p", "1", "x", "N1", True, None), ("d", "p", "9", "x", "N2", False, None), ("d", "p", "1", "x", "N3", False, "zz"), ("d", "p", "8", "h2", "N4", True, None), ("d", "p", "7", "x", " other ", True, None), ("d", "p", "6", "x", "N6", True, None)], "domain string, product_id string, document_id string, content_hash string, display_name string, create_only boolean, expected_content_hash string")
    got = {r.document_id + r.display_name: r.conflict for r in R.replacement_conflicts(new, cur).collect()}
    assert got == {"1N1": "document_exists", "9N2": "document_not_found", "1N3": "document_changed", "8N4": "duplicate_content", "7 other ": "display_name_conflict", "6N6": None}


def test_search_of_many_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 16)
    monkeypatch.setattr(R, "STRIP", 5)
    vectors = [(f"k{k:03d}", "ab"[k % 3 == 0], [float((k * 7 + j * j * 5) % 11 - 5) for j in range(4 + (k % 7 == 0))]) for k in range(120)]
    vectors += [(f"t{k:03d}", "a", vectors[1][2]) for k in range(40)]  # copies, more than a block
    odd = [("n1", None, [1.0]), (None, "a", [1.0] * 4), ("n2", "a", None), ("n3", "a", [0.0] * 4), ("n4", "a", [float("nan")] * 4), ("n5", "c", [1.0]), ("n6", "a", [])]
    df = spark.createDataFrame(vectors + odd, "id string, dom string, v array<double>")
    dot = lambda a, b: reduce(lambda s, xy: s + xy[0] * xy[1], zip(a, b, strict=True), 0.0)  # noqa: E731 (sum() compensates)
    unit = {k: [x / sqrt(dot(v, v)) for x in v] for k, _, v in vectors}
    want = set()
    for k, dom, v in vectors:
        scored = [(-max(-1.0, min(1.0, dot(unit[k], unit[o]))), o) for o, d, w in vectors if o != k and d == dom and len(w) == len(v)]
        want |= {(k, o, place + 1) for place, (_, o) in enumerate(sorted(scored)[:5])}
    found = R.search_all(df, df, 5, "id", "query", "v", ["dom"]).select("query", "id", "rank").collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    assert R.search_all(df.limit(0), df, 5, "id", "query", "v", ["dom"]).count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([("event", "event"), ("event", "no_event"), ("no_event", "event")], "g string, p string")
    per = {r.label: (r.support, r.precision, r.recall) for r in X.per_class(df, "g", "p", list(EV.DECISIONS)).collect()}
    assert per == {"event": (2, 0.5, 0.5), "no_event": (1, 0.0, 0.0), "uncertain": (0, 0.0, 0.0)}
    runs = spark.createDataFrame([("SUCCESS", True), ("SUCCESS", False), ("BLOCKED", None), ("ERROR", None)], "execution_status string, decision_correct boolean")
    s = X.run_summary(runs).first()
    assert (s.valid_accuracy, s.end_to_end_accuracy, s.execution_rate) == (0.5, 0.25, 0.5)
    assert X.run_summary(runs.limit(0)).first().valid_accuracy is None


def test_research(spark):
    res = spark.createDataFrame([("page", 1, "u", None), ("page", 2, None, "r"), ("memory", 3, None, None)], "source string, seq int, url string, reference string")
    c = RS.register(res, "source", "seq")
    assert rows(c, "result_id") == [("memory-1",), ("page-1",), ("page-2",)]
    claims = spark.createDataFrame([("page-1", "abc"), ("page-1", "x"), ("none", "a")], "result_id string, excerpt string")
    cited = "result_id string, content string, source string, status string, domain string, credibility string"
    assert RS.unsupported(claims, spark.createDataFrame([("page-1", "zabcz", "page", "read", "competitor", "official")], cited)).count() == 2
    for source, status in (("memory", "confirmed"), ("search", "read"), ("page", None), (None, "read"), ("page", "pending")):  # context, or unread: no fact rests on it
        assert RS.unsupported(claims, spark.createDataFrame([("page-1", "zabcz", source, status, "competitor", "official")], cited)).count() == 3
    rec = spark.createDataFrame([(1, 1, "complete", "a", "x", None), (1, 2, "pending", "a", "y", "d"), (1, 3, "complete", None, None, "d")], "run int, seq int, status string, citation_id string, citation string, uncertainty string")
    r = RS.assemble(rec, "run", "seq").first()
    assert (r.status, r.citations, r.uncertainties) == ("pending", {"a": "y"}, ["d"])


def test_gates_fail_closed(spark):
    columns = "id int, domain string, kind string, credibility string, status string, reference string"
    docs = [
        (1, "own_product", "x", "user_provided", None, None), (2, "own_product", "x", None, None, None), (3, "competitor", None, "official", "confirmed", "r"),
        (4, "competitor", "official_page", "official", "confirmed", "r"), (5, "competitor", "evidence", "official", None, "r"), (6, "competitor", "evidence", None, "confirmed", ""),
        (7, "competitor", "confirmed_product_state", None, "confirmed", "r"), (8, "competitor", "verified_official_content", "official", "confirmed", "r"), (9, None, "competition_event", None, "confirmed", "r"),
    ]
    got = {r.id: r.v for r in spark.createDataFrame(docs, columns).select("id", R.admission_violation(*[F.col(c.split()[0]) for c in columns.split(", ")[1:]]).alias("v")).collect()}
    assert got == {1: None, 2: "own_not_user_provided", 3: "type_not_allowed", 4: "type_not_allowed", 5: "not_confirmed", 6: "verification_missing", 7: "not_official", 8: None, 9: None}
    memory = spark.createDataFrame([(1, None, "user"), (2, "prefer", None), (3, "prefer", "user")], "id int, content string, kind string")
    got = {r.id: r.v for r in memory.select("id", M.candidate_violation(F.col("content"), F.lit("preference"), F.lit("we prefer it"), F.col("kind")).alias("v")).collect()}
    assert got == {1: "not_verbatim", 2: "fact_source", 3: None}


def test_report_rules(spark):
    cited = [("p", "own page", "page", "read", "own_product", "third_party"), ("k", "own facts", "knowledge", "confirmed", "own_product", "user_provided"), ("c", "their facts", "event", "confirmed", "competitor", "official")]
    citations = spark.createDataFrame(cited, "result_id string, content string, source string, status string, domain string, credibility string")
    schema = "report_id int, section string, claim_no int, kind string, result_id string, excerpt string, refs array<string>"

    def rules(*supports):
        df = spark.createDataFrame([(1, *x) for x in supports], schema)
        return RS.report_violations(df, citations).first().violations

    both = [("own_product_comparison", 0, "inference", "k", "own", ["c", "k"]), ("own_product_comparison", 0, "inference", "c", "their", ["c", "k"])]
    assert rules(*both) == [] and rules(both[0]) == ["competitor_missing", "references_differ"]
    assert rules(both[0], ("own_product_comparison", 1, "inference", "c", "their", ["c", "k"])) == ["own_knowledge_missing", "competitor_missing"]  # each claim needs both
    # an official source beside it doesn't make a third party's page one; knowledge alone carries a fact
    assert rules(("background", 0, "fact", "p", "page", ["c", "p"]), ("background", 0, "fact", "c", "facts", ["c", "p"])) == ["third_party_fact"]
    assert rules(("background", 0, "fact", "k", "facts", ["k"])) == [] and rules(("background", 0, "inference", "p", "page", ["p"])) == []
    assert rules(("watch_next", 0, "fact", "k", "facts", ["k"])) == ["fact_in_advice"] and rules(("background", 0, "fact", "k", "else", ["k", "k"])) == ["unsupported"]


def test_search_equals_brute_force(spark):
    rows = [(k, [float((k * 7) % 5 - 2), float(k % 3), 1.0] if k % 4 else [1.0, 2.0, 3.0]) for k in range(200)]  # many ties
    odd = [(500, None), (501, [1.0, 2.0]), (502, [0.0, 0.0, 0.0]), (503, [float("nan"), 1.0, 1.0]), (504, [None, 1.0, 1.0]), (None, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 9.0) for r in rows + odd], "id int, v array<double>, score double").repartition(5)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    q = [1.0, -1.0, 0.5]
    want = sorted(rows, key=lambda r: (-round(cos(r[1], q), 12), r[0]))[:25]
    got = R.search(df.where("id is not null"), q, 25, "id", "v").collect()
    assert [r.id for r in got] == [r[0] for r in want] and got[0].score == pytest.approx(cos(want[0][1], q))
    assert R.search(df.limit(0), q, 5, "id", "v").count() == 0


def test_memory_search_is_bounded(spark):
    rows = [(k, [1.0, k / 10], "w", "a", "confirmed", k != 3, k) for k in range(60)] + [(99, [1.0, 0.0], "w", "b", "confirmed", True, 1), (98, [1.0, 0.0], "w", "a", "pending", True, 1)]
    df = spark.createDataFrame(rows, "memory_id int, v array<double>, scope string, scope_id string, status string, active boolean, updated_at int")
    assert [r.memory_id for r in M.search(df, [1.0, 0.0], 5, "w", "a", "v").collect()] == [0, 1, 2, 4, 5]
    assert M.search(df, [1.0, 0.0], 50, "w", "a", "v").count() == 50
    for k in (0, 51):
        with pytest.raises(ValueError, match="from 1 to 50"):
            M.search(df, [1.0, 0.0], k, "w", "a", "v")


def test_near_products_pick_what_ordered_sums_pick():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(7)
    x = rng.normal(size=(700, 64))
    x[300:420], x[500:] = x[:120], x[0]  # copies, and one vector 201 times
    x /= np.sqrt(R._in_order(x, x))[:, None]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    for size in (700, 40, 3, 1):
        t = pa.table({"_id": pa.array(range(size)), "_unit": pa.array(list(x[:size]))})
        out = R._best_of_block(5, schema)(t, t).to_pylist() if size > 1 else []
        want = []
        for i in range(size):
            s = np.clip(R._in_order(x[:size], x[i]), -1.0, 1.0)
            s[i] = -np.inf
            want += [{"query_id": i, "vec_id": int(k), "score": float(s[k])} for k in np.argsort(-s, kind="stable")[:5] if k != i]
        assert out == (want if size > 1 else [])
    assert R.STRIP * R.GROUP <= 4096  # the maxima of groups are what is sorted, not the scores
