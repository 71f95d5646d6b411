"""Rules on literal rows: each case's operator against the rows it must give, stated by hand."""

from __future__ import annotations

from collections.abc import Callable

import duckdb
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions import text as T
from changelens.functions import urls as U
from changelens.functions.identity import all_keys, fingerprint, leaks, state_key
from changelens.operators import events as EV
from changelens.operators import history as H
from changelens.operators import links as L
from changelens.operators import memory as M
from changelens.operators import metrics as X
from changelens.operators import pages as P
from changelens.operators import product as PR
from changelens.operators import retrieval as R
from changelens.operators import service as SV
from changelens.operators import statements as ST
from changelens.operators import states as S
from changelens.streaming import state as STATE

CASES: dict[str, tuple] = {}
#: SQL that says what a case must give, where rows by hand would repeat a hash.
ORACLES: dict[str, str] = {}


def cases(name: str, schema: str, rows: list[tuple], build: Callable[[DataFrame], DataFrame], want: list[tuple], columns: str) -> None:
    CASES[name.removeprefix("q_")] = (schema, rows, build, want, [c.split()[0] for c in columns.split(", ")])


def sql_value(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"

def text_list(column) -> F.Column:
    return F.array_join(column, ",")

_HALF = "<li>a</li><li>b</li><li>c</li>"

_CARD = "<div><h3>{}</h3><p>{}</p><dl><dt>k</dt><dd>{}</dd><dd>w</dd></dl><a href='/{}'>go</a></div>"

_HTML = [
    (1, "<title> A  B </title><nav>no</nav><h2>H</h2><p>Av<span>ail</span>able<br>now</p><pre>a\n  b</pre><script>x</script>"),
    (2, "<ol><li>one<ul><li>in</li></ul></li><li></li><li>two</li></ol><p>a<p>b"),
    (3, "<table><tr><th>n</th><th>v</th></tr><tr><td>a|b</td><td>1<table><tr><td>x</td></tr></table></td></tr></table>"),
    (4, f"<ul>{_HALF}{_HALF}</ul>"), (5, f"<ul>{_HALF}{_HALF}<li>d</li></ul>"), (6, "<ul>" + "<li>a</li>" * 4 + "</ul>"),
    (7, "<section>" + _CARD.format("A", "one <del>5</del>", "v", "x") + _CARD.format("B", "two", "u", "y") + "</section>"),
    (8, "<div>loose <b>words</b><p>own</p>tail</div><footer>f</footer><h1> </h1><p></p>"), (9, ""), (10, "<main><h1>T</h1><code>c = 1</code></main><noscript>n</noscript><style>s</style>"),
]

cases("q_blocks_of_html", "case_id int, html string", _HTML,
      lambda d: P.parse_pages(d, ["case_id"]).select("case_id", "title", "content", text_list(F.transform("blocks", lambda b: b["type"])).alias("types")),
      [
          (1, "A B", "## H\n\nAvailable now\n\n```\na\n  b\n```", "heading,paragraph,code"), (2, "", "1. one\n  - in\n2. two\n\na b", "list,paragraph"),
          (3, "", "| n | v |\n| --- | --- |\n| a\\|b | 1 |", "table"), (4, "", "- a\n- b\n- c", "list"), (5, "", "- a\n- b\n- c\n- a\n- b\n- c\n- d", "list"),
          (6, "", "- a\n- a\n- a\n- a", "list"), (7, "", "### A\n\none 5\n\nk\n\nv\n\nw\n\ngo\n\n### B\n\ntwo\n\nk\n\nu\n\nw\n\ngo", "group"), (8, "", "loose words\n\nown\n\ntail", "paragraph,paragraph,paragraph"),
          (9, "", "", ""), (10, "", "# T\n\n```\nc = 1\n```", "heading,code"),
      ], "case_id INTEGER, title VARCHAR, content VARCHAR, types VARCHAR")

_CARDS = "array<struct<title:string,links:array<struct<text:string,href:string>>,key_values:array<struct<key:string,value:string>>,text_marks:array<struct<text:string,marks:array<string>>>>>"

def _cards(d: DataFrame) -> DataFrame:
    groups = P.parse_pages(d, ["case_id"]).select("case_id", F.explode("blocks").alias("b")).where("b.type = 'group'")
    cards = groups.select("case_id", F.explode(F.from_json(F.get_json_object("b.json", "$.cards"), _CARDS)).alias("c"))
    pair = lambda c, a, b: text_list(F.transform(c, lambda x: F.concat(x[a], F.lit("="), b(x))))
    return cards.select("case_id", "c.title", pair("c.key_values", "key", lambda x: x["value"]).alias("key_values"), pair("c.text_marks", "text", lambda x: x["marks"][0]).alias("marks"), pair("c.links", "text", lambda x: x["href"]).alias("links"))

cases("q_cards_of_html", "case_id int, html string", _HTML, _cards,
      [(7, "A", "k=v\nw", "5=strikethrough", "go=/x"), (7, "B", "k=u\nw", "", "go=/y")], "case_id INTEGER, title VARCHAR, key_values VARCHAR, marks VARCHAR, links VARCHAR")

cases("q_aria_signals", "case_id int, html string", [(1, '<b aria-selected="true" role="tab">'), (2, '<ul role="tablist"><li role="x tab">'), (3, "<p>role=tab</p>"), (4, None)],
      lambda d: P.parse_pages(d, ["case_id"]).select("case_id", text_list("signals").alias("signals")),
      [(1, "role_tab,aria_selected"), (2, "role_tablist,role_tab"), (3, ""), (4, "")], "case_id INTEGER, signals VARCHAR")

cases("q_link_regions", "case_id int, html string", [(1, "<nav><a href='/n'>N</a></nav><main><p><a href='/m' title='t' download>M <b>x</b></a></p></main><footer><a href='/f'>F</a></footer><a href='/o' aria-label='l'></a><a>none</a>")],
      lambda d: P.page_links(d, ["case_id"]).select("href", "anchor_text", "page_region", "title", "aria_label", "is_download"),
      [("/n", "N", "nav", None, None, False), ("/m", "M x", "main", "t", None, True), ("/f", "F", "footer", None, None, False), ("/o", "", "other", None, "l", False)],
      "href VARCHAR, anchor_text VARCHAR, page_region VARCHAR, title VARCHAR, aria_label VARCHAR, is_download BOOLEAN")

cases("q_chunks_of_markdown", "case_id int, text string", [(1, "# A\n\none\n\ntwo\n\n## B\n\n|a|b|\n|-|-|\n|1|2|\n\n```\n# x\n\ny\n```"), (2, "# only"), (3, "a\r\nb\n\n### C #\nd")],
      lambda d: P.chunk(d, ["case_id"]).select("case_id", "chunk_index", text_list("heading_path").alias("path"), "table_context", "content"),
      [(1, 0, "A", None, "one\n\ntwo"), (1, 1, "A,B", "|a|b|\n|-|-|", "|a|b|\n|-|-|\n|1|2|"), (1, 2, "A,B", None, "```\n# x\n\ny\n```"), (3, 0, "", None, "a\nb"), (3, 1, "C", None, "d")],
      "case_id INTEGER, chunk_index INTEGER, path VARCHAR, table_context VARCHAR, content VARCHAR")

cases("q_units_of_html", "case_id int, html string", [(1, "<h2>H</h2><p>a</p><ul><li>b<ul><li>d</li></ul></li><li>c</li></ul><table><tr><th>x</th></tr><tr><td>1</td></tr></table>")],
      lambda d: P.statement_units(P.parse_pages(d, ["case_id"]), ["case_id"]).drop("case_id"),
      [(0, "a", "H"), (1, "b", "H"), (2, "c", "H"), (3, "d", "H"), (4, "1", "x")], "unit_no INTEGER, text VARCHAR, context VARCHAR")

_TABLE = "<h1>T</h1><table><tr><th>n</th><th>v</th></tr><tr><td>{}</td><td>{}</td></tr><tr><td>z</td><td>9</td></tr></table>"

_PAIRS = [
    (1, _TABLE.format("a", 1), _TABLE.format("a", 2)), (2, _TABLE.format("z", 1), _TABLE.format("z", 2)), (3, "<h1>a</h1>", "<h1>b</h1>"), (4, None, "<p>x</p>"),
    (5, "<ul><li>p<ul><li>x</li></ul></li><li>q</li></ul>", "<ul><li>p</li><li>q<ul><li>x</li></ul></li></ul>"), (6, "<h2>H</h2><p>old <a href='/a'>l</a></p>", "<h2>H</h2><p>new <a href='/b'>l</a></p>"),
    (7, "<p>a</p><p>b</p>", "<p>a</p>"), (8, "<p>a</p>", "<p>a</p>"), (9, "<ul><li>one</li><li>two</li></ul>", "<ul><li>one</li><li>three</li></ul>"),
]

def _sides(d: DataFrame, function) -> DataFrame:
    side = lambda c: P.parse_pages(d.select("case_id", F.col(c).alias("html")), ["case_id"]).select("case_id", F.transform("blocks", lambda b: b["json"]).alias(c))
    both = d.select("case_id", *[F.col(c).isNull().alias(f"no_{c}") for c in ("a", "b")]).join(side("a"), "case_id").join(side("b"), "case_id")
    both = both.select("case_id", *[F.when(~F.col(f"no_{c}"), F.col(c)).alias(c) for c in ("a", "b")])
    return function(both, ["case_id"], "a", "b")

def _block_diff(d: DataFrame) -> DataFrame:
    got = _sides(d, P.block_diff)
    part = lambda path: F.get_json_object("changes", path)
    return got.select(
        "case_id", "n_changes", part("$[0].change").alias("change"), part("$[0].block_type").alias("block_type"), part("$[0].rows").alias("rows"),
        part("$[0].items[*].change").alias("items"), part("$[0].links_changed").alias("links_changed"), part("$[0].heading_path").alias("path"),
    )

cases("q_block_diff", "case_id int, a string, b string", _PAIRS, _block_diff,
      [
          (1, 1, "modified", "table", '[{"change":"modified","changed_cells":[{"column":"v","current":"2","previous":"1"}],"row_key":"a"}]', None, None, '["T"]'),
          (2, 1, "modified", "table", '[{"change":"modified","changed_cells":[{"column":"v","current":"2","previous":"1"}],"row_key":null}]', None, None, '["T"]'),
          (3, 0, None, None, None, None, None, None), (4, None, None, None, None, None, None, None), (5, 1, "modified", "list", None, '["deleted","added"]', None, "[]"),
          (6, 1, "modified", "paragraph", None, None, "true", '["H"]'), (7, 1, "deleted", "paragraph", None, None, None, "[]"), (8, 0, None, None, None, None, None, None),
          (9, 1, "modified", "list", None, '"modified"', None, "[]"),
      ], "case_id INTEGER, n_changes INTEGER, change VARCHAR, block_type VARCHAR, rows VARCHAR, items VARCHAR, links_changed VARCHAR, path VARCHAR")

_TWO = "<section><div><h3>A</h3><p>{}</p></div><div><h3>{}</h3><p>two</p></div></section>"

cases("q_state_diff", "case_id int, a string, b string", [(1, _TWO.format("one", "B"), _TWO.format("uno", "B")), (2, _TWO.format("one", "B"), _TWO.format("one", "C")), (3, "<p>x</p>", "<p>y</p>"), (4, "<p>x</p>", "<p>x</p>")],
      lambda d: _sides(d, P.state_diff).select("case_id", F.explode(F.from_json("changes", "array<struct<change:string,kind:string,title:string,previous:string,current:string>>")).alias("c")).select("case_id", "c.*"),
      [
          (1, "modified", "card", "A", "### A\n\none", "### A\n\nuno"), (2, "deleted", "card", "B", "### B\n\ntwo", None), (2, "added", "card", "C", None, "### C\n\ntwo"),
          (3, "deleted", "block", None, "x", None), (3, "added", "block", None, None, "y"),
      ], "case_id INTEGER, change VARCHAR, kind VARCHAR, title VARCHAR, previous VARCHAR, current VARCHAR")

cases("q_line_diff", "case_id int, a string, b string", [(1, "a\nb\nc", "a\nB\nc"), (2, "", "x"), (3, "1\n2\n3\n4\n5\n6", "2\n3\n4\n5\n6"), (4, None, "")],
      lambda d: P.content_diff(d, ["case_id"], "a", "b"),
      [(1, "--- previous\n+++ current\n@@ -1,3 +1,3 @@\n a\n-b\n+B\n c"), (2, "--- previous\n+++ current\n@@ -0,0 +1 @@\n+x"), (3, "--- previous\n+++ current\n@@ -1,4 +1,3 @@\n-1\n 2\n 3\n 4"), (4, "")],
      "case_id INTEGER, diff VARCHAR")

cases("q_text_forms", "case_id int, a string", [(1, " x\u00a0\u3000y\n z "), (2, "\r\n a\r\nb\rc \n"), (3, "p|q\nr"), (4, None)],
      lambda d: d.select("case_id", T.collapse(F.col("a")).alias("collapsed"), T.normalize_newlines(F.col("a")).alias("lines"), T.escape_cell(F.col("a")).alias("cell")),
      [(1, "x y z", "x\u00a0\u3000y\n z", " x\u00a0\u3000y  z "), (2, "a b c", "a\nb\nc", "   a  b c  "), (3, "p|q r", "p|q\nr", "p\\|q r"), (4, None, None, None)],
      "case_id INTEGER, collapsed VARCHAR, lines VARCHAR, cell VARCHAR")

cases("q_public_urls", "url string", [(u,) for u in (
          "https://x.com", "ftp://x.com/", "http://u@x.com/", "http://x.com:8080/", "http://x.com:80/a", "http://10.0.0.1/", "http://8.8.8.8/", "http://192.0.2.7/", "http://224.0.0.1/", "http://localhost/", "http://a.local/",
          "http://a.lan/", "http://[::1]/", "http://[2606:4700::1111]/", "http://[2001:db8::1]/", "http://[fe80::1]/", "http://[fd00::1]:443/", "https://x.com/?token=abcdefgh", "http://300.1.1.1/")],
      lambda d: d.select("url", U.is_public(F.col("url")).alias("is_public")),
      [("https://x.com", True), ("ftp://x.com/", False), ("http://u@x.com/", False), ("http://x.com:8080/", False), ("http://x.com:80/a", True), ("http://10.0.0.1/", False), ("http://8.8.8.8/", True), ("http://192.0.2.7/", False),
       ("http://224.0.0.1/", True), ("http://localhost/", False), ("http://a.local/", False), ("http://a.lan/", True), ("http://[::1]/", False), ("http://[2606:4700::1111]/", True), ("http://[2001:db8::1]/", False),
       ("http://[fe80::1]/", False), ("http://[fd00::1]:443/", False), ("https://x.com/?token=abcdefgh", False), ("http://300.1.1.1/", True)],
      "url VARCHAR, is_public BOOLEAN")

cases("q_url_match", "a string, b string", [("http://x.com/a", "http://x.com/a"), ("http://X.com/a/", "http://x.com/a"), ("http://x.com/a", "http://x.com/b"), ("http://x.com", "http://x.com/")],
      lambda d: d.select("a", "b", U.match_kind(F.col("a"), F.col("b")).alias("kind")),
      [("http://x.com/a", "http://x.com/a", "exact"), ("http://X.com/a/", "http://x.com/a", "equivalent"), ("http://x.com/a", "http://x.com/b", "unmatched"), ("http://x.com", "http://x.com/", "equivalent")], "a VARCHAR, b VARCHAR, kind VARCHAR")

cases("q_action_links", "url string, said string, download boolean", [("https://a.b/p", "隐私政策", False), ("https://a.b/docs", "API docs", False), ("https://a.b/x.zip", "get", False), ("https://a.b/y", "file", True), ("https://a.b/sign-in/", "go", None)],
      lambda d: d.select("url", U.is_noise(F.col("url"), F.col("said"), F.col("download")).alias("is_noise")),
      [("https://a.b/p", True), ("https://a.b/docs", False), ("https://a.b/x.zip", True), ("https://a.b/y", True), ("https://a.b/sign-in/", True)], "url VARCHAR, is_noise BOOLEAN")

cases("q_offset_times", "a string", [("2024-01-01T00:00:00",), ("2024-01-01T02:00:00+02:00",), ("2024-01-01T00:00:00Z",), ("undated; retrieved 2024-01-02",), ("2024-01-03",), ("nonsense",)],
      lambda d: d.select("a", F.unix_timestamp(T.parse_instant(F.col("a"))).alias("instant"), F.unix_timestamp(T.case_instant(F.col("a"))).alias("of_case")),
      [("2024-01-01T00:00:00", None, None), ("2024-01-01T02:00:00+02:00", 1704067200, 1704067200), ("2024-01-01T00:00:00Z", 1704067200, 1704067200), ("undated; retrieved 2024-01-02", None, 1704153600), ("2024-01-03", None, 1704240000), ("nonsense", None, None)],
      "a VARCHAR, instant BIGINT, of_case BIGINT")

cases("q_json_identity", "j string", [('{"b": {"Gold": 1}, "a": [2, {"c": 3}]}',), ('{"a": [2, {"c": 3}], "b": {"Gold": 1}}',), ('{"api_key": 1, "x": {"Password": 2}}',), (None,)],
      lambda d: d.select("j", fingerprint("j").alias("body_hash"), text_list(all_keys("j")).alias("keys"), F.coalesce(leaks("j", {"gold"}), F.lit(False)).alias("leaks"), text_list(F.array_sort(PR.secret_fields(F.col("j")))).alias("secrets")),
      [], "j VARCHAR")

cases("q_state_keys", "scope array<string>, path array<string>", [(["Plan"], ["Ｐro  "]), (["PLAN"], ["pro"]), (None, ["x"])],
      lambda d: d.select(state_key("scope", "path").alias("state_key")), [], "state_key VARCHAR")

cases("q_scope_ids", "w string, p string", [("ws", "prod"), ("ws", None), ('a"b', "é")],
      lambda d: d.select("w", "p", PR.scope_id(F.col("w"), F.col("p")).alias("scope_id")), [], "w VARCHAR")

_DECISION = (
    "id int, decision string, event_type string, event_subject string, change_action string, event_time string, effective_time string, affected_scope string, change_items array<struct<item:string,previous_state:string,current_state:string>>, "
    "citations map<string,array<struct<input_field:string,excerpt:string>>>, previous_state string, current_state string, relevant_source_context string, detection_path string, evidence_status string, source_credibility string"
)

_CITED = {
    "event_type": [("current_state", "price 12")], "event_subject": [("current_state", "Pro")], "change_items.0.item": [("current_state", "price")],
    "change_items.0.previous_state": [("previous_state", "price 10")], "change_items.0.current_state": [("current_state", "price 12")],
}

def _decision(k: int, cite: dict | None = None, drop: str | None = None, **change) -> tuple:
    base = {
        "id": k, "decision": "event", "event_type": "pricing", "event_subject": "Pro", "change_action": None, "event_time": None, "effective_time": None, "affected_scope": None, "change_items": [("price", "10", "12")],
        "citations": {f: q for f, q in (_CITED | (cite or {})).items() if f != drop}, "previous_state": "Pro price 10", "current_state": "Pro price 12", "relevant_source_context": None,
        "detection_path": "state_comparison", "evidence_status": "confirmed", "source_credibility": "official",
    }
    return tuple((base | change).values())

_DECISIONS = [
    _decision(1), _decision(2, drop="event_subject"), _decision(3, {"affected_scope": [("current_state", "Pro")]}), _decision(4, {"event_subject": []}), _decision(5, {"event_type": [("current_state", "price 99")]}),
    _decision(6, {"change_items.0.current_state": [("previous_state", "price 10")]}), _decision(7, {"event_time": [("current_state", "price 12")]}, event_time="2024"), _decision(8, evidence_status="pending"),
    _decision(9, change_items=[("price", None, "12")], drop="change_items.0.previous_state"), _decision(10, change_items=[("price", "12", "12")], cite={"change_items.0.previous_state": [("previous_state", "price 10"), ("previous_state", "12")]}, previous_state="Pro price 10 12"),
    _decision(11, detection_path="explicit_statement", source_credibility="unverified"), _decision(12, decision="no_event", event_type=None, event_subject=None, change_items=None, citations=None),
]

cases("q_claim_rules", _DECISION, _DECISIONS, lambda d: d.select("id").join(EV.first_violation(EV.claim_violations(d, ["id"]), ["id"]), "id", "left").select("id", "rule", "field"),
      [
          (1, None, None), (2, "citation_missing", "event_subject"), (3, "invalid_reference", "affected_scope"), (4, "citation_empty", "event_subject"), (5, "excerpt_not_found", "event_type"),
          (6, "invalid_input_field", "change_items.0.current_state"), (7, "claim_not_verbatim", "event_time"), (8, "unconfirmed_input", ""), (9, "comparison_side_missing", "change_items.0.previous_state"),
          (10, "identical_states", "change_items.0"), (11, "unofficial_statement", ""), (12, None, None),
      ], "id INTEGER, rule VARCHAR, field VARCHAR")

cases("q_fact_fields", _DECISION, [_decision(1), _decision(2, event_type=None, change_items=None, event_time="2024")], lambda d: EV.fact_fields(d, ["id"]),
      [(1, "event_type", "pricing"), (1, "event_subject", "Pro"), (1, "change_items.0.item", "price"), (1, "change_items.0.previous_state", "10"), (1, "change_items.0.current_state", "12"), (2, "event_subject", "Pro"), (2, "event_time", "2024")],
      "id INTEGER, field VARCHAR, value VARCHAR")

cases("q_decisions_of_cases", "c int, decision string, event_type string, event_subject string, change_action string, event_time string, effective_time string, affected_scope string",
      [(1, "no_event", *[None] * 6), (1, "event", "pricing", "Pro", "up", None, None, None), (2, "uncertain", *[None] * 6), (2, "no_event", *[None] * 6), (3, "event", "pricing", "A", *[None] * 4), (3, "event", "access", "B", *[None] * 4)],
      lambda d: EV.normalize_decisions(d, "c").select("c", "decision", "n_events", "event_type", "event_subject"),
      [(1, "event", 1, "pricing", "Pro"), (2, "uncertain", 0, None, None), (3, "event", 2, None, None)], "c INTEGER, decision VARCHAR, n_events BIGINT, event_type VARCHAR, event_subject VARCHAR")

_EVENT_SCHEMA = "event_id string, competitor string, event_type string, observed string, evidence array<struct<evidence_id:string,source_url:string,source_credibility:string,evidence_status:string,evidence_capability:string,relevant_excerpt:string,observed_at:string>>"

cases("q_semantic_view", _EVENT_SCHEMA, [("e1", "X", "pricing", "2024", [("i", "http://x", "official", "confirmed", "t", "q", "2024")]), ("e2", "X", None, "2025", [])],
      lambda d: d.select("event_id", PR.semantic_view(["competitor", "event_type"]).alias("view")),
      [("e1", '{"competitor":"X","event_type":"pricing","evidence":[{"source_url":"http://x","source_credibility":"official","evidence_status":"confirmed","evidence_capability":"t","relevant_excerpt":"q"}]}'), ("e2", '{"competitor":"X","event_type":null,"evidence":[]}')],
      "event_id VARCHAR, view VARCHAR")

cases("q_local_context", "id int, changes array<struct<heading_path:array<string>,headers:array<string>,context_blocks:array<string>,card_title:string,previous:string>>",
      [(1, [(["A", "B"], None, ["c"], None, "x"), (None, ["h"], None, "T", "y")]), (2, []), (3, None)], lambda d: d.select("id", PR.local_context(F.col("changes")).alias("context")),
      [(1, '[{"heading_path":["A","B"],"context_blocks":["c"]},{"headers":["h"],"card_title":"T"}]'), (2, None), (3, None)], "id INTEGER, context VARCHAR")

cases("q_side_texts", "id int, changes array<struct<previous:array<string>,current:array<string>>>", [(1, [(["a", "b"], ["c"]), (["b"], [])]), (2, [])],
      lambda d: d.select("id", *[EV.local_side(F.col("changes"), s).alias(s) for s in ("previous", "current")]), [(1, "a\nb", "c"), (2, None, None)], "id INTEGER, previous VARCHAR, current VARCHAR")

_NESTED = "id int, body struct<title:string,n:int,tags:array<string>,more:map<string,string>>"

cases("q_redact_deep", _NESTED, [(1, ("ok", 1, ["token: abcdefg", "in /tmp/x"], {"k": "C:\\x", "l": "fine"})), (2, None)],
      lambda d: d.select("id", T.map_strings(F.col("body"), d.schema["body"].dataType, T.redact).alias("b")).select("id", "b.title", text_list("b.tags").alias("tags"), F.col("b.more")["k"].alias("k"), F.col("b.more")["l"].alias("l")),
      [(1, "ok", "[secret],[path]", "[path]", "fine"), (2, None, None, None, None)], "id INTEGER, title VARCHAR, tags VARCHAR, k VARCHAR, l VARCHAR")

cases("q_qualify_deep", _NESTED, [(1, ("c1", 1, ["c2", "other"], {"k": "c1"}))],
      lambda d: d.select(T.map_strings(F.col("body"), d.schema["body"].dataType, lambda x: F.when(x.rlike("^c[0-9]+$"), F.concat(F.lit("research:"), x)).otherwise(x)).alias("b")).select("b.title", text_list("b.tags").alias("tags"), F.col("b.more")["k"].alias("k")),
      [("research:c1", "research:c2,other", "research:c1")], "title VARCHAR, tags VARCHAR, k VARCHAR")

cases("q_model_text", "title string, heads array<string>, tab string, content string", [("T", ["A", "B"], "|h|", "c"), ("", [], None, "c")],
      lambda d: d.select(R.model_text(F.col("title"), F.col("heads"), F.col("tab"), F.col("content")).alias("model_text")), [("T\nA\nB\n|h|\n\nc",), ("\n\nc",)], "model_text VARCHAR")

cases("q_model_items", "result_id string, source string, source_group string, domain string, title string, content string, credibility string, status string, url string, path string", [("r1", "page", "g", "competitor", "t", "c", "official", "read", "http://x", "/p"), ("r2", *["x"] * 9)],
      lambda d: PR.model_items(d, ["r1"]), [("r1", "page", "g", "competitor", "t", "c", "official", "read")], "result_id VARCHAR, source VARCHAR, source_group VARCHAR, domain VARCHAR, title VARCHAR, content VARCHAR, credibility VARCHAR, status VARCHAR")

cases("q_research_view", "event_id string, status string, namespace string, key string, error_type string, result string", [("a", "completed", "n", "k1", None, "R"), ("b", "failed", "n", "k2", None, "S"), ("c", "failed", "n", "k3", "quota", "S"), ("d", "running", "n", "k4", None, "S")],
      lambda d: PR.research_view(d.drop("result"), d.select("namespace", "key", "result")), [("a", True, "completed", "R", None), ("b", True, "failed", None, "research_error"), ("c", True, "failed", None, "quota"), ("d", True, "running", None, None)],
      "event_id VARCHAR, recommended BOOLEAN, status VARCHAR, result VARCHAR, error_type VARCHAR")

cases("q_input_rules", "id int, w string, p string, c string, official string, more array<string>, profile string, focus string",
      [(1, "w", None, "c", "https://x.com", [], None, ""), (2, "", "", "c", None, None, None, ""), (3, "w", None, " ", "http://u@x.com", ["https://y.com"], None, ""), (4, "w", None, "c", None, ["ftp://y"], "p" * 4001, "my password: hunter22")],
      lambda d: d.select("id", text_list(PR.input_violations(*[F.col(c) for c in ("w", "p", "c", "official", "more", "profile", "focus")])).alias("violations")),
      [(1, ""), (2, "workspace_length,product_length"), (3, "unsafe_text,unsafe_url"), (4, "profile_length,unsafe_text,unsafe_url")], "id INTEGER, violations VARCHAR")

cases("q_meaningful_blocks", "id int, types array<string>, cards array<int>", [(1, ["heading"], [None]), (2, ["heading", "table"], [None, None]), (3, ["group"], [0]), (4, ["group"], [2]), (5, [], [])],
      lambda d: d.select("id", PR.has_meaningful_blocks(F.col("types"), F.col("cards")).alias("meaningful")), [(1, False), (2, True), (3, False), (4, True), (5, False)], "id INTEGER, meaningful BOOLEAN")

cases("q_replacements", "domain string, product_id string, document_id string, content_hash string, display_name string, create_only boolean, expected_content_hash string, stored boolean",
      [("d", "p", "a", "h1", "One", False, None, True), ("d", "p", "b", "h2", "Two", False, None, True), ("d", "p", "a", "h9", "new", True, None, False), ("d", "p", "c", "h9", "new", False, None, False), ("d", "p", "b", "h9", "new", False, "old", False), ("d", "p", "e", "h1", "new", True, None, False), ("d", "p", "f", "h9", " ONE", True, None, False), ("d", "p", "g", "h9", "x", True, None, False)],
      lambda d: R.replacement_conflicts(d.where("not stored").drop("stored"), d.where("stored").drop("stored", "create_only", "expected_content_hash")).select("document_id", "conflict"),
      [("a", "document_exists"), ("c", "document_not_found"), ("b", "document_changed"), ("e", "duplicate_content"), ("f", "display_name_conflict"), ("g", None)], "document_id VARCHAR, conflict VARCHAR")

cases("q_changed_ancestor", "page int, path string, depth int, before string, after string", [(1, "/", 0, "a", "b"), (1, "/x", 1, "a", "b"), (1, "/x/y", 2, "a", "b"), (1, "/x/z", 2, "a", "a"), (2, "/", 0, "a", "b"), (3, "/q", 1, None, "b")],
      lambda d: S.nearest_changed_ancestor(d.withColumnRenamed("before", "f"), d.withColumnRenamed("after", "f"), ["page"], "path", "depth", "f"), [(1, "/x/y"), (3, "/q")], "page INTEGER, scope VARCHAR")

cases("q_own_content", "page int, path string, is_scope boolean", [(1, "/a/b", True), (1, "/a/b/c", False), (1, "/a/x", False), (2, "/a/b/c", False)],
      lambda d: S.own_content(d.where("not is_scope"), d.where("is_scope"), ["page"], "path").select("page", "path"), [(1, "/a/x"), (2, "/a/b/c")], "page INTEGER, path VARCHAR")

cases("q_same_domains", "a array<string>, b array<string>", [(["X.com", "y.com"], ["y.COM", "x.com", "x.com"]), (["x.com"], ["y.com"])],
      lambda d: d.select(text_list("a").alias("a"), L.same_set(F.col("a"), F.col("b")).alias("same")), [("X.com,y.com", True), ("x.com", False)], "a VARCHAR, same BOOLEAN")

cases("q_statement_plan", "workspace string, statement_id string, statement_date string, initial_backfill boolean, state string, origin string, seen boolean",
      [("w", "a", "2024-03-01", True, None, None, False), ("w", "b", "2023-01-01", True, None, None, False), ("w", "c", None, False, None, None, False), ("w", "d", None, False, None, None, True), ("w", "e", "2024-03-01", False, "pending", "historical_backfill", False), ("w", "f", "2024-03-02", True, "processed", "historical_backfill", False)],
      lambda d: ST.plan(d.select("workspace", "statement_id", F.col("statement_date").cast("date").alias("statement_date"), "initial_backfill"), d.where("seen").select("workspace", "statement_id"), d.where("state is not null").select("workspace", "statement_id", "state", "origin"), F.lit("2024-03-10").cast("date")).select("statement_id", "origin"),
      [("a", "historical_backfill"), ("c", "normal_monitoring"), ("e", "retry")], "statement_id VARCHAR, origin VARCHAR")

_MACHINE = "k string, seq int, action string, token string, request_id string, content string"

def _machine(step, out):
    return lambda d: STATE.in_batch(d, ["k"], ["seq"], step, f"k string, seq int, {out}")

cases("q_preference_states", _MACHINE, [("a", k, a, None, None, c) for k, (a, c) in enumerate([("edit", "x"), ("suggest", "v1"), ("edit", "x"), ("confirm", None), ("edit", "v2"), ("remove", None), ("confirm", None)])] + [("b", 0, "add", None, None, "w"), ("b", 1, "ignore", None, None, None)],
      _machine(STATE.preference, "state string, content string, accepted boolean"),
      [("a", 0, "none", None, False), ("a", 1, "pending", "v1", True), ("a", 2, "pending", "v1", False), ("a", 3, "confirmed", "v1", True), ("a", 4, "confirmed", "v2", True), ("a", 5, "inactive", "v2", True), ("a", 6, "inactive", "v2", False), ("b", 0, "confirmed", "w", True), ("b", 1, "confirmed", "w", False)],
      "k VARCHAR, seq INTEGER, state VARCHAR, content VARCHAR, accepted BOOLEAN")

cases("q_gold_rules", "case_id string, path string, decision string, event_type string, event_subject string, change_action string, annotation_status string, annotated_by string",
      [("a", "state_comparison", "event", "pricing", "s", None, "ready", "me"), ("b", "x", "maybe", None, None, None, "draft", None), ("c", "explicit_statement", "no_event", None, "s", None, "ready", None), ("d", "explicit_statement", "event", None, None, None, "draft", None), ("e", "state_comparison", "no_event", *[None] * 5), ("e", "state_comparison", "no_event", *[None] * 5)],
      lambda d: X.gold_violations(d).select("case_id", text_list("violations").alias("violations")),
      [("a", ""), ("b", "path,decision"), ("c", "facts_without_event,annotator_missing"), ("d", "event_without_type"), ("e", "duplicate_case"), ("e", "duplicate_case")], "case_id VARCHAR, violations VARCHAR")

cases("q_legacy_gold_rules", "case_id string, expected string", [("a", '{"title": 1}'), ("b", '{"x": [{"contextual_diff_expected": 1}]}'), ("c", "{}"), ("c", "{}"), (" ", "{}")],
      lambda d: PR.legacy_violations(d).select("case_id", text_list("violations").alias("violations")), [("a", ""), ("b", "forbidden_field"), ("c", "duplicate_case"), ("c", "duplicate_case"), (" ", "case_id_missing")], "case_id VARCHAR, violations VARCHAR")

cases("q_expected_set", "id string, target string", [("a", "x"), ("b", "y"), ("d", "z")], lambda d: X.expected_set(d, {"a": "x", "b": "q", "c": "w"}, "id", "target").select("id", "target"), [("b", "y"), ("c", None), ("d", "z")], "id VARCHAR, target VARCHAR")

cases("q_blocked_errors", "c string, e string", [("LLMConfigurationError", None), ("ValueError", "quota_exceeded"), ("ValueError", "other"), (None, None)],
      lambda d: d.select("c", "e", X.is_blocked(F.col("c"), F.col("e")).alias("blocked")), [("LLMConfigurationError", None, True), ("ValueError", "quota_exceeded", True), ("ValueError", "other", False), (None, None, False)], "c VARCHAR, e VARCHAR, blocked BOOLEAN")

cases("q_time_eligible", "id int, decision string, gold string, body string", [(1, "event", "2024-01-02", "on 2024-01-02 or 2024-01-03"), (2, "event", "2024-01-02", "none"), (3, "no_event", "2024-01-02", "2024-01-02"), (4, "event", "2024-01-02 2024-01-03", "2024-01-02 2024-01-03")],
      lambda d: d.select("id", X.time_eligible(F.col("decision"), T.dates_in(F.col("gold")), T.dates_in(F.col("body"))).alias("eligible")), [(1, True), (2, False), (3, False), (4, False)], "id INTEGER, eligible BOOLEAN")

_CASES = "case_id string, path string, gold_decision string, gold_type string, decision string, event_type string, n_events int, n_evidence int, n_unverified int, model_calls int, execution_status string"

_SCORED = [("a", "p", "event", "x", "event", "x", 1, 1, 0, 1, "SUCCESS"), ("b", "p", "no_event", None, "event", "x", 1, 0, 1, 2, "SUCCESS"), ("c", "q", "uncertain", None, None, None, 0, 0, 0, 0, "ERROR"), ("d", "q", "event", "x", "event", "y", 2, 1, 0, 1, "SUCCESS")]

cases("q_review_queue", _CASES, _SCORED, lambda d: X.review_queue(X.score_case(d)).select("case_id", text_list("review_reasons").alias("reasons")), [("b", "decision"), ("d", "event_type,several_events")], "case_id VARCHAR, reasons VARCHAR")

cases("q_offline_rescore", _CASES, _SCORED, lambda d: PR.rescore(d.select("case_id", "gold_decision", "gold_type"), d.where("case_id <> 'c'").drop("gold_decision", "gold_type", "path")).select("n_cases", "n_success", "n_blocked", "n_error", "valid_accuracy", "end_to_end_accuracy"),
      [(4, 3, 1, 0, 2 / 3, 0.5)], "n_cases BIGINT, n_success BIGINT, n_blocked BIGINT, n_error BIGINT, valid_accuracy DOUBLE, end_to_end_accuracy DOUBLE")

cases("q_filtered_cases", _CASES, _SCORED, lambda d: PR.filter_cases(d, path="q").select("case_id"), [("c",), ("d",)], "case_id VARCHAR")

cases("q_text_damage", "c int, at int, stage string, body string, target string", [(1, 0, "html", "a  Target b", "target"), (1, 1, "blocks", "a b", "target"), (1, 2, "text", "a", "target"), (2, 0, "html", "x y", "X\ny"), (2, 1, "blocks", "x y", "X\ny")],
      lambda d: SV.damage(d, "c", "at", "stage", "body", "target"), [(1, "blocks"), (2, None)], "c INTEGER, lost_at VARCHAR")

cases("q_triage_query", "competitor string, event_subject string, change_action string, change_items array<struct<item:string,current_state:string>>", [("X", "Pro", "up", [("price", "12"), ("seat", None)]), ("Y", None, None, None)],
      lambda d: d.select("competitor", SV.triage_query(d).alias("query")), [("X", "X Pro up price 12 seat "), ("Y", "Y   ")], "competitor VARCHAR, query VARCHAR")

cases("q_triage_rules", "event_id int, claim_no int, result_id string, source string, domain string", [(1, 1, "a", "knowledge", "own_product"), (1, 1, "b", "knowledge", "competitor"), (1, 2, "c", "memory", "own_product"), (1, 2, "d", "knowledge", "competitor"), (2, 1, "e", "knowledge", "own_product")],
      lambda d: SV.triage_violations(d.select("event_id", "claim_no", "result_id"), d.select("result_id", "source", "domain")), [(1, 2, "both_domains_needed"), (2, 1, "both_domains_needed")], "event_id INTEGER, claim_no INTEGER, violation VARCHAR")

cases("q_preferences", "memory_id string, content string, status string, source_type string, updated_at string", [("a", "x", "confirmed", "user", "1"), ("b", "y", "pending", "research", "2"), ("c", "z", "confirmed", "research", "3")],
      lambda d: SV.preference_view(d).select("memory_id", "source_label"), [("a", "stated"), ("b", "suggested"), ("c", "confirmed")], "memory_id VARCHAR, source_label VARCHAR")

cases("q_acquisition", "id int, e string, q string, signals array<string>", [(1, "timeout", None, []), (2, None, "FAIL", []), (3, None, "PASS", ["role_tab"]), (4, None, "PASS", []), (5, "blocked", None, [])],
      lambda d: d.select("id", P.acquisition(F.col("e"), F.col("q"), F.col("signals")).alias("reason")), [(1, "static_acquisition_error"), (2, "static_quality_gate"), (3, "interactive_structure"), (4, None), (5, None)], "id INTEGER, reason VARCHAR")

cases("q_snapshot_rows", "url string, content string, at string", [("u", "x", "2024-01-01 00:00:00"), ("v", None, "2024-01-02 00:00:00")],
      lambda d: H.snapshots(d.withColumn("at", F.col("at").cast("timestamp")), "at", "content", "v1").select("url", "content_hash", "extraction_version"), [], "url VARCHAR")


ORACLES["q_json_identity"] = """WITH v(j, canon, keys, leaks, secrets) AS (VALUES ('{"b": {"Gold": 1}, "a": [2, {"c": 3}]}', '{"a": [2, {"c": 3}], "b": {"Gold": 1}}', 'a,b,c,gold', true, ''),
('{"a": [2, {"c": 3}], "b": {"Gold": 1}}', '{"a": [2, {"c": 3}], "b": {"Gold": 1}}', 'a,b,c,gold', true, ''), ('{"api_key": 1, "x": {"Password": 2}}', '{"api_key": 1, "x": {"Password": 2}}', 'api_key,password,x', false, 'api_key,password'), (NULL, NULL, NULL, false, NULL))
SELECT j, sha256(canon) AS body_hash, keys, leaks, secrets FROM v"""

ORACLES["q_state_keys"] = """SELECT 'interactive-state:' || sha256('{"scope_path":["plan"],"state_path":["pro"]}') AS state_key FROM range(2) UNION ALL SELECT NULL"""

ORACLES["q_scope_ids"] = """SELECT w, p, sha256(body) AS scope_id FROM (VALUES ('ws', 'prod', '["ws", "prod"]'), ('ws', NULL, '"ws"'), ('a"b', 'é', '["a\\"b", "é"]')) AS v(w, p, body)"""

ORACLES["q_snapshot_rows"] = "SELECT 'u' AS url, sha256('x') AS content_hash, 'v1' AS extraction_version UNION ALL SELECT 'v', NULL, 'v1'"


@pytest.mark.parametrize("name", CASES)
def test_rule(spark, name):
    schema, rows, build, want, columns = CASES[name]
    plain = lambda v: v.isoformat() if hasattr(v, "isoformat") else list(v) if isinstance(v, (list, tuple)) else v
    got = [tuple(map(plain, r)) for r in build(spark.createDataFrame(rows, schema)).select(*columns).collect()]
    if f"q_{name}" in ORACLES:
        found = duckdb.sql(ORACLES[f"q_{name}"])
        want = found.select(*columns).fetchall()
    assert sorted(map(str, got)) == sorted(str(tuple(map(plain, r))) for r in want)
