"""The registered queries over the supplied tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens.functions import text as T
from changelens.functions import urls as U
from changelens.functions import vectors as V
from changelens.operators import events as EV
from changelens.operators import history as H
from changelens.operators import links as L
from changelens.operators import memory as M
from changelens.operators import metrics as X
from changelens.operators import pages as P
from changelens.operators import research as RS
from changelens.operators import retrieval as R
from changelens.operators import service as SV
from changelens.operators import statements as ST
from changelens.operators import states as S
from changelens.streaming import state as STATE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- history and change over `events`: (user_id, event_type) is a page, props its content ---


def _scans(spark, sf):
    e = t(spark, sf, "events")
    version = F.when(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"), "v1").otherwise("v2")
    return e.select("event_id", "ts", "user_id", "event_type", "value", "props", F.sha2(F.col("props").cast("binary"), 256).alias("content_hash"), version.alias("extraction_version"))


_SCANS = """scans AS (SELECT event_id, ts, user_id, event_type, value, props, sha256(props) AS content_hash,
  CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'v1' ELSE 'v2' END AS extraction_version FROM events),
prev AS (SELECT c.*, p.event_id AS p_id, p.content_hash AS p_hash, p.extraction_version AS p_version FROM scans c
  LEFT JOIN LATERAL (SELECT * FROM scans p WHERE p.user_id = c.user_id AND p.event_type = c.event_type AND p.ts < c.ts
                     ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) p ON true)"""
_CHANGED = "CASE WHEN p_id IS NULL OR p_version <> extraction_version THEN NULL ELSE content_hash <> p_hash END"


@query(f"WITH {_SCANS} SELECT event_id, p_id IS NULL AS is_first_scan, {_CHANGED} AS changed, CASE WHEN p_id IS NOT NULL AND p_version <> extraction_version THEN 'extraction_version_changed' END AS reason FROM prev")
def q_change_tristate(spark, sf):
    out = H.detect_changes(_scans(spark, sf), ["user_id", "event_type"], "ts", "event_id")
    return out.select("event_id", "is_first_scan", "changed", "reason")


@query(f"WITH {_SCANS} SELECT event_id, p_id AS previous_event_id FROM prev")
def q_asof_previous(spark, sf):
    e = _scans(spark, sf).withColumn("id", F.col("event_id"))
    return H.previous_strict(e, ["user_id", "event_type"], "ts", "event_id", ["id"]).select("event_id", F.col("previous_id").alias("previous_event_id"))


@query(f"WITH {_SCANS} SELECT {_CHANGED} AS changed, count(*) AS n FROM prev GROUP BY 1")
def q_change_summary(spark, sf):
    return H.detect_changes(_scans(spark, sf), ["user_id", "event_type"], "ts", "event_id").groupBy("changed").agg(F.count("*").alias("n"))


@query("SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') = count(*) THEN 'failed' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'partial' ELSE 'complete' END AS status FROM events GROUP BY 1")
def q_scan_status_fold(spark, sf):
    return H.scan_status(t(spark, sf, "events"), ["user_id"], F.col("event_type") == "error")


@query("SELECT user_id, event_type, min_by(event_id, ts) AS first_seen, max_by(event_id, ts) AS last_seen, count(*) AS n_seen FROM events GROUP BY 1, 2")
def q_first_last_seen(spark, sf):
    return H.seen(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")


@query("SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'added' WHEN props = first_value(props) OVER w THEN 'duplicate' ELSE 'unstable' END AS outcome FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def q_register_state(spark, sf):
    return H.register(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], "props").select("event_id", "outcome")


@query("SELECT event_id, coalesce(event_type = lag(event_type, 1) OVER w AND event_type = lag(event_type, 2) OVER w, false) AS is_stable FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_dom_stability(spark, sf):
    return H.stable_runs(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "is_stable")


@query("SELECT event_id, CASE WHEN max((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'BLOCKED' ELSE 'RUN' END AS status FROM events")
def q_circuit_break(spark, sf):
    return H.circuit_break(t(spark, sf, "events"), ["ts", "event_id"], F.col("event_type") == "error", ["user_id"]).select("event_id", "status")


@query("""WITH l AS (SELECT event_id, event_type, coalesce(count(*) FILTER (event_type = 'view') OVER w, 0) AS used_read, coalesce(count(*) FILTER (event_type = 'click') OVER w, 0) AS used_search, coalesce(count(*) OVER w, 0) AS used_tool
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, used_read, used_search, used_tool, (event_type <> 'view' OR used_read < 3) AND (event_type <> 'click' OR used_search < 2) AND used_tool < 10 AS allowed FROM l""")
def q_budget_ledger(spark, sf):
    kind = F.col("event_type")
    out = H.budget_ledger(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], {"read": (kind == "view", 3), "search": (kind == "click", 2), "tool": (F.lit(True), 10)})
    return out.select("event_id", "used_read", "used_search", "used_tool", "allowed")


@query("""WITH a AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'error' THEN 'ignored' WHEN 'view' THEN 'register' ELSE 'retry' END AS action FROM events),
b AS (SELECT *, min(CASE WHEN action IN ('processed', 'ignored') THEN struct_pack(ts := ts, id := event_id, action := action) END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ended FROM a)
SELECT event_id, coalesce(ended.action, 'pending') AS state, CAST(count(*) FILTER (action <> 'register' AND (ended IS NULL OR ended.id = event_id)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS attempts FROM b""")
def q_fsm_attempts(spark, sf):
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "processed").when(kind == "error", "ignored").when(kind == "view", "register").otherwise("retry")
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", action.alias("action"))
    return STATE.lifecycles(e, ["user_id"], ["ts", "event_id"], "action").select("event_id", "state", "attempts")



@query("""WITH r AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'research' WHEN 'click' THEN 'monitor' WHEN 'view' THEN 'no_action' END AS triage, ts FROM events)
SELECT event_id, row_number() OVER (ORDER BY CASE triage WHEN 'research' THEN 0 WHEN 'monitor' THEN 1 WHEN 'no_action' THEN 2 ELSE 3 END, ts DESC, event_id) AS place FROM r QUALIFY place <= 50""")
def q_event_feed_order(spark, sf):
    e = t(spark, sf, "events").withColumn("triage", F.when(F.col("event_type") == "purchase", "research").when(F.col("event_type") == "click", "monitor").when(F.col("event_type") == "view", "no_action"))
    top = e.orderBy(*EV.feed_order(F.lit(None).cast("timestamp_ntz"), F.col("ts"), F.col("triage")), "event_id").limit(50)
    return top.select("event_id", F.row_number().over(W.orderBy(*EV.feed_order(F.lit(None).cast("timestamp_ntz"), F.col("ts"), F.col("triage")), "event_id")).cast("long").alias("place"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1")
def q_recent_window(spark, sf):
    as_of = F.lit("2024-01-31").cast("timestamp_ntz")
    return t(spark, sf, "events").where(EV.recent(F.col("ts"), as_of, 7)).groupBy("event_type").agg(F.count("*").alias("n"))


# --- states: days 1-7 against days 23-30, keyed by user and type ---


def _state_sides(spark, sf):
    e = t(spark, sf, "events")
    last = e.groupBy("user_id", "event_type", F.when(F.col("ts") < F.lit("2024-01-08").cast("timestamp_ntz"), "p").when(F.col("ts") >= F.lit("2024-01-23").cast("timestamp_ntz"), "c").alias("side"))
    last = last.agg(F.max_by("props", F.struct("ts", "event_id")).alias("content_hash"))
    return last.where("side = 'p'"), last.where("side = 'c'")


_SIDES = """p AS (SELECT user_id, event_type, max_by(props, ts) AS h FROM events WHERE ts < TIMESTAMP '2024-01-08' GROUP BY 1, 2),
c AS (SELECT user_id, event_type, max_by(props, ts) AS h FROM events WHERE ts >= TIMESTAMP '2024-01-23' GROUP BY 1, 2),
m AS (SELECT coalesce(p.user_id, c.user_id) AS user_id, coalesce(p.event_type, c.event_type) AS event_type, p.h AS ph, c.h AS ch
  FROM p FULL JOIN c ON p.user_id = c.user_id AND p.event_type = c.event_type)"""


@query(f"WITH {_SIDES} SELECT user_id, event_type, CASE WHEN ph IS NULL THEN 'current_only' WHEN ch IS NULL THEN 'previous_only' WHEN ph = ch THEN 'unchanged' ELSE 'modified' END AS status FROM m")
def q_state_match(spark, sf):
    p, c = _state_sides(spark, sf)
    return S.match_states(p, c, ["user_id", "event_type"], "content_hash", F.lit(True), F.lit(True)).select("user_id", "event_type", "status")


@query(f"WITH {_SIDES} SELECT user_id, event_type, CASE WHEN ph IS NULL OR ch IS NULL THEN 'unresolved' WHEN ph = ch THEN 'unchanged' ELSE 'modified' END AS status FROM m")
def q_state_partial(spark, sf):
    p, c = _state_sides(spark, sf)
    return S.match_states(p, c, ["user_id", "event_type"], "content_hash", F.lit(True), F.lit(False)).select("user_id", "event_type", "status")


@query(f"WITH {_SIDES} SELECT event_type, CASE WHEN bool_or(coalesce(ph <> ch, false)) THEN true WHEN bool_and(ph IS NOT NULL AND ch IS NOT NULL) THEN false END AS changed, count(*) AS n_states FROM m GROUP BY user_id, event_type")
def q_state_changed_fold(spark, sf):
    p, c = _state_sides(spark, sf)
    matched = S.match_states(p, c, ["user_id", "event_type"], "content_hash", F.lit(True), F.lit(False))
    return S.fold(matched, ["user_id", "event_type"]).drop("user_id")


@query("""WITH p AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-17'), a AS (
SELECT l_partkey, max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS q, max_by(l_discount, l_orderkey * 10 + l_linenumber) AS d FROM p GROUP BY 1), b AS (
SELECT l_partkey, max_by(l_quantity, l_orderkey * 10 + l_linenumber) AS q, max_by(l_discount, l_orderkey * 10 + l_linenumber) AS d FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-17' GROUP BY 1)
SELECT coalesce(a.l_partkey, b.l_partkey) AS l_partkey, CASE WHEN a.l_partkey IS NULL THEN 'added' WHEN b.l_partkey IS NULL THEN 'deleted' WHEN a.q <> b.q OR a.d <> b.d THEN 'modified' ELSE 'unchanged' END AS status,
CAST(CASE WHEN a.l_partkey IS NULL OR b.l_partkey IS NULL THEN 2 ELSE (a.q <> b.q)::INT + (a.d <> b.d)::INT END AS BIGINT) AS n_changed FROM a FULL JOIN b ON a.l_partkey = b.l_partkey""")
def q_keyed_row_diff(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("side", F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp_ntz")).withColumn("tab", F.lit(1))
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = li.groupBy("tab", "side", "l_partkey").agg(F.max_by("l_quantity", at).alias("l_quantity"), F.max_by("l_discount", at).alias("l_discount"))
    out = S.keyed_row_diff(rows.where("side"), rows.where("not side"), ["tab"], "l_partkey", ["l_quantity", "l_discount"])
    return out.select("l_partkey", "status", F.size("changed_cells").cast("long").alias("n_changed"))


@query("SELECT o_custkey, o_orderkey, o_totalprice <> lag(o_totalprice) OVER w AS changed FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def q_price_state_change(spark, sf):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    first = F.row_number().over(w) == 1
    version = F.lit("v1")
    changed = H.change(first, version, version, F.col("o_totalprice"), F.lag("o_totalprice").over(w))
    return t(spark, sf, "orders").select("o_custkey", "o_orderkey", changed.alias("changed"))


# --- statements ---


@query("""WITH seen AS (SELECT DISTINCT user_id, props FROM events WHERE ts < TIMESTAMP '2024-01-16')
SELECT e.event_id FROM events e WHERE e.ts >= TIMESTAMP '2024-01-16' AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = e.user_id AND s.props = e.props)""")
def q_new_statements_anti(spark, sf):
    e = t(spark, sf, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return ST.not_in(e.where(F.col("ts") >= cut), e.where(F.col("ts") < cut), ["user_id", "props"]).select("event_id")


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-25' - 10 AND DATE '2024-01-25' ORDER BY day DESC, event_id DESC LIMIT 20")
def q_backfill_topk(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    return ST.backfill(e, "day", "event_id", F.lit("2024-01-25").cast("date"), 20, 10)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS unit_no FROM l WHERE trim(line) <> '')
SELECT doc_id, CAST(max(unit_no) AS BIGINT) AS n_units, CAST(max(pos) AS BIGINT) AS last_line FROM k WHERE unit_no <= 60 GROUP BY 1""")
def q_line_units_topk60(spark, sf):
    lines = t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where("trim(line) <> ''")
    units = ST.first_units(lines, ["doc_id"], "pos", 60)
    return units.groupBy("doc_id").agg(F.max("unit_no").cast("long").alias("n_units"), (F.max("pos") + 1).cast("long").alias("last_line"))


# --- documents ---

_PY_BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]"


@query(rf"SELECT doc_id, CAST(length(regexp_replace(text, '{_PY_BLANK}+', '', 'g')) AS BIGINT) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines FROM documents")
def q_content_metrics(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.visible_chars(F.col("text")).alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


_GATE_ROWS = [(-1, ""), (-2, "   \n "), (-3, "Loading"), (-4, "Please wait\nnow"), (-5, "short"), (-6, "正在加载")]
_GATE_VALUES = ", ".join(f"({i}, {' || chr(10) || '.join(repr(p) for p in s.split(chr(10)))})" for i, s in _GATE_ROWS)


@query(rf"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {_GATE_VALUES}) AS v(doc_id, text)),
m AS (SELECT doc_id, lower(text) AS low, length(regexp_replace(text, '{_PY_BLANK}+', '', 'g')) AS chars, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS blocks FROM d)
SELECT doc_id, CASE WHEN chars = 0 OR blocks = 0 THEN 'FAIL' WHEN regexp_matches(low, '加载中|正在加载|loading|please wait|enable javascript|javascript required') AND chars <= 200 AND blocks <= 5 THEN 'FAIL' WHEN chars < 120 AND blocks < 3 THEN 'WARNING' ELSE 'PASS' END AS quality,
CAST((chars = 0)::INT + (blocks = 0)::INT + (chars > 0 AND blocks > 0 AND chars <= 200 AND blocks <= 5 AND regexp_matches(low, '加载中|正在加载|loading|please wait|enable javascript|javascript required'))::INT + (chars > 0 AND blocks > 0 AND NOT (chars <= 200 AND blocks <= 5 AND regexp_matches(low, '加载中|正在加载|loading|please wait|enable javascript|javascript required')) AND chars < 120 AND blocks < 3)::INT AS BIGINT) AS n_reasons FROM m""")
def q_quality_gate(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(_GATE_ROWS, "doc_id long, text string"))
    q = P.quality_gate(d.withColumn("n_blocks", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))), "text", "n_blocks")
    return q.select("doc_id", F.col("quality.status").alias("quality"), F.size("quality.reasons").cast("long").alias("n_reasons"))


_SECRET_SQL = " OR ".join(f"regexp_matches(text, '{p}')" for p in T.SECRETS)


@query(f"SELECT doc_id FROM documents WHERE {_SECRET_SQL}")
def q_secret_scan(spark, sf):
    return t(spark, sf, "documents").where(T.contains_secret(F.col("text"))).select("doc_id")


_PATH_ROWS = [(-1, "see C:\\Users\\x"), (-2, "file://a"), (-3, "in /tmp/x"), (-4, "/var/log"), (-5, "https://x.com/home/users/a"), (-6, "at /Users/me"), (-7, "abc:/x"), (-8, "/home/me token: abc"), (-9, "x/tmp/y /etc/z")]


@query(f"SELECT doc_id, md5(CASE WHEN {_SECRET_SQL} THEN '[secret]' WHEN doc_id IN (-1, -2, -3, -4, -6) THEN '[path]' ELSE text END) AS public_md5 FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {', '.join(str(r).replace(chr(92) * 2, chr(92)) for r in _PATH_ROWS)}))")
def q_redact(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(_PATH_ROWS, "doc_id long, text string"))
    return d.select("doc_id", F.md5(T.redact(F.col("text")).cast("binary")).alias("public_md5"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def q_exact_dup_groups(spark, sf):
    h = t(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT doc_id, sha256(text) AS content_hash, length(text) AS n_chars_found FROM documents")
def q_content_hash(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"), F.length("text").cast("long").alias("n_chars_found"))


def _run_hash(k: int):
    """Hash of the k words from a place on."""
    return lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(k)), " "))


@query("SELECT DISTINCT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def q_anchor_recall(spark, sf):
    """Documents that hold a benchmark passage: candidates meet on hashes of up to five of its inner words, then the whole passage decides.

    The first and last word of a passage may be cut out of longer ones, the
    others are whole.  A passage of at most two words has no inner one and is
    looked for in every text.
    """
    words = lambda c: F.split(F.col(c), "[\\s]+")
    b = t(spark, sf, "benchmark").select("item_id", F.col("text").alias("anchor"), words("text").alias("w"))
    b = b.withColumn("k", F.greatest(F.lit(0), F.least(F.lit(5), F.size("w") - 2)))
    d = t(spark, sf, "documents").select("doc_id", "text")
    lengths = [r.k for r in b.select("k").distinct().collect()]  # six at most
    found = None
    for k in sorted(lengths):
        some = b.where(F.col("k") == k)
        if k == 0:
            pairs = d.join(some, F.contains("text", "anchor")).select("item_id", "doc_id")
        else:
            some = some.withColumn("key", F.xxhash64(F.array_join(F.slice("w", 2, k), " ")))
            at = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - k + 1)).otherwise(F.array().cast("array<int>"))
            keys = d.select("doc_id", words("text").alias("w")).select("doc_id", F.explode(F.array_distinct(F.transform(at, _run_hash(k)))).alias("key"))
            near = keys.join(some.select("item_id", "key"), "key").select("item_id", "doc_id").distinct()
            pairs = near.join(d, "doc_id").join(some.select("item_id", "anchor"), "item_id").where(F.contains("text", "anchor")).select("item_id", "doc_id")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


@query("SELECT doc_id, 'source_' || substr(sha256(source), 1, 16) AS source_group, lang || '-' || row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS result_id FROM documents")
def q_source_group_ids(spark, sf):
    d = RS.numbered(t(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang"], "doc_id")
    return d.select("doc_id", T.source_group(F.col("source"), F.lit(None).cast("string"), F.lit("x")).alias("source_group"), F.concat_ws("-", "lang", F.col("number").cast("string")).alias("result_id"))


@query("WITH a AS (SELECT doc_id, text, 0 AS side FROM documents WHERE lang <> 'en' UNION ALL SELECT doc_id, text, 1 FROM documents) SELECT doc_id FROM a QUALIFY row_number() OVER (PARTITION BY text ORDER BY side, doc_id) = 1")
def q_evidence_union_distinct(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang", "text")
    earlier, later = d.where("lang <> 'en'").drop("lang"), d.drop("lang")  # what a run had gathered, and all that the next one did
    return EV.union_distinct(earlier, later, [], ["text"], "doc_id").select("doc_id")


_DATE_ROWS = [
    (-1, "on 2024-02-30 and 2024-03-01"), (-2, "March 5th, 2024 then 7 April 2023"), (-3, "2024年1月9日发布"), (-4, "v2024.01.02 x"), (-5, "nothing"), (-6, "since 1999-01-02 and 1987/12/3"),
]


@query("""SELECT * FROM (VALUES (-1, NULL::DATE, '2024-03-01'), (-2, DATE '2024-03-05', '2024-03-05'), (-3, DATE '2024-01-09', '2024-01-09'), (-4, DATE '2024-01-02', ''), (-5, NULL, ''), (-6, NULL, '1987-12-03,1999-01-02')) AS v(doc_id, first_date, all_dates)
UNION ALL SELECT doc_id, NULL, '' FROM documents
UNION ALL SELECT o_orderkey + 1000000000, CAST(CASE WHEN year(o_orderdate) >= 2000 THEN o_orderdate ELSE o_orderdate + INTERVAL 12 YEAR END AS DATE), strftime(o_orderdate, '%Y-%m-%d') || ',' || strftime(o_orderdate + INTERVAL 12 YEAR, '%Y-%m-%d') FROM orders""")
def q_dates_in_text(spark, sf):
    later = F.col("o_orderdate") + F.expr("interval 12 years")
    text = F.concat(F.lit("order of "), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" renewed "), F.date_format(later, "MMMM d, yyyy"), F.lit(" in full"))
    d = t(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(_DATE_ROWS, "doc_id long, text string"))
    d = d.unionByName(t(spark, sf, "orders").select((F.col("o_orderkey") + 1000000000).alias("doc_id"), text.alias("text")))
    return d.select("doc_id", T.first_date(F.col("text")).alias("first_date"), F.array_join(T.dates_in(F.col("text")), ",").alias("all_dates"))


# --- pages and links ---


@query("SELECT page_id, trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS title FROM pages")
def q_page_title(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)).alias("title"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host FROM pages")
def q_page_host(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"))


@query("""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END
 || CASE WHEN regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) = '' THEN '' ELSE '?' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) END AS url_key FROM pages""")
def q_url_key(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.url_key(F.col("url")).alias("url_key"))


@query("""WITH h AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '.') AS p FROM pages)
SELECT page_id, CASE WHEN len(p) <= 2 THEN array_to_string(p, '.') WHEN length(p[len(p)]) = 2 AND p[len(p)-1] IN ('ac','co','com','edu','gov','net','org') THEN array_to_string(list_slice(p, len(p)-2, len(p)), '.') ELSE array_to_string(list_slice(p, len(p)-1, len(p)), '.') END AS domain FROM h""")
def q_registrable_domain(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.registrable_domain(U.host(F.col("url"))).alias("domain"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/?#]') AS is_valid, contains(regexp_extract(url, '^https?://([^/?#]*)', 1), '.') AS is_public FROM pages")
def q_url_checks(spark, sf):
    return t(spark, sf, "pages").select("page_id", U.is_valid(F.col("url")).alias("is_valid"), U.is_public(F.col("url")).alias("is_public"))


def _links(spark, sf):
    rows = t(spark, sf, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?s)<a href="[^"]*">.*?</a>'), F.lit(0))).alias("pos", "a"))
    rows = rows.select("page_id", "url", "pos", F.regexp_extract("a", r'<a href="([^"]*)">', 1).alias("href"), F.regexp_extract("a", r'(?s)<a href="[^"]*">(.*?)</a>', 1).alias("anchor_text"))
    rooted = F.concat(U.scheme(F.col("url")), F.lit("://"), U.authority(F.col("url")), F.col("href"))
    return rows.withColumn("target", F.when(F.col("href").startswith("/"), rooted).otherwise(F.col("href")))


_LINKS = """a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>'), 1) - 1 AS pos FROM pages),
l0 AS (SELECT page_id, url, pos, regexp_extract(a, '<a href="([^"]*)">', 1) AS href, regexp_extract(a, '(?s)<a href="[^"]*">(.*?)</a>', 1) AS anchor_text FROM a),
l AS (SELECT page_id, url, pos, href AS raw, anchor_text, CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href ELSE href END AS href FROM l0)"""


@query(f"WITH {_LINKS} SELECT page_id, raw AS href, CAST(pos AS BIGINT) AS pos FROM l QUALIFY row_number() OVER (PARTITION BY page_id, raw ORDER BY pos) = 1")
def q_page_links(spark, sf):
    return L.first_by_key(_links(spark, sf), ["page_id"], "href", "pos").select("page_id", "href", F.col("pos").cast("long").alias("pos"))


_NOISE_SQL = r"""(anchor_text = '' OR regexp_matches(lower(anchor_text), 'contact us|cookie policy|legal notice|privacy policy|sign in|sign up|terms of service')
 OR regexp_matches(lower(href), '^https?://([^/?#]*[.])?(facebook|instagram|linkedin|twitter|x|weibo|youtube)[.]com([/?#]|$)')
 OR regexp_matches(lower(regexp_extract(href, '^https?://[^/?#]*([^?#]*)', 1)), '[.](7z|avi|css|dmg|eot|exe|gif|gz|ico|jpeg|jpg|js|map|mov|mp3|mp4|msi|png|rar|svg|tar|tgz|ttf|webm|webp|woff2?|zip)$')
 OR len(list_intersect(list_transform(regexp_split_to_array(lower(regexp_extract(href, '^https?://[^/?#]*([^?#]*)', 1)), '[/_.]+'), lambda x: replace(x, '-', '')), ['account','console','contact','cookie','dashboard','legal','login','logout','privacy','register','signin','signup','terms'])) > 0)"""


@query(f"WITH {_LINKS} SELECT page_id, CAST(pos AS BIGINT) AS pos, {_NOISE_SQL} AS is_noise FROM l")
def q_link_noise(spark, sf):
    rows = _links(spark, sf)
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), U.is_noise(F.col("target"), U.describe(F.col("anchor_text")), F.lit(False)).alias("is_noise"))


def _priorities(spark, sf):
    return _links(spark, sf).withColumn("priority", U.link_priority(F.col("target"), F.col("url"), F.lit("page_link"), F.lit("main"), F.array().cast("array<string>")))


_PRIORITY = r"""d AS (SELECT *, lower(regexp_extract(href, '^https?://([^/?#:]*)', 1)) AS th, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS oh,
  len(list_filter(string_split(regexp_extract(href, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS depth, regexp_extract(href, '^[^?#]*[?]([^#]*)', 1) AS q FROM l),
r AS (SELECT *, CAST(10 + CASE WHEN th = oh THEN 30 WHEN regexp_extract(th, '([^.]+[.][^.]+)$', 1) = regexp_extract(oh, '([^.]+[.][^.]+)$', 1) THEN 20 ELSE 0 END + 10 + 5
  + CASE WHEN depth <= 2 THEN 5 WHEN depth >= 6 THEN -5 ELSE 0 END - CASE WHEN length(q) - length(replace(q, '&', '')) >= 2 THEN 5 ELSE 0 END AS INTEGER) AS priority FROM d)"""


@query(f"WITH {_LINKS}, {_PRIORITY} SELECT page_id, CAST(pos AS BIGINT) AS pos, priority FROM r")
def q_link_priority(spark, sf):
    return _priorities(spark, sf).select("page_id", F.col("pos").cast("long").alias("pos"), "priority")


@query(f"WITH {_LINKS}, {_PRIORITY} SELECT oh AS host, page_id, CAST(pos AS BIGINT) AS pos, row_number() OVER (PARTITION BY oh ORDER BY priority DESC, page_id, pos) AS place FROM r QUALIFY place <= 40")
def q_candidate_pool40(spark, sf):
    rows = _priorities(spark, sf).withColumn("host", U.host(F.col("url"))).withColumn("arrival", F.struct("page_id", "pos"))
    return L.pool(rows, ["host"], "priority", "arrival").select("host", "page_id", F.col("pos").cast("long").alias("pos"), F.col("place").cast("long").alias("place"))


@query(r"""WITH b AS (SELECT page_id, html, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS x FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS title,
(length(html) - length(replace(html, '<h1>', ''))) // 4 AS n_headings, regexp_matches(html, '\s(role|aria-selected)=') AS has_signals FROM b""")
def q_page_blocks(spark, sf):
    p = P.parse_pages(t(spark, sf, "pages"), ["page_id"])
    return p.select("page_id", "title", F.size(F.filter("blocks", lambda b: b["type"] == "heading")).cast("long").alias("n_headings"), (F.size("signals") > 0).alias("has_signals"))


_BODY = """body AS (SELECT page_id, trim(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1)) AS ad, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS head,
  regexp_replace(regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)(</article>|<footer|$)', 1), '<(/?p|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS rest FROM pages),
plain AS (SELECT page_id, unnest([struct_pack(k := 0, x := ad, context := NULL), struct_pack(k := 1, x := rest, context := head)]) AS u FROM body),
units AS (SELECT page_id, u.k AS k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u.x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS x,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(u.context, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS context FROM plain)"""


@query(f"""WITH {_BODY}, m AS (SELECT page_id, sum(length(replace(x, ' ', ''))) + 1 + max(coalesce(length(replace(context, ' ', '')), 0)) AS chars FROM units GROUP BY 1)
SELECT page_id, CASE WHEN chars = 0 THEN 'FAIL' ELSE 'PASS' END AS quality, CAST(chars AS BIGINT) AS chars, 3 AS n_blocks, 3 AS n_valid, 1 AS n_heading, 2 AS n_paragraph, 0 AS n_list, 0 AS n_table, 0 AS n_code, 0 AS n_group FROM m""")
def q_page_quality(spark, sf):
    """Quality and block counts of every page, from one parse; each has an advertisement, a heading and one paragraph left open."""
    p = P.parse_pages(t(spark, sf, "pages"), ["page_id"])
    q = P.quality_gate(p.withColumn("n_valid", F.size(F.filter("blocks", lambda b: b["has_content"]))), "content", "n_valid")
    m = P.block_metrics(q, ["page_id", F.col("quality.status").alias("quality")])
    return m.drop("headings")


@query(f"WITH {_LINKS} SELECT page_id, CAST(pos AS BIGINT) AS pos, raw AS href, 'nav' AS page_region FROM l")
def q_page_link_regions(spark, sf):
    links = P.page_links(t(spark, sf, "pages"), ["page_id"])
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "href", "page_region")


@query(f"""WITH {_BODY} SELECT page_id, CAST(k AS INTEGER) AS unit_no, md5(x) AS text_md5, context FROM units""")
def q_statement_units(spark, sf):
    u = P.statement_units(P.parse_pages(t(spark, sf, "pages"), ["page_id"]), ["page_id"])
    return u.select("page_id", "unit_no", F.md5(F.col("text").cast("binary")).alias("text_md5"), "context")


@query("SELECT doc_id, sha256(regexp_replace(text, '[\\s]+', '', 'g')) AS visible_hash, 0 AS n_bad FROM documents WHERE trim(text) <> ''")
def q_chunk_offsets(spark, sf):
    """Chunks joined hold every visible character of their document, and none is over the bound."""
    c = P.chunk(t(spark, sf, "documents"), ["doc_id"])
    parts = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("p"), F.count_if((F.length("content") > 1200) | (F.col("end") - F.col("start") != F.length("content"))).cast("int").alias("n_bad"))
    joined = F.array_join(F.transform("p", lambda x: x["content"]), "")
    return parts.select("doc_id", F.sha2(F.regexp_replace(joined, r"\s+", "").cast("binary"), 256).alias("visible_hash"), "n_bad")


@query("SELECT NULL::VARCHAR AS chunk_id, NULL::BIGINT AS n WHERE false")
def q_chunk_ids_unique(spark, sf):
    c = P.chunk(t(spark, sf, "documents"), ["doc_id"])
    cid = T.chunk_id(F.lit("own_product"), F.col("doc_id").cast("string"), F.sha2(F.col("doc_id").cast("string"), 256), 1200, F.col("chunk_index"))
    return c.select(cid.alias("chunk_id")).groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS head FROM documents), p AS (SELECT doc_id, text, lag(text) OVER (PARTITION BY head ORDER BY doc_id) AS previous FROM d),
n AS (SELECT doc_id, text, previous, len(string_split(rtrim(text, chr(10)), chr(10))) - len(string_split(rtrim(previous, chr(10)), chr(10))) AS net FROM p WHERE previous IS NOT NULL AND previous <> text)
SELECT doc_id, CAST(net AS BIGINT) AS net_lines, true AS differs FROM n""")
def q_doc_diff_near_copy(spark, sf):
    """Line differences of documents that share their first line, each with the one before it: lines gained, and that there is a difference."""
    d = t(spark, sf, "documents").select("doc_id", "text")
    heads = d.select("doc_id", F.xxhash64(F.substring_index("text", "\n", 1)).alias("head"))
    before = heads.withColumn("before", F.lag("doc_id").over(W.partitionBy("head").orderBy("doc_id"))).where("before IS NOT NULL").select("doc_id", "before")
    pairs = before.join(d, "doc_id").join(d.select(F.col("doc_id").alias("before"), F.col("text").alias("previous")), "before").where("previous <> text")
    out = P.content_diff(pairs, ["doc_id"], "previous", "text").withColumn("lines", F.slice(F.split("diff", "\n"), 3, 1 << 30))
    count = lambda sign: F.size(F.filter("lines", lambda x: F.startswith(x, F.lit(sign))))
    return out.select("doc_id", (count("+") - count("-")).cast("long").alias("net_lines"), (F.length("diff") > 0).alias("differs"))


@query("""SELECT event_id, NOT (row_number() OVER w = 1) AS was_seen, row_number() OVER w = 1 AND ts >= TIMESTAMP '2024-01-10' AS is_new FROM events WINDOW w AS (PARTITION BY user_id, props ORDER BY ts, event_id)""")
def q_stream_seen_set(spark, sf):
    baseline = F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    e = t(spark, sf, "events").select("user_id", "props", "ts", "event_id", baseline.alias("baseline"))
    return STATE.sights(e, ["user_id", "props"], ["ts", "event_id"], "baseline").select("event_id", "was_seen", "is_new")



@query("""WITH s AS (SELECT *, event_type <> 'error' AS ok FROM events)
SELECT event_id, max(CASE WHEN ok THEN struct_pack(ts := ts, id := event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).id AS previous,
max(CASE WHEN ok THEN struct_pack(ts := ts, id := event_id) END) OVER (PARTITION BY user_id ORDER BY ts, event_id).id AS processed, ok AS advanced FROM s""")
def q_stream_watermark(spark, sf):
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "error", "done").alias("outcome"))
    return STATE.watermarks(e, ["user_id"], ["ts", "event_id"], "event_id", "outcome").select("event_id", "previous", "processed", "advanced")



# --- vectors ---

_EMB = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"


@query(f"WITH {_EMB} SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS length, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first FROM e")
def q_unit_vectors(spark, sf):
    e = t(spark, sf, "embeddings").select("vec_id", V.as_doubles(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("length"), F.round(V.unit(F.col("v"))[0], 6).alias("first"))


_Q = [((7 * k) % 11 - 5) / 5 for k in range(64)]


@query(f"WITH {_EMB} SELECT vec_id, round(list_cosine_similarity(v, {_Q}::DOUBLE[]), 6) AS score FROM e ORDER BY list_cosine_similarity(v, {_Q}::DOUBLE[]) DESC, vec_id LIMIT 10")
def q_vector_topn(spark, sf):
    return R.search(t(spark, sf, "embeddings"), _Q, 10, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query(f"WITH {_EMB} SELECT vec_id, round(list_cosine_similarity(v, {_Q}::DOUBLE[]), 6) AS score FROM e WHERE label = 3 ORDER BY list_cosine_similarity(v, {_Q}::DOUBLE[]) DESC, vec_id LIMIT 10")
def q_vector_filtered(spark, sf):
    return R.search(t(spark, sf, "embeddings"), _Q, 10, "vec_id", "embedding", F.col("label") == 3).select("vec_id", F.round("score", 6).alias("score"))


_ALL = f"""{_EMB}, s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score FROM e q JOIN e c ON q.label = c.label AND q.vec_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 5)"""


@query(f"WITH {_ALL} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS BIGINT) AS rank FROM k")
def q_vector_topn_all_queries(spark, sf):
    e = t(spark, sf, "embeddings")
    return R.search_all(e, e, 5, "vec_id", "query_id", "embedding", ["label"]).select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_ALL}, r AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY vec_id % 7 DESC, rank) AS rerank_rank FROM k) SELECT query_id, vec_id, CAST(rerank_rank AS BIGINT) AS rerank_rank FROM r WHERE rerank_rank <= 2")
def q_rerank_topk(spark, sf):
    e = t(spark, sf, "embeddings")
    c = R.search_all(e, e, 5, "vec_id", "query_id", "embedding", ["label"]).withColumn("rerank_score", F.col("vec_id") % 7)
    return R.rerank(c, "query_id", "rank", "rerank_score", 2).select("query_id", "vec_id", F.col("rerank_rank").cast("long").alias("rerank_rank"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE len(embedding) <> 64 OR label > 6 GROUP BY 1")
def q_vector_space_guard(spark, sf):
    e = t(spark, sf, "embeddings").withColumn("space", F.when(F.col("label") > 6, "other").otherwise("main"))
    return R.space_violations(e, "embedding", "space", "main", 64).groupBy("label").agg(F.count("*").alias("n"))


# --- conversations and memory ---


@query("SELECT conv_id, turn, coalesce(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_earlier FROM conversations")
def q_conversation_history(spark, sf):
    from changelens.operators.research import history

    out = history(t(spark, sf, "conversations"), ["conv_id"], "turn", F.col("role") == "user", "text")
    return out.select("conv_id", "turn", F.size("history").cast("long").alias("n_earlier"))


@query("""WITH w AS (SELECT *, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS last FROM events), k AS (SELECT * FROM w WHERE last IS NULL OR last <> props)
SELECT event_id, lag(event_id) OVER v AS supersedes, lead(event_id) OVER v IS NULL AS active FROM k WINDOW v AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)""")
def q_memory_supersession(spark, sf):
    return M.supersession(t(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["props"], "event_id").select("event_id", "supersedes", "active")


@query("SELECT conv_id, turn, CAST(conv_id % 10 AS VARCHAR) AS scope_id FROM conversations WHERE role <> 'system' AND turn % 2 = 0 AND length(text) > 0")
def q_memory_eligible(spark, sf):
    """Eligible memories of every scope."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", F.lit("product").alias("scope"), (F.col("conv_id") % 10).cast("string").alias("scope_id"), F.when(F.col("role") == "system", "pending").otherwise("confirmed").alias("status"), ((F.col("turn") % 2 == 0) & (F.length("text") > 0)).alias("active"), F.col("turn").alias("updated_at"), F.col("conv_id").alias("memory_id"))
    return M.eligible(c, "product", None).select("conv_id", "turn", "scope_id")


_SECRET = lambda c: "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in T.SECRETS) + ")"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN ' ' ELSE text END AS said, CASE WHEN doc_id % 17 = 0 THEN 'token: x' ELSE 'r' || doc_id END AS reference FROM documents)
SELECT doc_id, CASE WHEN trim(said) = '' THEN 'blank' WHEN length(said) > 4000 THEN 'too_long' WHEN {_SECRET("said")} OR {_SECRET("reference")} THEN 'secret' END AS violation FROM d""")
def q_memory_source_gate(spark, sf):
    """Documents as sources, some of them blank, some with a secret for a reference."""
    said = F.when(F.col("doc_id") % 19 == 0, " ").otherwise(F.col("text"))
    reference = F.when(F.col("doc_id") % 17 == 0, "token: x").otherwise(F.concat(F.lit("r"), "doc_id"))
    return t(spark, sf, "documents").select("doc_id", M.source_violation(said, reference).alias("violation"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(length(text), turn)::BIGINT AS n_chars FROM conversations GROUP BY 1")
def q_idempotent_upsert(spark, sf):
    return M.latest(t(spark, sf, "conversations"), ["conv_id"], ["turn"]).select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))


@query("SELECT e.user_id, e.event_type FROM (SELECT DISTINCT user_id, event_type, props FROM events WHERE ts >= TIMESTAMP '2024-01-20') e WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.ts < TIMESTAMP '2024-01-20' AND p.user_id = e.user_id AND p.event_type = e.event_type AND p.props = e.props)")
def q_pending_insert(spark, sf):
    e = t(spark, sf, "events")
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    new = e.where(F.col("ts") >= cut).select("user_id", "event_type", "props").distinct()
    return M.pending_new(new, e.where(F.col("ts") < cut), ["user_id", "event_type", "props"]).select("user_id", "event_type")


@query("""WITH i AS (SELECT user_id, event_type, max_by(props, ts) AS fp FROM events GROUP BY 1, 2), c AS (SELECT user_id, event_type, max_by(props, ts) AS fp FROM events WHERE ts < TIMESTAMP '2024-01-28' GROUP BY 1, 2)
SELECT i.user_id, i.event_type, CASE WHEN c.fp IS NULL THEN 'inserted' WHEN c.fp = i.fp THEN 'unchanged' ELSE 'updated' END AS outcome FROM i LEFT JOIN c ON i.user_id = c.user_id AND i.event_type = c.event_type""")
def q_upsert_plan(spark, sf):
    e = t(spark, sf, "events")
    last = lambda df: df.groupBy("user_id", "event_type").agg(F.max_by("props", F.struct("ts", "event_id")).alias("fp"))
    return R.upsert_plan(last(e), last(e.where(F.col("ts") < F.lit("2024-01-28").cast("timestamp_ntz"))), ["user_id", "event_type"], "fp").select("user_id", "event_type", "outcome")


# --- evaluation: quality is gold, toxic the prediction ---


@query("SELECT g.v AS gold, p.v AS predicted, (SELECT count(*) FROM labels l WHERE l.quality = g.v AND l.toxic = p.v) AS n FROM (VALUES (0), (1)) g(v), (VALUES (0), (1)) p(v)")
def q_confusion_matrix(spark, sf):
    return X.confusion(t(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query("""WITH c AS (SELECT v AS label, (SELECT count(*) FROM labels WHERE quality = v) AS g, (SELECT count(*) FROM labels WHERE toxic = v) AS p, (SELECT count(*) FROM labels WHERE toxic = v AND quality = v) AS t FROM (VALUES (0), (1), (2)) x(v)),
r AS (SELECT label, g AS support, CASE WHEN p = 0 THEN 0.0 ELSE t / p END AS precision, CASE WHEN g = 0 THEN 0.0 ELSE t / g END AS recall FROM c)
SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM r""")
def q_per_class_prf(spark, sf):
    out = X.per_class(t(spark, sf, "labels"), "quality", "toxic", [0, 1, 2])
    return out.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def q_binary_prf(spark, sf):
    out = X.binary(t(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1)
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT quality, count(*) FILTER (toxic = 1) AS matched, count(*) FILTER (toxic > 5) AS none, round(count(*) FILTER (toxic = 1) / nullif(count(*), 0), 6) AS rate, CAST(NULL AS DOUBLE) AS empty_rate FROM labels GROUP BY 1")
def q_ratio_null_denominator(spark, sf):
    hit, none = F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") > 5)
    return t(spark, sf, "labels").groupBy("quality").agg(hit.alias("matched"), none.alias("none"), F.round(X.ratio(hit, F.count("*")), 6).alias("rate"), X.ratio(none, none).alias("empty_rate"))


@query("SELECT x.l AS label, (SELECT count(*) FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = x.l) AS n FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) x(l)")
def q_dataset_distribution(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels").select("doc_id"), "doc_id")
    return X.distribution(d, "lang", ["de", "en", "es", "fr", "it"])


@query("SELECT source, count(*) FILTER (toxic = 1) AS matched, count(*) AS total, round(count(*) FILTER (toxic = 1) / count(*), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def q_micro_ratio(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "source").join(t(spark, sf, "labels"), "doc_id")
    out = X.micro(d.withColumn("m", (F.col("toxic") == 1).cast("long")).withColumn("one", F.lit(1).cast("long")), ["source"], "m", "one")
    return out.select("source", "matched", "total", F.round("rate", 6).alias("rate"))


# --- event deduplication over `orders`: a customer is a competitor, status P a doubt, F a match ---

_VERDICTS = "CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 OR count(*) FILTER (o_orderstatus = 'F') > 1 THEN 'UNCERTAIN' WHEN count(*) FILTER (o_orderstatus = 'F') = 1 THEN 'SAME_EVENT' ELSE 'NEW_EVENT' END"


@query(f"SELECT o_custkey, {_VERDICTS} AS verdict FROM orders GROUP BY 1")
def q_dedup_verdict_fold(spark, sf):
    o = t(spark, sf, "orders").withColumn("v", F.when(F.col("o_orderstatus") == "P", "UNCERTAIN").when(F.col("o_orderstatus") == "F", "SAME_EVENT").otherwise("NEW_EVENT"))
    return EV.verdict_fold(o, ["o_custkey"], "v")


@query("SELECT a.o_orderkey, count(*) AS n_peers FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey GROUP BY 1")
def q_dedup_peers(spark, sf):
    o = t(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return EV.peers(o, o.select("o_custkey", F.col("o_orderkey").alias("other")), "o_custkey", "o_orderkey", "other").groupBy("o_orderkey").agg(F.count("*").alias("n_peers"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderstatus <> 'O' THEN 'uncertain' WHEN o_orderpriority LIKE '1%' THEN CASE WHEN o_totalprice > 100000 THEN NULL ELSE 'uncertain' END
 WHEN o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'no_event' WHEN o_orderpriority LIKE '4%' THEN NULL ELSE 'uncertain' END AS decision FROM orders""")
def q_event_gate(spark, sf):
    p = F.substring("o_orderpriority", 1, 1)
    decision = EV.gate(
        F.when(F.col("o_orderstatus").isin("F", "O"), "confirmed").otherwise("pending"), F.when(p == "1", "explicit_statement").otherwise("state_comparison"),
        F.when(F.col("o_totalprice") > 100000, "official").otherwise("unverified"),
        F.when(p == "2", "baseline").when(p == "3", "unchanged").when(p == "4", "comparable").otherwise("missing"), F.lit("a"), F.lit("b"), F.lit(1),
    )
    return t(spark, sf, "orders").select("o_orderkey", decision.alias("decision"))


# --- runs, scores, results and views over `orders`, `labels` and `events` ---

_RUNS = """r AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'BLOCKED' WHEN doc_id % 10 = 1 THEN 'ERROR' ELSE 'SUCCESS' END AS s, quality = 1 - toxic AS ok FROM labels)"""


@query(f"""WITH {_RUNS} SELECT count(*) AS n_cases, count(*) FILTER (s = 'SUCCESS') AS n_success, count(*) FILTER (s = 'BLOCKED') AS n_blocked, count(*) FILTER (s = 'ERROR') AS n_error,
round(count(*) FILTER (ok AND s = 'SUCCESS') / count(*) FILTER (s = 'SUCCESS'), 6) AS valid_accuracy, round(count(*) FILTER (ok AND s = 'SUCCESS') / count(*), 6) AS end_to_end_accuracy, round(count(*) FILTER (s = 'SUCCESS') / count(*), 6) AS execution_rate FROM r""")
def q_run_summary(spark, sf):
    m = F.col("doc_id") % 10
    runs = t(spark, sf, "labels").select(F.when(m == 0, "BLOCKED").when(m == 1, "ERROR").otherwise("SUCCESS").alias("execution_status"), (F.col("quality") == 1 - F.col("toxic")).alias("decision_correct"))
    out = X.run_summary(runs)
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("accuracy", "rate")) else F.col(c) for c in out.columns])


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'event' WHEN 'O' THEN 'no_event' ELSE 'uncertain' END AS g, CASE WHEN o_totalprice > 150000 THEN 'event' ELSE 'no_event' END AS a, o_orderpriority LIKE '1%' AS type_ok FROM orders)
SELECT CASE WHEN g <> a THEN g || '_as_' || a WHEN g = 'event' AND NOT type_ok THEN 'event_type_mismatch' END AS category, count(*) AS n FROM c GROUP BY 1""")
def q_bad_cases(spark, sf):
    o = t(spark, sf, "orders")
    gold = F.when(F.col("o_orderstatus") == "F", "event").when(F.col("o_orderstatus") == "O", "no_event").otherwise("uncertain")
    actual = F.when(F.col("o_totalprice") > 150000, "event").otherwise("no_event")
    return o.select(X.bad_case(gold, actual, F.col("o_orderpriority").like("1%")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'event' WHEN 'O' THEN 'no_event' ELSE 'uncertain' END AS g, CASE WHEN o_totalprice > 150000 THEN 'event' ELSE 'no_event' END AS a, substr(o_orderpriority, 1, 1)::INT AS p FROM orders)
SELECT g = a AS decision_correct, CASE WHEN g = 'event' THEN p <= 2 END AS event_type_correct, CAST((a = 'event' AND p = 5)::INT + (p = 4)::INT + (a <> 'event' AND p = 3)::INT AS BIGINT) AS n_violations, CAST((g <> a)::INT + (g = 'event' AND p > 2)::INT AS BIGINT) AS n_reasons, count(*) AS n FROM c GROUP BY 1, 2, 3, 4""")
def q_score_cases(spark, sf):
    p = F.substring("o_orderpriority", 1, 1).cast("int")
    cases = t(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "event").when(F.col("o_orderstatus") == "O", "no_event").otherwise("uncertain").alias("gold_decision"), F.when(F.col("o_totalprice") > 150000, "event").otherwise("no_event").alias("decision"),
        F.lit("pricing").alias("gold_type"), F.when(p <= 2, "pricing").alias("event_type"), F.when(p == 3, 1).otherwise(0).alias("n_events"), F.when(p == 5, 0).otherwise(1).alias("n_evidence"), F.lit(0).alias("n_unverified"), F.when(p == 4, 2).otherwise(1).alias("model_calls"),
    )
    scored = X.score_case(cases).select("decision_correct", "event_type_correct", F.size("violations").cast("long").alias("n_violations"), F.size("review_reasons").cast("long").alias("n_reasons"))
    return scored.groupBy(*scored.columns).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS workspace_id, count(DISTINCT o_custkey) AS n_competitors, count(*) FILTER (o_orderstatus = 'P') AS n_pending, count(*) FILTER (o_orderstatus <> 'P') AS n_events FROM orders GROUP BY 1")
def q_overview(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("workspace_id"), F.col("o_custkey").alias("competitor"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("confirmed").alias("status"))
    return SV.overview(o)


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n, count(*) FILTER (event_type = 'error') AS h FROM events GROUP BY 1)
SELECT user_id, CASE WHEN n > 0 AND h > 0 THEN 'new_and_historical' WHEN n > 0 THEN 'new' WHEN h > 0 THEN 'historical' ELSE 'none' END AS message FROM c""")
def q_scan_summary(spark, sf):
    c = t(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n"), F.count_if(F.col("event_type") == "error").alias("h"))
    return c.select("user_id", SV.scan_summary(F.col("n"), F.col("h")).alias("message"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_or(event_type = 'signup') THEN 'pending' ELSE 'complete' END AS status, count(DISTINCT props) AS n_citations, count(DISTINCT CASE WHEN value > 50 THEN props END) AS n_uncertainties FROM events GROUP BY 1""")
def q_result_assembly(spark, sf):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "pending").otherwise("complete")
    rec = t(spark, sf, "events").select("user_id", status.alias("status"), F.col("props").alias("citation_id"), F.col("event_id").alias("citation"), F.when(F.col("value") > 50, F.col("props")).alias("uncertainty"), F.struct("ts", "event_id").alias("at"))
    out = RS.assemble(rec, "user_id", "at")
    return out.select("user_id", "status", F.size("citations").cast("long").alias("n_citations"), F.coalesce(F.size("uncertainties"), F.lit(0)).cast("long").alias("n_uncertainties"))


@query("SELECT doc_id, sha256('[\"' || source || '\", \"' || lang || '\"]') AS identity, regexp_replace(source || ':' || lang || '?', '[<>:\"/|?*]', '_', 'g') AS file_name FROM documents")
def q_identities(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.list_identity(F.col("source"), F.col("lang")).alias("identity"), T.safe_filename(F.concat("source", F.lit(":"), "lang", F.lit("?"))).alias("file_name"))


@query(f"""WITH {_LINKS}, k AS (SELECT raw AS key, page_id * 100000 + pos AS seq, CASE WHEN pos < 6 THEN 'page_link' WHEN pos % 2 = 0 THEN 'web_search' ELSE 'user_input' END AS provenance, CASE WHEN pos % 3 = 0 THEN '' ELSE anchor_text END AS title, href FROM l)
SELECT key, CASE max(CASE provenance WHEN 'user_input' THEN 3 WHEN 'web_search' THEN 2 ELSE 1 END) WHEN 3 THEN 'user_input' WHEN 2 THEN 'web_search' ELSE 'page_link' END AS provenance, arg_min(title, seq) FILTER (title <> '') AS title, arg_min(href, seq) AS url FROM k GROUP BY 1""")
def q_candidate_merge(spark, sf):
    pos = F.col("pos")
    rows = _links(spark, sf).select(
        F.col("href").alias("key"), (F.col("page_id") * 100000 + pos).alias("seq"), F.when(pos < 6, "page_link").when(pos % 2 == 0, "web_search").otherwise("user_input").alias("provenance"),
        F.when(pos % 3 == 0, "").otherwise(F.col("anchor_text")).alias("title"), F.lit("").alias("snippet"), F.col("target").alias("url"),
    )
    return L.merge_candidates(rows, "key", "seq").select("key", "provenance", "title", "url")


@query("""WITH c AS (SELECT conv_id, turn, turn % 4 = 0 AS is_default, row_number() OVER (PARTITION BY conv_id, turn % 4 = 0 ORDER BY turn) AS place, 1 + turn % 3 AS depth FROM conversations)
SELECT conv_id, turn, is_default OR (place <= 3 AND depth <= 2) AS kept FROM c""")
def q_bounded_tabs(spark, sf):
    tabs = t(spark, sf, "conversations").select("conv_id", "turn", (F.col("turn") % 4 == 0).alias("is_default"), (1 + F.col("turn") % 3).alias("depth"))
    return S.bounded_tabs(tabs, ["conv_id"], "turn", "is_default", ["conv_id"], per_group=3).select("conv_id", "turn", "kept")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
