"""Registered queries that run as streams: `events` in time order, in several micro-batches, through durable state.

The SQL states the same over the whole table, by windows where they reach, by
recursion where a row depends on the state before it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.plans.catalog import query, t
from changelens.session import shared_folder
from changelens.streaming import processors as P
from changelens.streaming import roles as R

BATCHES = 3


def live(spark: SparkSession, rows: DataFrame, machine: P.Machine) -> DataFrame:
    """What the machine says to each row, streamed in BATCHES micro-batches and read back."""
    at = f"{shared_folder(spark)}/streams/{type(machine).__name__}-{uuid.uuid4().hex[:12]}"
    P.drain(P.stream(P.staged(rows, "ts", f"{at}/in", BATCHES), machine), f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out")


def _by_type(**names: str) -> F.Column:
    out = F.lit(None).cast("string")
    for kind, name in names.items():
        out = F.when(F.col("event_type") == kind, name).otherwise(out)
    return out


_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_BEFORE = "(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"""WITH s AS (SELECT *, event_type <> 'error' AS ok, count(*) FILTER (event_type <> 'error') OVER {_BEFORE} AS earlier FROM events),
m AS (SELECT *, ok AND (event_id % 5 <> 0 OR earlier = 0) AS moves FROM s)
SELECT event_id, max(CASE WHEN moves THEN struct_pack(ts := ts, id := event_id) END) OVER {_BEFORE}.id AS previous, event_id AS observed,
  max(CASE WHEN moves THEN struct_pack(ts := ts, id := event_id) END) OVER {_W}.id AS processed, moves AS advanced FROM m""")
def q_live_watermark(spark, sf):
    """Comparison watermark: errors fail, and every fifth event was compared with a base that is gone."""
    outcome, base = F.when(F.col("event_type") != "error", "done"), F.when(F.col("event_id") % 5 == 0, F.lit(-1).cast("long"))
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_id").alias("scan_id"), F.col("event_id").alias("snapshot_id"), outcome.alias("outcome"), base.alias("base"))
    return live(spark, e, P.Watermark(["user_id"], ["ts", "event_id"])).drop("user_id")


@query("""SELECT event_id, row_number() OVER w > 1 AS was_seen, row_number() OVER w = 1 AND ts >= TIMESTAMP '2024-01-10' AS is_new, first_value(event_id) OVER w AS first_seen
FROM events WINDOW w AS (PARTITION BY user_id, props ORDER BY ts, event_id)""")
def q_live_seen_set(spark, sf):
    e = t(spark, sf, "events").select("user_id", "props", "ts", "event_id", (F.col("ts") < F.lit("2024-01-10").cast("timestamp_ntz")).alias("baseline"))
    return live(spark, e, P.Seen(["user_id", "props"], ["ts", "event_id"])).drop("user_id", "props")


@query(f"""WITH a AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'error' THEN 'ignored' WHEN 'view' THEN 'register' ELSE 'retry' END AS action FROM events),
b AS (SELECT *, min(CASE WHEN action IN ('processed', 'ignored') THEN struct_pack(ts := ts, id := event_id, action := action) END) OVER {_W} AS ended FROM a)
SELECT event_id, coalesce(ended.action, 'pending') AS state, CAST(count(*) FILTER (action <> 'register' AND (ended IS NULL OR ended.id = event_id)) OVER {_W} AS BIGINT) AS attempts FROM b""")
def q_live_lifecycle(spark, sf):
    action = F.coalesce(_by_type(purchase="processed", error="ignored", view="register"), F.lit("retry"))
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", action.alias("action"))
    return live(spark, e, P.Lifecycle(["user_id"], ["ts", "event_id"])).drop("user_id")


@query("""WITH RECURSIVE e AS (
  SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'fail' WHEN 'view' THEN 'claim' ELSE 'retry' END AS action,
    'p' || event_id % 2 AS token, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 'not_started' AS state, CAST(NULL AS VARCHAR) AS token, CAST(0 AS BIGINT) AS attempts, false AS accepted FROM e
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN takes THEN 'running' WHEN ends AND action = 'complete' THEN 'completed' WHEN ends THEN 'failed' ELSE base END,
    CASE WHEN takes THEN asks WHEN ends OR base <> state THEN NULL ELSE token END, attempts + takes::INT, takes OR ends
  FROM (
    SELECT *, action IN ('claim', 'retry') AND (base = 'not_started' OR base = 'failed' AND action = 'retry') AS takes
    FROM (
      SELECT e.user_id, e.n, e.event_id, e.action, e.token AS asks, r.state, r.token, r.attempts,
        CASE WHEN e.action IN ('claim', 'retry') AND r.state = 'running' AND r.token <> e.token THEN 'failed' ELSE r.state END AS base,
        e.action IN ('complete', 'fail') AND r.state = 'running' AND r.token = e.token AS ends
      FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
SELECT event_id, state, attempts, accepted FROM r WHERE n > 0""")
def q_live_claims(spark, sf):
    """A user is a task; views claim it, clicks retry it, for two processes in turn."""
    action = F.coalesce(_by_type(purchase="complete", error="fail", view="claim"), F.lit("retry"))
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", action.alias("action"), F.concat(F.lit("p"), (F.col("event_id") % 2).cast("string")).alias("token"))
    return live(spark, e, P.Claims(["user_id"], ["ts", "event_id"])).drop("user_id")


@query(f"""WITH e AS (SELECT *, event_id % 4 AS request, event_type IN ('view', 'click') AS ask, struct_pack(ts := ts, id := event_id) AS place FROM events),
f AS (SELECT *, min(CASE WHEN ask THEN place END) OVER (PARTITION BY user_id, request ORDER BY ts, event_id) AS asked FROM e),
g AS (SELECT *, min(CASE WHEN event_type IN ('purchase', 'error') AND asked IS NOT NULL THEN struct_pack(ts := ts, id := event_id, kind := event_type) END) OVER (PARTITION BY user_id, request ORDER BY ts, event_id) AS ended FROM f)
SELECT event_id, CASE WHEN asked IS NULL THEN 'unknown' WHEN ended IS NULL THEN 'running' WHEN ended.kind = 'purchase' THEN 'completed' ELSE 'failed' END AS state,
  ask AND asked.id <> event_id AS repeated, CAST(count(*) FILTER (ask AND asked.id = event_id) OVER {_W} AS BIGINT) AS n_turns FROM g""")
def q_live_follow_ups(spark, sf):
    """A user is a conversation with four requests; views and clicks ask, purchases complete, errors fail."""
    action = F.coalesce(_by_type(purchase="complete", error="fail", view="ask", click="ask"), F.lit("none"))
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", action.alias("action"), (F.col("event_id") % 4).alias("request_id"))
    return live(spark, e, P.FollowUps(["user_id"], ["ts", "event_id"])).drop("user_id")


@query(f"""WITH a AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN struct_pack(ts := ts, id := event_id) END) OVER {_W} AS done FROM events)
SELECT event_id, CASE WHEN done IS NOT NULL THEN 'complete' WHEN event_type = 'error' THEN 'failed' ELSE 'running' END AS status,
  CAST(count(*) FILTER (done IS NULL OR done.id = event_id) OVER {_W} AS BIGINT) AS attempts, done IS NOT NULL AND done.id <> event_id AS skipped,
  CAST(count(*) FILTER (event_type = 'error' AND done IS NULL) OVER {_W} AS BIGINT) AS n_failures FROM a""")
def q_live_steps(spark, sf):
    e = t(spark, sf, "events").select("user_id", "ts", "event_id", _by_type(purchase="complete", error="failed").alias("outcome"), F.lit("retrieval_error").alias("category"))
    return live(spark, e, P.Steps(["user_id"], ["ts", "event_id"])).drop("user_id")


_TURNS = """turns AS (SELECT conv_id, turn, coalesce(text, '') AS text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 2 + 1 AS call FROM conversations WHERE role = 'user'),
asked AS (SELECT *, call <= 2 AS sent, string_split(text, '.')[1] AS first FROM turns),
said AS (
  SELECT conv_id, turn, CAST(CASE WHEN sent THEN call END AS INTEGER) AS call, CASE WHEN sent AND length(text) % 5 > 0 THEN first END AS proposal,
    CASE WHEN NOT sent THEN 'budget' WHEN length(text) % 5 = 0 THEN 'empty' WHEN length(first) < 12 THEN 'too_short' ELSE 'accepted' END AS status FROM asked
  UNION ALL SELECT conv_id, turn, CAST(call AS INTEGER), first || '!!', 'not_verbatim' FROM asked WHERE sent AND length(text) % 5 = 1)"""


def _first_sentence(texts: list[str]) -> list[list[str]]:
    """A role whose answers follow from the text: nothing, its first sentence, or that and something it doesn't say."""
    answers = []
    for x in texts:
        first = x.split(".")[0]
        answers.append([[], [first, f"{first}!!"], [first], [first], [first]][len(x) % 5])
    return answers


def _verbatim(text: str, proposal: str) -> str | None:
    return "not_verbatim" if proposal not in text else "too_short" if len(proposal) < 12 else None


def _asked(spark, sf) -> DataFrame:
    turns = t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return R.ask(turns, _first_sentence, _verbatim, ["conv_id", "turn"], "text", "conv_id", "turn", batch=2, budget=2)


@query(f"WITH {_TURNS} SELECT conv_id, turn, call, md5(proposal) AS proposal, status FROM said")
def q_role_proposals(spark, sf):
    """What users say, two turns to a call and two calls to a conversation, through a role."""
    return _asked(spark, sf).withColumn("proposal", F.md5(F.col("proposal").cast("binary")))


@query(f"WITH {_TURNS} SELECT status AS outcome, count(*) AS n FROM said WHERE proposal IS NOT NULL GROUP BY status")
def q_role_rejections(spark, sf):
    return R.tally(_asked(spark, sf), [])
