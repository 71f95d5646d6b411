"""Incremental state over whole tables: transition functions over the ordered rows of a key.

`processors` has the same machines for streams, on state that Spark keeps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

Transition = Callable[[dict, dict], dict | None]


def comparison_watermark(state: dict, row: dict) -> dict:
    """Observed moves with every scan; processed only with an outcome, and never back.

    Rows: scan_id, snapshot_id, outcome (NULL: the comparison failed), and base,
    the processed pointer that the scan was compared with (NULL: the current one).
    """
    current = state.get("processed")
    base = row["base"] if row.get("base") is not None else current
    done = state.setdefault("done", set())
    state["observed"] = row["snapshot_id"]
    moved = False
    if row["outcome"] is not None and row["scan_id"] not in done:
        done.add(row["scan_id"])
        if current in (None, base, row["snapshot_id"]):
            state["processed"], moved = row["snapshot_id"], True
    return {"scan_id": row["scan_id"], "previous": current, "observed": state["observed"], "processed": state.get("processed"), "advanced": moved}


def seen_set(state: dict, row: dict) -> dict:
    """First and last sight of a statement; new means first seen after the baseline."""
    first = "first" not in state
    state.setdefault("first", row["snapshot_id"])
    state["last"] = row["snapshot_id"]
    return {"snapshot_id": row["snapshot_id"], "was_seen": not first, "is_new": bool(first and not row["baseline"]), "first_seen": state["first"]}


def statement_lifecycle(state: dict, row: dict) -> dict:
    """pending to processed with attempts counted; a terminal state stays."""
    state.setdefault("state", "pending")
    state.setdefault("attempts", 0)
    if state["state"] == "pending":
        state["attempts"] += row["action"] != "register"
        if row["action"] in ("processed", "ignored"):
            state["state"] = row["action"]
    return {"seq": row["seq"], "state": state["state"], "attempts": state["attempts"]}


def claim(state: dict, row: dict) -> dict:
    """not_started, running, completed or failed; `token` names the process that asks.

    claim and retry take a task that nobody has started, retry also a failed one;
    either interrupts a running task of another process, which then has failed.
    """
    now, token, ok = state.get("state", "not_started"), state.get("token"), False
    if row["action"] in ("claim", "retry"):
        now = "failed" if now == "running" and token != row["token"] else now
        if now == "not_started" or now == "failed" and row["action"] == "retry":
            now, token, ok = "running", row["token"], True
    elif now == "running" and token == row["token"]:
        now, ok = ("completed" if row["action"] == "complete" else "failed"), True
    state["state"], state["token"] = now, token
    return {"seq": row["seq"], "state": now, "accepted": ok}


def follow_up(state: dict, row: dict) -> dict:
    """Turns by request id: the same request again gives its first answer's state and starts nothing."""
    turns = state.setdefault("turns", {})
    known = turns.get(row["request_id"])
    if row["action"] == "ask":
        if known is None:
            turns[row["request_id"]] = "running"
    elif known == "running":
        turns[row["request_id"]] = "completed" if row["action"] == "complete" else "failed"
    return {"seq": row["seq"], "state": turns.get(row["request_id"], "unknown"), "repeated": bool(known is not None and row["action"] == "ask")}


def backfill_origin(state: dict, row: dict, quota: int = 20) -> dict:
    """Statements of a first scan take the quota, later new ones are monitoring, the rest is skipped."""
    used = state.get("used", 0)
    origin = "normal_monitoring"
    if row["first_scan"]:
        origin = "historical_backfill" if used < quota else "skipped"
        state["used"] = used + (origin == "historical_backfill")
    return {"seq": row["seq"], "origin": origin}


def checkpointed_step(state: dict, row: dict) -> dict:
    """A step of a run: a complete one is skipped, any other try counts; failures keep their category.

    Rows: seq, outcome (complete, failed, or NULL while it runs), category.
    """
    skipped = state.get("status") == "complete"
    if not skipped:
        state["attempts"] = state.get("attempts", 0) + 1
        state["status"] = row["outcome"] or "running"
        if state["status"] == "failed":
            state["failures"] = [*state.get("failures", ()), row.get("category") or "unknown"]
    return {"seq": row["seq"], "status": state["status"], "attempts": state["attempts"], "skipped": skipped, "n_failures": len(state.get("failures", ()))}


def preference(state: dict, row: dict) -> dict:
    """An item of the user's preferences: added ones are confirmed, suggested ones wait; nothing else moves a state that isn't its own.

    Actions: add, suggest, confirm, ignore, edit, remove; `content` goes with add, suggest and edit.
    """
    moves = {("none", "add"): "confirmed", ("none", "suggest"): "pending", ("pending", "confirm"): "confirmed", ("pending", "ignore"): "inactive", ("confirmed", "edit"): "confirmed", ("confirmed", "remove"): "inactive"}
    now = state.get("state", "none")
    following = moves.get((now, row["action"]))
    if following:
        state["state"] = following
        state["content"] = row.get("content") or state.get("content")
    return {"seq": row["seq"], "state": state.get("state", "none"), "content": state.get("content"), "accepted": following is not None}


def in_batch(df: DataFrame, keys: list[str], order: list[str], step: Transition, schema: str) -> DataFrame:
    """The transitions of all rows; a key's history is read in one task, in order, a batch of rows at a time."""
    out = to_arrow_schema(T.DataType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, {}
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, {}
                done.append(dict(zip(keys, key, strict=True)) | step(state, row))
            yield pa.RecordBatch.from_pylist(done, schema=out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


# --- the same over whole tables by windows, where a row's state follows from what came before it ---


def _so_far(keys: list[str], order: list[str]):
    return W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _first(condition: Column, order: list[str], *more: Column) -> Column:
    """The place of the first row so far that meets a condition, as a struct."""
    return F.min(F.when(condition, F.struct(*order, *more)))


def watermarks(df: DataFrame, keys: list[str], order: list[str], snapshot: str, outcome: str) -> DataFrame:
    """Adds previous, processed, advanced: scans once each, compared with the pointer as it stands."""
    w, done = _so_far(keys, order), F.col(outcome).isNotNull()
    pointer = F.last(F.when(done, F.col(snapshot)), ignorenulls=True)
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns({"previous": pointer.over(before), "processed": pointer.over(w), "advanced": done})


def sights(df: DataFrame, keys: list[str], order: list[str], baseline: str) -> DataFrame:
    """Adds was_seen, is_new, first_seen (the last of `order` at first sight)."""
    w = _so_far(keys, order)
    was = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) > 1
    return df.withColumns({"was_seen": was, "is_new": ~was & ~F.col(baseline), "first_seen": F.first(order[-1]).over(w)})


def lifecycles(df: DataFrame, keys: list[str], order: list[str], action: str) -> DataFrame:
    """Adds state and attempts."""
    w, a = _so_far(keys, order), F.col(action)
    ended = df.withColumn("_ended", _first(a.isin("processed", "ignored"), order, a.alias("_action")).over(w))
    open_ = F.col("_ended").isNull() | (F.struct(*[F.col("_ended")[c] for c in order]) == F.struct(*order))
    return ended.withColumns({"attempts": _count((a != "register") & open_).over(w), "state": F.coalesce("_ended._action", F.lit("pending"))}).drop("_ended")


def origins(df: DataFrame, keys: list[str], order: list[str], first_scan: str, quota: int = 20) -> DataFrame:
    """Adds origin: statements of a first scan take the quota, the rest of them is skipped, later ones are monitoring."""
    used = _count(F.col(first_scan)).over(_so_far(keys, order))
    return df.withColumn("origin", F.when(~F.col(first_scan), "normal_monitoring").when(used <= quota, "historical_backfill").otherwise("skipped"))


def steps(df: DataFrame, keys: list[str], order: list[str], outcome: str) -> DataFrame:
    """Adds status, attempts, skipped, n_failures."""
    w, o = _so_far(keys, order), F.coalesce(F.col(outcome), F.lit("running"))
    rows = df.withColumn("_done", _first(o == "complete", order).over(w))
    tried = F.col("_done").isNull() | (F.col("_done") == F.struct(*order))
    status = F.when(F.col("_done").isNotNull(), "complete").otherwise(o)
    return rows.withColumns({"status": status, "attempts": _count(tried).over(w), "skipped": ~tried, "n_failures": _count(tried & (o == "failed")).over(w)}).drop("_done")


def distinct_stream(df: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """First sight of each key within a time horizon; the state is dropped beyond it."""
    return df.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def idempotent_batches(write: Callable[[DataFrame], None], done: Callable[[int], bool], mark: Callable[[int], None]):
    """A foreachBatch function that writes a batch's outcome, then marks it; a marked batch is passed over."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not done(batch_id):
            write(batch)
            mark(batch_id)

    return run


def memoized(keys: DataFrame, artifacts: DataFrame, on: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Artifacts of `keys`: those there are, and those computed for the rest."""
    return artifacts.join(keys, on, "left_semi").unionByName(compute(keys.join(artifacts.select(*on).distinct(), on, "left_anti")))
