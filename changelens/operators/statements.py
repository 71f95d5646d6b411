"""Statements of sources: units, backfill, new and pending ones, processing plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens.functions.text import collapse, list_identity
from changelens.functions.urls import host

BACKFILL_DAYS, BACKFILL_LIMIT, UNIT_LIMIT = 90, 20, 60


def eligible_source(credibility: Column, final_url: Column, official_domains: Column) -> Column:
    return F.coalesce((credibility == "official") & F.array_contains(official_domains, host(final_url)), F.lit(False))


def first_units(units: DataFrame, source: list[str], order: str, limit: int = UNIT_LIMIT) -> DataFrame:
    """The first `limit` units of each source in document order."""
    w = W.partitionBy(*source).orderBy(order)
    return units.withColumn("unit_no", F.row_number().over(w)).where(F.col("unit_no") <= limit)


def statement_id(final_url: Column, excerpt: Column, context: Column) -> Column:
    return list_identity(final_url, collapse(excerpt), collapse(context))


def backfill(candidates: DataFrame, date: str, statement: str, reference: Column, limit: int = BACKFILL_LIMIT, days: int = BACKFILL_DAYS) -> DataFrame:
    """Dated statements of the last `days`, both ends included: the latest `limit` by (date, id)."""
    within = F.col(date).between(F.date_sub(reference, days), reference)
    return candidates.where(within).orderBy(F.desc(date), F.desc(statement)).limit(limit)


def not_in(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def plan(extracted: DataFrame, seen: DataFrame, states: DataFrame, reference: Column, workspace: str = "workspace") -> DataFrame:
    """What to process now, with its origin: pending ones, first-scan backfill within the quota, later new ones.

    `extracted`: workspace, statement_id, statement_date, initial_backfill;
    `seen`: workspace, statement_id; `states`: workspace, statement_id, state, origin.
    """
    key = [workspace, "statement_id"]
    retry = extracted.join(states.where("state = 'pending'").select(*key), key).withColumn("origin", F.lit("retry"))
    fresh = not_in(extracted, states, key)
    used = states.groupBy(workspace).agg(F.count_if(F.col("origin") == "historical_backfill").alias("_used"))
    dated = fresh.where(F.col("initial_backfill") & F.col("statement_date").between(F.date_sub(reference, BACKFILL_DAYS), reference))
    w = W.partitionBy(workspace).orderBy(F.desc("statement_date"), F.desc("statement_id"))
    room = dated.withColumn("_n", F.row_number().over(w)).join(used, workspace, "left").where(F.col("_n") <= BACKFILL_LIMIT - F.coalesce("_used", F.lit(0)))
    first = room.drop("_n", "_used").withColumn("origin", F.lit("historical_backfill"))
    later = not_in(fresh.where(~F.col("initial_backfill")), seen, key).withColumn("origin", F.lit("normal_monitoring"))
    return retry.unionByName(first).unionByName(later)
