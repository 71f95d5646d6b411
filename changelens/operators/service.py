"""Views that a product surface reads: overview, summaries, labels, confirmed sources, triage contexts, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.urls import host
from changelens.operators.memory import latest
from changelens.operators.retrieval import search_all

QUERY_CHARS = 1500


def overview(events: DataFrame, workspace: str = "workspace_id") -> DataFrame:
    """Competitors, pending events and events of each workspace."""
    pending = F.col("status") == "pending"
    return events.groupBy(workspace).agg(F.count_distinct("competitor").alias("n_competitors"), F.count_if(pending).alias("n_pending"), F.count_if(~pending).alias("n_events"))


def scan_summary(new: Column, historical: Column) -> Column:
    """Which of four messages a scan ends with; a missing historical count is none."""
    n, h = F.coalesce(new, F.lit(0)) > 0, F.coalesce(historical, F.lit(0)) > 0
    return F.when(n & h, "new_and_historical").when(n, "new").when(h, "historical").otherwise("none")


def document_status(parsing: Column, ingestion: Column) -> Column:
    busy = F.coalesce(parsing.isin("pending", "parsing"), F.lit(False)) | F.coalesce(ingestion == "ingesting", F.lit(False))
    return F.when((parsing == "parsed") & (ingestion == "completed"), "stored").when(busy, "in_progress").otherwise("failed")


def preference_view(records: DataFrame) -> DataFrame:
    """Preferences with where they come from: the user, or an inference that waits for them."""
    source = F.when(F.col("source_type") == "user", "stated").when(F.col("status") == "pending", "suggested").otherwise("confirmed")
    return records.select("memory_id", "content", "status", source.alias("source_label"), "updated_at")


def confirm_sources(sources: DataFrame, official_domains: str = "official_domains") -> DataFrame:
    """Adds credibility: official only where the host is among the domains declared official."""
    ok = F.array_contains(official_domains, host(F.col("url")))
    return sources.withColumn("credibility", F.when(F.coalesce(ok, F.lit(False)), "official").otherwise("unverified"))


def configuration(log: DataFrame, workspace: str = "workspace_id", order: str = "seq") -> DataFrame:
    """The configuration in force of each workspace."""
    return latest(log, [workspace], [order])


def artifacts_of(references: DataFrame, records: DataFrame) -> DataFrame:
    """References (ns, key) with the latest record each points to; NULL where there is none."""
    return references.join(latest(records, ["ns", "key"], ["seq"]).select("ns", "key", "body"), ["ns", "key"], "left")


def events_of_product(events: DataFrame, event_id: str) -> DataFrame:
    """An event by its product id, whichever competitor it belongs to."""
    return events.where(F.col("product_event_id") == event_id)


def triage_query(events: DataFrame) -> Column:
    """The fixed retrieval query of an event: competitor, subject, action and items, within bounds."""
    items = F.transform(F.coalesce("change_items", F.array().cast("array<struct<item:string,current_state:string>>")), lambda x: F.concat_ws(" ", x["item"], F.coalesce(x["current_state"], F.lit(""))))
    return F.substring(F.concat_ws(" ", "competitor", F.coalesce("event_subject", F.lit("")), F.coalesce("change_action", F.lit("")), F.array_join(items, " ")), 1, QUERY_CHARS)


def triage_context(events: DataFrame, chunks: DataFrame, n: int = 5) -> DataFrame:
    """The n best chunks of each event in each domain. `events`: chunk_id, vector; `chunks`: domain, chunk_id, vector."""
    asked = events.select("chunk_id", "vector", F.explode(F.array(F.lit("own_product"), F.lit("competitor"))).alias("domain"))
    asked = asked.withColumn("chunk_id", F.concat_ws("@", "chunk_id", "domain"))
    got = search_all(chunks, asked, n, "chunk_id", "query_id", "vector", ["domain"])
    return got.withColumn("event", F.split_part("query_id", F.lit("@"), F.lit(1))).withColumn("domain", F.split_part("query_id", F.lit("@"), F.lit(2))).drop("query_id")


def triage_violations(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Triage results whose relevance claims lack direct evidence of both domains. `claims`: event_id, claim_no, result_id."""
    c = claims.join(citations.select("result_id", "source", "domain"), "result_id", "left")
    own = F.bool_or(F.coalesce((F.col("source") == "knowledge") & (F.col("domain") == "own_product"), F.lit(False)))
    other = F.bool_or(F.coalesce(F.col("domain") == "competitor", F.lit(False)))
    return c.groupBy("event_id", "claim_no").agg((own & other).alias("_ok")).where("not _ok").select("event_id", "claim_no", F.lit("both_domains_needed").alias("violation"))


def legacy_watermark(comparisons: DataFrame, outcomes: DataFrame) -> DataFrame:
    """For URLs without a pointer: the latest snapshot whose comparison has an outcome. `comparisons`: url, snapshot_id, captured_at."""
    done = comparisons.join(outcomes.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    return done.groupBy("url").agg(F.max_by("snapshot_id", F.struct("captured_at", "snapshot_id")).alias("processed"))


def damage(stages: DataFrame, case: str, order: str, stage: str, text: str, target: str) -> DataFrame:
    """The first extraction stage after which a target text is no longer found; NULL if it survives all."""
    found = F.contains(F.lower(F.regexp_replace(F.col(text), r"\s+", " ")), F.lower(F.regexp_replace(F.col(target), r"\s+", " ")))
    return stages.groupBy(case).agg(F.min_by(stage, F.when(~F.coalesce(found, F.lit(False)), F.col(order))).alias("lost_at"))
