"""Event decisions: deterministic gate, claim rules, evidence, deduplication, identities, presentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens.functions.text import parse_instant

# Closed vocabularies and the order in which rules are checked.
DECISIONS = ("event", "no_event", "uncertain")
EVENT_TYPES = ("capability", "availability", "pricing", "plan_packaging", "access_permission", "commercialization", "deprecation", "positioning")
EVIDENCE_FIELDS = ("previous_state", "current_state", "relevant_source_context")
FACTS = ("event_type", "event_subject", "change_action", "event_time", "effective_time", "affected_scope")
VERBATIM = ("event_time", "effective_time", "affected_scope")
RULES = (
    "citation_missing", "invalid_reference", "citation_empty", "excerpt_not_found", "invalid_input_field", "claim_not_verbatim",
    "unconfirmed_input", "comparison_side_missing", "identical_states", "unofficial_statement",
)
MAX_INPUT_CHARS = 40_000


def gate(status: Column, path: Column, credibility: Column, comparison: Column, previous: Column, current: Column, n_diff: Column) -> Column:
    """no_event or uncertain where the inputs decide; NULL where a model has to."""
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    comparable = (comparison == "comparable") & filled(previous) & filled(current) & (F.coalesce(n_diff, F.lit(0)) > 0)
    return (
        F.when(status != "confirmed", "uncertain")
        .when(path == "explicit_statement", F.when(credibility == "official", F.lit(None)).otherwise("uncertain"))
        .when(comparison.isin("baseline", "unchanged"), "no_event")
        .when(comparable, F.lit(None))
        .otherwise("uncertain")
    )


def input_violations(previous_at: Column, current_at: Column, previous: Column, payload: Column) -> Column:
    """Names of the observation rules that an input breaks; times are ISO text that names its offset, compared as instants."""
    before, now = parse_instant(previous_at), parse_instant(current_at)
    rules = F.array(
        F.when(now.isNull(), "current_time_missing"),
        F.when(previous_at.isNotNull() & before.isNull(), "previous_time_without_offset"),
        F.when(before >= now, "previous_not_earlier"),
        F.when((F.length(previous) > 0) & previous_at.isNull(), "previous_time_missing"),
        F.when(F.length(payload) > MAX_INPUT_CHARS, "input_too_large"),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def fact_fields(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, value) of every fact that is not null; change items as change_items.N.part."""
    plain = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FACTS])
    items = F.flatten(
        F.transform(
            F.coalesce("change_items", F.array().cast("array<struct<item:string,previous_state:string,current_state:string>>")),
            lambda x, i: F.array(*[F.struct(F.concat(F.lit("change_items."), i.cast("string"), F.lit(f".{p}")).alias("field"), x[p].alias("value")) for p in ("item", "previous_state", "current_state")]),
        )
    )
    return decisions.select(*keys, F.explode(F.concat(plain, items)).alias("f")).select(*keys, "f.field", "f.value").where("value is not null")


def claim_violations(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rule, field) for each rule broken; the first by precedence decides.

    `decisions`: the facts, change_items, citations map<field, array<struct<input_field, excerpt>>>,
    the input texts, detection_path, evidence_status, source_credibility, decision.
    """
    facts = fact_fields(decisions, keys)
    cited = decisions.select(*keys, F.explode(F.coalesce("citations", F.create_map().cast("map<string,array<struct<input_field:string,excerpt:string>>>"))).alias("field", "quotes"))
    joined = facts.join(cited, [*keys, "field"], "full_outer")
    sets = joined.select(*keys, F.when(F.col("quotes").isNull() & F.col("value").isNotNull(), RULES[0]).when(F.col("value").isNull(), RULES[1]).alias("rule"), "field")
    paired = joined.where("value is not null and quotes is not null")
    empty = paired.where(F.size("quotes") == 0).select(*keys, F.lit(RULES[2]).alias("rule"), "field")
    context = decisions.select(*keys, *EVIDENCE_FIELDS, "detection_path")
    quotes = paired.select(*keys, "field", "value", F.explode("quotes").alias("q")).join(context, keys)
    text = F.coalesce(*[F.when(F.col("q.input_field") == f, F.coalesce(f, F.lit(""))) for f in EVIDENCE_FIELDS], F.lit(""))
    blank = F.trim(F.coalesce("q.excerpt", F.lit(""))) == ""
    missing = blank | ~F.contains(text, F.coalesce("q.excerpt", F.lit("")))
    is_previous, is_current = F.endswith("field", F.lit(".previous_state")), F.endswith("field", F.lit(".current_state"))
    allowed = (F.col("q.input_field") == "previous_state") | ((F.col("detection_path") != "state_comparison") & (F.col("q.input_field") == "current_state"))
    side = (is_previous & ~allowed) | (is_current & (F.col("q.input_field") != "current_state"))
    quoted = quotes.select(*keys, F.when(missing, RULES[3]).when(side, RULES[4]).alias("rule"), "field")
    needs = F.col("field").isin(*VERBATIM) | is_previous | is_current
    verbatim = quotes.where(needs).groupBy(*keys, "field").agg(F.bool_or(F.contains("q.excerpt", "value")).alias("ok")).where("not ok").select(*keys, F.lit(RULES[5]).alias("rule"), "field")
    event = decisions.where("decision = 'event'")
    comparing = F.col("detection_path") == "state_comparison"
    status = event.where("evidence_status <> 'confirmed'").select(*keys, F.lit(RULES[6]).alias("rule"), F.lit("").alias("field"))
    items = event.where(comparing).select(*keys, F.posexplode("change_items").alias("i", "x"))
    at = F.concat(F.lit("change_items."), F.col("i").cast("string"))
    one_side = F.when(F.col("x.previous_state").isNull(), ".previous_state").when(F.col("x.current_state").isNull(), ".current_state")
    sides = items.where(one_side.isNotNull()).select(*keys, F.lit(RULES[7]).alias("rule"), F.concat(at, one_side).alias("field"))
    same = items.where("x.previous_state = x.current_state").select(*keys, F.lit(RULES[8]).alias("rule"), at.alias("field"))
    unofficial = event.where(~comparing & (F.col("source_credibility") != "official")).select(*keys, F.lit(RULES[9]).alias("rule"), F.lit("").alias("field"))
    parts = [sets, empty, quoted, verbatim, status, sides, same, unofficial]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where("rule is not null")


def first_violation(violations: DataFrame, keys: list[str]) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    return violations.groupBy(*keys).agg(F.min_by(F.struct("rule", "field"), F.struct(order, "field")).alias("v")).select(*keys, "v.rule", "v.field")


def build_evidence(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each input field with text: status, capability, distinct excerpts, fingerprint."""
    rows = decisions.select(
        "*", F.posexplode(F.array(*[F.struct(F.lit(f).alias("input_field"), F.col(f).alias("source_text")) for f in EVIDENCE_FIELDS])).alias("seq", "e")
    ).where(F.length("e.source_text") > 0)
    mine = lambda k, v: F.exists(v, lambda q: q["input_field"] == F.col("e.input_field"))
    cited = F.map_filter(F.coalesce("citations", F.create_map().cast("map<string,array<struct<input_field:string,excerpt:string>>>")), mine)
    quotes = F.filter(F.flatten(F.map_values(cited)), lambda q: q["input_field"] == F.col("e.input_field"))
    excerpts = F.array_distinct(F.transform(quotes, lambda q: q["excerpt"]))
    status = F.when((F.col("decision") == "uncertain") & (F.col("evidence_status") != "conflict"), "pending").otherwise(F.col("evidence_status"))
    observed = F.when(F.col("e.input_field") == "previous_state", F.col("previous_observed_at")).otherwise(F.col("current_observed_at"))
    out = rows.select(
        *keys, "seq", F.col("e.input_field").alias("input_field"), status.alias("evidence_status"), F.map_keys(cited).alias("evidence_capability"), observed.alias("observed_at"),
        F.when(F.size(excerpts) > 0, F.array_join(excerpts, "\n")).otherwise(F.col("e.source_text")).alias("relevant_excerpt"),
    )
    content = [c for c in out.columns if c not in (*keys, "seq")]
    return out.withColumn("evidence_id", F.sha2(F.to_json(F.struct(*sorted(content))), 256))


def union_distinct(existing: DataFrame, incoming: DataFrame, keys: list[str], content: list[str], order: str) -> DataFrame:
    """Rows of both, the first of each content kept: existing before incoming, then by `order`."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(incoming.withColumn("_side", F.lit(1)))
    w = W.partitionBy(*keys, *content).orderBy("_side", order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_side", "_n")


def verdict_fold(verdicts: DataFrame, keys: list[str], verdict: str) -> DataFrame:
    """UNCERTAIN with any doubt or more than one match, SAME_EVENT with exactly one, else NEW_EVENT."""
    same, doubt = F.count_if(F.col(verdict) == "SAME_EVENT"), F.count_if(F.col(verdict) == "UNCERTAIN")
    return verdicts.groupBy(*keys).agg(F.when((doubt > 0) | (same > 1), "UNCERTAIN").when(same == 1, "SAME_EVENT").otherwise("NEW_EVENT").alias("verdict"))


def peers(candidates: DataFrame, existing: DataFrame, competitor: str, candidate_id: str, existing_id: str) -> DataFrame:
    """Candidates with the existing events of the same competitor, themselves aside."""
    e = existing.withColumnRenamed(existing_id, "_peer")
    return candidates.join(e, competitor).where(F.col(candidate_id) != F.col("_peer")).withColumnRenamed("_peer", "peer_id")


def event_id(facts: list[Column], prefix: str = "evt_") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}), 256), 1, 24))


def present(events: DataFrame) -> DataFrame:
    """Public facts with a title, the latest observation time, and no internal columns."""
    title = F.concat_ws(" · ", F.nullif(F.col("event_subject"), F.lit("")), F.nullif(F.col("change_action"), F.lit("")))
    return events.select("event_id", title.alias("title"), *FACTS, F.array_max(F.transform("evidence", lambda e: e["observed_at"])).alias("observation_time"))


def qualify(ids: Column, group: Column) -> Column:
    return F.transform(ids, lambda x: F.concat_ws(":", group, x))


def normalize_decisions(results: DataFrame, case: str) -> DataFrame:
    """One decision a case: event over uncertain over no_event; facts only of a single event."""
    rank = F.when(F.col("decision") == "event", 2).when(F.col("decision") == "uncertain", 1).otherwise(0)
    n = F.count_if(F.col("decision") == "event")
    facts = [F.when(n == 1, F.max_by(f, rank)).alias(f) for f in FACTS]
    return results.groupBy(case).agg(F.max_by("decision", rank).alias("decision"), n.alias("n_events"), *facts)


def feed_order(event_time: Column, observed_at: Column, triage: Column) -> list[Column]:
    """Sort keys of the event feed: triage, then the latest time first."""
    return [F.when(triage == "research", 0).when(triage == "monitor", 1).when(triage == "no_action", 2).otherwise(3).asc(), F.coalesce(event_time, observed_at).desc()]


def recent(at: Column, as_of: Column, days: int) -> Column:
    return at >= as_of - F.make_interval(days=F.lit(days))


def local_side(changes: Column, side: str) -> Column:
    """Distinct texts of one side of a difference in order; NULL if there are none."""
    return F.nullif(F.array_join(F.array_distinct(F.flatten(F.transform(changes, lambda c: c[side]))), "\n"), F.lit(""))


def detection_inputs(pages: DataFrame, states: DataFrame) -> DataFrame:
    """One input for the page and one for each state that isn't unchanged."""
    return pages.withColumn("unit", F.lit("page")).unionByName(states.where("status <> 'unchanged'").drop("status").withColumn("unit", F.lit("state")), allowMissingColumns=True)
