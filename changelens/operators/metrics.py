"""Evaluation metrics: ratios, confusion, precision and recall, summaries, gold contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ratio(matched: Column, total: Column) -> Column:
    """matched / total; NULL without any."""
    return matched / F.nullif(total, F.lit(0))


def or_zero(matched: Column, total: Column) -> Column:
    return F.coalesce(matched / F.nullif(total, F.lit(0)), F.lit(0.0))


def label_dim(df: DataFrame, labels: list) -> DataFrame:
    """The labels as a table of their own: classes without a case stay in the result."""
    return df.sparkSession.createDataFrame([(x,) for x in labels], "label " + ("int" if isinstance(labels[0], int) else "string"))


def confusion(df: DataFrame, gold: str, predicted: str, labels: list) -> DataFrame:
    """gold, predicted, n for every pair of labels, zeros included."""
    dim = label_dim(df, labels)
    pairs = dim.select(F.col("label").alias("gold"), F.explode(F.array(*map(F.lit, labels))).alias("predicted"))
    n = df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    return pairs.join(n, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(df: DataFrame, gold: str, predicted: str, labels: list) -> DataFrame:
    """label, support, precision, recall, f1; 0.0 where nothing was predicted or nothing is there."""
    hits = F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p"), (F.col(gold) == F.col(predicted)).cast("int").alias("t")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).alias("t")))
    sums = df.select(F.explode(hits).alias("h")).groupBy("h.label").agg(F.sum("h.g").alias("g"), F.sum("h.p").alias("p"), F.sum("h.t").alias("t"))
    out = label_dim(df, labels).join(sums, "label", "left").na.fill(0, ["g", "p", "t"])
    precision, recall = or_zero(F.col("t"), F.col("p")), or_zero(F.col("t"), F.col("g"))
    return out.select("label", F.col("g").cast("long").alias("support"), precision.alias("precision"), recall.alias("recall"), or_zero(2 * precision * recall, precision + recall).alias("f1"))


def macro(classes: DataFrame) -> DataFrame:
    return classes.agg(*[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def binary(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    tp, fp, fn = F.count_if(gold & predicted), F.count_if(~gold & predicted), F.count_if(gold & ~predicted)
    out = df.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    p, r = or_zero(F.col("tp"), F.col("tp") + F.col("fp")), or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"), or_zero(2 * p * r, p + r).alias("f1"))


def type_accuracy(df: DataFrame, gold_type: str, actual_type: str, decision_ok: str) -> DataFrame:
    """Strict accuracy over all cases with a gold type, conditional over those decided right."""
    has = F.col(gold_type).isNotNull()
    right = F.coalesce(has & (F.col(gold_type) == F.col(actual_type)), F.lit(False))
    ok = F.coalesce(F.col(decision_ok), F.lit(False))
    return df.agg(ratio(F.count_if(right), F.count_if(has)).alias("strict"), ratio(F.count_if(right & ok), F.count_if(has & ok)).alias("conditional"))


def time_metrics(df: DataFrame, gold: str, actual: str, supported: str) -> DataFrame:
    g, a = F.col(gold), F.col(actual)
    return df.agg(ratio(F.count_if(g == a), F.count_if(g.isNotNull())).alias("exact"), F.count_if(g.isNotNull() & a.isNull()).alias("abstained"), F.count_if(a.isNotNull() & ~F.coalesce(F.col(supported), F.lit(False))).alias("unsupported"))


def run_summary(df: DataFrame) -> DataFrame:
    """Counts by execution status; correctness over SUCCESS alone and over all cases."""
    done = F.col("execution_status") == "SUCCESS"
    right = F.coalesce(F.col("decision_correct"), F.lit(False)) & done
    return df.agg(
        F.count("*").alias("n_cases"), F.count_if(done).alias("n_success"), F.count_if(F.col("execution_status") == "BLOCKED").alias("n_blocked"), F.count_if(F.col("execution_status") == "ERROR").alias("n_error"),
        ratio(F.count_if(right), F.count_if(done)).alias("valid_accuracy"), ratio(F.count_if(right), F.count("*")).alias("end_to_end_accuracy"), ratio(F.count_if(done), F.count("*")).alias("execution_rate"),
    )


def by_path(df: DataFrame, path: str) -> DataFrame:
    return df.groupBy(path).agg(F.count("*").alias("n"), ratio(F.count_if(F.coalesce(F.col("decision_correct"), F.lit(False))), F.count("*")).alias("accuracy"))


def micro(df: DataFrame, keys: list[str], matched: str, total: str) -> DataFrame:
    """Sums of matches over sums of totals."""
    return df.groupBy(*keys).agg(F.sum(matched).alias("matched"), F.sum(total).alias("total"), ratio(F.sum(matched), F.sum(total)).alias("rate"))


def violations_of(df: DataFrame, violations: str) -> DataFrame:
    return df.select(F.explode(violations).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


def bad_case(gold: Column, actual: Column, type_ok: Column) -> Column:
    """Category of a wrong case; NULL for a right one."""
    return F.when(gold != actual, F.concat(gold, F.lit("_as_"), actual)).when((gold == "event") & ~F.coalesce(type_ok, F.lit(True)), "event_type_mismatch")


def score_case(df: DataFrame) -> DataFrame:
    """Adds decision_correct, event_type_correct, violations and review_reasons of a case.

    Columns: gold_decision, decision, gold_type, event_type, n_events, n_evidence, n_unverified, model_calls.
    """
    right = F.col("gold_decision") == F.col("decision")
    type_ok = F.when(F.col("gold_decision") == "event", F.col("gold_type").eqNullSafe(F.col("event_type")))
    hard = F.array(
        F.when((F.col("decision") == "event") & (F.col("n_evidence") == 0), "event_without_evidence"), F.when(F.col("n_unverified") > 0, "unverified_quote"),
        F.when(F.col("model_calls") > 1, "extra_model_call"), F.when((F.col("decision") != "event") & (F.col("n_events") > 0), "events_without_decision"),
        F.when(F.col("decision").isNull(), "decision_missing"),
    )
    reasons = F.array(F.when(~right, "decision"), F.when(~type_ok, "event_type"), F.when(F.col("n_events") > 1, "several_events"))
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    return df.withColumn("decision_correct", right).withColumn("event_type_correct", type_ok).withColumn("violations", some(hard)).withColumn("review_reasons", some(reasons))


def review_queue(df: DataFrame) -> DataFrame:
    return df.where(F.size("review_reasons") > 0)


def is_blocked(error_class: Column, error_type: Column) -> Column:
    """Whether a failure comes from configuration or quota rather than from the code."""
    classes = r"(?:Agent|AgentTool|LLM|SearchProvider)(?:Configuration)?Error$"
    kinds = ("missing_api_key", "authentication_failed", "quota_exceeded", "quota_unavailable", "service_not_enabled")
    return F.coalesce(error_class.rlike(rf"^{classes}"), F.lit(False)) | F.coalesce(error_type.isin(*kinds), F.lit(False))


def distribution(df: DataFrame, column: str, labels: list) -> DataFrame:
    """label, n for each label, those without a row too."""
    n = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return label_dim(df, labels).join(n, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gold_violations(df: DataFrame) -> DataFrame:
    """case_id, violations of gold records: unique id, closed words, facts only with an event, a ready case has an annotator."""
    n = F.count("*").over(W.partitionBy("case_id"))
    facts = F.coalesce(F.col("event_type"), F.col("event_subject"), F.col("change_action")).isNotNull()
    rules = F.array(
        F.when(n > 1, "duplicate_case"), F.when(~F.col("path").isin("state_comparison", "explicit_statement"), "path"), F.when(~F.col("decision").isin("event", "no_event", "uncertain"), "decision"),
        F.when((F.col("decision") != "event") & facts, "facts_without_event"), F.when((F.col("decision") == "event") & F.col("event_type").isNull(), "event_without_type"),
        F.when((F.col("annotation_status") == "ready") & F.col("annotated_by").isNull(), "annotator_missing"),
    )
    return df.select("case_id", F.filter(rules, lambda x: x.isNotNull()).alias("violations"))


def expected_set(df: DataFrame, expected: dict[str, str], key: str, value: str) -> DataFrame:
    """Rows of either side that don't agree with the expected ids and values."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{key} string, _expected string")
    return df.select(key, value).join(want, key, "full_outer").where(~F.col(value).eqNullSafe(F.col("_expected")))


def time_eligible(gold_decision: Column, gold_dates: Column, body_dates: Column) -> Column:
    return (gold_decision == "event") & (F.size(gold_dates) == 1) & (F.size(F.array_except(gold_dates, body_dates)) == 0)
