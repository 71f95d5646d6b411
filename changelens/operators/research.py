"""Research citations: ids by kind, fact mode, support, report checks, output assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens.functions.text import source_group

MODEL_VIEW = ["result_id", "source", "domain", "source_group", "content", "credibility", "status", "title"]


def register(results: DataFrame, kind: str, order: str) -> DataFrame:
    """Citations numbered within their kind, with the group of their origin."""
    w = W.partitionBy(kind).orderBy(order)
    out = results.withColumn("result_id", F.concat_ws("-", F.col(kind), F.row_number().over(w).cast("string")))
    return out.withColumn("source_group", source_group(F.col("url"), F.col("reference"), F.col("result_id")))


# Sources that give context only, and states in which a source may carry a fact.
CONTEXT_SOURCES, FACT_STATES = ("memory", "search"), ("confirmed", "read")
ADVICE = ("implications", "watch_next")


def _true(condition: Column) -> Column:
    """A condition that NULL does not meet."""
    return F.coalesce(condition, F.lit(False))


def is_factual(source: Column, status: Column) -> Column:
    return _true(~source.isin(*CONTEXT_SOURCES) & status.isin(*FACT_STATES))


def factual(citations: DataFrame) -> DataFrame:
    """Citations that may carry a fact: neither memory nor search, confirmed or read."""
    return citations.where(is_factual(F.col("source"), F.col("status")))


def _supported(content: Column, excerpt: Column, source: Column, status: Column) -> Column:
    return is_factual(source, status) & _true((F.trim(excerpt) != "") & F.contains(content, excerpt))


def checked(supports: DataFrame, citations: DataFrame) -> DataFrame:
    """Supports with what they cite and `supported`: a citation that may carry a fact and holds the excerpt."""
    cited = citations.select("result_id", "content", "source", "status", "domain", "credibility")
    return supports.join(cited, "result_id", "left").withColumn("supported", _supported(F.col("content"), F.col("excerpt"), F.col("source"), F.col("status")))


def unsupported(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Claims that cite nothing, nothing that may carry a fact, or an excerpt that isn't in it."""
    return checked(claims, citations).where(~F.col("supported"))


def _any(condition: Column) -> Column:
    return F.bool_or(_true(condition))


def _references_differ(listed: str) -> Column:
    used = F.array_sort(F.collect_set("result_id"))
    return ~F.coalesce(used == F.array_sort(F.array_distinct(F.first(listed))), F.lit(False))


def _third_party() -> Column:
    return _any((F.col("kind") == "fact") & (F.col("source") == "page") & ~F.coalesce(F.col("credibility") == "official", F.lit(False)))


def _violations(**rules: Column) -> Column:
    return F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]), lambda x: x.isNotNull())


def report_violations(supports: DataFrame, citations: DataFrame) -> DataFrame:
    """report_id, violations of each report.

    `supports`, a row for each support of a claim: report_id, section, claim_no,
    kind, result_id, excerpt, refs (the ids that the report lists).  A fact may
    cite no page that isn't official; a claim of the section own_product_comparison
    needs knowledge of the own product and something of a competitor; what follows
    from facts (ADVICE) is no fact itself; the list names what is cited.
    """
    c = checked(supports, citations)
    own = _any((F.col("source") == "knowledge") & (F.col("domain") == "own_product"))
    compared = c.where("section = 'own_product_comparison'").groupBy("report_id", "claim_no").agg(own.alias("own"), _any(F.col("domain") == "competitor").alias("other"))
    compared = compared.groupBy("report_id").agg(F.bool_and("own").alias("_own"), F.bool_and("other").alias("_other"))
    rules = c.groupBy("report_id").agg(
        F.bool_or(~F.col("supported")).alias("_unsupported"), _third_party().alias("_third"), _any(F.col("section").isin(*ADVICE) & (F.col("kind") == "fact")).alias("_advice"), _references_differ("refs").alias("_differ")
    )
    missing = lambda name: ~F.coalesce(F.col(name), F.lit(True))
    found = _violations(
        unsupported=F.col("_unsupported"), third_party_fact=F.col("_third"), own_knowledge_missing=missing("_own"), competitor_missing=missing("_other"), fact_in_advice=F.col("_advice"), references_differ=F.col("_differ")
    )
    return rules.join(compared, "report_id", "left").select("report_id", found.alias("violations"))


def follow_up_violations(supports: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id, violations: as for reports, without sections. `supports`: answer_id, kind, result_id, excerpt, refs."""
    rules = _violations(unsupported=F.bool_or(~F.col("supported")), third_party_fact=_third_party(), references_differ=_references_differ("refs"))
    return checked(supports, citations).groupBy("answer_id").agg(rules.alias("violations"))


def verification_violations(supports: DataFrame, citations: DataFrame) -> DataFrame:
    """verification_id, violations: only new citations count, a decision needs an official one, an open one its questions.

    `supports`: verification_id, result_id, excerpt (both NULL: no support), decision,
    new_refs, initial_refs, n_unresolved.
    """
    cited = F.col("result_id").isNotNull()
    known = F.size(F.array_intersect(F.collect_set("result_id"), F.coalesce(F.first("initial_refs"), F.array().cast("array<string>")))) > 0
    open_ = F.coalesce(F.first("decision") == "still_pending", F.lit(False))
    rules = _violations(
        unsupported=F.coalesce(F.bool_or(cited & ~F.col("supported")), F.lit(False)),
        not_new=_references_differ("new_refs") | known,
        official_missing=~open_ & ~_any(cited & (F.col("credibility") == "official")),
        question_missing=open_ & ~F.coalesce(F.first("n_unresolved") > 0, F.lit(False)),
    )
    return checked(supports, citations).groupBy("verification_id").agg(rules.alias("violations"))


def has_generated_url(result: Column) -> Column:
    """Whether a result in JSON holds a URL that a model wrote."""
    return result.rlike(r"(?i)https?://|www\.")


def assemble(records: DataFrame, run: str, order: str) -> DataFrame:
    """One result a run: failed over pending over complete; the last citation of an id, the first of equal doubts.

    `records`: status, citation_id, citation, uncertainty.
    """
    cited = records.where("citation_id is not null").groupBy(run, "citation_id").agg(F.max_by("citation", order).alias("citation"))
    cited = cited.groupBy(run).agg(F.map_from_entries(F.collect_list(F.struct("citation_id", "citation"))).alias("citations"))
    doubts = records.where("uncertainty is not null").groupBy(run, "uncertainty").agg(F.min(order).alias("_at"))
    doubts = doubts.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "uncertainty"))), lambda x: x["uncertainty"]).alias("uncertainties"))
    status = records.groupBy(run).agg(F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status") == "pending"), "pending").otherwise("complete").alias("status"))
    return status.join(cited, run, "left").join(doubts, run, "left")


def history(turns: DataFrame, keys: list[str], order: str, done: Column, value: str) -> DataFrame:
    """Adds history: the values of earlier completed turns in order."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return turns.withColumn("history", F.collect_list(F.when(done, F.col(value))).over(w))


def numbered(rows: DataFrame, group: list[str], key: str, width: int = 4096) -> DataFrame:
    """Adds number, the place of each row in its group by an integer key: places within ranges of the key, and sums of what lies below, so that no group is sorted in one task."""
    part = F.floor(F.col(key) / width)
    counts = rows.groupBy(*group, part.alias("_part")).agg(F.count("*").alias("_n"))
    below = counts.withColumn("_below", F.sum("_n").over(W.partitionBy(*group).orderBy("_part")) - F.col("_n")).drop("_n")
    place = F.row_number().over(W.partitionBy(*group, "_part").orderBy(key))
    return rows.withColumn("_part", part).withColumn("_place", place).join(below, [*group, "_part"]).withColumn("number", F.col("_below") + F.col("_place")).drop("_part", "_place", "_below")
