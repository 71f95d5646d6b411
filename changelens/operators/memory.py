"""Long-term memory: write policy, supersession chains, eligibility."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens.functions.text import contains_secret
from changelens.operators.retrieval import search as nearest

# Kinds of sources that state facts, words by which a type shows, and texts that aren't worth keeping.
FACT_SOURCES = ("event", "evidence", "snapshot", "knowledge", "pricing", "web_page")
TYPE_SIGNALS = {
    "focus": ("关注", "重点", "优先", "focus", "prioritize"),
    "preference": ("偏好", "倾向", "默认", "更喜欢", "优先", "prefer", "preference", "prioritize"),
    "constraint": ("必须", "仅限", "不要", "不得", "约束", "must", "only", "avoid"),
    "goal": ("目标", "计划", "持续", "希望", "goal", "plan"),
    "decision": ("决定", "选择", "采用", "decision", "decided"),
    "hypothesis": ("假设", "推测", "可能", "认为", "hypothesis", "may"),
    "open_question": ("待确认", "尚未", "需要确认", "是否", "问题", "open question", "unresolved"),
}
TEMPORARY = (
    r"(?i)(?:临时|这次先|现在先|今天先|本次仅).{0,20}(?:运行|重跑|导出|下载|打开|关闭|提交|删除|安装|测试)|"
    r"(?:run|retry|export|download|open|close|commit|delete|install|test).{0,20}(?:this time|today|temporarily)"
)
FACT_ONLY = r"(?i)^(?:.{0,30})(?:支持|上线|发布|定价|售价|每月|价格|版本|released|supports|pricing|costs)(?:.{0,80})$"
MAX_SOURCE_CHARS = 4000


def source_violation(text: Column, reference: Column) -> Column:
    """Why a text may not go to a model; NULL if it may."""
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "blank")
        .when(F.length(text) > MAX_SOURCE_CHARS, "too_long")
        .when(contains_secret(text) | contains_secret(F.coalesce(reference, F.lit(""))), "secret")
    )


def has_signal(kind: Column, text: Column) -> Column:
    low = F.lower(text)
    told = [(kind == k) & reduce(or_, [F.contains(low, F.lit(s)) for s in signals]) for k, signals in TYPE_SIGNALS.items()]
    return F.coalesce(reduce(or_, told), F.lit(False))


def has_any_signal(text: Column) -> Column:
    return reduce(or_, [has_signal(F.lit(k), text) for k in TYPE_SIGNALS])


def candidate_violation(content: Column, kind: Column, source_text: Column, source_kind: Column) -> Column:
    """The first rule that a memory candidate breaks, those of its source before its own; NULL if none. A source of no known kind counts as one of facts."""
    return F.coalesce(
        F.concat(F.lit("source_"), source_violation(source_text, F.lit(None).cast("string"))),
        F.when(F.coalesce(source_kind.isin(*FACT_SOURCES), F.lit(True)), F.lit("fact_source")),
        F.when(~F.coalesce(F.contains(source_text, content), F.lit(False)), F.lit("not_verbatim")),
        F.when(contains_secret(content), F.lit("secret")),
        F.when(content.rlike(TEMPORARY), F.lit("temporary")),
        F.when(~has_signal(kind, source_text), F.lit("no_signal")),
        F.when(content.rlike(FACT_ONLY) & ~has_any_signal(content), F.lit("fact_only")),
    )


def supersession(records: DataFrame, keys: list[str], order: list[str], content: list[str], record_id: str) -> DataFrame:
    """The versions of each key: repeats of the last content collapse; each points to the one before; the newest is active."""
    w = W.partitionBy(*keys).orderBy(*order)
    value = F.struct(*content)
    kept = records.withColumn("_last", F.lag(value).over(w)).where(F.col("_last").isNull() | (F.col("_last") != value)).drop("_last")
    return kept.withColumn("supersedes", F.lag(record_id).over(w)).withColumn("active", F.lead(record_id).over(w).isNull())


def pending_new(incoming: DataFrame, active: DataFrame, exact: list[str]) -> DataFrame:
    """Incoming records that no active one equals exactly."""
    return incoming.join(active.select(*exact).distinct(), exact, "left_anti")


def eligible(records: DataFrame, scope: str, scope_id: str | None, types: list[str] | None = None) -> DataFrame:
    """Confirmed and active records of a scope (without an id: of all of that kind), latest first."""
    ok = (F.col("scope") == scope) & (F.col("status") == "confirmed") & F.col("active")
    if scope_id is not None:
        ok = ok & (F.col("scope_id") == scope_id)
    if types:
        ok = ok & F.col("memory_type").isin(*types)
    return records.where(ok).orderBy(F.desc("updated_at"), F.desc("memory_id"))


#: The most that a search may ask for.
MAX_FOUND = 50


def search(records: DataFrame, query: list[float], k: int, scope: str, scope_id: str | None, vector: str) -> DataFrame:
    """The k eligible records nearest to a vector by (-score, memory_id); k from 1 to MAX_FOUND."""
    if not 1 <= k <= MAX_FOUND:
        raise ValueError(f"k must be from 1 to {MAX_FOUND}")
    return nearest(eligible(records, scope, scope_id), query, k, "memory_id", vector)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: how an upsert or a tombstone shows in an append-only log."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def without_deleted(log: DataFrame, keys: list[str], order: list[str], deleted: str) -> DataFrame:
    return latest(log, keys, order).where(~F.coalesce(F.col(deleted), F.lit(False)))


def active_key_violations(records: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than one active confirmed record: must be empty."""
    return records.where("active and status = 'confirmed'").groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
