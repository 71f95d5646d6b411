"""Snapshot history: the previous snapshot, tri-state change, first and last sight, registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

VERSION_CHANGED = "extraction_version_changed"


def snapshots(pages: DataFrame, captured_at: str, content: str, version: str | None) -> DataFrame:
    """Pages with captured_at, content_hash and extraction_version; a missing version stays NULL."""
    return pages.withColumn("captured_at", F.col(captured_at)).withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256)).withColumn("extraction_version", F.lit(version).cast("string"))


def previous_strict(df: DataFrame, keys: list[str], at: str, tie: str, columns: list[str], prefix: str = "previous_") -> DataFrame:
    """Adds, for each row, `columns` of the latest row of its keys strictly earlier than it.

    Rows at the same time never see each other; of several at the latest
    earlier time the greatest `tie` is taken.  One sort by keys and time.
    """
    out = df.withColumn("_rank", F.dense_rank().over(W.partitionBy(*keys).orderBy(at)))
    top = F.max(F.struct(F.col(tie), *columns)).over(W.partitionBy(*keys, "_rank"))  # the row that later ones look back to
    out = out.withColumn("_top", top)
    firsts = W.partitionBy(*keys).orderBy("_rank").rangeBetween(-1, -1)
    out = out.withColumn("_previous", F.max("_top").over(firsts))
    return out.select("*", *[F.col(f"_previous.{c}").alias(f"{prefix}{c}") for c in columns], F.col("_previous").isNull().alias("is_first_scan")).drop("_top", "_rank", "_previous")


def change(first: Column, version: Column, previous_version: Column, digest: Column, previous_digest: Column) -> Column:
    """NULL on a first scan or between versions, else whether the hash differs."""
    return F.when(first, F.lit(None)).when(~version.eqNullSafe(previous_version), F.lit(None)).otherwise(digest != previous_digest)


def change_reason(first: Column, version: Column, previous_version: Column) -> Column:
    return F.when(~first & ~version.eqNullSafe(previous_version), F.lit(VERSION_CHANGED))


def detect_changes(df: DataFrame, keys: list[str], at: str, tie: str, digest: str = "content_hash", version: str = "extraction_version") -> DataFrame:
    """Adds is_first_scan, changed and reason."""
    out = previous_strict(df, keys, at, tie, [digest, version])
    args = F.col("is_first_scan"), F.col(version), F.col(f"previous_{version}")
    return out.withColumn("changed", change(*args, F.col(digest), F.col(f"previous_{digest}"))).withColumn("reason", change_reason(*args))


def seen(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """First and last `value` of each key in order, and how often it was seen."""
    by = F.struct(*order)
    return df.groupBy(*keys).agg(F.min_by(value, by).alias("first_seen"), F.max_by(value, by).alias("last_seen"), F.count("*").alias("n_seen"))


def register(df: DataFrame, keys: list[str], order: list[str], digest: str) -> DataFrame:
    """Adds outcome: the first of a key is added, one like the first is a duplicate, others are unstable."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("outcome", F.when(F.row_number().over(w) == 1, "added").when(F.col(digest) == F.first(digest).over(w), "duplicate").otherwise("unstable"))


def stable_runs(df: DataFrame, keys: list[str], order: list[str], digest: str, needed: int = 3) -> DataFrame:
    """Adds is_stable: the fingerprint equals those of the `needed` - 1 observations before it."""
    w = W.partitionBy(*keys).orderBy(*order)
    same = [F.lag(digest, k).over(w) == F.col(digest) for k in range(1, needed)]
    return df.withColumn("is_stable", F.coalesce(same[0] if len(same) == 1 else F.forall(F.array(*same), lambda x: x), F.lit(False)))


def scan_status(df: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    """failed if every scan failed, partial if any did, else complete."""
    n, bad = F.count("*"), F.count_if(failed)
    return df.groupBy(*keys).agg(F.when(bad == n, "failed").when(bad > 0, "partial").otherwise("complete").alias("status"))


def circuit_break(df: DataFrame, order: list[str], blocked: Column, keys: list[str] | None = None) -> DataFrame:
    """Adds status: after the first blocked row of its keys every later one is blocked."""
    w = W.partitionBy(*(keys or [])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("status", F.when(F.max(blocked.cast("int")).over(w) == 1, "BLOCKED").otherwise("RUN"))


def budget_ledger(df: DataFrame, keys: list[str], order: list[str], kinds: dict[str, tuple[Column, int]]) -> DataFrame:
    """Adds used_<kind> (uses before this row) and allowed: none of its kinds' budgets is spent."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out, ok = df, F.lit(True)
    for name, (uses, limit) in kinds.items():
        out = out.withColumn(f"used_{name}", F.coalesce(F.count_if(uses).over(w), F.lit(0)).cast("long"))
        ok = ok & (~uses | (F.col(f"used_{name}") < limit))
    return out.withColumn("allowed", ok)


def first_sights(df: DataFrame, keys: list[str], order: list[str], baseline: Column) -> DataFrame:
    """Adds was_seen and is_new: a key is new at its first sight, unless that belongs to the baseline."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) == 1
    return df.withColumn("was_seen", ~first).withColumn("is_new", first & ~baseline)
