"""Interactive states: matching two traversals, folding their comparison, keyed row differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCHEMA_UNAVAILABLE = "interactive_state_schema_unavailable"
SCHEMA_CHANGED = "interactive_state_schema_version_changed"
INCOMPLETE = "traversal_incomplete"


def schema_reason(current: Column, previous: Column) -> Column:
    """Why two snapshots' states can't be compared; NULL if they can."""
    return F.when(current.isNull() | previous.isNull(), SCHEMA_UNAVAILABLE).when(current != previous, SCHEMA_CHANGED)


def collect(states: DataFrame, keys: list[str], eligible: str = "comparison_eligible") -> tuple[DataFrame, DataFrame]:
    """(eligible states, per-key report): eligibility defaults to TRUE; the report counts what is excluded and what is there twice."""
    ok = F.coalesce(F.col(eligible), F.lit(True))
    report = states.groupBy(*keys).agg(F.count_if(~ok).alias("excluded"), (F.count_if(ok) > 1).alias("duplicate"))
    return states.where(ok), report


def match_states(previous: DataFrame, current: DataFrame, keys: list[str], digest: str, previous_complete: Column, current_complete: Column) -> DataFrame:
    """Full outer match on the keys: status and changed of every state of either side.

    A state of one side only is a change if both traversals were complete, and
    unresolved otherwise: not observed is never absent.
    """
    p = previous.select(*keys, F.col(digest).alias("previous_hash"))
    c = current.select(*keys, F.col(digest).alias("current_hash"))
    both = previous_complete & current_complete
    status = (
        F.when(F.col("previous_hash").isNotNull() & F.col("current_hash").isNotNull(), F.when(F.col("previous_hash") == F.col("current_hash"), "unchanged").otherwise("modified"))
        .when(~both, "unresolved")
        .when(F.col("current_hash").isNotNull(), "current_only")
        .otherwise("previous_only")
    )
    out = p.join(c, keys, "full_outer").withColumn("status", status)
    changed = F.when(F.col("status") == "unchanged", False).when(F.col("status") == "unresolved", F.lit(None)).otherwise(True)
    return out.withColumn("changed", changed)


def fold(matched: DataFrame, keys: list[str]) -> DataFrame:
    """changed: TRUE with any definite change, else FALSE if all is settled, else NULL."""
    any_change = F.coalesce(F.bool_or("changed"), F.lit(False))
    settled = F.bool_and(F.col("changed").isNotNull())
    return matched.groupBy(*keys).agg(F.when(any_change, True).when(settled, False).alias("changed"), F.count("*").alias("n_states"))


def keyed_row_diff(previous: DataFrame, current: DataFrame, table: list[str], key: str, columns: list[str]) -> DataFrame:
    """Rows of keyed tables as added, deleted, modified or unchanged, with the names of changed cells."""
    p = previous.select(*table, key, F.struct(*columns).alias("before"))
    c = current.select(*table, key, F.struct(*columns).alias("after"))
    cells = F.filter(
        F.array(*[F.when(~F.col(f"before.{x}").eqNullSafe(F.col(f"after.{x}")), F.lit(x)) for x in columns]), lambda x: x.isNotNull()
    )
    out = p.join(c, [*table, key], "full_outer")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.size(cells) > 0, "modified").otherwise("unchanged")
    return out.withColumn("status", status).withColumn("changed_cells", cells)


def is_keyed(rows: DataFrame, table: list[str], key: str) -> DataFrame:
    """Whether every row of a table has a non-empty key of its own."""
    ok = (F.count("*") == F.count_distinct(key)) & (F.count_if(F.coalesce(F.col(key), F.lit("")) == "") == 0)
    return rows.groupBy(*table).agg(ok.alias("is_keyed"))


def nearest_changed_ancestor(before: DataFrame, after: DataFrame, page: list[str], path: str, depth: str, fingerprint: str) -> DataFrame:
    """The deepest element, the document root aside, whose fingerprint differs between two observations."""
    b = before.select(*page, path, depth, F.col(fingerprint).alias("_b"))
    a = after.select(*page, path, F.col(fingerprint).alias("_a"))
    changed = b.join(a, [*page, path]).where(~F.col("_a").eqNullSafe(F.col("_b")) & (F.col(depth) > 0))
    return changed.groupBy(*page).agg(F.max_by(path, F.struct(F.col(depth), F.col(path))).alias("scope"))


def bounded_tabs(tabs: DataFrame, group: list[str], order: str, is_default: str, page: list[str], per_group: int = 5, per_page: int = 12, max_depth: int = 2, depth: str = "depth") -> DataFrame:
    """Adds kept: non-default tabs within the bounds of their group, page and depth; defaults always."""
    in_group = F.row_number().over(W.partitionBy(*group, is_default).orderBy(order))
    out = tabs.withColumn("_ok", F.col(is_default) | ((in_group <= per_group) & (F.col(depth) <= max_depth)))
    in_page = F.row_number().over(W.partitionBy(*page, "_ok", is_default).orderBy(*group, order))
    return out.withColumn("kept", F.col("_ok") & (F.col(is_default) | (in_page <= per_page))).drop("_ok")


def own_content(parents: DataFrame, nested: DataFrame, page: list[str], path: str) -> DataFrame:
    """Blocks of a parent state that lie in no nested scope (by path prefix)."""
    n = nested.select(*page, F.col(path).alias("_scope")).distinct()
    within = F.expr(f"startswith({path}, _scope)")
    return parents.join(n, [parents[p] == n[p] for p in page] + [within], "left_anti")
