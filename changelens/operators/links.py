"""Page links and monitoring candidates: first-wins keys, noise, priority, bounded pools, source checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

POOL = 40
PROVENANCE_RANK = {"user_input": 3, "web_search": 2, "page_link": 1}


def first_by_key(links: DataFrame, page: list[str], key: str, order: str) -> DataFrame:
    """The first link of each key on a page, in document order."""
    w = W.partitionBy(*page, key).orderBy(order)
    return links.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pool(links: DataFrame, group: list[str], priority: str, order: str, limit: int = POOL) -> DataFrame:
    """The `limit` links of highest priority of each group; ties keep the earlier."""
    w = W.partitionBy(*group).orderBy(F.desc(priority), order)
    return links.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def merge_candidates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One candidate a key: strongest provenance, first non-empty title and snippet, first URL."""
    rank = F.coalesce(*[F.when(F.col("provenance") == p, r) for p, r in PROVENANCE_RANK.items()], F.lit(0))
    filled = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))).alias(c)
    return rows.groupBy(key).agg(F.max_by("provenance", rank).alias("provenance"), filled("title"), filled("snippet"), F.min_by("url", order).alias("url"))


def verified_sources(sources: DataFrame, pages: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, missing): sources that match a page read with PASS by its final URL whose requested URL is known."""
    read = pages.where("quality_status = 'PASS'").join(known.select(F.col("url").alias("requested_url")).distinct(), "requested_url", "left_semi")
    read = read.select(F.col("final_url").alias("url")).distinct()
    return sources.join(read, "url", "left_semi"), sources.join(read, "url", "left_anti")


def display_title(*options: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(o), F.lit("")) for o in options])


def same_set(a: Column, b: Column) -> Column:
    """Equality of two lists as sets, without case."""
    norm = lambda c: F.array_sort(F.array_distinct(F.transform(c, F.lower)))
    return norm(a) == norm(b)
