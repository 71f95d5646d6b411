"""Exact retrieval over chunks and memories: filters before ranks, ties by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from changelens.functions.text import parse_instant
from changelens.functions.vectors import as_doubles, space_violation, unit

#: Rows of a block of vectors, and queries that are scored at once.
BLOCK = 4096
STRIP = 32
#: Chunks of a block whose best score stands for them at first.
GROUP = 32
#: More than two sums of products of unit vectors differ by their order, up to thousands of components.
SLACK = 1e-9


def with_unit(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("_unit", unit(as_doubles(F.col(vector))))


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products component by component, as `dot` adds them: equal vectors score equally wherever they stand."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * (y[:, d] if y.ndim == 2 else y[d])
    return out


def _scored(batch: pa.RecordBatch, vector: str, q: np.ndarray) -> pa.Table:
    """Rows of a batch with a usable vector of the query's dimension, and their cosines."""
    column = batch.column(batch.schema.get_field_index(vector))
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), len(q)), False)
    rows = pa.Table.from_batches([batch]).filter(fits)
    x = column.filter(fits).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))  # a null becomes NaN
    with np.errstate(all="ignore"):
        length = np.sqrt(_in_order(x, x))
        usable = np.isfinite(x).all(1) & (length > 0)
        score = np.clip(_in_order(x[usable] / length[usable, None], q), -1.0, 1.0)
    return rows.filter(pa.array(usable)).append_column("score", pa.array(score))


def search(chunks: DataFrame, query: list[float], n: int, key: str, vector: str, where: Column | None = None) -> DataFrame:
    """The n best chunks for one vector by (-score, key); the filter comes first.

    A task scores its rows a batch at a time and hands on its own n best, so n
    rows a task are sorted in the end.
    """
    q = np.array(query, np.float64)
    q = q / np.sqrt(_in_order(q[None], q[None]))
    rows = (chunks if where is None else chunks.where(where)).drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            both = _scored(batch, vector, q)
            both = both if best is None else pa.concat_tables([best, both])
            best = both.take(pc.sort_indices(both, [("score", "descending"), (key, "ascending")])[:n])
        if best is not None:
            yield from best.combine_chunks().to_batches()

    found = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return found.orderBy(F.desc("score"), key).limit(n)


def _best_of_block(n: int, schema: pa.Schema):
    """The n best chunks of one block for each query of another: a matrix product says which come near, and only their sums run in the order of `cosine`, so scores are equal bit by bit."""

    def run(asked: pa.Table, chunks: pa.Table) -> pa.Table:
        if not len(asked) or not len(chunks):
            return schema.empty_table()
        chunks = chunks.sort_by("_id")
        codes = pa.chunked_array([*asked.column("_id").chunks, *chunks.column("_id").chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
        at, own = codes[len(asked) :], codes[: len(asked)]
        q, c = (np.stack(x.column("_unit").to_numpy(zero_copy_only=False)) for x in (asked, chunks))
        wide = np.ascontiguousarray(c.T)
        starts = np.arange(0, len(c), GROUP)
        picked_q, picked_c, scores = [], [], []
        for start in range(0, len(q), STRIP):
            strip = q[start : start + STRIP]
            near = strip @ wide
            near[own[start : start + STRIP, None] == at] = -np.inf
            tops = np.maximum.reduceat(near, starts, axis=1)  # n groups of chunks that reach a score hold n chunks that do
            floor = np.partition(tops, len(starts) - n, axis=1)[:, len(starts) - n] if len(starts) > n else np.full(len(strip), -1.0)
            # the n best in any order of summing are among these; their scores are summed in order
            i, found = np.nonzero((near >= floor[:, None] - SLACK) & (near > -np.inf))
            score = np.clip(_in_order(c[found], strip[i]), -1.0, 1.0)
            best = np.lexsort((found, -score, i))
            best = best[np.arange(len(best)) - np.searchsorted(i, i) < n]  # i is in order before and after
            picked_q.append(start + i[best])
            picked_c.append(found[best])
            scores.append(score[best])
        ids = asked.column("_id").take(pa.array(np.concatenate(picked_q))), chunks.column("_id").take(pa.array(np.concatenate(picked_c)))
        return pa.Table.from_arrays([*ids, pa.array(np.concatenate(scores))], schema.names).cast(schema)

    return run


def search_all(chunks: DataFrame, queries: DataFrame, n: int, key: str, query_key: str, vector: str, domain: list[str]) -> DataFrame:
    """The n best chunks of each query within its own domain, ranked from 1.

    Both sides are dealt out in blocks of about BLOCK rows of a domain and dimension; a task scores one block
    of queries against one of chunks and hands on n rows a query, so a domain of any size is shared among tasks and no
    pair is a row.  Keys are unique on each side; rows without a key, a domain or a usable vector take no part.
    """

    def usable(df: DataFrame) -> DataFrame:
        rows = with_unit(df.where(F.col(key).isNotNull()), vector).where("_unit is not null")
        return rows.select(*domain, F.size("_unit").alias("_dim"), F.col(key).alias("_id"), "_unit")

    group, cell = [*domain, "_dim"], [*domain, "_dim", "_asked", "_held"]
    keys = [f"_key{k}" for k in range(len(cell))]
    c, q = usable(chunks), usable(queries)
    parts = lambda df, name: df.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias(name))
    sizes = parts(q, "_q").join(parts(c, "_c"), group)

    def dealt(df: DataFrame, own: str, count: str, other: str, others: str) -> DataFrame:
        rows = df.join(sizes, group).withColumn(own, F.pmod(F.xxhash64("_id"), F.col(count)))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))
        rows = rows.select(*[F.col(x).alias(k) for x, k in zip(cell, keys, strict=True)], "_id", "_unit")
        return rows.repartition(*keys)  # else a domain would stay in one task

    kinds = [T.StructField(query_key, queries.schema[key].dataType), T.StructField(key, chunks.schema[key].dataType), T.StructField("score", T.DoubleType())]
    schema = T.StructType(kinds)
    asked, held = dealt(q, "_asked", "_q", "_held", "_c"), dealt(c, "_held", "_c", "_asked", "_q")
    scored = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_best_of_block(n, to_arrow_schema(schema)), schema)
    over = W.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= n).select(query_key, key, "score", "rank")


def rerank(candidates: DataFrame, query: str, index: str, score: str, k: int) -> DataFrame:
    """The k best of each query's candidates by (-rerank score, index)."""
    over = W.partitionBy(query).orderBy(F.desc(score), index)
    return candidates.withColumn("rerank_rank", F.row_number().over(over)).where(F.col("rerank_rank") <= k)


def space_violations(chunks: DataFrame, vector: str, space: str, expected: str, dimension: int) -> DataFrame:
    return chunks.withColumn("violation", space_violation(as_doubles(F.col(vector)), F.col(space), expected, dimension)).where("violation is not null")


def embedder(embed: Callable[[list[str]], list[list[float]]], batch: int = 10):
    """A pandas UDF that embeds texts in batches, order kept."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.fillna("").tolist()
            out = [v for k in range(0, len(texts), batch) for v in embed(texts[k : k + batch])]
            if len(out) != len(texts):
                raise ValueError("an embedding for each text is needed")
            yield pd.Series(out)

    return run


def model_text(title: Column, headings: Column, table: Column, content: Column) -> Column:
    """What a model reads of a chunk: title, headings, table header, a blank line, the content."""
    head = F.concat_ws("\n", F.nullif(title, F.lit("")), F.nullif(F.array_join(headings, "\n"), F.lit("")), table)
    return F.concat(F.trim(head), F.lit("\n\n"), content)


# What a competitor's knowledge may come from, and which of it must be official.
ADMITTED = ("verified_official_content", "competition_event", "evidence", "confirmed_product_state")
OFFICIAL = ("verified_official_content", "confirmed_product_state")


def admission_violation(domain: Column, source_type: Column, credibility: Column, status: Column, reference: Column) -> Column:
    """Why a document may not enter the knowledge store; NULL if it may. What is NULL meets no condition."""
    fails = lambda condition: ~F.coalesce(condition, F.lit(False))
    own = F.coalesce(domain == "own_product", F.lit(False))
    return (
        F.when(own, F.when(fails(credibility == "user_provided"), "own_not_user_provided"))
        .when(fails(source_type.isin(*ADMITTED)), "type_not_allowed")
        .when(fails(status == "confirmed"), "not_confirmed")
        .when(fails(reference != ""), "verification_missing")
        .when(source_type.isin(*OFFICIAL) & fails(credibility == "official"), "not_official")
    )


def metadata_violations(domain: Column, title: Column, url: Column, reference: Column, observed_at: Column) -> Column:
    """Names of the rules that a source's metadata break; `observed_at` is ISO text that names its offset."""
    rules = F.array(
        F.when(~F.coalesce(domain.isin("own_product", "competitor"), F.lit(False)), "domain"),
        F.when(F.coalesce(F.trim(title), F.lit("")) == "", "title"),
        F.when(url.isNotNull() & ~url.rlike(r"^https?://[^/@]+(/|$|\?|#)"), "url"),
        F.when(url.isNull() & reference.isNull(), "source"),
        F.when(parse_instant(observed_at).isNull(), "observed_at"),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def upsert_plan(incoming: DataFrame, current: DataFrame, keys: list[str], fingerprint: str) -> DataFrame:
    """Adds outcome: inserted, updated or unchanged by fingerprint."""
    c = current.select(*keys, F.col(fingerprint).alias("_now"))
    out = incoming.join(c, keys, "left")
    return out.withColumn("outcome", F.when(F.col("_now").isNull(), "inserted").when(F.col("_now") == F.col(fingerprint), "unchanged").otherwise("updated")).drop("_now")


def replacement_conflicts(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Adds conflict, the first that holds of: document_exists, document_not_found, document_changed, duplicate_content, display_name_conflict.

    Both sides: domain, product_id, document_id, content_hash, display_name;
    incoming also create_only and expected_content_hash.
    """
    scope = ["domain", "product_id"]
    here = current.select(*scope, "document_id", F.col("content_hash").alias("_hash"))
    by_content = current.select(*scope, "content_hash", F.col("document_id").alias("_twin")).groupBy(*scope, "content_hash").agg(F.collect_set("_twin").alias("_twins"))
    by_name = current.groupBy(*scope, F.lower(F.trim("display_name")).alias("_name")).agg(F.collect_set("document_id").alias("_names"))
    out = incoming.withColumn("_name", F.lower(F.trim("display_name"))).join(here, [*scope, "document_id"], "left")
    out = out.join(by_content, [*scope, "content_hash"], "left").join(by_name, [*scope, "_name"], "left")
    other = lambda c: F.size(F.array_except(F.coalesce(c, F.array().cast("array<string>")), F.array("document_id"))) > 0
    conflict = (
        F.when(F.col("create_only") & F.col("_hash").isNotNull(), "document_exists")
        .when(~F.col("create_only") & F.col("_hash").isNull(), "document_not_found")
        .when(F.col("expected_content_hash").isNotNull() & (F.col("_hash") != F.col("expected_content_hash")), "document_changed")
        .when(other(F.col("_twins")), "duplicate_content")
        .when(other(F.col("_names")), "display_name_conflict")
    )
    return out.withColumn("conflict", conflict).drop("_hash", "_twins", "_names", "_name")
