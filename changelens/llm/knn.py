"""Exact top-k search by inner product: a Voronoi join of queries and data.

Vectors go to the cell of their nearest pivot; there are about as many pivots
as the square root of the vectors, so that cells and their number grow alike.
Each cell's summary (pivot, radius) bounds what its vectors can score.  A query is first solved in its own
cell, which gives a score it has at least k times; then it visits only cells
whose bound reaches that score, in bounded blocks of queries and data.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens.llm.base import Scratch

#: Vectors in a block; pivots, at most (beyond their square cells grow with the data, which costs time alone); sampled vectors for each pivot.
BLOCK, PIVOT_LIMIT, SAMPLE = 1024, 16_384, 8
PIVOT_SEED = 5
BLOCKS = "dim int, cell int, n int, rows binary, ids binary, vecs binary, floors binary"


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Batches of at most `n` rows from Parquet and to Python while rows hold whole blocks; joins hand them on one by one, generated code would hold all of a block's matches."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(n), "spark.sql.parquet.columnarReaderBatchSize": str(n), "spark.sql.codegen.wholeStage": "false"}
    old = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, vec, row (an own key of each row): floor(scale * x) of each component; vectors that are null or hold null or non-finite components left out."""
    real = F.transform("embedding", lambda x: x.cast("double"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    out = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True)))
    out = out.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(real, lambda x: F.floor(x * scale).cast("long")).alias("vec"))
    return out.withColumn("row", F.monotonically_increasing_id())


def pivot_count(n: int) -> int:
    return max(1, min(PIVOT_LIMIT, math.isqrt(n) // 4))


def choose_pivots(sample: list[list[int]], n: int) -> dict[int, np.ndarray]:
    """Pivots by dimension: a few rounds of k-means over a bounded sample, shared out by the dimensions' parts of it."""
    out, all_of_them = {}, pivot_count(n)
    for dim in sorted({len(v) for v in sample}):
        some = [v for v in sample if len(v) == dim]
        x = np.array(some, np.float64).reshape(len(some), dim)
        k = max(1, min(len(x), round(all_of_them * len(some) / len(sample))))
        centres = x[np.random.default_rng(PIVOT_SEED).permutation(len(x))[:k]].copy()
        for _ in range(4):
            at = _closest(x, centres)
            sums = np.zeros_like(centres)
            np.add.at(sums, at, x)
            counts = np.bincount(at, minlength=k)
            centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        out[dim] = centres
    return out


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres * centres).sum(1)[None, :]
    return np.concatenate([(norms - 2 * (x[a : a + BLOCK] @ centres.T)).argmin(1) for a in range(0, len(x), BLOCK)]) if len(x) else np.zeros(0, np.int64)


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles carry them exactly while they stay under 2**53."""
    top = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(x).max(initial=0))) * max(1, q.shape[1])
    if top < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _assign(pivots: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1).to_pylist()
            cell, dist = np.zeros(len(vecs), np.int32), np.zeros(len(vecs))
            dims = np.array([len(v) for v in vecs], np.int32)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.array([vecs[i] for i in at], np.float64).reshape(len(at), dim)
                centres = pivots.get(int(dim), np.zeros((1, dim)))
                cell[at] = _closest(x, centres)
                dist[at] = np.sqrt(((x - centres[cell[at]]) ** 2).sum(1))
            raw = [np.array(v, "<i8").tobytes() for v in vecs]
            yield pa.RecordBatch.from_arrays([batch.column(2), ids, pa.array(dims), pa.array(cell), pa.array(dist), pa.array(raw, pa.binary())], ["row", "vec_id", "dim", "cell", "dist", "raw"])

    return run


def _blocks(rows: DataFrame, parts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Blocks of about BLOCK vectors of a cell; large cells are dealt out by a hash of the row."""
    dealt = rows.join(F.broadcast(parts), ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("parts")))

    def run(group: pa.Table) -> pa.Table:
        order = group.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        floors = order.column("floor").to_numpy(zero_copy_only=False) if "floor" in order.column_names else np.zeros(0)
        one = [order.column("dim")[0].as_py(), order.column("cell")[0].as_py(), len(order), order.column("row").to_numpy().astype("<i8").tobytes(), order.column("vec_id").to_numpy().astype("<i8").tobytes(), b"".join(order.column("raw").to_pylist()), floors.astype("<f8").tobytes()]
        kinds = [pa.int32()] * 3 + [pa.binary()] * 4
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(one, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return scratch.write(dealt.groupBy("dim", "cell", "salt").applyInArrow(run, BLOCKS), name)


def _met(data: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of queries with the blocks of data in the cell they visit; never broadcast, as vectors that visit many cells make small files of a large table."""
    blocks = asked.select("dim", "cell", *[F.col(c).alias(f"q_{c}") for c in ("n", "rows", "ids", "vecs", "floors")])
    return blocks.hint("merge").join(data, ["dim", "cell"])


def _solve(k: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                q, x = (np.frombuffer(r[c], "<i8").reshape(-1, dim) if dim else np.zeros((r[m], 0), np.int64) for c, m in (("q_vecs", "q_n"), ("vecs", "n")))
                qrow, qid, xrow, xid = (np.frombuffer(r[c], "<i8") for c in ("q_rows", "q_ids", "rows", "ids"))
                floors = np.frombuffer(r["q_floors"], "<f8") if r["q_floors"] else np.full(len(qid), -np.inf)
                scores = _exact(q, x)
                out = []
                for i in range(len(qid)):
                    s = scores[i]
                    ok = np.flatnonzero((s >= floors[i]) & (xrow != qrow[i]))
                    if len(ok) > k:
                        least = np.partition(s[ok], len(ok) - k)[len(ok) - k]
                        ok = ok[s[ok] >= least]
                        ok = ok[np.lexsort((xid[ok], -s[ok]))[:k]]
                    if len(ok):
                        out.append((np.full(len(ok), qrow[i]), np.full(len(ok), qid[i]), xid[ok], s[ok]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_row", "query_id", "vec_id", "score"])

    return run


def _best(rows: DataFrame, k: int, query: str) -> DataFrame:
    over = W.partitionBy(query).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each query (ids divisible by `every`).

    Defined cases: vectors that are null, or hold null or non-finite
    components, and rows without an id take no part; each row is a query and a
    candidate of its own, whatever id or vector it shares with others, and only
    itself it does not find; vectors score only against those of the same
    dimension; ties go to the smaller id; fewer than k others are all returned;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "knn")
    ints = scratch.write(integer_vectors(vectors, scale), "vectors")
    n = ints.count()
    wanted = SAMPLE * max(1024, pivot_count(n))
    share = min(1.0, wanted / max(1, n))
    sample = ints.where(F.pmod(F.xxhash64("vec_id", F.lit(PIVOT_SEED)), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("vec_id", F.lit(PIVOT_SEED))).limit(wanted)
    pivots = choose_pivots([r[0] for r in sample.select("vec").collect()], n)
    placed = scratch.write(ints.select("vec_id", "vec", "row").mapInArrow(_assign(pivots), "row long, vec_id long, dim int, cell int, dist double, raw binary"), "placed")
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("dist").alias("radius"))
    cells = scratch.write(cells.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("long")), "cells")  # a row for each pivot
    summary: dict[int, tuple] = {}
    for dim, rows in groupby(sorted((r["dim"], r["cell"], r["radius"]) for r in cells.collect()), itemgetter(0)):
        _, at, radius = zip(*rows, strict=True)
        summary[dim] = np.array(at), np.array(radius)
    data = _blocks(placed.select("row", "vec_id", "dim", "cell", "raw"), cells.select("dim", "cell", "parts"), scratch, "data")
    queries = placed.where(F.col("vec_id") % every == 0)
    result = "query_row long, query_id long, vec_id long, score long"

    def solved(blocks: DataFrame, name: str) -> DataFrame:
        with arrow_rows(spark, 8):
            return scratch.write(_met(data, blocks).mapInArrow(_solve(k), result), name)

    own = _blocks(queries.select("row", "vec_id", "dim", "cell", "raw"), cells.select("dim", "cell", "parts"), scratch, "queries")
    first = scratch.write(_best(solved(own, "own"), k, "query_row"), "first")
    floors = first.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
    floored = queries.join(floors, "row", "left").select("row", "vec_id", "dim", "cell", "raw", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    again = _blocks(floored, cells.select("dim", "cell", "parts"), scratch, "floored")

    def visits(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim, own_cell = r["dim"], r["cell"]
                q = np.frombuffer(r["vecs"], "<i8").reshape(r["n"], dim) if dim else np.zeros((r["n"], 0), np.int64)
                rows, ids, floor = np.frombuffer(r["rows"], "<i8"), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["floors"], "<f8")
                norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                centres = pivots.get(dim, np.zeros((1, dim)))
                at, radius = summary[dim]
                most = q @ centres[at].T + norm[:, None] * radius[None, :]
                near = most * (1 + 1e-9 * np.sign(most)) + 1e-6 >= floor[:, None]
                near[:, at == own_cell] = False
                for j in np.flatnonzero(near.any(0)):
                    cell, need = int(at[j]), np.flatnonzero(near[:, j])
                    if len(need):
                        one = [dim, cell, len(need), rows[need].tobytes(), ids[need].tobytes(), q[need].astype("<i8").tobytes(), floor[need].tobytes()]
                        kinds = [pa.int32()] * 3 + [pa.binary()] * 4
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, kinds, strict=True)], ["dim", "cell", "n", "rows", "ids", "vecs", "floors"])

    with arrow_rows(spark, 8):
        abroad = scratch.write(again.mapInArrow(visits, BLOCKS), "visits")
    rest = solved(abroad, "abroad")
    best = _best(first.select("query_row", "query_id", "vec_id", "score").unionByName(rest), k, "query_row")
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.id, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.id <> d.id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
