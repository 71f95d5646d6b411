"""Centroid clustering of quantised vectors by weighted deduplication.

Equal quantised vectors become one row with a multiplicity; Lloyd's rounds run
over these rows with sums of integers weighted by it, so that a vector that
fills a third of the table costs as much as one that occurs once.  Assignments
are then joined back to the ids.  Only centroids and their sums (a row a
cluster and dimension) reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.base import Scratch

CLUSTERS, ROUNDS, SCALE, DIM, SEED = 8, 10, 1024, 64, 3
#: Components must be smaller for squared distances to fit into 64 bits.
LARGEST = 1 << 27
SUM = "decimal(38,0)"


def _quantise(dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.columns
            right = np.array([x.is_valid and len(x) == dim for x in vecs]) if len(vecs) else np.zeros(0, bool)
            x = vecs.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
            real = np.isfinite(x).all(1)
            x = np.floor(scale * x[real])
            if np.abs(x).max(initial=0) >= LARGEST:
                raise ValueError(f"a component of {LARGEST} or more: squared distances don't fit into 64 bits")
            out = [v.tobytes() for v in x.astype("<i4")]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(right)).filter(pa.array(real)), pa.array(out, pa.binary())], ["vec_id", "vec"])

    return run


def quantised(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, vec (little-endian 32-bit floor(scale * x)) of vectors with `dim` components, none null or non-finite."""
    both = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return both.mapInArrow(_quantise(dim, scale), "vec_id long, vec binary")


def first_centroids(kept: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest hash of seed and id, in the order of the hashes; ids that are null come last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.select(order.alias("order"), "vec").orderBy(F.asc_nulls_last("order"), "vec").limit(k).collect()
    return np.array([np.frombuffer(r["vec"], "<i4") for r in rows], np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance, exactly; ties go to the smaller number."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    kind = np.float64 if 4 * x.shape[1] * largest * largest < 1 << 53 else np.int64  # doubles are exact below 2**53
    x, c = x.astype(kind), centroids.astype(kind)
    if kind is np.float64:
        square = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    else:
        square = np.stack([((x - one) ** 2).sum(1) for one in c], 1)
    at = square.argmin(1)
    return at.astype(np.int32), square[np.arange(len(x)), at].astype(np.int64)


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _sums(centroids: np.ndarray):
    """Weighted sums of a partition's vectors by cluster and component; component -1 is the weight."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), object)
        for batch in batches:
            x, weight = _vectors(batch.column(0), dim), batch.column(1).to_numpy()
            at, _ = nearest(x, centroids)
            one = np.zeros((k, dim + 1), np.int64)
            np.add.at(one, at, np.column_stack([x * weight[:, None], weight]))
            total += one
        some = [(c, i if i < dim else -1, Decimal(total[c, i])) for c in range(k) if total[c, dim] for i in range(dim + 1)]
        cols = list(zip(*some, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int32(), pa.decimal128(38, 0)), strict=True)], ["cluster", "at", "total"])

    return run


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, distance = nearest(_vectors(batch.column(0), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(distance)], ["vec", "weight", "cluster", "distance"])

    return run


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of the mean of their vectors; those without any stay."""
    sums = distinct.mapInArrow(_sums(centroids), f"cluster int, at int, total {SUM}").groupBy("cluster", "at").agg(F.sum("total").alias("total"))
    totals = {(r["cluster"], r["at"]): int(r["total"]) for r in sums.collect()}  # a row a cluster and component
    out = centroids.copy()
    for c in {c for c, _ in totals}:
        out[c] = [totals[c, i] // totals[c, -1] for i in range(centroids.shape[1])]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that is kept.

    Defined cases: vectors that are null, of another length, or hold null or
    non-finite components are left out; fewer vectors than clusters give as many
    centroids as vectors; rows that repeat an id or a vector count each; a null
    vec_id is kept, and starts no cluster while others can; ties go to the
    smaller number; components of 2**27 or more after scaling are an error,
    since their distances don't fit; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    kept = scratch.write(quantised(vectors, dim, scale), "kept")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    distinct = scratch.write(kept.groupBy("vec").agg(F.count("*").alias("weight")), "distinct")
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    assigned = scratch.write(distinct.mapInArrow(_assign(centroids), "vec binary, weight long, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")).alias("total"))
    inertia = {r["cluster"]: int(r["total"]) for r in sums.collect()}  # a row a cluster
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = [(c, n, sum(inertia.values()), digest[c]) for c, n in sorted(inertia.items())]
    of = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = kept.join(assigned.select("vec", "cluster", "distance"), "vec").drop("vec")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Each round as two steps over (vector, component, value) rows."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"x AS MATERIALIZED (SELECT row, unnest(v) AS x, unnest(range({DIM})) AS i FROM kept)",
        f"""c0 AS MATERIALIZED (
  SELECT c, unnest(v) AS x, unnest(range({DIM})) AS i
  FROM (SELECT v, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS c FROM kept) WHERE c < {CLUSTERS})""",
    ]
    for n in range(ROUNDS + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT row, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT row, c, CAST(sum((x.x - k.x) * (x.x - k.x)) AS BIGINT) AS d FROM x JOIN c{n} k USING (i) GROUP BY row, c) GROUP BY row)"""
        )
        if n < ROUNDS:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (
  SELECT k.c, k.i, coalesce(m.x, k.x) AS x
  FROM c{n} k LEFT JOIN (
    SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS x FROM (SELECT a.c, i, sum(x) AS s, count(*) AS n FROM x JOIN a{n} a USING (row) GROUP BY a.c, i)) m
  ON m.c = k.c AND m.i = k.i)"""
            )
    last = ROUNDS
    return f"""WITH {", ".join(parts)},
digest AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS "cluster", d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a{last} USING (row) JOIN digest USING (c)"""


ORACLE = _oracle()
