"""Shared helpers: tables, scratch files in the shared checkpoint folder, graph components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts of this package define a word break.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='changelens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _forget(spark: SparkSession, root: str) -> None:
    """Deletes a folder when the driver ends; a session that has ended before leaves it."""
    with contextlib.suppress(Exception):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Intermediate tables as Parquet in the shared folder: lineage ends there and a lost executor costs nothing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/changelens/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        atexit.register(_forget, spark, self.root)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        gc.collect()  # shuffle files of a finished step go once nothing refers to it
        self.spark._jvm.System.gc()
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def label_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the fold that decides which labels may be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def bounded_labels(labels: DataFrame, label: str, allowed: Column, limit: int) -> DataFrame:
    """(doc_id, label) of about `limit` labelled documents at most, chosen by hash; ties in a document's labels by majority."""
    rows = labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    n = rows.count()
    if n > limit:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * limit / n))
    return rows


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a long, b long): (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps until nothing moves; each round
    is written to the shared folder.  Stars pass through minima only, so rows
    stay within the number of edges.
    """
    edges = scratch.write(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(edges)
    while True:
        # large star: each node links its larger neighbours to its smallest neighbour (or itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written first: a join of two scans can be split at a hub, one that shares a stage with its aggregate can't
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, gone = scratch.write(large, "large"), least
        # small star: each node links its smaller neighbours, and itself, to the smallest of them
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = scratch.write(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(edges, large, gone, least)
        edges, after = small, mark(small)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
