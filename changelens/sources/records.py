"""Line records, key/value namespaces, and the sinks that keep them: append-only, latest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens.operators.memory import latest, without_deleted
from changelens.sources.datasource import COUNTS, Conflict, register, store, versions


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a blank or broken line fails the job where a plain JSON read would pass over it."""
    rows = spark.read.text(path)
    bad = F.raise_error(F.lit("blank line"))
    checked = F.when(F.trim("value") == "", bad.cast("string")).otherwise(F.col("value"))
    return rows.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def items(records: DataFrame, namespace: str) -> DataFrame:
    """Current entries of a namespace in order of insertion: `records` is a log of ns, key, body, seq."""
    own = records.where(F.col("ns") == namespace)
    first = own.groupBy("key").agg(F.min("seq").alias("_first"))
    return latest(own, ["key"], ["seq"]).join(first, "key").orderBy("_first").drop("_first")


def get(records: DataFrame, namespace: str, key: str) -> DataFrame:
    """The current entry, or nothing."""
    return records.where((F.col("ns") == namespace) & (F.col("key") == key)).orderBy(F.desc("seq")).limit(1)


def put(rows: DataFrame, path: str) -> None:
    """Appends upserts (ns, key, body, seq) to the log; readers take the last of each key."""
    rows.write.mode("append").partitionBy("ns").parquet(path)


def save_snapshots(snapshots: DataFrame, path: str, buckets: int = 64) -> None:
    """Appends snapshots by a bucket of their URL; nothing is overwritten."""
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets))
    snapshots.withColumn("url_bucket", bucket).repartition(F.col("url_bucket")).write.mode("append").partitionBy("url_bucket").parquet(path)


def snapshot_names(snapshots: DataFrame, name: str) -> DataFrame:
    """Adds file_name: `name`, and for later ones of the same name a number behind it."""
    n = F.row_number().over(W.partitionBy(name).orderBy("captured_at", "snapshot_id")) - 1
    return snapshots.withColumn("file_name", F.when(n == 0, F.col(name)).otherwise(F.concat_ws("_", name, n.cast("string"))))


def compact(log: DataFrame, keys: list[str], order: list[str], deleted: str) -> DataFrame:
    """What a log of upserts and tombstones comes to."""
    return without_deleted(log, keys, order, deleted)


def reset_scope(records: DataFrame, scope: DataFrame, keys: list[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """(what stays, counts by kind of what goes) when all records of the scoped keys are deleted."""
    gone = records.join(scope.select(*keys).distinct(), keys, "left_semi")
    return records.join(scope.select(*keys).distinct(), keys, "left_anti"), gone.groupBy(kind).agg(F.count("*").alias("n"))


def write_results(cases: DataFrame, path: str) -> None:
    """Scored cases and the review queue as JSON lines; an existing folder is refused."""
    cases.write.mode("errorifexists").json(f"{path}/results")
    cases.where(F.size("review_reasons") > 0).write.mode("errorifexists").json(f"{path}/review_queue")


def merge_versioned(rows: DataFrame, path: str, keys: list[str], retries: int = 10) -> dict[str, int]:
    """Upserts rows into a versioned table as its next version; how many were inserted, updated, unchanged.

    The whole merge is made for one version and published only if that is still
    the latest; else it is made again for the newer one.  `rows` hold a key once.
    """
    spark = rows.sparkSession
    register(spark)
    table = lambda version: spark.read.format("versioned_table").option("path", path).option("version", version).load()
    rest = [c for c in rows.columns if c not in keys]
    for _ in range(retries + 1):
        system, root = store(path)
        version = (versions(system, root) or [0])[-1]
        writer = lambda df, v=version: df.write.format("versioned_table").option("path", path).option("expected", v)
        try:
            if not version:
                writer(rows).mode("overwrite").save()
                return {"inserted": rows.count(), "updated": 0, "unchanged": 0}
            now = table(version).select(*rows.columns)
            seen = now.select(*keys, F.struct(*rest).alias("_now"))
            plan = rows.join(seen, keys, "left").withColumn("outcome", F.when(F.col("_now").isNull(), "inserted").when(F.col("_now").eqNullSafe(F.struct(*rest)), "unchanged").otherwise("updated"))
            counts = {r["outcome"]: r["n"] for r in plan.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
            if set(counts) <= {"unchanged"}:
                return {k: counts.get(k, 0) for k in COUNTS}
            writer(now.join(rows.select(*keys), keys, "left_anti").unionByName(rows)).mode("overwrite").save()
            return {k: counts.get(k, 0) for k in COUNTS}
        except Exception as e:
            if "the write was made for" not in str(e):
                raise
    raise Conflict(f"{retries} other writers were faster")
