"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which a source's
budget ends is the only one refined, by the next bits of the hash, until a
single hash value is left.  Documents under the threshold are then taken by a
filter; nothing is sorted by size or hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from changelens.llm.base import WORD, Scratch

WEIGHTS = (3.0, 1.0, 2.0)
HASH_BITS, BUCKET_BITS = 60, 12


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and a 60-bit hash of the id."""
    digest = F.md5(F.concat_ws("|", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    )


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """`sources` with its position by code point, null last, from per-partition counts rather than one sorted task."""
    rows = scratch.write(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn("_at", F.monotonically_increasing_id()), "sources"
    )
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    counts = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    rows = rows.withColumn("_part", part).join(counts, "_part")
    return rows.withColumn("position", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def targets(sources: DataFrame, weights, share: float, cap: float, scratch: Scratch) -> DataFrame:
    """source, source_size, target: weighted shares of `share` times all sizes, filled up to `cap` times each source's size."""
    place = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    rows = scratch.write(ranked(sources, scratch).withColumn("w", place).withColumn("cap", F.col("source_size") * cap), "weights")
    level = 0.0
    while True:  # the water level only rises; a round without a newly capped source ends it
        full = F.col("cap") <= F.lit(level) * F.col("w")
        total, capped, free = rows.agg(
            F.sum("source_size"), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))
        ).first()
        following = (share * (total or 0) - (capped or 0.0)) / free if free else level
        if following <= level:
            break
        level = following
    return rows.select("source", "source_size", F.least(F.col("cap"), F.col("w") * level).alias("target"))


def thresholds(items: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    """For each source the hash `below` which its documents get one more copy, so that these sizes come nearest to `rest`.

    State of a source: `low`, where the open bucket begins, and `before`, what lies under it.
    """
    state = scratch.write(plan.select("source", "rest", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before")), "state")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    for shift in range(HASH_BITS - BUCKET_BITS, -1, -BUCKET_BITS):
        a, s = items.alias("a"), state.alias("s")
        within = F.shiftright("a.h", shift + BUCKET_BITS) == F.shiftright("s.low", shift + BUCKET_BITS)
        buckets = (
            a.join(s, F.col("a.source").eqNullSafe(F.col("s.source")) & within & F.col("a.size").isNotNull())
            .groupBy("a.source", F.shiftright("a.h", shift).alias("bucket"))
            .agg(F.sum("a.size").alias("tokens"), F.first("s.rest").alias("rest"), F.first("s.before").alias("start"))
        )
        over = W.partitionBy("source").orderBy("bucket")
        buckets = buckets.withColumn("upto", F.col("start") + F.sum("tokens").over(over))
        opened = buckets.where("upto >= rest").groupBy("source").agg(
            F.min(F.struct("bucket", (F.col("upto") - F.col("tokens")).alias("before"), "upto")).alias("at")
        )
        opened = opened.select(
            "source", (F.col("at.bucket") * F.lit(1 << shift)).alias("low"), F.col("at.before").alias("before"), F.col("at.upto").alias("upto")
        )
        state = scratch.write(
            plan.alias("p").join(opened.alias("o"), F.col("p.source").eqNullSafe(F.col("o.source")), "left").select(
                "p.source", "p.rest", "o.low", "o.before", "o.upto"
            ),
            "state",
        )
    nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("before"))
    return state.select(
        "source",
        F.when(F.col("low").isNull(), F.when(F.col("rest") > 0, 1 << HASH_BITS).otherwise(0))
        .when(nearer, F.col("low") + 1)
        .otherwise(F.col("low"))
        .alias("below"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of `docs`.

    Whole copies come first: floor(target / source_size) for every document of
    the source; what is left goes to documents by hash threshold.  No document
    has more than ceil(cap) copies.

    Defined cases: null or empty text has size 0 and takes nothing; a null
    source is a source of its own, last in order; repeated rows share a hash
    and are taken together; an empty table gives an empty result; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    items = scratch.write(sized(docs), "sized")
    sources = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sources, weights, share, cap, scratch)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = scratch.write(plan, "plan")
    below = thresholds(items, plan, scratch)
    t = scratch.write(
        plan.alias("p").join(below.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source"))).select("p.*", "b.below"), "thresholds"
    ).alias("t")
    copies = F.col("t.whole") + F.when(F.col("i.h") < F.col("t.below"), 1).otherwise(0)
    return items.alias("i").join(t, F.col("i.source").eqNullSafe(F.col("t.source"))).select(
        "i.doc_id", "i.source", "i.size", "t.source_size", "t.target", copies.alias("copies"), (F.col("i.size") * copies).alias("taken")
    )


def apply_mix(docs: DataFrame, **settings) -> DataFrame:
    """`docs` as mixed: each row as many times as it has copies, the columns unchanged.

    Copies depend on source and id alone, so rows that share an id in two
    sources have each their own, and repeated rows are each copied alike.
    """
    got = mix(docs, **settings).select("doc_id", "source", "copies").distinct().where("copies > 0")
    d, g = docs.alias("d"), got.alias("g")
    joined = d.join(g, F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("d.source").eqNullSafe(F.col("g.source")))
    copied = joined.select(F.struct("d.*").alias("d"), F.explode(F.sequence(F.lit(1), F.col("g.copies").cast("int"))))
    return copied.select("d.*")


ORACLE = r"""
WITH items AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w
  FROM items GROUP BY source),
ratio AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS r FROM src),
steps AS (
  SELECT r, sum(cap) OVER (ORDER BY r) AS capped, sum(w) OVER () - sum(w) OVER (ORDER BY r) AS free,
         1.5::DOUBLE * sum(source_size) OVER () AS pool FROM ratio),
levels AS (
  SELECT max(lv) AS lv FROM (
    SELECT (pool - capped) / free AS lv, r FROM steps WHERE free > 0 AND (pool - capped) / free >= r
    UNION ALL SELECT max(pool) / (SELECT sum(w) FROM src), 0 FROM steps)),
plan AS (
  SELECT source, source_size, least(cap, w * lv) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, w * lv) / source_size) ELSE 0 END::BIGINT AS whole
  FROM ratio, levels),
run AS (
  SELECT i.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         CAST(sum(i.size) OVER (PARTITION BY i.source ORDER BY i.h) AS BIGINT) AS upto,
         CAST(sum(i.size) OVER (PARTITION BY i.source, i.h) AS BIGINT) AS own
  FROM items i JOIN plan p ON i.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       CAST(size * (whole + CASE WHEN rest > 0 AND (upto < rest OR (upto - own < rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM run
"""
