"""Line deduplication by distinct-site spread.

Every line hash gets HyperLogLog sketches of the sites and of the texts that
hold it, built and merged by aggregation.  Lines whose estimates clear the
threshold are cross-site boilerplate, lines that fall short are not, and those
near it are counted exactly.  Nothing else decides: a footer of forty lines
under one line of text goes like one line under forty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.base import Scratch

#: Sites, and different texts, that a line must be found in; sketch size (2**k registers).
MIN_SITES, LOG_K = 5, 10
ADDED = ("n_lines", "n_cut")


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, scratch: Scratch, min_sites: int, site: str, lg_k: int = LOG_K) -> DataFrame:
    """line (hash) of each non-blank line in at least `min_sites` sites and as many different texts."""
    text = F.col("text").cast("string")
    held = F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), _hash))
    lines = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.xxhash64(text).alias("content"), F.explode(held).alias("line"))
    kinds = {"sites": "site", "texts": "content"}
    spread = lines.groupBy("line").agg(*[F.hll_sketch_agg(c, lg_k).alias(k) for k, c in kinds.items()])
    spread = spread.select("line", *[F.hll_sketch_estimate(k).alias(k) for k in kinds])
    slack = 4 * 1.04 / 2 ** (lg_k / 2)
    low, high = max(1.0, min_sites * (1 - slack)) - 0.5, min_sites * (1 + slack) + 0.5
    found = scratch.write(spread.where((F.col("sites") >= low) & (F.col("texts") >= low)), "spread")
    sure = (F.col("sites") > high) & (F.col("texts") > high)
    near = scratch.write(found.where(~sure).select("line"), "near")
    held = scratch.write(lines.join(near, "line").select("line", *kinds.values()), "held")
    exact = None
    for kind, c in kinds.items():
        counted = held.select("line", c).distinct().groupBy("line").agg(F.count("*").alias(kind))
        exact = counted if exact is None else exact.join(counted, "line")
    exact = exact.where((F.col("sites") >= min_sites) & (F.col("texts") >= min_sites)).select("line")
    return scratch.write(found.where(sure).select("line").unionByName(exact), "boilerplate")


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """`docs` with such lines cut from `text`, and n_lines, n_cut (lines before, lines cut) added.

    Defined cases: a null text stays null with no lines; blank lines are never
    cut; a null site counts as one site; copies of a text count as one text,
    so a document copied everywhere isn't boilerplate, but the common lines of
    copies with edits are, once five of them lie on five sites (drop such copies
    first where they matter); a text of such lines alone becomes empty; repeated rows are cut alike; columns called n_lines or
    n_cut are replaced and all others kept as they are; an empty table gives an
    empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    common = boilerplate(docs, scratch, min_sites, site)
    text = F.col("text").cast("string")
    held = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("key"), F.explode(F.array_distinct(F.transform(F.split(text, "\n"), _hash))).alias("line")).distinct()
    cut = held.join(common, "line").groupBy("key").agg(F.collect_set("line").alias("cut"))  # at most the lines of one text
    cut = scratch.write(cut, "cut")
    kept = [c for c in docs.columns if c.lower() not in ADDED]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), text.alias("body"), F.xxhash64(text).alias("key"))
    # `cut` grows with the documents, so both sides are shuffled at any size
    joined = keyed.join(cut.hint("merge"), "key", "left").withColumn("lines", F.split("body", "\n"))
    is_cut = lambda x: (F.trim(x) != "") & F.array_contains(F.col("cut"), _hash(x))
    joined = joined.withColumn("gone", F.when(F.col("cut").isNotNull(), F.size(F.filter("lines", is_cut))).otherwise(0))
    rest = F.when(F.col("gone") > 0, F.array_join(F.filter("lines", lambda x: ~is_cut(x)), "\n")).otherwise(F.col("body"))
    return joined.select(
        *[rest.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in kept],
        F.when(F.col("body").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.col("gone").cast("long").alias("n_cut"),
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, coalesce(source, '') AS site, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT DISTINCT site, text, line FROM (SELECT site, text, trim(unnest(ls), ' ') AS line FROM d) WHERE line <> ''),
b AS (SELECT line FROM l GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES} AND count(DISTINCT text) >= {MIN_SITES}),
p AS (
  SELECT rid, x, i, trim(x, ' ') IN (SELECT line FROM b) AS cut
  FROM (SELECT rid, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS i FROM d WHERE text IS NOT NULL)),
s AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (cut) AS n_cut, string_agg(x, chr(10) ORDER BY i) FILTER (NOT cut) AS kept
  FROM p GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_cut, 0) AS BIGINT) AS n_cut,
       md5(CASE WHEN n_cut > 0 THEN coalesce(kept, '') ELSE text END) AS kept_md5
FROM d LEFT JOIN s USING (rid)
"""
