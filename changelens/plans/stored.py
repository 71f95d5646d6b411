"""Registered queries that write tables and files and read them back: document files, and a table in versions."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from changelens.functions import text as T
from changelens.operators import memory as M
from changelens.operators import research as RS
from changelens.plans.catalog import query, t
from changelens.session import shared_folder
from changelens.sources import records
from changelens.sources.datasource import register
from changelens.sources.export import write_documents


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/stored/{name}-{uuid.uuid4().hex[:12]}"


def _one_line(text: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@query(r"""WITH d AS (
  SELECT doc_id, ['txt', 'md', 'docx', 'xlsx'][1 + doc_id % 4] AS format, CASE WHEN doc_id % 4 = 0 THEN text ELSE regexp_replace(text, '[#|]', '', 'g') END AS body FROM documents),
l AS (SELECT *, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ls FROM d),
x AS (
  SELECT doc_id, format, CASE format WHEN 'md' THEN 'Document ' || doc_id WHEN 'xlsx' THEN 'Text' ELSE 'text' END AS location,
    CASE format WHEN 'txt' THEN body WHEN 'docx' THEN array_to_string(ls, ' ') WHEN 'md' THEN '# Document ' || doc_id || ' ' || body
      ELSE '# Sheet: Text | ' || ls[1] || ' | | --- |' || coalesce(array_to_string(list_transform(ls[2:], lambda y: ' | ' || y || ' |'), ''), '') END AS text
  FROM l)
SELECT doc_id, format, 'parsed' AS status, 1 AS unit, location, md5(trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS digest FROM x""")
def q_document_files(spark, sf):
    """Every document as a file of one of four formats, read back through the data source: a row a unit."""
    d, folder = t(spark, sf, "documents"), _folder(spark, "files")
    kind = F.element_at(F.array(*map(F.lit, ("txt", "md", "docx", "xlsx"))), (F.col("doc_id") % 4 + 1).cast("int"))
    body = F.when(F.col("doc_id") % 4 == 0, F.col("text")).otherwise(F.regexp_replace("text", "[#|]", ""))
    write_documents(d.select(F.col("doc_id").alias("name"), kind.alias("format"), F.concat(F.lit("Document "), "doc_id").alias("title"), body.alias("text")), folder).count()
    register(spark)
    got = spark.read.format("document_files").option("path", folder).load()
    return got.select(F.regexp_extract("path", r"([0-9]+)\.[a-z]+$", 1).cast("long").alias("doc_id"), "format", "status", "unit", "location", F.md5(_one_line(F.col("text")).cast("binary")).alias("digest"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'P' ELSE o_orderstatus END AS status, 3 AS version,
  (SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 1) FROM orders) AS inserted,
  (SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 AND o_orderstatus <> 'P') FROM orders) AS updated,
  (SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND NOT (o_orderkey % 5 = 0 AND o_orderstatus <> 'P')) FROM orders) AS unchanged
FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, o_orderstatus, 3, (SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 1) FROM orders),
  (SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 = 0 AND o_orderstatus <> 'P') FROM orders),
  (SELECT count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 AND NOT (o_orderkey % 5 = 0 AND o_orderstatus <> 'P')) FROM orders)
FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0""")
def q_versioned_upsert(spark, sf):
    """Even orders are stored in two appends, then those divisible by three are merged, every fifth with another status: three versions."""
    o, path = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), _folder(spark, "orders")
    register(spark)
    for part in (0, 2):
        o.where((F.col("o_orderkey") % 4 == part)).write.format("versioned_table").option("path", path).mode("append").save()
    late = o.where("o_orderkey % 3 = 0").withColumn("status", F.when(F.col("o_orderkey") % 5 == 0, "P").otherwise(F.col("status")))
    counts = records.merge_versioned(late, path, ["o_orderkey"])
    now = spark.read.format("versioned_table").option("path", path).option("version", 3).load()
    return now.select("o_orderkey", "status", F.lit(3).alias("version"), *[F.lit(counts[k]).cast("long").alias(k) for k in ("inserted", "updated", "unchanged")])


# --- records ---


@query("SELECT event_id, event_type, value, props FROM events")
def q_json_lines(spark, sf):
    """Events as lines of JSON, read back line by line."""
    path = _folder(spark, "lines")
    t(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type", "value", "props")).alias("value")).write.text(path)
    return records.read_jsonl(spark, path, "event_id long, event_type string, value double, props string")


def _log(spark, sf, name: str):
    """A log of a namespace for each type of event and a key for each user, written and read back."""
    path = _folder(spark, name)
    e = t(spark, sf, "events").select(F.col("event_type").alias("ns"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("body"), F.col("event_id").alias("seq"))
    records.put(e, path)
    return spark.read.schema(e.schema).parquet(path)


@query("""SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS body, row_number() OVER (ORDER BY min(event_id)) AS place FROM events WHERE event_type = 'click' GROUP BY user_id""")
def q_namespace_items(spark, sf):
    """Current entries of a namespace, in the order in which their keys came."""
    log = _log(spark, sf, "items")
    first = log.where("ns = 'click'").groupBy("key").agg(F.min("seq").alias("first"))
    place = F.row_number().over(Window.orderBy("first"))  # a row a user
    return records.items(log, "click").select("key", "body").join(first.select("key", place.cast("long").alias("place")), "key")


@query("""SELECT CAST(user_id AS VARCHAR) AS key, arg_max(props, event_id) AS body, max(event_id) AS seq FROM events WHERE event_type = 'view' AND user_id = (SELECT min(user_id) FROM events WHERE event_type = 'view') GROUP BY user_id""")
def q_namespace_get(spark, sf):
    log = _log(spark, sf, "get")
    least = log.where("ns = 'view'").agg(F.min(F.col("key").cast("long")).cast("string")).first()[0]
    return records.get(log, "view", least).select("key", "body", "seq")


@query("""SELECT user_id, event_type, event_id, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, props ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""")
def q_deleted_records(spark, sf):
    """Latest rows of each key, without the keys whose latest row deletes them."""
    log = t(spark, sf, "events").withColumn("gone", F.col("event_type") == "error")
    return records.compact(log, ["user_id", "props"], ["ts", "event_id"], "gone").select("user_id", "event_type", "event_id", "props")


@query("""SELECT event_type AS kind, count(*) AS n FROM events WHERE user_id % 3 = 1 GROUP BY event_type UNION ALL SELECT 'left', count(*) FROM events WHERE user_id % 3 <> 1""")
def q_scope_reset(spark, sf):
    """What a reset of every third user's scope deletes, by kind, and how much it leaves."""
    e = t(spark, sf, "events")
    left, gone = records.reset_scope(e, e.where("user_id % 3 = 1").select("user_id"), ["user_id"], "event_type")
    return gone.withColumnRenamed("event_type", "kind").unionByName(left.agg(F.lit("left").alias("kind"), F.count("*").alias("n")))


# --- single rules ---


@query(r"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN substr(text, 5, 30) || 'zz' ELSE translate(substr(text, 5, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS anchor FROM documents),
f AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g'), ' ') AS body, trim(regexp_replace(lower(anchor), '\s+', ' ', 'g'), ' ') AS anchor FROM d)
SELECT doc_id, contains(body, anchor) AS held FROM f""")
def q_folded_anchors(spark, sf):
    anchor = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring("text", 5, 30), F.lit("zz"))).otherwise(F.translate(F.substring("text", 5, 30), string.ascii_lowercase, string.ascii_uppercase))
    return t(spark, sf, "documents").select("doc_id", T.contains_folded(F.col("text"), anchor).alias("held"))


@query("SELECT doc_id, regexp_matches(text, '(?i)https?://|www\\.') AS written FROM documents")
def q_written_urls(spark, sf):
    return t(spark, sf, "documents").select("doc_id", RS.has_generated_url(F.col("text")).alias("written"))


_MEMORY = "SELECT vec_id AS memory_id, embedding, CASE WHEN label % 2 = 0 THEN 'workspace' ELSE 'event' END AS scope, 's' || label % 4 AS scope_id, CASE WHEN vec_id % 5 = 0 THEN 'pending' ELSE 'confirmed' END AS status, vec_id % 7 > 0 AS active FROM embeddings"
_ASKED = [((5 * k) % 13 - 6) / 6 for k in range(64)]


@query(f"""WITH m AS ({_MEMORY}) SELECT memory_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_ASKED}::DOUBLE[]), 6) AS score FROM m
WHERE scope = 'workspace' AND scope_id = 's2' AND status = 'confirmed' AND active ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_ASKED}::DOUBLE[]) DESC, memory_id LIMIT 50""")
def q_memory_search(spark, sf):
    """The fifty eligible records of one scope that are nearest to a vector."""
    e = t(spark, sf, "embeddings")
    m = e.select(
        F.col("vec_id").alias("memory_id"), "embedding", F.when(F.col("label") % 2 == 0, "workspace").otherwise("event").alias("scope"), F.concat(F.lit("s"), (F.col("label") % 4).cast("string")).alias("scope_id"),
        F.when(F.col("vec_id") % 5 == 0, "pending").otherwise("confirmed").alias("status"), (F.col("vec_id") % 7 > 0).alias("active"), F.col("vec_id").alias("updated_at"),
    )
    return M.search(m, _ASKED, 50, "workspace", "s2", "embedding").select("memory_id", F.round("score", 6).alias("score"))
