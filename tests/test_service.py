from pyspark.sql import functions as F

from changelens.operators import service as V


def test_labels(spark):
    df = spark.createDataFrame([(1, 2, "parsed", "completed"), (1, None, "parsing", None), (0, 3, "parsed", "ingesting"), (0, 0, "failed", None)], "n int, h int, p string, i string")
    got = [(r.s, r.d) for r in df.select(V.scan_summary(F.col("n"), F.col("h")).alias("s"), V.document_status(F.col("p"), F.col("i")).alias("d")).collect()]
    assert got == [("new_and_historical", "stored"), ("new", "in_progress"), ("historical", "in_progress"), ("none", "failed")]


def test_sources_and_overview(spark):
    s = spark.createDataFrame([("https://a.com/x", ["a.com"]), ("https://b.com/", ["a.com"]), ("https://c.com/", None)], "url string, official_domains array<string>")
    assert [r.credibility for r in V.confirm_sources(s).collect()] == ["official", "unverified", "unverified"]
    e = spark.createDataFrame([("w", "c1", "pending"), ("w", "c1", "confirmed"), ("w", "c2", "confirmed")], "workspace_id string, competitor string, status string")
    assert tuple(V.overview(e).first()) == ("w", 2, 1, 2)


def test_triage(spark):
    chunks = spark.createDataFrame([("own_product", "o1", [1.0, 0.0]), ("own_product", "o2", [0.0, 1.0]), ("competitor", "c1", [1.0, 1.0])], "domain string, chunk_id string, vector array<double>")
    ev = spark.createDataFrame([("e1", [1.0, 0.1])], "chunk_id string, vector array<double>")
    got = {(r.event, r.domain, r["rank"]): r.chunk_id for r in V.triage_context(ev, chunks, 1).collect()}
    assert got == {("e1", "own_product", 1): "o1", ("e1", "competitor", 1): "c1"}
    claims = spark.createDataFrame([("e1", 1, "k"), ("e1", 1, "m"), ("e1", 2, "k")], "event_id string, claim_no int, result_id string")
    cites = spark.createDataFrame([("k", "knowledge", "own_product"), ("m", "page", "competitor")], "result_id string, source string, domain string")
    assert [r.claim_no for r in V.triage_violations(claims, cites).collect()] == [2]


def test_damage_and_legacy(spark):
    st = spark.createDataFrame([("c", 1, "raw", "A  price here", "a price"), ("c", 2, "blocks", "A price", "a price"), ("c", 3, "content", "A pri ce", "a price"), ("d", 1, "raw", "x", "x")], "case string, seq int, stage string, text string, target string")
    assert {r["case"]: r.lost_at for r in V.damage(st, "case", "seq", "stage", "text", "target").collect()} == {"c": "content", "d": None}
    c = spark.createDataFrame([("u", "s1", 1), ("u", "s2", 2), ("u", "s3", 3)], "url string, snapshot_id string, captured_at int")
    assert V.legacy_watermark(c, spark.createDataFrame([("s2",), ("s1",)], "snapshot_id string")).first().processed == "s2"
