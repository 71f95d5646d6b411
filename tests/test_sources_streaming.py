import io
import zipfile

import pytest

from changelens.sources import files, records
from changelens.streaming import models, state

DOC = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{}</w:body></w:document>'
PAR = '<w:p><w:pPr><w:pStyle w:val="{}"/></w:pPr><w:r><w:t>{}</w:t></w:r></w:p>'


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_rels", ".rels") if "/" not in name else name, body)
    return out.getvalue()


def docx():
    body = PAR.format("Heading1", "Top") + PAR.format("ListBullet", "item") + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return zipped(**{"word/document.xml": DOC.format(body), "word/media/x.png": "x"})


def xlsx():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    return zipped(**{
        "xl/workbook.xml": f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/worksheets/s.xml": f'<worksheet {main}><sheetData><row><c r="B2" t="inlineStr"><is><t>h</t></is></c><c r="C2"><v>5</v></c></row><row><c r="C3"><f>SUM(A1)</f></c></row></sheetData><mergeCells><mergeCell ref="B2:B3"/></mergeCells></worksheet>',
    })


def test_files_of_every_kind(spark, tmp_path):
    made = {
        "a.txt": b"\xef\xbb\xbfhello", "b.md": b"# Title\n\ntext", "c.docx": docx(), "d.xlsx": xlsx(), "e.txt": b" \n", "f.txt": b"\xff\xfe\x00bad\xff", "g.bin": b"x",
        "h.docx": b"not a zip", "i.docx": zipped(**{"other.xml": "<a/>"}), "j.pdf": b"%PDF-1.4",
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].text == "hello" and got["a.txt"].title == "a" and got["b.md"].title == "Title"
    assert got["c.docx"].text == "# Top\n\n- item\n\n| a | b |\n| --- | --- |" and got["c.docx"].warnings == ["images_skipped"]
    assert "| h | 5 |" in got["d.xlsx"].text and "[公式: =SUM(A1)]" in got["d.xlsx"].text and got["d.xlsx"].warnings == ["formula_without_cached_value:S!C3", "merged_cells"]
    codes = {k: (got[k].status, got[k].error) for k in ("e.txt", "f.txt", "g.bin", "h.docx", "i.docx")}
    assert codes == {"e.txt": ("failed", "empty_file"), "f.txt": ("failed", "encoding_not_utf8"), "g.bin": ("unsupported", "unsupported"), "h.docx": ("failed", "invalid_zip"), "i.docx": ("failed", "invalid_docx")}
    small = {r.path.rsplit("/", 1)[1]: r.error for r in files.read_files(spark, str(tmp_path), max_bytes=3).collect()}
    assert small["b.md"] == "file_too_large"


def test_zip_bounds():
    bomb = io.BytesIO()
    with zipfile.ZipFile(bomb, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", b"\0" * 20_000_000)
    assert files.parse_file("x.docx", bomb.getvalue())[1] == "zip_ratio"


def test_jsonl_blank_line_fails(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in records.read_jsonl(spark, str(tmp_path / "ok.jsonl"), "a int").collect()] == [1, 2]
    with pytest.raises(Exception, match="blank line"):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()


def test_log_is_latest_wins(spark, tmp_path):
    log = str(tmp_path / "log")
    records.put(spark.createDataFrame([("n", "b", "1", 1), ("n", "a", "2", 2)], "ns string, key string, body string, seq int"), log)
    records.put(spark.createDataFrame([("n", "b", "3", 3)], "ns string, key string, body string, seq int"), log)
    df = spark.read.parquet(log)
    assert [(r.key, r.body) for r in records.items(df, "n").collect()] == [("b", "3"), ("a", "2")]
    assert records.get(df, "n", "b").first().body == "3" and records.get(df, "n", "zz").count() == 0


WATERMARK = "url string, scan_id string, previous string, observed string, processed string, advanced boolean"


def scans(spark):
    return [("u", 1, "s1", "p1", "ok", None), ("u", 2, "s2", "p2", None, None), ("u", 3, "s3", "p3", "ok", "p1"), ("u", 4, "s4", "p0", "ok", "p1"), ("v", 1, "t1", "q1", None, None)]


def test_watermark_waits_for_an_outcome(spark):
    df = spark.createDataFrame(scans(spark), "url string, seq int, scan_id string, snapshot_id string, outcome string, base string")
    got = {r.scan_id: (r.previous, r.processed, r.advanced) for r in state.in_batch(df, ["url"], ["seq"], state.comparison_watermark, WATERMARK).collect()}
    assert got == {"s1": (None, "p1", True), "s2": ("p1", "p1", False), "s3": ("p1", "p3", True), "s4": ("p3", "p3", False), "t1": (None, None, False)}


def test_lifecycles():
    def trace(step, actions, **more):
        s: dict = {}
        return [step(s, {"seq": k, "token": "a", "request_id": "r"} | more | a)["state"] for k, a in enumerate(actions)]

    do = lambda *names: [{"action": n} for n in names]
    assert trace(state.statement_lifecycle, do("register", "failed", "processed", "failed")) == ["pending", "pending", "processed", "processed"]
    assert trace(state.claim, do("complete", "claim", "fail", "claim", "retry", "complete", "retry")) == ["not_started", "running", "failed", "failed", "running", "completed", "completed"]
    assert trace(state.claim, [{"action": "claim"}, {"action": "claim", "token": "b"}]) == ["running", "failed"]
    assert trace(state.claim, [{"action": "retry"}, {"action": "retry", "token": "b"}, {"action": "complete"}]) == ["running", "running", "running"]
    assert trace(state.follow_up, do("ask", "ask", "complete", "ask")) == ["running", "running", "completed", "completed"]
    s: dict = {}
    assert [state.backfill_origin(s, {"seq": k, "first_scan": True}, quota=2)["origin"] for k in range(3)] == ["historical_backfill", "historical_backfill", "skipped"]


def test_idempotent_batches():
    done, wrote = set(), []
    run = state.idempotent_batches(wrote.append, done.__contains__, done.add)
    run("a", 0), run("a", 0), run("b", 1)
    assert wrote == ["a", "b"]


def test_models(spark):
    cols = "evidence_status string, detection_path string, source_credibility string, comparison_status string, previous_state string, current_state string, n_diff int"
    df = spark.createDataFrame([("confirmed", "state_comparison", "official", "comparable", "a", "b", 1), ("confirmed", "state_comparison", "official", "baseline", None, None, 0)], cols)
    got = models.detect(df, lambda prompt, p: {"decision": "event", "was": p["previous_state"]}).orderBy("comparison_status").collect()
    assert [(r.gate_decision, r.model_decision, r.model_calls) for r in got] == [("no_event", None, 0), (None, '{"decision": "event", "was": "a"}', 1)]
    e = spark.createDataFrame([(1, 1, "x/"), (1, 2, "x"), (1, 3, "z")], "case int, seq int, url string")
    a = spark.createDataFrame([(1, "x"), (1, "x/")], "case int, url string")
    kind = lambda p, q: "exact" if p == q else "equivalent" if p.rstrip("/") == q.rstrip("/") else "unmatched"
    got = {r.expected: (r.actual, r.kind) for r in models.greedy_match(e, a, "case", kind).collect()}
    assert got == {"x/": ("x/", "exact"), "x": ("x", "exact"), "z": (None, "unmatched")}
