"""Local documents: text, Markdown, DOCX and XLSX from binary files, PDF where a library is there."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from pathlib import PurePosixPath
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import chunking
from changelens.operators.pages import per_row

# Bounds of what is read.
MAX_BYTES, MAX_CHARS = 20 * 1024 * 1024, 2_000_000
ZIP_MEMBERS, ZIP_BYTES, ZIP_RATIO, SHEET_CELLS = 5_000, 50 * 1024 * 1024, 1_000, 100_000
PDF_MIN_CHARS = 20
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
OUT = "status string, error string, title string, text string, content_hash string, units array<struct<location:string,text:string>>, warnings array<string>"


class Refused(ValueError):
    """A file that is not read; the message is its code."""


def preflight(data: bytes) -> zipfile.ZipFile:
    """An office archive within bounds: members, expanded size, ratio, no encryption."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile as e:
        raise Refused("invalid_zip") from e
    infos = z.infolist()
    if len(infos) > ZIP_MEMBERS or sum(i.file_size for i in infos) > ZIP_BYTES:
        raise Refused("zip_too_large")
    if any(i.flag_bits & 1 for i in infos):
        raise Refused("encrypted")
    if any(i.file_size > ZIP_RATIO * max(1, i.compress_size) for i in infos):
        raise Refused("zip_ratio")
    return z


def _xml(z: zipfile.ZipFile, name: str):
    raw = z.read(name)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise Refused("xml_entities")
    return ElementTree.fromstring(raw)


def table_text(rows: list[list[str]]) -> str:
    clean = [[c.replace("|", "\\|").replace("\n", " ") for c in r] for r in rows]
    if not clean:
        return ""
    lines = ["| " + " | ".join(r) + " |" for r in clean]
    return "\n".join([lines[0], "| " + " | ".join("---" for _ in clean[0]) + " |", *lines[1:]])


def plain(data: bytes, stem: str, markdown: bool):
    try:
        text = chunking.normalize(data.decode("utf-8-sig"))
    except UnicodeDecodeError as e:
        raise Refused("encoding_not_utf8") from e
    if not text:
        raise Refused("empty_file")
    head = re.search(r"(?m)^# (.+)$", text) if markdown else None
    units = chunking.markdown_units(text) if markdown else [{"location": "text", "text": text}]
    return head[1].strip() if head else stem, text, units, []


def docx(data: bytes, stem: str):
    """Document order: headings make paths, list styles get marks, tables are Markdown."""
    z = preflight(data)
    if "word/document.xml" not in z.namelist():
        raise Refused("invalid_docx")
    body = _xml(z, "word/document.xml").find(f"{W}body")
    words = lambda p: "".join((x.text or "") if x.tag == f"{W}t" else "\n" if x.tag == f"{W}br" else "\t" for x in p.iter() if x.tag in (f"{W}t", f"{W}br", f"{W}tab"))
    lines, title = [], None
    for x in body if body is not None else ():
        if x.tag == f"{W}tbl":
            lines.append(table_text([["".join(words(p) for p in c.iter(f"{W}p")).strip() for c in r.findall(f"{W}tc")] for r in x.findall(f"{W}tr")]))
        elif x.tag == f"{W}p":
            text = words(x).strip()
            style = x.find(f"{W}pPr/{W}pStyle")
            name = (style.get(f"{W}val") if style is not None else "").replace(" ", "").lower()
            level = re.fullmatch(r"heading([1-6])", name)
            if not text:
                continue
            if name == "title" or level:
                title = title or text
            mark = "#" * int(level[1]) + " " if level else "1. " if name.startswith("listnumber") else "- " if name.startswith("list") else ""
            lines.append(mark + text)
    names = z.namelist()
    warnings = [w for w, hit in (("images_skipped", any(n.startswith("word/media/") for n in names)), ("headers_skipped", any(re.match(r"word/(header|footer)\d", n) for n in names)), ("floating_text_skipped", body is not None and any(e.tag.endswith("}txbxContent") for e in body.iter()))) if hit]
    text = "\n\n".join(lines)
    return title or stem, text, chunking.markdown_units(text), warnings


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(data: bytes, stem: str):
    """A Markdown table for each sheet's used range: cached values, formulas where there is none, merged ranges named."""
    z = preflight(data)
    names = z.namelist()
    if "xl/workbook.xml" not in names:
        raise Refused("invalid_xlsx")
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in _xml(z, "xl/sharedStrings.xml").findall(f"{S}si")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    units, warnings = [], []
    for sheet in _xml(z, "xl/workbook.xml").iter(f"{S}sheet"):
        target = targets.get(sheet.get(f"{R}id"), "")
        root = _xml(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
        cells: dict[tuple[int, int], str] = {}
        for row in root.iter(f"{S}row"):
            for c in row.findall(f"{S}c"):
                ref, kind = c.get("r") or "", c.get("t")
                v, f = c.find(f"{S}v"), c.find(f"{S}f")
                text = v.text if v is not None and v.text else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{S}t"))
                elif kind == "b" and text is not None:
                    text = "TRUE" if text == "1" else "FALSE"
                if text is None and f is not None:
                    warnings.append(f"formula_without_cached_value:{sheet.get('name')}!{ref}")
                    text = f"[公式: ={f.text or ''}]"
                if text:
                    cells[int(re.search(r"\d+$", ref)[0]) - 1, _column(ref)] = text
        if not cells:
            continue
        (r0, r1), (c0, c1) = ((min(k[d] for k in cells), max(k[d] for k in cells)) for d in (0, 1))
        if (r1 - r0 + 1) * (c1 - c0 + 1) > SHEET_CELLS:
            raise Refused("sheet_too_large")
        text = table_text([[cells.get((r, c), "") for c in range(c0, c1 + 1)] for r in range(r0, r1 + 1)])
        merged = [m.get("ref") for m in root.iter(f"{S}mergeCell")]
        if merged:
            text += "\n\nmerged: " + ", ".join(merged)
            warnings.append("merged_cells")
        units.append({"location": sheet.get("name"), "text": f"# Sheet: {sheet.get('name')}\n\n{text}"})
    if not units:
        warnings.append("workbook_has_no_data")
    return stem, "\n\n".join(u["text"] for u in units), units, sorted(set(warnings))


def pdf(data: bytes, stem: str):
    """A unit for each page with text; without a PDF library the type is unsupported."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise Refused("unsupported") from e
    pages = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
    units = [{"location": f"Page {k}", "text": f"# Page {k}\n\n{t}"} for k, t in enumerate(pages, 1) if t]
    if sum(len("".join(t.split())) for t in pages) < PDF_MIN_CHARS:
        raise Refused("scanned_or_no_text")
    return stem, "\n\n".join(u["text"] for u in units), units, []


READERS = {".txt": lambda d, s: plain(d, s, False), ".md": lambda d, s: plain(d, s, True), ".docx": docx, ".xlsx": xlsx, ".pdf": pdf}


def parse_file(path: str, data: bytes | None, max_bytes: int = MAX_BYTES, max_chars: int = MAX_CHARS) -> tuple:
    """(status, error, title, text, content_hash, units, warnings): parsed, failed, unsupported or scanned_or_no_text."""
    name = PurePosixPath(path)
    data = data or b""
    digest = hashlib.sha256(data).hexdigest()
    try:
        reader = READERS.get(name.suffix.lower())
        if reader is None:
            raise Refused("unsupported")
        if len(data) > max_bytes:
            raise Refused("file_too_large")
        if not data:
            raise Refused("empty_file")
        title, text, units, warnings = reader(data, name.stem)
        if not text.strip():
            raise Refused("scanned_or_no_text" if name.suffix.lower() == ".docx" else "empty_file")
        if len(text) > max_chars:
            raise Refused("text_too_long")
        return "parsed", None, title, text, digest, units, warnings
    except Refused as e:
        code = str(e)
        return code if code in ("unsupported", "scanned_or_no_text") else "failed", code, None, None, digest, [], []
    except (KeyError, ValueError, IndexError, TypeError, ElementTree.ParseError, zipfile.BadZipFile):
        return "failed", "invalid_file", None, None, digest, [], []


def read_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """path and the parsed form of each file under `path`; files over the bound are named without being loaded.

    Spark's file readers pass over files of no bytes, so those give no row; a file of white space is `empty_file`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("content", F.when(F.col("length") <= max_bytes, F.col("content")))
    out = per_row(files.withColumn("name", F.col("path")), ["path", "length"], ["name", "content"], parse_file, OUT)
    large = F.col("length") > max_bytes
    return out.withColumn("status", F.when(large, "failed").otherwise(F.col("status"))).withColumn("error", F.when(large, "file_too_large").otherwise(F.col("error")))


def knowledge_documents(parsed: DataFrame, document_id: str) -> DataFrame:
    """One document a unit: id `doc:unit:n`, title `parsed · location` within 300 characters."""
    u = parsed.where("status = 'parsed'").select("*", F.posexplode("units").alias("n", "u"))
    title = F.substring(F.concat_ws(" · ", "title", "u.location"), 1, 300)
    return u.select(F.concat_ws(":", F.col(document_id), F.lit("unit"), (F.col("n") + 1).cast("string")).alias("document_id"), title.alias("title"), F.col("u.text").alias("content"), "content_hash")


def evidence_documents(events: DataFrame, competitor: str) -> DataFrame:
    """One knowledge document for each confirmed evidence of an event."""
    e = events.select("event_id", F.col(competitor).alias("competitor_id"), F.explode("evidence").alias("e")).where("e.evidence_status = 'confirmed'")
    return e.select(F.concat_ws(":", "event_id", "e.evidence_id").alias("document_id"), "competitor_id", F.lit("evidence").alias("source_type"), F.col("e.relevant_excerpt").alias("content"), F.col("e.observed_at").alias("observed_at"))
