"""Pages to blocks, links, quality and differences: one Arrow pass a page where the parser is needed."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.functions import chunking, diffing, markup
from changelens.functions.text import has_placeholder, visible_chars

BLOCK = "struct<seq:int,type:string,level:int,text:string,has_content:boolean,json:string>"
PARSED = f"title string, content string, block_hash string, signals array<string>, blocks array<{BLOCK}>"
LINK = "array<struct<anchor_text:string,href:string,aria_label:string,title:string,page_region:string,is_download:boolean>>"


#: Rows of a batch that are worked on at once: what a page becomes takes many times its bytes.
SLICE = 128


def per_row(df: DataFrame, keys: list[str], inputs: list[str], function, schema: str) -> DataFrame:
    """Adds columns by a function of text columns; `schema` names the fields of the tuples it returns."""
    kept = [df.schema[k] for k in keys]
    out = T.StructType(kept + T._parse_datatype_string(schema).fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType(out.fields[len(keys) :]))

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(a, SLICE) for a in range(0, max(1, whole.num_rows), SLICE)):
                cols = [c.to_pylist() for c in batch.columns[len(keys) :]]
                rows = [function(*r) for r in zip(*cols, strict=True)]
                made = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], [*keys, *arrow.names])

    return df.select(*keys, *inputs).mapInArrow(run, out)


def _parsed(html: str | None):
    title, content, blocks = markup.extract(html or "")
    rows = []
    for k, b in enumerate(blocks):
        text = b.get("text") if "text" in b else markup.serialize([b])
        rows.append({"seq": k, "type": b["type"], "level": b.get("level"), "text": text, "has_content": markup.has_content(b), "json": markup.canonical(b)})
    import hashlib

    whole = "[" + ",".join(r["json"] for r in rows) + "]"
    return title, content, hashlib.sha256(whole.encode()).hexdigest(), markup.signals(html or ""), rows


def parse_pages(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, title, content, block_hash, signals, blocks of each page; a null page is empty."""
    return per_row(pages, keys, [html], _parsed, PARSED)


def typed_blocks(pages: DataFrame, keys: list[str], kind: str, html: str = "html") -> DataFrame:
    """keys, json: one row a block of one type, and nothing else of the page."""
    run = lambda h: ([markup.canonical(b) for b in markup.blocks_of(h or "") if b["type"] == kind],)
    return per_row(pages, keys, [html], run, "json array<string>").select(*keys, F.explode("json").alias("json"))


def page_diff(pairs: DataFrame, keys: list[str], previous: str, current: str) -> DataFrame:
    """changes (JSON) and n_changes of two columns of pages, each parsed where it is compared; a null page is empty."""

    def run(a, b):
        got = diffing.contextual(*[markup.blocks_of(x or "") for x in (a, b)])
        return markup.canonical(got), len(got)

    return per_row(pairs, keys, [previous, current], run, "changes string, n_changes int")


def row_changes(pairs: DataFrame, keys: list[str], previous: str, current: str) -> DataFrame:
    """keys, change, row_key, changed_cells: one row a changed row of a table that both of a pair's pages have, nothing else of their differences; a null page is empty."""
    fields = ("change", "row_key", "changed_cells")
    schema = "change string, row_key string, changed_cells array<struct<column:string,previous:string,current:string>>"
    out = T.StructType([pairs.schema[k] for k in keys] + T._parse_datatype_string(schema).fields)
    cell = pa.struct([(name, pa.string()) for name in ("column", "previous", "current")])
    types = (pa.string(), pa.string(), pa.list_(cell))

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(a, SLICE) for a in range(0, whole.num_rows, SLICE)):
                sides = zip(*(c.to_pylist() for c in batch.columns[len(keys) :]), strict=True)
                found = [(k, r) for k, (a, b) in enumerate(sides) for r in diffing.row_changes(*[markup.blocks_of(x or "") for x in (a, b)])]
                at = pa.array([k for k, _ in found], pa.int32())
                made = [pa.array([r[f] for _, r in found], kind) for f, kind in zip(fields, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(keys)]), *made], [*keys, *fields])

    return pairs.select(*keys, previous, current).mapInArrow(run, out)


def page_links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row a link with its place on the page and the region it stands in."""
    found = per_row(pages, keys, [html], lambda h: (markup.page_links(h or ""),), f"links {LINK}")
    return found.select(*keys, F.posexplode("links").alias("pos", "l")).select(*keys, "pos", "l.*")


def block_metrics(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Visible characters, blocks, valid blocks, a count for each type, the first 20 headings."""
    of = lambda t: F.size(F.filter("blocks", lambda b: b["type"] == t)).cast("long").alias(f"n_{t}")
    heads = F.slice(F.transform(F.filter("blocks", lambda b: b["type"] == "heading"), lambda b: b["text"]), 1, 20)
    return parsed.select(
        *keys, visible_chars(F.col("content")).alias("chars"), F.size("blocks").cast("long").alias("n_blocks"),
        F.size(F.filter("blocks", lambda b: b["has_content"])).cast("long").alias("n_valid"), *[of(t) for t in ("heading", "paragraph", "list", "table", "code", "group")], heads.alias("headings"),
    )


def quality_gate(rows: DataFrame, content: str, n_blocks: str) -> DataFrame:
    """Adds quality, struct(status, reasons): nothing there fails, a short placeholder fails, sparse content warns, the rest passes."""
    rows = rows.withColumn("_chars", visible_chars(F.col(content))).withColumn("_waits", has_placeholder(F.col(content)))  # once each
    chars, n = F.col("_chars"), F.col(n_blocks)
    empty, placeholder, sparse = (chars == 0) | (n == 0), F.col("_waits") & (chars <= 200) & (n <= 5), (chars < 120) & (n < 3)
    reasons = F.array(F.when(chars == 0, "empty_content"), F.when(n == 0, "no_valid_blocks"), F.when(~empty & placeholder, "dynamic_placeholder"), F.when(~empty & ~placeholder & sparse, "sparse_content"))
    status = F.when(empty | placeholder, "FAIL").when(sparse, "WARNING").otherwise("PASS")
    return rows.withColumn("quality", F.struct(status.alias("status"), F.filter(reasons, lambda x: x.isNotNull()).alias("reasons"))).drop("_chars", "_waits")


def acquisition(static_error: Column, static_quality: Column, signals: Column) -> Column:
    """Why a page has to be rendered; NULL if the static page will do."""
    return (
        F.when(static_error.isin("timeout", "request_failed", "http_error"), "static_acquisition_error")
        .when(static_error.isNull() & (static_quality != "PASS"), "static_quality_gate")
        .when(static_error.isNull() & (F.size(signals) > 0), "interactive_structure")
    )


def chunk(documents: DataFrame, keys: list[str], text: str = "text", title: str | None = None, limit: int = chunking.DEFAULT_CHARS) -> DataFrame:
    """One row a chunk; a document that can't be cut gives none."""
    fields = "chunks array<struct<chunk_index:int,start:int,end:int,heading_path:array<string>,table_context:string,content:string>>"

    def run(body, name):
        try:
            return (chunking.chunks(body, name or "", limit),)
        except chunking.ChunkError:
            return ([],)

    df = documents.withColumn("_title", F.col(title) if title else F.lit(""))
    return per_row(df, keys, [text, "_title"], run, fields).select(*keys, F.explode("chunks").alias("c")).select(*keys, "c.*")


def statement_units(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit_no, text, context) of parsed pages, every unit of each."""

    def run(blocks):
        return ([{"unit_no": k, "text": t, "context": c} for k, (t, c) in enumerate(chunking.statement_units([json.loads(b) for b in blocks or ()]))],)

    df = parsed.withColumn("_json", F.transform("blocks", lambda b: b["json"]))
    out = per_row(df, keys, ["_json"], run, "units array<struct<unit_no:int,text:string,context:string>>")
    return out.select(*keys, F.explode("units").alias("u")).select(*keys, "u.*")


def content_diff(pairs: DataFrame, keys: list[str], previous: str, current: str, whole: bool = False) -> DataFrame:
    """Unified line difference of each pair, in three lines of context or the whole text; rows that are equal should be filtered before."""
    return per_row(pairs, keys, [previous, current], lambda a, b: (diffing.unified(a or "", b or "", whole),), "diff string")


def block_diff(pairs: DataFrame, keys: list[str], previous: str, current: str) -> DataFrame:
    """changes (JSON) and n_changes of two columns of block JSON lists; NULL where a side is missing."""

    def run(a, b):
        got = diffing.contextual(*[None if x is None else [json.loads(y) for y in x] for x in (a, b)])
        return (None, None) if got is None else (markup.canonical(got), len(got))

    return per_row(pairs, keys, [previous, current], run, "changes string, n_changes int")


def state_diff(pairs: DataFrame, keys: list[str], previous: str, current: str) -> DataFrame:
    """Changes of modified states: plain blocks and cards by title."""
    run = lambda a, b: (markup.canonical(diffing.state_blocks(*[[json.loads(y) for y in x or ()] for x in (a, b)])),)
    return per_row(pairs, keys, [previous, current], run, "changes string")


def change_diff(pairs: DataFrame, keys: list[str], changed: str, texts: tuple[str, str], blocks: tuple[str, str]) -> DataFrame:
    """keys, diff, changes, n_changes of each pair: differences where `changed` is TRUE, NULL where it is FALSE or NULL.

    Sides of pairs that haven't changed are not handed to the parser's process.
    """
    open_ = F.coalesce(F.col(changed), F.lit(False))
    sides = [F.when(open_, F.col(c)).alias(name) for c, name in zip((*texts, *blocks), ("_a", "_b", "_c", "_d"), strict=True)]

    def run(a, b, c, d):
        if a is None and b is None:
            return None, None, None
        got = diffing.contextual(*[None if x is None else [json.loads(y) for y in x] for x in (c, d)])
        return diffing.unified(a or "", b or ""), None if got is None else markup.canonical(got), None if got is None else len(got)

    return per_row(pairs.select(*keys, *sides), keys, ["_a", "_b", "_c", "_d"], run, "diff string, changes string, n_changes int")


def discovery_read(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """keys, status, reasons, title, headings, links of each page; what a page says and leads to is NULL unless it passes the quality gate."""
    parsed = parse_pages(pages, keys, html)
    heads = F.transform(F.filter("blocks", lambda b: b["type"] == "heading"), lambda b: b["text"])
    valid = F.size(F.filter("blocks", lambda b: b["has_content"]))
    gated = quality_gate(parsed.withColumn("_n", valid), "content", "_n")
    links = per_row(pages, keys, [html], lambda h: (markup.page_links(h or ""),), f"links {LINK}")
    passes = F.col("quality.status") == "PASS"
    said = [F.when(passes, x).alias(name) for name, x in (("title", F.col("title")), ("headings", heads), ("links", F.col("links")))]
    return gated.join(links, keys).select(*keys, F.col("quality.status").alias("status"), F.array_join("quality.reasons", ",").alias("reasons"), *said)
