"""Documents as files of four formats, written by tasks: what `document_files` reads back."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.sources.datasource import store
from changelens.sources.files import W as WORD
from changelens.sources.files import R as RELATIONS
from changelens.sources.files import S as SHEET

#: Characters that XML can't hold.
UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
WRITTEN = "path string, length long"


def _lines(text: str) -> list[str]:
    return [x for x in (line.strip() for line in UNWRITABLE.sub("", text).split("\n")) if x]


def _zip(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def txt(title: str, text: str) -> bytes:
    return text.encode()


def md(title: str, text: str) -> bytes:
    return f"# {title}\n\n{text}".encode()


def docx(title: str, text: str) -> bytes:
    """A paragraph for each line."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in _lines(text))
    return _zip(**{"word/document.xml": f'<w:document xmlns:w="{WORD[1:-1]}"><w:body>{body}</w:body></w:document>'})


def xlsx(title: str, text: str) -> bytes:
    """A sheet named Text with a row for each line."""
    rows = "".join(f'<row r="{k}"><c r="A{k}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c></row>' for k, x in enumerate(_lines(text), 1))
    return _zip(
        **{
            "xl/workbook.xml": f'<workbook xmlns="{SHEET[1:-1]}" xmlns:r="{RELATIONS[1:-1]}"><sheets><sheet name="Text" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/text.xml"/></Relationships>',
            "xl/worksheets/text.xml": f'<worksheet xmlns="{SHEET[1:-1]}"><sheetData>{rows}</sheetData></worksheet>',
        }
    )


WRITERS = {"txt": txt, "md": md, "docx": docx, "xlsx": xlsx}


def write_documents(rows: DataFrame, folder: str) -> DataFrame:
    """Writes `name`.`format` for each row (name, format, title, text); path and length of each file.

    A file that is written again by a repeated task has the same bytes.  A null
    text is an empty one; a format that isn't known fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = store(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                path, data = f"{root}/{r['name']}.{r['format']}", WRITERS[r["format"]](r["title"] or "", r["text"] or "")
                with system.open_output_stream(path) as f:
                    f.write(data)
                done.append((path, len(data)))
            paths, sizes = zip(*done, strict=True) if done else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])

    return rows.select(*[F.col(c).cast("string").alias(c) for c in ("name", "format", "title", "text")]).mapInArrow(run, WRITTEN)
