"""Two Spark data sources: local documents of five formats, and a keyed table with atomic versions.

    register(spark)
    spark.read.format("document_files").option("path", folder).load()
    rows.write.format("versioned_table").option("path", folder).option("keys", "id").mode("append").save()

Paths are local or of any store that pyarrow reaches by its URI.  Planning and
commits see names, sizes and manifests only; file contents and rows stay in tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from changelens.sources.files import MAX_BYTES, READERS, parse_file

FILE_ROWS = "path string, format string, length long, status string, error string, title string, content_hash string, unit int, location string, text string, warnings array<string>"
PARTITION_BYTES = 64 * 1024 * 1024
#: What opening a file costs, in bytes read meanwhile.
OPEN_BYTES = 64 * 1024


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


# --- documents ---


@dataclass
class Files(InputPartition):
    files: list


class DocumentFiles(DataSource):
    """A row for each unit of each file under `path`; a file that isn't parsed gives one row with its status.

    Options: path; maxBytes of a file (a larger one is named, not read);
    partitionBytes, the size that a task's files come to.  Filters on path
    (=, in, prefix) and format (=, in) choose files before any is opened.
    """

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return FILE_ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return DocumentReader(self.options, [f.name for f in schema.fields])


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.max_bytes, self.part_bytes = int(options.get("maxbytes", MAX_BYTES)), int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (the API's name)
        for f in filters:
            on = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo | In) and on in ("path", "format") or isinstance(f, StringStartsWith) and on == "path":
                self.wanted.append(f)
            else:
                yield f

    def chosen(self, path: str) -> bool:
        have = {"path": path, "format": kind_of(path)}

        def fits(f: Filter) -> bool:
            value = have[f.attribute[0]]
            return value.startswith(f.value) if isinstance(f, StringStartsWith) else value in f.value if isinstance(f, In) else value == f.value

        return all(map(fits, self.wanted))

    def partitions(self) -> list[InputPartition]:
        """Files in order of their paths, dealt into runs of about `partitionBytes`."""
        system, root = store(self.path)
        found = sorted((i.path, i.size or 0) for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and not PurePosixPath(i.path).name.startswith((".", "_")))
        out: list[InputPartition] = []
        run, size = [], 0
        for path, length in found:
            if not self.chosen(path):
                continue
            cost = OPEN_BYTES + (length if length <= self.max_bytes else 0)
            if run and size + cost > self.part_bytes:
                out.append(Files(run))
                run, size = [], 0
            run.append((path, length))
            size += cost
        return [*out, Files(run)] if run else out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = store(self.path)
        for path, length in partition.files:
            data = None
            if length <= self.max_bytes:
                with system.open_input_stream(path) as f:
                    data = f.read()
            one = parse_file(path, data or b"", self.max_bytes) if data is not None else ("failed", "file_too_large", None, None, None, [], [])
            status, error, title, _, digest, units, warnings = one
            head = {"path": path, "format": kind_of(path), "length": length, "status": status, "error": error, "title": title, "content_hash": digest, "warnings": warnings}
            for k, u in enumerate(units or [{"location": None, "text": None}], 1):
                row = head | {"unit": k if units else None, "location": u["location"], "text": u["text"]}
                yield tuple(row[c] for c in self.columns)


def kind_of(path: str) -> str:
    suffix = PurePosixPath(path).suffix.lower()
    return suffix[1:] if suffix in READERS else "other"


# --- a table in versions ---

MANIFEST = "_versions"
COUNTS = ("inserted", "updated", "unchanged")


class Conflict(RuntimeError):
    """Another writer has taken the version, and every retry met another one."""


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    rows: int


def versions(system: fs.FileSystem, root: str) -> list[int]:
    found = system.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}", allow_not_found=True))
    return sorted(int(PurePosixPath(i.path).stem) for i in found if i.path.endswith(".json"))


def manifest(system: fs.FileSystem, root: str, version: int) -> dict:
    if not version:
        return {"version": 0, "files": []}
    with system.open_input_stream(f"{root}/{MANIFEST}/{version:012d}.json") as f:
        return json.loads(f.read())


def publish(root_uri: str, version: int, body: dict) -> bool:
    """Creates a version's manifest if nobody has; the folder entry appears whole or not at all.

    Local stores link a finished file to its name, which fails if the name is
    there.  Other stores need a create that refuses to replace, which pyarrow
    doesn't offer, so they are refused.
    """
    import os

    system, root = store(root_uri)
    if not isinstance(system, fs.LocalFileSystem):
        raise NotImplementedError("exclusive creation needs a local or mounted store")
    os.makedirs(f"{root}/{MANIFEST}", exist_ok=True)
    draft = f"{root}/{MANIFEST}/.{uuid.uuid4().hex}"
    with open(draft, "w") as f:
        json.dump(body, f)
        f.flush()
        os.fsync(f.fileno())
    try:
        os.link(draft, f"{root}/{MANIFEST}/{version:012d}.json")
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)


class VersionedTable(DataSource):
    """Rows in Parquet files that a version's manifest names; what no manifest names does not exist.

    Options: path; version to read (the latest if not given); retries of a commit.
    A write appends one version, or with mode overwrite replaces the table in
    one; readers see all of it or nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "versioned_table"

    def schema(self) -> StructType:
        system, root = store(self.options["path"])
        known = versions(system, root)
        if not known:
            raise FileNotFoundError(f"no version under {root}")
        return StructType.fromJson(json.loads(manifest(system, root, int(self.options.get("version", known[-1])))["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return VersionReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> VersionWriter:
        return VersionWriter(self.options, schema, overwrite)


class VersionReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.version, self.columns = options["path"], options.get("version"), [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        system, root = store(self.path)
        version = int(self.version) if self.version else (versions(system, root) or [0])[-1]
        files = manifest(system, root, version)["files"]
        return [Files([f]) for f in files] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, root = store(self.path)
        for name in partition.files:
            with system.open_input_file(f"{root}/{name}") as f:
                yield from pq.ParquetFile(f).iter_batches(columns=self.columns)


class VersionWriter(DataSourceArrowWriter):
    """Each task writes one file of its own; the driver's commit publishes the next version with all of them.

    If another writer has published that number first, an append reads the new
    latest and tries the number after it; an overwrite that was planned on an
    older version is refused, as is one whose option `expected` names another.
    Files of a failed job are deleted.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.overwrite, self.retries = options["path"], overwrite, int(options.get("retries", 20))
        self.schema = json.dumps(schema.jsonValue())
        system, root = store(self.path)
        base = (versions(system, root) or [0])[-1]
        self.base = int(options.get("expected", base))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = store(self.path)
        system.create_dir(f"{root}/data", recursive=True)
        name, out, rows = f"data/{uuid.uuid4().hex}.parquet", None, 0
        try:
            for batch in iterator:
                if out is None:
                    out = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=system)
                out.write_batch(batch)
                rows += batch.num_rows
        except BaseException:
            if out is not None:
                out.close()
                system.delete_file(f"{root}/{name}")
            raise
        if out is not None:
            out.close()
        return Written(name if out is not None else None, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        files = [m.file for m in messages if m and m.file]
        for _ in range(self.retries + 1):
            latest = (versions(system, root) or [0])[-1]
            if self.overwrite and latest != self.base:
                self.abort(messages)
                raise Conflict(f"version {latest} is there, the write was made for {self.base}")
            before = [] if self.overwrite else manifest(system, root, latest)["files"]
            body = {"version": latest + 1, "schema": self.schema, "files": [*before, *files], "rows": sum(m.rows for m in messages if m)}
            if publish(self.path, latest + 1, body):
                return
        self.abort(messages)
        raise Conflict(f"no free version after {self.retries} retries")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = store(self.path)
        for m in messages:
            if m and m.file:
                system.delete_file(f"{root}/{m.file}")


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session, with pushdown of filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DocumentFiles)
    spark.dataSource.register(VersionedTable)
