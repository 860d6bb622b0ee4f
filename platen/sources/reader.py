"""PDF files as DataFrames: one row per document, page, character, vector, image or annotation.

Files come through Spark's binaryFile reader, so any path that Spark reads will do, and are decoded in Python tasks, one
file at a time, page by page. ``kinds`` that are not asked for are not built; ``decode_kinds`` builds several in one pass.
Problems stay with their page: its ``error`` or ``annots_error`` names them, and what could be decoded comes all the same.
A document's row has the error that kept it from being opened; in a pass with its pages, theirs too.
"""

from __future__ import annotations

import fnmatch
import os
import re
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from .. import schema
from .pdf.document import ALL, BROKEN, Document

SCHEMAS = {"documents": schema.DOCUMENTS, "pages": schema.PAGES, "chars": schema.CHARS, "vectors": schema.VECTORS, "images": schema.IMAGES, "annots": schema.ANNOTS}
#: Rows of an Arrow batch that a file's rows are cut into.
ROWS = 20_000
#: Bytes and files that one partition of the data source reads.
PART_BYTES, PART_FILES = 64 << 20, 512


def decode_file(doc_id: int, path: str, data: bytes, kinds: tuple, pages: set[int] | None = None, password: str = "", unicode_norm: str | None = None, failfast: bool = False, arrays: bool = False) -> Iterator[tuple[str, dict]]:
    """(kind, row) of the kinds asked for of one file, page by page; the document's own row comes last. With ``arrays``
    characters come as ``Glyphs``, many in one."""
    count, metadata, problems, error = 0, [], [], None
    try:
        made = Document(data, password, unicode_norm, arrays)
        count = len(made.pages)
        if "documents" in kinds:
            metadata = list(made.metadata().items())
        run = tuple(k for k in ALL if k in kinds or k == "annots" and "pages" in kinds)
        if run:
            seq = 0
            for page, objects in made.run(run, pages):
                found = [f"page {page['page_number']}: {page[k]}" for k in ("error", "annots_error") if page[k]]
                problems += found
                if failfast and found:
                    raise ValueError("; ".join(found))
                if "pages" in kinds:
                    yield "pages", {"doc_id": doc_id} | page
                for kind in run:
                    if arrays and kind == "chars":
                        yield from ((kind, g) for g in objects[kind])
                    elif kind in kinds:
                        for seq, r in enumerate(objects[kind]):
                            yield kind, {"doc_id": doc_id, "seq": seq} | r
        problems += made.problems
    except BROKEN as e:
        if failfast:
            raise
        error = {"name": getattr(e, "name", "FormatError"), "message": str(e)}
    if "documents" in kinds:
        if error is None and problems:
            error = {"name": "PageError", "message": "; ".join(problems)}
        yield "documents", {"doc_id": doc_id, "path": path, "page_count": count, "metadata": metadata, "error": error}


def decode_kinds(files: DataFrame, kinds: tuple = tuple(SCHEMAS), pages: list[int] | None = None, password: str = "", unicode_norm: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Rows of all kinds asked for from (doc_id, path, content), in one pass over the files: ``kind``, and a column of
    that name that holds the row."""
    wanted, failfast = None if pages is None else set(pages), mode.upper() == "FAILFAST"
    shape = ", ".join(["kind string", *(f"{k} struct<{_fields(SCHEMAS[k])}>" for k in kinds)])
    to = to_arrow_schema(_parse_datatype_string(shape))

    def run(batches):
        waiting = []
        for batch in batches:
            for doc_id, path, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for kind, row in decode_file(doc_id, path, content or b"", kinds, wanted, password, unicode_norm, failfast):
                    waiting.append({"kind": kind, kind: row})
                    if len(waiting) == ROWS:
                        yield pa.RecordBatch.from_pylist(waiting, schema=to)
                        waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=to)

    return files.select("doc_id", "path", "content").mapInArrow(run, shape)


def decode_arrays(files: DataFrame, f: Callable[[Iterator[tuple[str, dict]]], tuple | None], schema: str, kinds: tuple = ("pages", "chars"), pages: list[int] | None = None, password: str = "", unicode_norm: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """A row for each file: its doc_id and what ``f`` makes from its (kind, row) pairs, unless that is None. Characters come
    as ``Glyphs``: they are decoded and used in one task, and no row for a character is made."""
    wanted, failfast = None if pages is None else set(pages), mode.upper() == "FAILFAST"
    to = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, path, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (made := f(decode_file(doc_id, path, content or b"", kinds, wanted, password, unicode_norm, failfast, True))) is not None:
                    out.append((doc_id, *made))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*out), to)], schema=to)

    return files.select("doc_id", "path", "content").mapInArrow(run, schema)


def _fields(columns: str) -> str:
    """The columns of a schema as the fields of a struct."""
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in _parse_datatype_string(columns))


def of_kind(made: DataFrame, kind: str) -> DataFrame:
    return made.filter(F.col("kind") == kind).select(f"{kind}.*")


def decode(files: DataFrame, kind: str, pages: list[int] | None = None, password: str = "", unicode_norm: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Rows of one kind from (doc_id, path, content)."""
    return of_kind(decode_kinds(files, (kind,), pages, password, unicode_norm, mode), kind)


def doc_id_of(path: str) -> int:
    """The 64-bit hash of a path that xxhash64() gives in Spark."""
    n = xxhash.xxh64_intdigest(path.encode(), seed=42)
    return n - (1 << 64) if n >> 63 else n


def files(spark: SparkSession, path: str | list[str], max_bytes: int | None = None) -> DataFrame:
    """(doc_id, path, content) of files; doc_id is a hash of the path, so it needs no order of files."""
    df = spark.read.format("binaryFile").load(path)
    if max_bytes is not None:
        df = df.filter(F.col("length") <= max_bytes)
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def from_bytes(spark: SparkSession, contents: dict[int, bytes]) -> DataFrame:
    return spark.createDataFrame([(k, f"memory:{k}", bytearray(v)) for k, v in contents.items()], "doc_id long, path string, content binary")


def fetch(spark: SparkSession, urls: list[str], timeout: float = 60) -> DataFrame:
    """Files by HTTP, fetched in tasks."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(content=[_get(url, timeout) for url in pdf["path"]])

    listed = spark.createDataFrame([(u,) for u in urls], "path string").repartition(max(1, len(urls)))
    return listed.select(F.xxhash64("path").alias("doc_id"), "path").mapInPandas(run, "doc_id long, path string, content binary")


def _get(url: str, timeout: float) -> bytes:
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:
            if answer.status != 200:
                raise OSError(f"Failed to fetch PDF: {answer.status} {answer.reason}")
            return answer.read()
    except urllib.error.HTTPError as e:
        raise OSError(f"Failed to fetch PDF: {e.code} {e.reason}") from e


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the .pdf files below a folder, or of those that a pattern names, in order; paths as
    Spark's binaryFile writes them."""
    if ":/" in path:
        where, root = fs.FileSystem.from_uri(path)
        prefix = path[: path.index(":") + 1] if path.startswith("file:") else path[: len(path) - len(root)]
    else:
        where, root, prefix = fs.LocalFileSystem(), os.path.abspath(path), "file:"
    if where.get_file_info(root).type == fs.FileType.File:
        found = [where.get_file_info(root)]
    else:
        base = re.split(r"[*?\[]", root, maxsplit=1)[0] if re.search(r"[*?\[]", root) else root
        base = base if base == root else base.rpartition("/")[0]
        found = [i for i in where.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True)) if i.type == fs.FileType.File]
        found = [i for i in found if (fnmatch.fnmatch(i.path, root) if base != root else i.path.lower().endswith(".pdf"))]
    return sorted((prefix + i.path, i.size or 0) for i in found)


class PdfReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.kind, self.schema, self.pages = options, options.get("kind", "chars"), schema, None
        if options.get("pages"):
            self.pages = {int(x) for x in options["pages"].split(",")}

    def pushFilters(self, filters):
        """Filters on page_number choose the pages that are decoded; Spark applies all filters again."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("page_number",):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.pages = values if self.pages is None else self.pages & values
            yield f

    def partitions(self):
        """Runs of files of about PART_BYTES in all."""
        parts, size = [], PART_BYTES
        for path, n in list_files(self.options["path"]):
            if size + n > PART_BYTES or len(parts[-1].paths) >= PART_FILES:
                parts.append(_Files([]))
                size = 0
            parts[-1].paths.append(path)
            size += n
        return parts

    def read(self, partition):
        to = to_arrow_schema(self.schema)
        failfast, waiting = self.options.get("mode", "").upper() == "FAILFAST", []
        for path in partition.paths:
            where, name = (fs.LocalFileSystem(), path[5:]) if path.startswith("file:") else fs.FileSystem.from_uri(path)
            with where.open_input_stream(name) as f:
                data = f.read()
            for _, row in decode_file(doc_id_of(path), path, data, (self.kind,), self.pages, self.options.get("password", ""), self.options.get("unicode_norm"), failfast):
                waiting.append(row)
                if len(waiting) == ROWS:
                    yield pa.RecordBatch.from_pylist(waiting, schema=to)
                    waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=to)


class PdfDataSource(DataSource):
    """spark.read.format("pdf").option("kind", ...).load(path), for paths that every executor can open."""

    @classmethod
    def name(cls):
        return "pdf"

    def schema(self):
        return SCHEMAS[self.options.get("kind", "chars")]

    def reader(self, schema):
        return PdfReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfDataSource)
