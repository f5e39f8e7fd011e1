"""Archives as a data source: one zip is read by many tasks.

``spark.read.format("archive")`` plans from file sizes alone, as for Parquet: a zip is cut into ranges of
``split_bytes``, and a task reads the members whose local headers begin in its range, which the archive's own
directory tells.  The driver opens no archive and holds one line for each range.  A tar has no directory and is
compressed as a whole, so it is not splittable: one task reads it from front to back.

Columns: path, name, size, safe, content, error.  ``content`` is null for members whose names would leave a folder they
are extracted to and for those above ``max_member`` bytes, with the reason in ``error``, and with the option
``content=false``.  An archive that cannot be read is one row with an error; directories and links are no members, an
empty archive gives no rows, members of one name are rows of their own.

Filters ``name = ...`` and ``name in (...)`` reach the reader: other members are neither read nor unpacked.
"""

from __future__ import annotations

import glob
import io
import os
import tarfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .archives import is_safe

MEMBERS = "path string, name string, size long, safe boolean, content binary, error string"
SPLIT_BYTES = 128 * 2**20
MAX_MEMBER = 256_000_000


def _files_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path inside it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder, of one file, or of those that match a local pattern."""
    files, inner = _files_of(path)
    info = files.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.Directory:
        found = files.get_file_info(fs.FileSelector(inner, recursive=True))
        prefix = path[: len(path) - len(inner)] if "://" in path else ""
        return sorted((prefix + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    matches = sorted(glob.glob(inner)) if "://" not in path else []
    if not matches:
        raise FileNotFoundError(path)
    return [(m, os.path.getsize(m)) for m in matches if os.path.isfile(m)]


class _File(io.RawIOBase):
    """A file of pyarrow whose bad positions are OSErrors, as ``zipfile`` expects."""

    def __init__(self, file: pa.NativeFile):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        at = offset + (0, self.file.tell(), self.file.size())[whence]
        if at < 0:
            raise OSError(f"no position {at}")
        return self.file.seek(min(at, self.file.size()))

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, buffer) -> int:
        return self.file.readinto(buffer)


class Range(InputPartition):
    """The members of an archive whose headers begin in ``[start, stop)``."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = options["path"].split(",") if "path" in options else []
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.largest = int(options.get("max_member", MAX_MEMBER))
        self.content = options.get("content", "true").lower() == "true"
        self.names: frozenset[str] | None = None

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("name",):
                names = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.names = names if self.names is None else self.names & names
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for path, size in (f for p in self.paths for f in _listed(p)):
            step = max(size, 1) if ".tar" in path or path.endswith(".tgz") else self.split
            out += [Range(path, at, at + step) for at in range(0, max(size, 1), step)]
        return out

    def _row(self, path: str, name: str, size: int, opened) -> tuple:
        safe = is_safe(name)
        reason = "unsafe name" if not safe else f"above {self.largest} bytes" if size > self.largest else None
        return path, name, size, safe, opened() if self.content and not reason else None, reason

    def _wanted(self, name: str) -> bool:
        return self.names is None or name in self.names

    def _members(self, part: Range) -> Iterator[tuple]:
        files, inner = _files_of(part.path)
        with files.open_input_file(inner) as raw, io.BufferedReader(_File(raw), 2**20) as file:
            if zipfile.is_zipfile(file):
                with zipfile.ZipFile(file) as archive:
                    for m in archive.infolist():
                        if part.start <= m.header_offset < part.stop and not m.is_dir() and self._wanted(m.filename):
                            yield self._row(part.path, m.filename, m.file_size, lambda m=m: archive.read(m))
            elif part.start == 0:
                file.seek(0)
                with tarfile.open(fileobj=file, mode="r|*") as archive:
                    for m in archive:
                        if m.isfile() and self._wanted(m.name):
                            yield self._row(part.path, m.name, m.size, lambda m=m: archive.extractfile(m).read())

    def read(self, part: Range) -> Iterator[tuple]:
        try:
            yield from self._members(part)
        except (OSError, tarfile.TarError, zipfile.BadZipFile, EOFError) as error:
            if part.start == 0 and self.names is None:
                yield part.path, None, None, None, None, f"{type(error).__name__}: {error}"


class ArchiveSource(DataSource):
    """Options: path (files, folders or patterns, by commas), split_bytes, max_member, content."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("archive")`` known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)


def write_archives(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """(path, members): one zip for each partition of ``df``, below a folder that all executors share.

    Runs when the result does.  Every attempt writes under a name of its own, and only what the result lists counts, so
    a repeated task does no harm; rows with a null name are left out, null contents are empty members.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = _files_of(folder)
        files.create_dir(inner, recursive=True)
        path, members = f"part-{uuid.uuid4().hex}.zip", 0
        with files.open_output_stream(f"{inner}/{path}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for batch in batches:
                for n, c in zip(batch.column(0), batch.column(1), strict=True):
                    archive.writestr(n.as_py(), c.as_py() or b"")
                    members += 1
        yield pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{path}"], "members": [members]})

    rows = df.filter(F.col(name).isNotNull()).select(F.col(name).cast("string"), F.col(content).cast("binary"))
    return rows.mapInArrow(write, "path string, members long")
