"""Archives and backups: members of tar and zip files as rows, safe extraction, stamped copies of folders.

Archives are read on the executors, one task for each file, member by member; what is written goes to a folder that
the caller names and all executors share.
"""

from __future__ import annotations

import os
import posixpath
import re
import shutil
import tarfile
import zipfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKER = "_COMPLETE"
MAX_MEMBER = 256_000_000


def is_safe(name: str) -> bool:
    """Whether a member's path stays below the folder it is extracted to."""
    return bool(name) and not name.startswith(("/", "\\")) and not re.match("^[A-Za-z]:", name) and ".." not in re.split(r"[/\\]", name)


def _members(path: str) -> Iterator[tuple[str, int, object]]:
    """(name, size, a function that opens the member) of the plain files of an archive, in its order; links are no files."""
    if zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield info.filename, info.file_size, lambda info=info: archive.open(info)
    else:
        with tarfile.open(path, "r|*") as archive:  # a stream: read once from front to back
            for info in archive:
                if info.isfile():
                    yield info.name, info.size, lambda info=info: archive.extractfile(info)


def archive_members(paths: DataFrame, column: str = "path", content: bool = False, wanted: list[str] | None = None) -> DataFrame:
    """(path, name, size, safe, content, error) of the members of every archive that the executors can open by path.

    With ``wanted``, only members with one of these base names, and reading stops when all were found.  ``content`` is
    null unless asked for, and for unsafe members and those above MAX_MEMBER bytes.  An archive that cannot be read is
    one row with an error.
    """
    names = set(wanted) if wanted is not None else None

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                left = set(names) if names is not None else None
                try:
                    for name, size, opened in _members(path):
                        base = posixpath.basename(name)
                        if left is not None and base not in names:
                            continue
                        safe = is_safe(name)
                        data = opened().read() if content and safe and size <= MAX_MEMBER else None
                        yield pd.DataFrame({"path": [path], "name": [name], "size": [size], "safe": [safe], "content": [data], "error": [None]})
                        if left is not None:
                            left.discard(base)
                            if not left:
                                break
                except (OSError, tarfile.TarError, zipfile.BadZipFile, EOFError) as error:
                    yield pd.DataFrame({"path": [path], "name": [None], "size": [None], "safe": [None], "content": [None], "error": [str(error)]})

    ddl = "path string, name string, size long, safe boolean, content binary, error string"
    return paths.select(F.col(column).cast("string").alias("path")).filter("path is not null").mapInPandas(rows, ddl)


def extract(spark: SparkSession, archive: str, target: str, wanted: list[str] | None = None) -> DataFrame:
    """(name, size) of the members that were extracted below ``target``; of ``wanted`` base names all must be there.

    Members whose path would leave the folder make the whole archive fail before anything is written.  A marker file is
    written last; a folder with one is not extracted again.
    """
    listing = [(n, s) for n, s, _ in _members(archive)]
    bad = [n for n, _ in listing if not is_safe(n)]
    if bad:
        raise ValueError(f"members leave the folder: {bad[:5]}")
    names = set(wanted) if wanted is not None else None
    missing = sorted((names or set()) - {posixpath.basename(n) for n, _ in listing})
    if missing:
        raise FileNotFoundError(f"not in the archive: {missing[:5]}")
    chosen = [(n, s) for n, s in listing if names is None or posixpath.basename(n) in names]
    if not os.path.exists(os.path.join(target, MARKER)):
        os.makedirs(target, exist_ok=True)
        keep = {n for n, _ in chosen}
        for name, _, opened in _members(archive):
            if name in keep:
                place = os.path.join(target, *name.split("/"))
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with opened() as source, open(place, "wb") as sink:
                    shutil.copyfileobj(source, sink)
        open(os.path.join(target, MARKER), "w").close()
    return spark.createDataFrame(chosen, "name string, size long")


def data_root(listing: DataFrame, holds: str, name: str = "name") -> str | None:
    """The shortest folder that directly holds an entry called ``holds``; None without one."""
    parents = listing.select(F.regexp_extract(name, f"^(.*?)/?(?:^|(?<=/)){re.escape(holds)}(?:/.*)?$", 1).alias("root"), F.col(name).rlike(f"(^|/){re.escape(holds)}(/|$)").alias("has")).filter("has")
    found = parents.agg(F.min(F.struct(F.length("root").alias("n"), F.col("root"))).alias("it")).first().it
    return found.root if found else None


def backup(source: str, into: str, moment: datetime | None = None) -> str:
    """Copy a folder to a new one below ``into`` that is named by the time; returns its path."""
    target = os.path.join(into, (moment or datetime.now()).strftime("backup_%Y%m%d_%H%M%S"))
    shutil.copytree(source, target)
    return target


def restore_latest(into: str, target: str) -> str:
    """Copy the newest backup (the greatest name) below ``into`` over ``target``; returns the backup's path."""
    names = sorted(n for n in os.listdir(into) if n.startswith("backup_") and os.path.isdir(os.path.join(into, n)))
    if not names:
        raise FileNotFoundError(f"no backup in {into}")
    shutil.copytree(os.path.join(into, names[-1]), target, dirs_exist_ok=True)
    return os.path.join(into, names[-1])
