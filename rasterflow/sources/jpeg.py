"""The ``jpeg`` sink: one file for each row (image_id, content)."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections import Counter
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

PARTS = "_parts"


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]


def file_name(image_id) -> str:
    """A name for an image: its id, without folder and extension where it is a path.

    Where the id has more than the name tells, a hash of the whole id follows, so different ids have different files.
    """
    whole = str(image_id)
    name = re.sub(r"\.[A-Za-z0-9]+$", "", whole.rstrip("/").rsplit("/", 1)[-1]) or "image"
    mark = "" if name == whole else "-" + hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest()[:16]
    return quote(name, safe="") + mark + ".jpeg"


def store(path: str):
    """(file system, path in it): a local path, or a URI of a store that Arrow knows."""
    from pyarrow import fs

    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


class JPEGDataSource(DataSource):
    """``df.write.format("jpeg").mode("append" | "overwrite").save(path)``; ``path`` must be a folder that executors share.

    Tasks write under a folder ``_parts``; files get their names when all tasks are done, so a failed job leaves
    nothing and replaces nothing. Two rows with the same id are an error. ``overwrite`` removes the other JPEG files of the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "jpeg"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        names = [f.name for f in schema]
        if not {"image_id", "content"} <= set(names):
            raise ValueError("rows need image_id and content")
        made = JPEGWriter(self.options["path"], names.index("image_id"), names.index("content"), overwrite)
        system, path = store(made.path)
        system.create_dir(made._parts(path), recursive=True)  # tasks don't make it: one that outlives its job finds it gone
        return made


class JPEGWriter(DataSourceWriter):
    def __init__(self, path: str, id_at: int, content_at: int, overwrite: bool = False):
        self.path, self.id_at, self.content_at, self.overwrite, self.job = path, id_at, content_at, overwrite, uuid.uuid4().hex

    def _parts(self, path: str) -> str:
        return f"{path}/{PARTS}/{self.job}"

    def write(self, rows):
        system, path = store(self.path)
        folder, attempt, names = self._parts(path), uuid.uuid4().hex, []
        for number, row in enumerate(rows):
            if row[self.content_at] is None:
                raise ValueError(f"image {row[self.id_at]} has no content")
            part = f"{folder}/{attempt}-{number}"
            try:
                with system.open_output_stream(part) as f:
                    f.write(bytes(row[self.content_at]))
            except OSError as fault:
                raise OSError(f"can't write image {row[self.id_at]} to {self.path}: {fault}") from fault
            names.append((part, file_name(row[self.id_at])))
        return Written(names)

    def commit(self, messages):
        from pyarrow import fs

        system, path = store(self.path)
        names = [n for m in messages if m for n in m.names]
        twice = [n for n, count in Counter(n for _, n in names).items() if count > 1]
        if twice:
            self._clear(system, path)
            raise ValueError(f"several rows for one file: {', '.join(sorted(twice)[:5])}")
        system.create_dir(path, recursive=True)
        if self.overwrite:
            kept = {n for _, n in names}
            for found in system.get_file_info(fs.FileSelector(path)):
                if found.type == fs.FileType.File and found.base_name.endswith(".jpeg") and found.base_name not in kept:
                    system.delete_file(found.path)
        for part, name in names:
            system.move(part, f"{path}/{name}")
        self._clear(system, path)

    def abort(self, messages):
        self._clear(*store(self.path))

    def _clear(self, system, path: str) -> None:
        from pyarrow import fs

        parts = f"{path}/{PARTS}"
        for wait in (0, 0.1, 0.5, 2):  # a task that is being stopped may still write
            time.sleep(wait)
            try:
                if system.get_file_info(self._parts(path)).type == fs.FileType.Directory:
                    system.delete_dir(self._parts(path))
                break
            except OSError:
                continue
        if system.get_file_info(parts).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(parts)):
            system.delete_dir(parts)


def register(spark) -> None:
    """Makes the formats ``ppm`` and ``jpeg`` known to the session."""
    from rasterflow.sources.ppm import PPMDataSource

    spark.dataSource.register(PPMDataSource)
    spark.dataSource.register(JPEGDataSource)
