"""Python data sink of images: PNG files for all rows, so that no class of images differs by its codec.

Tasks write into a folder of their own attempt below the job's under ``_unfinished``, which readers of folders pass over; the driver
moves the folders of the attempts that count, one rename a task, and removes the rest.  Only the driver makes the job's
folder, so a task that outlives a failed job finds no place to write to.  (Object stores have no folders: there such a task may leave
files under ``_unfinished``, which no reader sees.)  Paths are as in ``archives``.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from plumbline.sources.archives import opened

COLUMNS = ("name", "height", "width", "pixels")
UNFINISHED = "_unfinished"


def png(height: int, width: int, pixels: bytes) -> bytes:
    """RGB bytes as a PNG file; equal pixels give equal bytes."""
    line = width * 3
    raw = b"".join(b"\0" + pixels[i * line : (i + 1) * line] for i in range(height))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def fault(name: str | None, height: int | None, width: int | None, pixels: bytes | None) -> str | None:
    """Why a row cannot be a file; null if it can."""
    if not name or name.startswith("/") or any(p in ("", ".", "..") for p in name.split("/")):
        return "its name is no path below the folder"
    if not height or not width or height < 1 or width < 1 or pixels is None or len(pixels) != height * width * 3:
        return f"{None if pixels is None else len(pixels)} bytes are no {height} x {width} pixels"
    return None


@dataclass
class Written(WriterCommitMessage):
    folder: str | None
    part: int


class PictureWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        system, _, unfinished = self._root()
        system.create_dir(unfinished)

    def _root(self) -> tuple[fs.FileSystem, str, str]:
        system, root = opened(self.path)
        return system, root, posixpath.join(root, UNFINISHED, self.job)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, unfinished = self._root()
        task = TaskContext.get()
        folder, made = posixpath.join(unfinished, f"{task.partitionId()}-{task.taskAttemptId()}"), set()

        def make(path: str) -> None:
            if path not in made:
                if path != folder:
                    make(posixpath.dirname(path))
                system.create_dir(path, recursive=False)
                made.add(path)

        for batch in iterator:
            for row in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                if why := fault(*row):
                    raise ValueError(f"image {row[0]!r}: {why}")
                target = posixpath.join(folder, row[0])
                make(posixpath.dirname(target))
                with system.open_output_stream(target) as out:
                    out.write(png(*row[1:]))
        return Written(folder if made else None, task.partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        system, root, unfinished = self._root()
        if self.overwrite:  # only now that every task has written
            for old in system.get_file_info(fs.FileSelector(root)):
                if old.base_name != UNFINISHED:
                    (system.delete_file if old.is_file else system.delete_dir)(old.path)
        for m in messages:
            if m and m.folder:
                system.move(m.folder, posixpath.join(root, f"part-{m.part:05d}-{self.job[:12]}"))
        self._clear(system, root, unfinished)
        with system.open_output_stream(posixpath.join(root, "_SUCCESS")):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._root())

    def _clear(self, system: fs.FileSystem, root: str, unfinished: str) -> None:
        """Remove what this job left unfinished, and the folder of unfinished jobs if no other has any."""
        if system.get_file_info(unfinished).type == fs.FileType.Directory:
            system.move(unfinished, f"{unfinished}-over")  # at once, under tasks that still write
            system.delete_dir(f"{unfinished}-over")
        above = posixpath.join(root, UNFINISHED)
        if system.get_file_info(above).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(above)):
            system.delete_dir(above)


class Pictures(DataSource):
    """``format("pictures")``: writes rows ``(name, height, width, pixels)`` under ``path``; other columns are not written."""

    @classmethod
    def name(cls) -> str:
        return "pictures"

    def schema(self) -> str:
        return "name string, height int, width int, pixels binary"

    def writer(self, schema, overwrite: bool) -> PictureWriter:
        return PictureWriter(self.options["path"], overwrite)


def write_pictures(images: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``images(name, height, width, pixels)`` as ``path/part-.../name``, all or nothing.

    Names may hold folders (``brand/file.png``), which ``readers.image_files`` reads back with their hashes.  A name that occurs twice, a
    name that leads out of the folder, and pixels that do not fit their size fail the job, which then leaves earlier files as they were.
    """
    twice = images.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"names of more than one image: {sorted(str(r['name']) for r in twice)}")
    images.sparkSession.dataSource.register(Pictures)
    images.select(*COLUMNS).write.format("pictures").mode(mode).option("path", path).save()
