"""Python data source of ``.npz`` archives: a task reads a range of an archive's rows.

Archives are opened through ``pyarrow.fs``, so paths are local ones that all executors share, or URIs that it
knows.  Where only Hadoop's file systems reach a path, ``readers.npz_vectors`` reads it, a file a task.
"""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a partition, and of a batch, unless the options say otherwise.
ROWS = 1 << 16
BATCH = 4096


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int


class Member:
    """One array of an archive, by a handle of its own: its header, and blocks of its rows from any row on."""

    def __init__(self, file: pa.NativeFile, name: str):
        archive = zipfile.ZipFile(file)
        self.name, self.stored = name, archive.getinfo(f"{name}.npy").compress_type == zipfile.ZIP_STORED
        self.data = archive.open(f"{name}.npy")
        version = np.lib.format.read_magic(self.data)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        self.shape, by_column, self.dtype = read(self.data)
        if self.dtype.hasobject or not self.shape:
            raise ValueError(f"{name}: only rows of plain values can be read, not {self.dtype} of shape {self.shape}")
        self.turned = by_column and len(self.shape) > 1
        self.first, self.size = self.data.tell(), self.dtype.itemsize * int(np.prod(self.shape[1:], dtype=int))

    @property
    def seekable(self) -> bool:
        """Whether reading may begin at any row without reading those before it."""
        return self.stored and not self.turned

    def blocks(self, start: int, stop: int) -> Iterator[np.ndarray]:
        if self.turned:  # rows are not contiguous: the array is read whole
            whole = np.frombuffer(self.data.read(), self.dtype).reshape(self.shape, order="F")
            yield from (whole[i : min(i + BATCH, stop)] for i in range(start, stop, BATCH))
            return
        self.data.seek(self.first + start * self.size)
        for i in range(start, stop, BATCH):
            n = min(BATCH, stop - i)
            held = self.data.read(n * self.size)
            if len(held) < n * self.size:
                raise ValueError(f"{self.name}: cut short at row {i}")
            yield np.frombuffer(held, self.dtype, count=n * int(np.prod(self.shape[1:], dtype=int))).reshape(n, *self.shape[1:])


class ArchiveReader(DataSourceReader):
    """``partitions`` reads only directories and headers, a few kilobytes an archive, on the driver."""

    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.names = (options.get("ids", "files"), options.get("vectors", "vecs"))

    @contextmanager
    def _members(self, system: fs.FileSystem, path: str) -> Iterator[tuple[Member, Member]]:
        with system.open_input_file(path) as one, system.open_input_file(path) as other:
            yield self._checked(path, Member(one, self.names[0]), Member(other, self.names[1]))

    def _checked(self, path: str, ids: Member, vectors: Member) -> tuple[Member, Member]:
        if ids.shape[0] != vectors.shape[0] or len(ids.shape) != 1 or len(vectors.shape) != 2:
            raise ValueError(f"{path}: {ids.shape} ids do not name the rows of {vectors.shape} vectors")
        return ids, vectors

    def partitions(self) -> list[Rows]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        found = []
        for name in sorted(f.path for f in files if f.is_file and f.path.endswith(".npz")):
            with self._members(system, name) as (ids, vectors):
                n = ids.shape[0]
                step = self.rows if ids.seekable and vectors.seekable else max(n, 1)
                found += [Rows(name, i, min(i + step, n)) for i in range(0, n, step)]
        return found or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part.stop == part.start:
            return
        system, _ = opened(self.path)
        with self._members(system, part.path) as (ids, vectors):
            for names, block in zip(ids.blocks(part.start, part.stop), vectors.blocks(part.start, part.stop), strict=True):
                text = [n.decode() if isinstance(n, bytes) else str(n) for n in names.tolist()]
                ends = np.arange(len(text) + 1, dtype=np.int32) * block.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.ListArray.from_arrays(ends, np.ascontiguousarray(block, dtype=np.float32).ravel())], names=["id", "vec"])


class VectorArchives(DataSource):
    """``format("vector_archives")``: options ``path`` (an archive or a folder of them), ``rows`` a partition, ``ids`` and ``vectors``, the arrays' names."""

    @classmethod
    def name(cls) -> str:
        return "vector_archives"

    def schema(self) -> str:
        return "id string, vec array<float>"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def archive_vectors(spark: SparkSession, path: str, prefix: str = "", rows: int = ROWS) -> DataFrame:
    """``(id, vec)`` of the archives under ``path``, ``rows`` rows a task.

    Arrays that are stored (as ``numpy.savez`` does) are read from any row on; a compressed or transposed array makes its archive one
    task, which streams compressed rows in batches.  Ids that repeat stay; an archive without rows gives none; arrays of unlike length, of objects or cut short are errors.
    """
    spark.dataSource.register(VectorArchives)
    found = spark.read.format("vector_archives").option("rows", rows).load(path)
    return found.withColumn("id", F.concat(F.lit(prefix), "id")) if prefix else found
