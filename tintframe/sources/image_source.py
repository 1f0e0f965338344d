"""Image files as a Spark data source: ``images`` reads pictures and writes files.

Reading: ``spark.read.format("images").load(folder)`` after :func:`register`. One row a file:
``path, format, width, height, argb`` (packed colours in row order, little-endian), or
``error_kind`` and ``error`` for a file that is no image, has no decoder or is broken. Files are
dealt to partitions by size.

Writing: rows ``name, content`` become files of a folder. Tasks write to a hidden folder; only
when all have ended well are the files moved to their names, and after a failure none is left.
"""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import decoders, images

PICTURES_DDL = "path string, format string, width int, height int, argb binary, error_kind string, error string"
FILES_DDL = "name string, content binary"
_PICTURES = pa.schema([("path", pa.string()), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary()), ("error_kind", pa.string()), ("error", pa.string())])


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    store, root = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    return store, root


def picture(path: str, name: str, data: bytes) -> dict:
    """The row of a file. The error is told as a user would read it."""
    row = dict.fromkeys(_PICTURES.names) | {"path": path, "format": name}
    try:
        argb = decoders.decode(data, name)
    except decoders.ImageError as wrong:
        file = posixpath.basename(path)
        told = f"'{file}' is not a supported image." if wrong.kind == "unknown" else f"Could not open '{file}': {wrong}"
        return row | {"error_kind": wrong.kind, "error": told}
    return row | {"width": argb.shape[1], "height": argb.shape[0], "argb": np.ascontiguousarray(argb).astype("<i4").tobytes()}


def load(files: DataFrame) -> DataFrame:
    """Files ``path, content`` of any store that Spark reads to pictures, as the source returns them.

    A null content is an empty file; Spark's ``binaryFile`` passes over empty files. Formats are told by the first bytes, never by the name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, name, data in zip(batch["path"].to_pylist(), batch["format"].to_pylist(), batch["content"], strict=True):
                yield pa.RecordBatch.from_pylist([picture(path, name, data.as_py() or b"")], schema=_PICTURES)

    known = files.select("path", images.image_format(F.col("content")).alias("format"), "content")
    return known.mapInArrow(run, PICTURES_DDL)


def pixels(pictures: DataFrame, key: str = "path") -> DataFrame:
    """``key, y, x, argb`` of the pictures that were decoded, a part of a picture at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                argb, width = np.frombuffer(batch["argb"][i].as_buffer(), "<i4"), batch["width"][i].as_py()
                for lo in range(0, len(argb), 1 << 16):
                    some = argb[lo : lo + (1 << 16)]
                    y, x = np.divmod(np.arange(lo, lo + len(some)), width)
                    keys = pa.repeat(batch[key][i], len(some))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(some)], names=[key, "y", "x", "argb"])

    sound = pictures.filter(F.col("argb").isNotNull()).select(key, "width", "argb")
    kind = sound.schema[key].dataType.simpleString()
    return sound.mapInArrow(run, f"`{key}` {kind}, y int, x int, argb int")


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("partitionBytes", 32 << 20))

    def partitions(self) -> list[_Files]:
        store, root = _store(self.path)
        found = store.get_file_info(root)
        files = [found] if found.is_file else store.get_file_info(pafs.FileSelector(root, recursive=True))
        shown = sorted((f.path, f.size) for f in files if f.is_file and not any(p.startswith((".", "_")) for p in f.path[len(root) :].split("/")))
        parts, held, size = [], [], 0
        for path, n in shown:
            if held and size + n > self.most:
                parts.append(_Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*parts, _Files(tuple(held))]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as there:
                data = there.read()
            yield pa.RecordBatch.from_pylist([picture(path, decoders.sniff(data), data)], schema=_PICTURES)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.passing = f"_passing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, root = _store(self.path)
        folder, names = f"{root}/{self.passing}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for batch in iterator:
            for name, content in zip(batch["name"].to_pylist(), batch["content"], strict=True):
                if not name or name.startswith((".", "_")) or "/" in name:
                    raise ValueError(f"{name!r} is no name for a file")
                with store.open_output_stream(f"{folder}/{name}") as out:
                    out.write(content.as_py() or b"")
                names.append(name)
        return _Written(folder, tuple(names))

    def commit(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.path)
        every = [(m.folder, name) for m in messages if m is not None for name in m.names]
        names = [name for _, name in every]
        if len({*names}) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same name")
        for folder, name in every:
            store.move(f"{folder}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.passing}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.passing}")


class Images(DataSource):
    @classmethod
    def name(cls) -> str:
        return "images"

    def schema(self) -> str:
        return PICTURES_DDL

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Images)
