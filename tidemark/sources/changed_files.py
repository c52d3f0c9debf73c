"""A streaming source of files that are new or rewritten (survey ST01, E09).

Spark's file source takes every name once. Here an offset is the folder's list of files with their
fingerprints (size and time of change), so a rewritten file comes again as a whole, and an
untouched one doesn't. A file is read by byte ranges in separate tasks; a line belongs to the range
in which it starts. Rows are lines (without header handling): path, fingerprint, start (the line's
first byte), value.

Options: ``path`` (a folder, any URI that pyarrow opens), ``suffix`` (default .csv) and
``range_bytes``. Names starting with ``_`` or ``.`` are left out, folders are read with all below
them. The offset lists all files: meant for folders of exports, not for millions of files. A file
that is gone gives no rows. A file rewritten while it is read comes once more, with its new
fingerprint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "changed_files"
RANGE_BYTES = 64 << 20
READ_BYTES = 4 << 20


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (as Hadoop writes it: unquoted), and the path within it."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(quote(path, safe=":/@?&=,;+"))
    return fs.LocalFileSystem(), path


def list_fingerprints(path: str, suffix: str) -> dict[str, str]:
    """File name below ``path`` → "size-time of change"."""
    system, root = open_fs(path)
    root = root.rstrip("/")
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    out = {}
    for f in found:
        name = f.path[len(root) + 1 :]
        if f.type == fs.FileType.File and name.endswith(suffix) and not any(p[0] in "._" for p in name.split("/")):
            out[name] = f"{f.size}-{f.mtime_ns}"
    return out


@dataclass
class FileRange(InputPartition):
    name: str
    fingerprint: str
    start: int
    end: int


def range_lines(stream, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines that start in [start, end); line ends \\n or \\r\\n."""
    at = start
    rest = b""
    if start:  # the line that runs into this range belongs to the one before
        at = start - 1
    skipping = start > 0
    pos = at
    while True:
        block = stream.read_at(min(READ_BYTES, size - pos), pos) if pos < size else b""
        pos += len(block)
        rest += block
        lines = rest.split(b"\n")
        rest = lines.pop()
        for line in lines:
            if not skipping:
                if at >= end:
                    return
                yield at, line
            skipping = False
            at += len(line) + 1
        if not block:
            if rest and not skipping and at < end:
                yield at, rest
            return
        if at >= end and not skipping:
            return


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.suffix = options.get("suffix", ".csv")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(list_fingerprints(self.path, self.suffix), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        before, out = json.loads(start["files"]), []
        for name, fingerprint in json.loads(end["files"]).items():
            if before.get(name) != fingerprint:
                size = int(fingerprint.split("-")[0])
                out += [FileRange(name, fingerprint, at, min(at + self.range_bytes, size)) for at in range(0, max(size, 1), self.range_bytes)]
        return out

    def read(self, partition: FileRange):
        system, root = open_fs(self.path)
        names = ["path", "fingerprint", "start", "value"]
        try:
            stream = system.open_input_file(f"{root.rstrip('/')}/{partition.name}")
        except FileNotFoundError:
            return
        with stream:
            starts, lines, held = [], [], 0
            for at, line in range_lines(stream, partition.start, partition.end, stream.size()):
                if at == 0 and line.startswith(b"\xef\xbb\xbf"):
                    line = line[3:]
                starts.append(at)
                lines.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                held += len(line) + 16
                if held >= READ_BYTES:
                    yield self._batch(partition, starts, lines, names)
                    starts, lines, held = [], [], 0
            if starts:
                yield self._batch(partition, starts, lines, names)

    @staticmethod
    def _batch(partition, starts, lines, names):
        n = len(starts)
        return pa.RecordBatch.from_arrays([pa.array([partition.name] * n), pa.array([partition.fingerprint] * n), pa.array(starts, pa.int64()), pa.array(lines)], names=names)

    def commit(self, end: dict) -> None:
        pass


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, fingerprint string, start long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def changed_files(spark: SparkSession, path: str, suffix: str = ".csv", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """ST01: a stream of the lines of new and rewritten files below ``path``."""
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format(FORMAT).option("suffix", suffix).option("range_bytes", range_bytes).load(path)
