"""FASTA as a Python data source: ``spark.read.format("fasta")`` and ``spark.readStream.format("fasta")``, after ``register(spark)``.

Rows are file, offset (byte of the header line, or of the first line of a record without one), name, sequence, error (null for a good record).
A plain file is read in byte ranges of ``block`` bytes; a record belongs to the range its header begins in, so any task finds its
records alone and holds one record at a time. Compressed files (.gz, .xz, .bz2) are a range each. Filters on name are applied
while parsing: a record that is not asked for is never put together. Paths are those pyarrow knows (local, hdfs://, s3://).

The stream's offset is the number of bytes read of each file: files that appear are read, and files that grew by whole records
are read on from there.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringStartsWith

SCHEMA = "file string, offset long, name string, sequence string, error string"
_OPENERS = {".gz": gzip.open, ".xz": lzma.open, ".bz2": bz2.open}
_LETTERS = re.compile(rb"[A-Za-z\-~:*./]+")
_ARROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("name", pa.string()), ("sequence", pa.string()), ("error", pa.string())])


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int | None  # None: a compressed file, or to the end


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(paths: str) -> dict[str, int]:
    """Size of each file at the comma-separated paths; folders are listed, hidden files left out."""
    from pyarrow import fs

    out = {}
    for path in paths.split(","):
        store, at = _store(path.strip())
        info = store.get_file_info(at)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
        prefix = path.strip()[: -len(at)] if path.strip().endswith(at) else ""
        for f in found:
            if f.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            if f.is_file and f.base_name[:1] not in "._":
                out[prefix + f.path] = f.size
    return out


def split(sizes: dict[str, int], begins: dict[str, int], block: int) -> list[Range]:
    """Byte ranges of at most ``block`` bytes of what ``begins`` has not covered."""
    out = []
    for path, size in sorted(sizes.items()):
        begin = begins.get(path, 0)
        if any(path.endswith(x) for x in _OPENERS):
            out += [Range(path, 0, None)] if begin < size else []
        else:
            out += [Range(path, b, min(b + block, size)) for b in range(begin, size, block)]
    return out


def parse(lines: Iterable[bytes], begin: int, end: int | None, wanted=None) -> Iterator[tuple[int, str, str, str | None]]:
    """offset, name, sequence, error of the records whose first line is in [begin, end); ``lines`` start at ``begin``, or with the
    line that ``begin`` is in the middle of when ``begin`` > 0 (its caller starts a byte earlier, so no line is skipped wrongly)."""
    at, name, start, body = begin, None, begin, []
    take = False

    def made():
        if name is None and not body:
            return None
        sequence = b"".join(body)
        error = "no name" if not name else "no sequence" if not sequence else None if _LETTERS.fullmatch(sequence) else "invalid characters"
        return start, name or "", sequence.decode("utf-8", "replace").upper().replace("/", "-"), error

    for line in lines:
        here, at = at, at + len(line)
        text = line.strip()
        if text.startswith(b">"):
            if take and (row := made()):
                yield row
            if end is not None and here >= end:
                return
            name, start, body = text[1:].strip().decode("utf-8", "replace"), here, []
            take = wanted is None or wanted(name)
        elif text and not text.startswith(b";"):
            if name is None and not take:
                # text before the first header: of this file's beginning a record without name, else another range's
                if begin > 0 or (wanted is not None and not wanted("")):
                    continue
                take, start = True, here
            if take:
                body.append(text)
    if take and (row := made()):
        yield row


def read_range(part: Range, wanted=None, rows: int = 2048, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The records of a range, in batches of at most ``rows`` records and about ``size`` bytes."""
    store, path = _store(part.path)
    opener = next((o for x, o in _OPENERS.items() if path.endswith(x)), None)
    with store.open_input_file(path) as raw:
        begin, stream = part.begin, io.BufferedReader(raw, 1 << 20)
        if opener:
            stream = opener(stream)
        elif begin > 0:
            stream.seek(begin - 1)
            begin += len(stream.readline()) - 1  # the line that reaches into this range belongs to the one before
        found: list[tuple] = []
        held = 0
        if part.end is None or begin < part.end:
            for offset, name, sequence, error in parse(stream, begin, part.end, wanted):
                found.append((part.path, offset, name, sequence, error))
                held += len(sequence)
                if len(found) >= rows or held >= size:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    found, held = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _ARROW, strict=True)], schema=_ARROW)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.block = options["path"], int(options.get("block", 64 << 20))
        self.names: set[str] | None = None
        self.parts: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.names = {f.value} if self.names is None else self.names & {f.value}
            elif isinstance(f, In) and f.attribute == ("name",):
                self.names = set(f.value) if self.names is None else self.names & set(f.value)
            elif isinstance(f, StringStartsWith | StringContains) and f.attribute == ("name",):
                self.parts.append(("starts" if isinstance(f, StringStartsWith) else "holds", f.value))
            else:
                yield f

    def wanted(self, name: str) -> bool:
        return (self.names is None or name in self.names) and all(name.startswith(x) if how == "starts" else x in name for how, x in self.parts)

    def partitions(self) -> list[Range]:
        return split(files_of(self.paths), {}, self.block)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition, self.wanted if self.names is not None or self.parts else None)


class FastaStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.block = options["path"], int(options.get("block", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return files_of(self.paths)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return split(end, start, self.block)

    def commit(self, end: dict) -> None:
        pass

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)


class FastaSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)

    def streamReader(self, schema) -> FastaStream:
        return FastaStream(self.options)


def register(spark: SparkSession) -> SparkSession:
    """Make the format known to a session; filters reach it where Spark passes them on to Python sources."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's stream runner is a process without the package
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FastaSource)
    return spark
