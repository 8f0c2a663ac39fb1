"""JSON lines as data sources of their own: `strict_jsonl` (batch and stream reader, writer).

The reader cuts files into byte ranges and parses each range once. A range begins behind the first line break at or before its start, and ends with
the line that its end falls in, so every line is read by one task wherever the cuts are. A line that is no object of the schema is an
error that names file and line; only then are the lines before the range counted.

The writer makes one file: tasks write parts in a folder beside it, and the commit joins them in order and renames the whole over the
old file, which is there until then. A task that fails or is tried again leaves nothing in the result; an abort deletes
the folder. Its name begins with a dot, so what a task killed after that may leave is read by nobody.

The stream reader follows the files of a folder as they appear and grow. Its offset is how far each file has been read, always behind a line break, so
a line that is still being written waits, and a restart from a checkpoint goes on where it stopped.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.json
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .ranged import CHUNK, chunks, listed, located

SPLIT = 64 << 20


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    #: Whether start is known to be the beginning of a line.
    exact: bool = False


@dataclass
class Part(WriterCommitMessage):
    path: str | None
    number: int


def ranges(file: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(file, a, min(a + split, end), a == start) for a in range(start, end, split)]


def lines_of(part: Range, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in the range, whole, in runs, each with where it begins."""
    skip = part.start > 0 and not part.exact
    begin, held = part.start - skip, b""  # with the byte before the start, a line that begins right there is seen to
    for got in chunks(part.file, begin, size=size):
        held += got
        if skip:
            cut = held.find(b"\n")
            begin, held, skip = begin + (cut + 1 or len(held)), held[cut + 1 :] if cut >= 0 else b"", cut < 0
            if begin >= part.end:
                return
            if skip:
                continue
        cut = held.find(b"\n", max(part.end - 1 - begin, 0))  # the end of the line that holds the last byte of the range
        done = cut >= 0
        cut = cut if done else held.rfind(b"\n")
        if cut >= 0:
            yield begin, held[: cut + 1]
            begin, held = begin + cut + 1, held[cut + 1 :]
        if done:
            return
    if held and not skip:
        yield begin, held


def _number(file: str, offset: int) -> int:
    """The number of the line that begins at an offset, from 1."""
    return 1 + sum(c.count(b"\n") for c in chunks(file, 0, offset))


def _strict(schema: pa.Schema, file: str, begin: int, run: bytes) -> pa.Table:
    """Line by line: the table of a run, or the error of its first bad line."""
    rows = []
    for line in run.split(b"\n"):
        if line.strip():
            try:
                row = json.loads(line)
                if not isinstance(row, dict):
                    raise ValueError("no object")
                pa.Table.from_pylist([row], schema=schema)
            except (ValueError, TypeError, pa.ArrowException) as e:
                raise ValueError(f"{file}:{_number(file, begin)}: no object of the schema: {line[:80].decode(errors='replace')} ({str(e).splitlines()[0][:80]})") from None
            rows.append(row)
        begin += len(line) + 1
    return pa.Table.from_pylist(rows, schema=schema)


def tables(schema: pa.Schema, part: Range) -> Iterator[pa.RecordBatch]:
    """The rows of a range."""
    options = pa.json.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
    for begin, run in lines_of(part):
        n = sum(1 for x in run.split(b"\n") if x.strip())
        if not n:
            continue
        try:
            table = pa.json.read_json(io.BytesIO(run), pa.json.ReadOptions(use_threads=False, block_size=len(run) + 1), options)
        except pa.ArrowException:
            table = None
        if table is None or table.num_rows != n or any(not x.lstrip().startswith(b"{") for x in run.split(b"\n") if x.strip()):
            table = _strict(schema, part.file, begin, run)
        yield from table.select(schema.names).cast(schema).to_batches(max_chunksize=10_000)


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, path: str, split: int):
        self.schema, self.path, self.split = to_arrow_schema(schema), path, split

    def partitions(self) -> list[Range]:
        files = listed(self.path)
        if not files:
            raise FileNotFoundError(self.path)
        return [r for f, n in files for r in ranges(f, 0, n, self.split)] or [Range(files[0][0], 0, 0, True)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return tables(self.schema, partition)


def _whole_lines(file: str, size: int) -> int:
    """How many of the first `size` bytes are whole lines."""
    end = size
    while end > 0:
        start = max(0, end - CHUNK)
        cut = b"".join(chunks(file, start, end)).rfind(b"\n")
        if cut >= 0:
            return start + cut + 1
        end = start
    return 0


class _Stream(DataSourceStreamReader):
    def __init__(self, schema: StructType, path: str, split: int):
        self.schema, self.path, self.split = to_arrow_schema(schema), path, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: _whole_lines(f, n) for f, n in listed(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for f, n in sorted(end.items()) if n > start.get(f, 0) for r in ranges(f, start.get(f, 0), n, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return tables(self.schema, partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: files stay as they are."""


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, path: str):
        folder, _, name = path.rpartition("/")
        self.path, self.beside = path, f"{folder}/.{name}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        number, name = context.partitionId(), f"{self.beside}/{context.partitionId():06d}-{context.taskAttemptId()}"
        system, path = located(name)
        out = None
        for b in iterator:
            for row in b.to_pylist():
                if out is None:
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path)
                out.write((json.dumps(row, ensure_ascii=False, separators=(",", ":"), default=str) + "\n").encode())
        if out is None:
            return Part(None, number)
        out.close()
        return Part(name, number)

    def commit(self, messages: list[Part]) -> None:
        system, path = located(self.path)
        whole = f"{located(self.beside)[1]}.whole"
        with system.open_output_stream(whole) as out:
            for m in sorted((m for m in messages if m and m.path), key=lambda m: m.number):
                for c in chunks(m.path):
                    out.write(c)
        system.move(whole, path)
        self.abort(messages)

    def abort(self, messages: list[Part]) -> None:
        system, path = located(self.beside)
        if system.get_file_info(path).type == fs.FileType.Directory:
            system.delete_dir(path)


class StrictJsonl(DataSource):
    """Options: path (a file, a folder or a pattern; for writing the file), split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "strict_jsonl"

    def schema(self) -> str:
        raise ValueError("strict_jsonl needs a schema")

    def _path(self) -> str:
        if not (path := self.options.get("path")):
            raise ValueError("strict_jsonl needs a path")
        return re.sub("/$", "", path)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self._path(), int(self.options.get("split", SPLIT)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, self._path(), int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("strict_jsonl writes whole files: use mode overwrite")
        return _Writer(schema, self._path())
