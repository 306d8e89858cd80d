"""A stored table with a log of commits, as a Spark data source: batch and stream, both ways.

Tasks write files; the driver lists those of a whole write in one entry of the log, renamed into place. What no entry lists does
not exist for readers, so that a write that fails or is aborted leaves nothing to be seen. Rows have places in the order of the
log; a stream's offset is such a place, and a read is cut into pages of rows. A stream that repeats a batch finds its entry
there and drops the new files. One writer writes to a table at a time; readers are as many as like.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a page, which a task reads.
PAGE_ROWS = 50_000


class Store:
    """The files and the log of a table at a path or URI that driver and executors share."""

    def __init__(self, path: str):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        self.fs, self.root = files.FileSystem.from_uri(path) if "://" in path else (files.LocalFileSystem(), path)

    def entries(self) -> list[dict]:
        """The log in its order."""
        found = self.fs.get_file_info(files.FileSelector(f"{self.root}/log", allow_not_found=True))
        names = sorted(f.path for f in found if f.path.endswith(".json"))
        out = []
        for name in names:
            with self.fs.open_input_stream(name) as f:
                out.append(json.loads(f.read()))
        return out

    def listed(self) -> list[tuple[str, int]]:
        """All visible files in the order of their rows, with how many each has."""
        return [(name, n) for e in self.entries() for name, n in e["files"]]

    def commit(self, messages: list, writer: str | None = None, batch: int | None = None) -> bool:
        """One entry for all of a write's files; False, and the files go, if the writer's batch has its entry already."""
        entries = self.entries()
        if batch is not None and any(e["writer"] == writer and e["batch"] == batch for e in entries):
            self.drop(messages)
            return False
        entry = {"writer": writer, "batch": batch, "files": [[m.name, m.rows] for m in messages if m is not None and m.rows]}
        self.fs.create_dir(f"{self.root}/log")
        place = f"{self.root}/log/{len(entries):020d}.json"
        hidden = f"{place}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(hidden) as f:
            f.write(json.dumps(entry).encode())
        self.fs.move(hidden, place)
        return True

    def drop(self, messages: list) -> None:
        for m in messages:
            if m is not None and m.rows:
                self.fs.delete_file(f"{self.root}/rows/{m.name}")


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


def written(path: str, schema: StructType, batches: Iterator[pa.RecordBatch]) -> Written:
    """A task's rows as one file, that nothing lists yet; a task that fails takes its file with it."""
    store, kinds, name, rows, out = Store(path), to_arrow_schema(schema), f"{uuid.uuid4().hex}.parquet", 0, None
    try:
        for batch in batches:
            if out is None:
                store.fs.create_dir(f"{store.root}/rows")
                out = pq.ParquetWriter(f"{store.root}/rows/{name}", kinds, filesystem=store.fs)
            out.write_batch(batch.cast(kinds))
            rows += batch.num_rows
    except BaseException:
        if out is not None:
            out.close()
            store.fs.delete_file(f"{store.root}/rows/{name}")
        raise
    if out is not None:
        out.close()
    return Written(name, rows)


@dataclass
class Page(InputPartition):
    """Rows of visible files: (name, first, end) each."""

    pieces: list[tuple[str, int, int]]


def pages(listed: list[tuple[str, int]], start: int, end: int, size: int) -> list[Page]:
    """The rows from `start` up to `end` in pages of `size` rows."""
    out: list[Page] = []
    room, before = 0, 0
    for name, n in listed:
        low, high = max(start - before, 0), min(end - before, n)
        while low < high:
            if not room:
                out.append(Page([]))
                room = size
            take = min(room, high - low)
            out[-1].pieces.append((name, low, low + take))
            low, room = low + take, room - take
        before += n
    return out


def page_rows(path: str, schema: StructType, page: Page) -> Iterator[pa.RecordBatch]:
    """A page's rows; row groups outside of it are not read."""
    store, kinds = Store(path), to_arrow_schema(schema)
    for name, first, end in page.pieces:
        with store.fs.open_input_file(f"{store.root}/rows/{name}") as f:
            source, before = pq.ParquetFile(f), 0
            for g in range(source.num_row_groups):
                n = source.metadata.row_group(g).num_rows
                if before < end and before + n > first:
                    at = before
                    for batch in source.iter_batches(row_groups=[g], columns=kinds.names, use_threads=False):
                        low, high = max(first - at, 0), min(end - at, batch.num_rows)
                        if low < high:
                            yield batch.slice(low, high - low).select(kinds.names).cast(kinds)
                        at += batch.num_rows
                before += n


class LogReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.size, self.kind = options["path"], int(options.get("pagerows", PAGE_ROWS)), schema

    def partitions(self) -> list[InputPartition]:
        listed = Store(self.path).listed()
        return pages(listed, 0, sum(n for _, n in listed), self.size) or [Page([])]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return page_rows(self.path, self.kind, partition)


class LogStreamReader(DataSourceStreamReader):
    """Offsets are {"row": place}: the first row that is not read yet."""

    def __init__(self, options: dict, schema: StructType):
        self.path, self.size, self.kind = options["path"], int(options.get("pagerows", PAGE_ROWS)), schema

    def initialOffset(self) -> dict:  # noqa: N802
        return {"row": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"row": sum(n for _, n in Store(self.path).listed())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return pages(Store(self.path).listed(), start["row"], end["row"], self.size) or [Page([])]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        return page_rows(self.path, self.kind, partition)

    def commit(self, end: dict) -> None:
        pass


class LogWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind = options["path"], schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return written(self.path, self.kind, iterator)

    def commit(self, messages: list) -> None:
        Store(self.path).commit(messages)

    def abort(self, messages: list) -> None:
        Store(self.path).drop(messages)


class LogStreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.kind, self.name = options["path"], schema, options.get("writer", "")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return written(self.path, self.kind, iterator)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        Store(self.path).commit(messages, self.name, batchId)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        Store(self.path).drop(messages)


class LogSource(DataSource):
    """`tessera_log`. Options: path; pageRows; writer, the name under which a stream's batches are known."""

    @classmethod
    def name(cls) -> str:
        return "tessera_log"

    def schema(self) -> StructType:
        store = Store(self.options["path"])
        listed = store.listed()
        if not listed:
            raise ValueError(f"{self.options['path']} has no rows, and so no schema; give one")
        return from_arrow_schema(pq.read_schema(f"{store.root}/rows/{listed[0][0]}", filesystem=store.fs))

    def reader(self, schema: StructType) -> DataSourceReader:
        return LogReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogStreamReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("rows of a log are appended, not replaced")
        return LogWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return LogStreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)
