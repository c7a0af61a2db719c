"""Arrow IPC (Feather) files as a Spark data source, for reading and for writing.

    arrow.register(spark)
    spark.read.format("arrow_ipc").schema("a long, b string").load(path)
    df.write.format("arrow_ipc").mode("append").save(path)

Reading takes a file or a folder. Only the columns of the schema are read (without a schema, all columns of the first file), and
a partition is a group of record batches of one file, so a file of any size is shared out; the option batches (8) says how
many. Paths are what Arrow's file systems open: local and shared folders, hdfs:// and s3://. For stores that only Spark reads
there is files.read_arrow, one task a file.

Writing makes one file of each task under a name that no other has; the driver removes the files of a write that failed.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

NAME = "arrow_ipc"


def _opened(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    from pyarrow import fs

    system, at = _opened(path)
    if system.get_file_info(at).type == fs.FileType.File:
        return [at]
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))


@dataclass
class Batches(InputPartition):
    """Record batches first .. last - 1 of a file."""

    path: str
    first: int
    last: int


class ArrowReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.root, self.size = options["path"], int(options.get("batches", 8))
        self.target = to_arrow_schema(schema)

    def partitions(self) -> list[InputPartition]:
        system, out = _opened(self.root)[0], []
        for path in _files(self.root):
            with system.open_input_file(path) as f:
                n = pa.ipc.open_file(f).num_record_batches  # the footer only
            out += [Batches(path, i, min(n, i + self.size)) for i in range(0, n, self.size)]
        return out

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file
            return
        with _opened(self.root)[0].open_input_file(partition.path) as f:
            have = pa.ipc.open_file(f).schema
            missing = [n for n in self.target.names if have.get_field_index(n) < 0]
            if missing:
                raise ValueError(f"{partition.path} has no column {', '.join(missing)}")
            options = pa.ipc.IpcReadOptions(included_fields=sorted(have.get_field_index(n) for n in self.target.names))
            file = pa.ipc.open_file(f, options=options)
            for i in range(partition.first, partition.last):
                yield from pa.Table.from_batches([file.get_batch(i)]).select(self.target.names).cast(self.target).to_batches()


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.root, self.schema, self.overwrite = options["path"], to_arrow_schema(schema), overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, at = _opened(self.root)
        system.create_dir(at, recursive=True)
        path, file = f"{at}/part-{uuid.uuid4().hex}.arrow", None
        for batch in batches:
            if file is None:
                sink = system.open_output_stream(path)
                file = pa.ipc.new_file(sink, self.schema)
            file.write_batch(pa.Table.from_batches([batch]).cast(self.schema).combine_chunks().to_batches()[0])
        if file is None:
            return Written(None)
        file.close()
        sink.close()
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            system, kept = _opened(self.root)[0], {m.path for m in messages if m}
            for old in _files(self.root):
                if old not in kept:
                    system.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        system = _opened(self.root)[0]
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


class ArrowSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        files = _files(self.options["path"])
        if not files:
            raise ValueError(f"no Arrow file in {self.options['path']}: name a schema")
        with _opened(self.options["path"])[0].open_input_file(files[0]) as f:
            return from_arrow_schema(pa.ipc.open_file(f).schema)

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(schema, self.options, overwrite)


def register(spark: SparkSession) -> None:
    # Workers that plan a source are not told where this package is; its classes travel whole.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ArrowSource)
