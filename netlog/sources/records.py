"""Capture files: fixed-size records one after the other, read in parallel by byte range."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import RECORD_BYTES

RANGE_RECORDS = 64_000  # about 64 MiB per task
BATCH_RECORDS = 4_000


@dataclass
class RecordRange(InputPartition):
    path: str
    first: int
    n_bytes: int


class RecordFiles:
    """The files under a path, cut into byte ranges of whole records."""

    def __init__(self, path: str):
        self.path = path

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(root)
        if found.type == fs.FileType.Directory:
            listed = files.get_file_info(fs.FileSelector(root, recursive=True))
            listed = [f for f in listed if f.is_file and not f.base_name.startswith(("_", "."))]
        else:
            listed = [found]
        return {f.path: f.size for f in sorted(listed, key=lambda f: f.path)}

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[RecordRange]:
        step = RANGE_RECORDS * RECORD_BYTES
        return [
            RecordRange(path, at, min(step, upto - at)) for path, upto in end.items() for at in range(start.get(path, 0), upto, step)
        ]

    def read(self, partition: RecordRange) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.path) as source:
            at, end = partition.first, partition.first + partition.n_bytes
            while at < end:
                data = source.read_at(min(BATCH_RECORDS * RECORD_BYTES, end - at), at)
                if not data:
                    break
                n = -(-len(data) // RECORD_BYTES)
                bounds = np.minimum(np.arange(n + 1, dtype=np.int64) * RECORD_BYTES, len(data)).astype(np.int32)
                records = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                numbers = np.arange(n, dtype=np.int64) + at // RECORD_BYTES
                yield pa.RecordBatch.from_arrays(
                    [pa.array([partition.path] * n), pa.array(numbers), records], names=["path", "record_no", "record"]
                )
                at += len(data)


class RecordReader(RecordFiles, DataSourceReader):
    """The last record of a file may be cut short; it is returned as it is, for the decoder to reject."""

    def partitions(self) -> list[RecordRange]:
        return self.ranges({}, self.sizes())


class RecordStreamReader(RecordFiles, DataSourceStreamReader):
    """Offsets are the bytes read of each file: whole records only, so a record that is half written waits for its rest."""

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        return {path: size - size % RECORD_BYTES for path, size in self.sizes().items()}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[RecordRange]:
        return self.ranges(start, end)


class CaptureRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_records"

    def schema(self) -> str:
        return "path STRING, record_no BIGINT, record BINARY"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options["path"])

    def streamReader(self, schema) -> RecordStreamReader:
        return RecordStreamReader(self.options["path"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a file or folder as ``path, record_no, record``; give them to ``decode_records``.

    ``path`` is an absolute path or a URI that Arrow's file systems know, readable from every executor.
    """
    spark.dataSource.register(CaptureRecords)
    return spark.read.format("capture_records").load(path)


def read_records_stream(spark: SparkSession, path: str) -> DataFrame:
    """Records as they are appended to the files of a folder, each once; new files are taken up, too.

    A micro-batch reads what came since the one before, in parallel by byte range. A record that is not whole yet waits.
    A file that got shorter gives nothing until it is longer than it was. Columns and paths as in ``read_records``.
    """
    spark.dataSource.register(CaptureRecords)
    return spark.readStream.format("capture_records").load(path)
