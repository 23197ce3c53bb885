"""Matrices in NumPy's binary format as a data source: every partition is a range of rows, read at its place in the file.

``spark.read.format("npy").load(path)`` takes one ``.npy`` file or a folder of them, in the order of their names, and gives
``row_id, x``: the row's place in the whole and its numbers as doubles. Only headers are read to plan the scan. A file
of one dimension has rows of one number. Rows that lie column by column (Fortran order) are gathered from
their columns. Any whole or real number type and byte order will do; other types and more dimensions raise.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowlens.runtime import column

#: Bytes of a partition, unless the option ``partition_bytes`` says otherwise, and of a batch inside it.
PARTITION_BYTES, BATCH_BYTES = 1 << 26, 1 << 22
#: Rows of a file that a task writes.
FILE_ROWS = 1 << 17


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "/", path))


@dataclass
class RowRange(InputPartition):
    """Rows ``start`` to ``end`` of a file whose rows before it number ``earlier``."""

    path: str
    earlier: int
    start: int
    end: int
    rows: int
    width: int
    offset: int
    kind: str
    by_column: bool


def read_header(raw) -> tuple[int, int, int, np.dtype, bool]:
    """(rows, width, offset of the numbers, their type, column by column) of an open file."""
    version = np.lib.format.read_magic(raw)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, kind = read(raw)
    if len(shape) not in (1, 2) or kind.kind not in "iufb":
        raise ValueError(f"no matrix of numbers: shape {shape}, type {kind}")
    rows, width = shape if len(shape) == 2 else (shape[0], 1)
    return rows, width, raw.tell(), kind, bool(by_column and len(shape) == 2)


class NpyReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes

    def partitions(self) -> list[RowRange]:
        fs, base = open_path(self.path)
        info = fs.get_file_info(base)
        if info.type == pafs.FileType.Directory:
            names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".npy"))
        else:
            names = [base]
        found, earlier = [], 0
        for name in names:
            with fs.open_input_file(name) as raw:
                rows, width, offset, kind, by_column = read_header(raw)
            step = max(1, self.partition_bytes // max(1, width * kind.itemsize))
            for start in range(0, rows, step):
                found.append(RowRange(name, earlier, start, min(rows, start + step), rows, width, offset, kind.str, by_column))
            earlier += rows
        return found

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        p, kind = partition, np.dtype(partition.kind)
        fs, _ = open_path(self.path)
        step = max(1, BATCH_BYTES // max(1, p.width * kind.itemsize))
        with fs.open_input_file(p.path) as raw:
            for start in range(p.start, p.end, step):
                end = min(p.end, start + step)
                x = np.ascontiguousarray(_rows(raw, p, kind, start, end).astype(np.float64))
                ends = pa.array(np.arange(end - start + 1, dtype=np.int32) * p.width)
                lists = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, end) + p.earlier), lists], names=["row_id", "x"])


def _rows(raw, p: RowRange, kind: np.dtype, start: int, end: int) -> np.ndarray:
    def numbers(first: int, count: int) -> np.ndarray:
        raw.seek(p.offset + first * kind.itemsize)
        return np.frombuffer(raw.read(count * kind.itemsize), dtype=kind)

    if p.by_column:
        return np.stack([numbers(j * p.rows + start, end - start) for j in range(p.width)], axis=1) if p.width else np.zeros((end - start, 0))
    return numbers(start * p.width, (end - start) * p.width).reshape(end - start, p.width)


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_id bigint, x array<double>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("partition_bytes", PARTITION_BYTES)))


def read_npy(spark: SparkSession, path: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").option("partition_bytes", partition_bytes).load(path)


def write_npy(df: DataFrame, path: str, key: str, features: list[str]) -> str:
    """The named columns as doubles, in the order of ``key``, in files of up to ``FILE_ROWS`` rows below ``path``.

    A task that runs again writes the same files again. The folder is one that all executors reach.
    """
    x = F.array(*[column(f).cast("double") for f in features])
    ordered = df.select(column(key).alias("key"), x.alias("x")).repartitionByRange("key").sortWithinPartitions("key")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_path(path)
        fs.create_dir(base, recursive=True)
        held, count, files = [], 0, 0

        def put() -> None:
            with fs.open_output_stream(f"{base}/{TaskContext.get().partitionId():06d}-{files:06d}.npy") as out:
                np.lib.format.write_array(out, np.concatenate(held), allow_pickle=False)

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(features))
            while len(x):
                held.append(x[: FILE_ROWS - count])
                count, x = count + len(held[-1]), x[len(held[-1]) :]
                if count == FILE_ROWS:
                    put()
                    held, count, files = [], 0, files + 1
        if count:
            put()
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    ordered.mapInArrow(work, "files bigint").write.format("noop").mode("overwrite").save()
    return path
