"""The binary vector format as a Spark data source.

Fixed format: three unsigned 64-bit little-endian integers (element size, rows,
columns), then rows * columns elements, row by row.  Element types: float
(float32), double (float64), long (int64).
"""

from __future__ import annotations

import os
import struct
import sys
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from vicinal.errors import FileFormatError

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADER, HEADER_BYTES = "<QQQ", 24
ELEMENTS = {"float": np.dtype("<f4"), "double": np.dtype("<f8"), "long": np.dtype("<i8")}
#: Bytes that one task reads, about.
SLICE_BYTES = 32 << 20


def header(path: str, element: str) -> tuple[int, int]:
    """(rows, columns) of a file, checked against the element type and the file's length."""
    with open(path, "rb") as f:
        raw = f.read(HEADER_BYTES)
    if len(raw) < HEADER_BYTES:
        raise FileFormatError(f"{path}: too short for a header")
    width, rows, cols = struct.unpack(HEADER, raw)
    if width != ELEMENTS[element].itemsize:
        raise FileFormatError(f"{path}: elements of {width} bytes, not {ELEMENTS[element].itemsize}")
    if os.path.getsize(path) != HEADER_BYTES + width * rows * cols:
        raise FileFormatError(f"{path}: the length does not fit {rows} rows of {cols}")
    return rows, cols


class RowRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


class KnnBinReader(DataSourceReader):
    def __init__(self, path: str, element: str):
        self.path, self.element = path, element
        self.rows, self.cols = header(path, element)

    def partitions(self) -> list[RowRange]:
        step = max(1, SLICE_BYTES // max(1, self.cols * ELEMENTS[self.element].itemsize))
        return [RowRange(a, min(a + step, self.rows)) for a in range(0, self.rows, step)] or [RowRange(0, 0)]

    def read(self, partition: RowRange):
        dtype = ELEMENTS[self.element]
        kind = pa.from_numpy_dtype(dtype)
        for a in range(partition.first, partition.last, 8192):
            b = min(a + 8192, partition.last)
            with open(self.path, "rb") as f:
                f.seek(HEADER_BYTES + a * self.cols * dtype.itemsize)
                x = np.frombuffer(f.read((b - a) * self.cols * dtype.itemsize), dtype)
            offsets = pa.array(np.arange(0, len(x) + 1, self.cols, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.ListArray.from_arrays(offsets, pa.array(x, kind))], names=["id", "vec"])


class Part(WriterCommitMessage):
    def __init__(self, rows: int, cols: int):
        self.rows, self.cols = rows, cols


class KnnBinWriter(DataSourceArrowWriter):
    """Tasks write each row at its place in a file beside the target; the commit adds the header and renames it.

    The id of a row is its place, 0 to rows - 1.  A task that runs twice
    writes the same bytes twice.
    """

    def __init__(self, path: str, element: str, overwrite: bool):
        self.path, self.element = path, element
        self.whole = f"{path}.{uuid.uuid4().hex}.part"
        if os.path.exists(path) and not overwrite:
            raise FileFormatError(f"{path} exists")

    def write(self, iterator) -> Part:
        rows, cols, f = 0, 0, os.open(self.whole, os.O_RDWR | os.O_CREAT, 0o644)
        try:
            for b in iterator:
                if b.num_rows:
                    lengths = set(pc.list_value_length(b.column(1)).to_pylist())
                    if len(lengths) != 1 or (rows and lengths != {cols}):
                        raise FileFormatError("rows of different lengths")
                    cols, rows = lengths.pop(), rows + b.num_rows
                    at = b.column(0).to_numpy()
                    x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(ELEMENTS[self.element]).reshape(len(at), -1)
                    runs = [0, *(np.flatnonzero(np.diff(at) != 1) + 1), len(at)]
                    for i, j in zip(runs[:-1], runs[1:], strict=True):
                        data, place = memoryview(x[i:j].tobytes()), HEADER_BYTES + int(at[i]) * x[i : i + 1].nbytes
                        while data:
                            n = os.pwrite(f, data, place)
                            data, place = data[n:], place + n
        finally:
            os.close(f)
        return Part(rows, cols)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m and m.rows]
        if len({m.cols for m in parts}) > 1:
            self.abort(messages)
            raise FileFormatError("rows of different lengths")
        f = os.open(self.whole, os.O_RDWR | os.O_CREAT, 0o644)
        os.pwrite(f, struct.pack(HEADER, ELEMENTS[self.element].itemsize, sum(m.rows for m in parts), parts[0].cols if parts else 0), 0)
        os.close(f)
        os.replace(self.whole, self.path)

    def abort(self, messages: list[Part | None]) -> None:
        if os.path.exists(self.whole):
            os.remove(self.whole)


class KnnBinDataSource(DataSource):
    """`spark.read.format("knnbin").option("element", "float").load(path)`; paths are in a file system all nodes mount."""

    @classmethod
    def name(cls) -> str:
        return "knnbin"

    @property
    def element(self) -> str:
        e = self.options.get("element", "float")
        if e not in ELEMENTS:
            raise FileFormatError(f"element must be one of {', '.join(ELEMENTS)}")
        return e

    def schema(self) -> str:
        return f"id bigint, vec array<{ {'long': 'bigint'}.get(self.element, self.element) }>"

    def reader(self, schema: StructType) -> KnnBinReader:
        return KnnBinReader(self.options["path"], self.element)

    def writer(self, schema: StructType, overwrite: bool) -> KnnBinWriter:
        return KnnBinWriter(self.options["path"], self.element, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KnnBinDataSource)


def read_knnbin(spark: SparkSession, path: str, element: str = "float") -> DataFrame:
    """(id, vec); the id is the row's number in the file."""
    register(spark)
    return spark.read.format("knnbin").option("element", element).load(path)


def in_order(df: DataFrame, key: str, parts: int = 256) -> DataFrame:
    """Adds `place`, 0 to rows - 1 in the order of the key, without a global sort: ranges by quantiles, counts of the ranges, places inside them."""
    edges = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / parts) or []))
    spark = df.sparkSession
    at = spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "i int, e double").agg(F.sort_array(F.collect_list("e")).alias("e"))
    ranged = df.join(F.broadcast(at)).withColumn("range", F.size(F.filter("e", lambda x: x < F.col(key)))).drop("e")  # one row
    counts = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # as many rows as ranges
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return ranged.withColumn("inside", inside).join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("inside")).drop("inside", "before", "range")


def write_knnbin(df: DataFrame, path: str, element: str = "float", id_col: str = "id", vec_col: str = "vec") -> None:
    """Writes vectors in the order of their ids, replacing the file."""
    register(df.sparkSession)
    cast = "bigint" if element == "long" else element
    rows = in_order(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{cast}>").alias("vec")), "id")
    rows.select(F.col("place").cast("bigint").alias("id"), "vec").write.format("knnbin").option("element", element).mode("overwrite").save(path)
