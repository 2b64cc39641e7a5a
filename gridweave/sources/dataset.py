"""Datasets of tensors: tables with a dense index, and Python datasets as a Spark data source."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridweave import dtypes as dt
from gridweave.dtypes import DType
from gridweave.errors import DatasetError


def tensor_table(df: DataFrame, key: str, tensor: str | Column, dtype: DType, shape: Column | None = None) -> DataFrame:
    """idx, tensor (tagged with its dtype) and, if given, shape of a table whose key is a dense index."""
    tensor = F.col(tensor) if isinstance(tensor, str) else tensor
    extra = [shape.cast("array<bigint>").alias("shape")] if shape is not None else []
    return df.select(F.col(key).cast("bigint").alias("idx"), dt.tagged(tensor, "tensor", dtype), *extra)


def length(items: DataFrame) -> int:
    return items.count()


def is_empty(items: DataFrame) -> bool:
    return items.isEmpty()


def check_dense(items: DataFrame) -> None:
    """Raises unless idx is 0..n-1, each once."""
    r = items.agg(F.count("*").alias("n"), F.countDistinct("idx").alias("d"), F.min("idx").alias("a"), F.max("idx").alias("z")).first()
    if r.n and (r.n != r.d or r.a != 0 or r.z != r.n - 1):
        raise DatasetError(f"idx is not dense: {r.n} rows, {r.d} different, {r.a} to {r.z}")


def check_values(items: DataFrame) -> DataFrame:
    """``items`` whose null tensors and null elements raise an error that names the item."""
    bad = F.col("tensor").isNull() | F.exists("tensor", lambda x: x.isNull())
    said = F.raise_error(F.concat(F.lit("DatasetError: item "), F.col("idx").cast("string"), F.lit(": null")))
    field = items.schema["tensor"]
    return items.withColumn("tensor", F.when(bad, said).otherwise(F.col("tensor")).alias("tensor", metadata=field.metadata))


class Dataset:
    """A random-access collection of tensors, written by users.

    ``write(idx)`` gives an item as a numpy array; ``dtype`` is that of all items. Both must be picklable.
    """

    dtype: DType = dt.F32

    def __len__(self) -> int:
        raise NotImplementedError

    def write(self, idx: int) -> np.ndarray:
        raise NotImplementedError

    def layout(self, items: Sequence[int]) -> tuple[int, ...]:
        """The shape of a batch's items; by default the largest of each dimension."""
        shapes = [np.shape(self.write(i)) for i in items]
        return tuple(max(d) for d in zip(*shapes, strict=True))


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


#: Elements and items of an Arrow batch that a reader gives at once (but always a whole item).
BATCH_ELEMENTS, BATCH_ITEMS = 1 << 20, 1024
_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}


def item_of(dataset: Dataset, idx: int) -> np.ndarray:
    """An item as its column holds it; every error names the item."""
    try:
        item = np.asarray(dataset.write(idx))
    except Exception as e:
        raise DatasetError(str(e), idx) from e
    if item.size == 0:
        raise DatasetError("an item can't be empty", idx)
    dtype = dataset.dtype
    if not dtype.is_int:
        return dt.rounded(item, dtype)
    if item.dtype.kind not in "iub" or item.min() < dtype.low or item.max() > dtype.high:
        raise DatasetError(f"an item is not of {dtype.name}", idx)
    return item


def _source(dataset: Dataset, name: str, partitions: int) -> type[DataSource]:
    schema = f"idx bigint, shape array<bigint>, tensor {dataset.dtype.array()}"
    element = _ARROW[dataset.dtype.spark]
    arrow = pa.schema([("idx", pa.int64()), ("shape", pa.list_(pa.int64())), ("tensor", pa.list_(element))])

    class Reader(DataSourceReader):
        def partitions(self):
            n = len(dataset)
            k = max(1, min(partitions, n))
            return [_Range(n * i // k, n * (i + 1) // k) for i in range(k)]

        def read(self, partition):
            held: list[np.ndarray] = []
            size, first = 0, partition.start

            def batch():
                ends = np.r_[0, np.cumsum([x.size for x in held])].astype(np.int32)
                flat = np.concatenate([x.reshape(-1) for x in held]).astype(element.to_pandas_dtype())
                tensors = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, element))
                shapes = pa.array([list(x.shape) for x in held], pa.list_(pa.int64()))
                return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(held)), pa.int64()), shapes, tensors], schema=arrow)

            for idx in range(partition.start, partition.end):
                held.append(item_of(dataset, idx))
                size += held[-1].size
                if size >= BATCH_ELEMENTS or len(held) >= BATCH_ITEMS:
                    yield batch()
                    held, size, first = [], 0, idx + 1
            if held:
                yield batch()

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Source


def read_dataset(spark: SparkSession, dataset: Dataset, name: str = "gridweave_dataset", partitions: int = 32) -> DataFrame:
    """idx, shape, tensor of a Python dataset, read in index ranges."""
    spark.dataSource.register(_source(dataset, name, partitions))
    df = spark.read.format(name).load()
    return df.withColumn("tensor", dt.tagged(F.col("tensor"), "tensor", dataset.dtype))
