"""Epochs without end as a stream: a source whose offsets are (epoch, step).

Which items belong to a step is arithmetic (``plans.permute``), so a task reads exactly the items of its steps from a dataset and packs them where it
runs: nothing is shuffled, however long the stream goes on. A query that is restarted from its checkpoint goes on behind the last step it committed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gridweave.dtypes import BF16, DType
from gridweave.errors import ShapeError
from gridweave.plans.flow import StreamOptions, drawn_seed
from gridweave.plans.permute import Permutation
from gridweave.sources.dataset import Dataset, item_of

SCHEMA = "epoch int, step bigint, n bigint, shape array<bigint>, indices array<bigint>, data binary"
ARROW_SCHEMA = pa.schema([
    ("epoch", pa.int32()), ("step", pa.int64()), ("n", pa.int64()), ("shape", pa.list_(pa.int64())), ("indices", pa.list_(pa.int64())), ("data", pa.binary()),
])


def numpy_type(dtype: DType) -> np.dtype:
    """What a batch's bytes are: the dtype's own type, float32 for bfloat16, which numpy lacks."""
    return np.dtype("<f4" if dtype is BF16 else dtype.numpy)


def packed(items: list[np.ndarray], indices: list[int], target: tuple[int, ...], kind: np.dtype) -> np.ndarray:
    """Items in the first corners of a batch of zeros, each as large as ``target``."""
    out = np.zeros((len(items), *target), kind)
    for k, x in enumerate(items):
        if x.ndim != len(target) or any(a > b for a, b in zip(x.shape, target, strict=True)):
            raise ShapeError(f"Shape: item {indices[k]} of shape {list(x.shape)} does not fit {list(target)}")
        out[(k, *map(slice, x.shape))] = x
    return out


def batch_row(epoch: int, step: int, values: np.ndarray, indices: list[int]) -> pa.RecordBatch:
    row = (epoch, step, len(indices), list(values.shape), indices, values.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, ARROW_SCHEMA, strict=True)], schema=ARROW_SCHEMA)


@dataclass
class _Steps(InputPartition):
    """Steps ``first`` to ``last`` - 1, counted through all epochs."""

    first: int
    last: int

    def __post_init__(self):
        InputPartition.__init__(self, None)


class _EpochReader(DataSourceStreamReader):
    def __init__(self, dataset: Dataset, options: StreamOptions, a_trigger: int, tasks: int):
        self.dataset, self.options, self.a_trigger, self.tasks = dataset, options, a_trigger, tasks
        self.n = len(dataset)
        self.steps = -(-self.n // options.batch_size) if options.batch_size else 0
        ends = [x for x in (options.max_steps, None if options.epochs is None else options.epochs * self.steps) if x is not None]
        self.end = min(ends) if ends else None
        self.at: int | None = None  # where the last micro-batch ended

    def _offset(self, step: int) -> dict:
        return {"epoch": 1 + step // self.steps, "step": step % self.steps} if self.steps else {"epoch": 1, "step": 0}

    def _step(self, offset: dict) -> int:
        return (offset["epoch"] - 1) * self.steps + offset["step"]

    def initialOffset(self):
        return self._offset(0)

    def latestOffset(self):
        self.at = (self.at or 0) + (self.a_trigger if self.steps else 0)
        if self.end is not None:
            self.at = min(self.at, self.end)
        return self._offset(self.at)

    def partitions(self, start, end):
        first, last = self._step(start), self._step(end)
        if self.at is None:  # a restart plans the last micro-batch of its checkpoint first
            self.at = last
        cuts = [first + (last - first) * k // self.tasks for k in range(self.tasks + 1)]
        return [_Steps(a, z) for a, z in zip(cuts, cuts[1:], strict=False) if a < z]

    def read(self, partition):
        kind, size = numpy_type(self.dataset.dtype), self.options.batch_size
        order = Permutation(self.n, self.options.seed) if self.options.shuffle else None
        for at in range(partition.first, partition.last):
            epoch, step = 1 + at // self.steps, at % self.steps
            places = np.arange(step * size, min((step + 1) * size, self.n))
            indices = (places if order is None else order.indices(places, epoch)).tolist()
            items = [item_of(self.dataset, i) for i in indices]
            if type(self.dataset).layout is Dataset.layout:  # the largest of each dimension: no item is made twice
                target = tuple(max(d) for d in zip(*(x.shape for x in items), strict=True))
            else:
                target = tuple(int(d) for d in self.dataset.layout(indices))
            yield batch_row(epoch, step, packed(items, indices, target, kind), indices)


def epoch_stream(
    spark: SparkSession, dataset: Dataset, options: StreamOptions, name: str = "gridweave_epochs", a_trigger: int = 64, tasks: int = 16
) -> DataFrame:
    """A streaming DataFrame of packed batches: epoch, step, n, shape, indices, data.

    ``a_trigger`` steps make a micro-batch, in ``tasks`` tasks; ``epochs`` None goes on for ever. An unseeded shuffle draws its seed here, so a
    query that should be restarted in another session needs a seed. Empty datasets and batch size 0 give nothing. An item that fails names itself.
    """
    seed = drawn_seed(options.seed) if options.shuffle else None
    options = StreamOptions(options.batch_size, options.epochs, options.shuffle, seed, options.max_steps, True)

    class Epochs(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return SCHEMA

        def streamReader(self, schema):
            return _EpochReader(dataset, options, a_trigger, tasks)

    spark.dataSource.register(Epochs)
    return spark.readStream.format(name).load()
