"""Ordered iteration over batches on the driver, and batches of a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave import dtypes as dt
from gridweave.dtypes import DType
from gridweave.plans import flow
from gridweave.plans.flow import StreamOptions
from gridweave.sources import codec
from gridweave.sources.tensor_files import store_of, write_file
from gridweave.streaming.epochs import SCHEMA, batch_row, numpy_type, packed

Layout = Callable[[Sequence[int]], Sequence[int]]


@dataclass(frozen=True)
class Batch:
    """``values`` has the items' type in numpy (bfloat16, which numpy lacks, as float32) and shape (items, *largest item)."""

    epoch: int
    step: int
    values: np.ndarray
    indices: np.ndarray


def shaped_items(items: DataFrame, dtype: DType) -> DataFrame:
    """idx, shape and tensor; without a shape column tensors have one dimension."""
    size = F.size("tensor") if items.schema["tensor"].dataType.typeName() == "array" else F.length("tensor") / dtype.size
    shape = F.col("shape").cast("array<bigint>") if "shape" in items.columns else F.array(size.cast("bigint"))
    return items.select("idx", shape.alias("shape"), "tensor")


def packed_batches(items: DataFrame, options: StreamOptions, layout: Layout | None = None, first: int = 1) -> DataFrame:
    """epoch, step, n, shape (of the batch), indices and data: one row a batch, its items as bytes, one after another.

    ``items`` has idx, tensor (an array, or little-endian bytes, which are not unpacked on the way and suit large tensors) and, unless all tensors
    are one-dimensional, shape. Items are padded with zeros to the batch's largest shape or to
    what ``layout(indices)`` says; ranks must not differ in a batch. Tensors are joined to their places and moved to their batch, each once;
    a task fills one batch at a time. Partitions are in order of (epoch, step), and so are their rows. Epochs are numbered from ``first`` on.
    """
    n = items.count()
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = max(1, flow.total_steps(n, options))
    part = F.floor(F.col("global_step") * parts / steps).cast("int")
    rows = placed_items(items, options, layout, n, first).repartitionById(parts, part).sortWithinPartitions("global_step", "pos_in_batch")
    return rows.mapInArrow(packer(dt.dtype_of(items, "tensor")), SCHEMA)


def placed_items(items: DataFrame, options: StreamOptions, layout: Layout | None, n: int, first: int = 1) -> DataFrame:
    """global_step, epoch, step, pos_in_batch, idx, shape, max_shape and tensor of every item of a stream."""
    items = shaped_items(items, dt.dtype_of(items, "tensor"))
    places = flow.placed(items.select("idx", "shape") if layout is None else items.select("idx"), options, n, first)
    places = flow.with_layout(places, ["shape"]).drop("shape") if layout is None else flow.with_user_layout(places, layout)
    return places.join(items, "idx").select("global_step", "epoch", "step", "pos_in_batch", "idx", "shape", "max_shape", "tensor")


def filler(dtype: DType):
    """A function from Arrow batches of placed items, in order of their steps, to ``Batch`` after ``Batch``."""
    kind = numpy_type(dtype)

    def filled(held: list) -> Batch:
        _, epoch, step, _, _, target, _ = held[0]
        indices = [h[3] for h in held]
        return Batch(epoch, step, packed([h[6].reshape(h[4]) for h in held], indices, tuple(target), kind), np.array(indices, np.int64))

    def numbers(tensor: pa.Scalar) -> np.ndarray:
        if isinstance(tensor, pa.ListScalar) and dtype in dt.HALVES and pa.types.is_int16(tensor.type.value_type):  # packed_halves
            raw = tensor.values.to_numpy(zero_copy_only=False).view(np.uint16)
            return dt.bf16_values(raw) if dtype is dt.BF16 else raw.view("<f2")
        if isinstance(tensor, pa.ListScalar):
            return tensor.values.to_numpy(zero_copy_only=False).astype(kind, copy=False)
        x = np.frombuffer(tensor.as_buffer(), dtype.numpy)
        return dt.bf16_values(x) if dtype is dt.BF16 else x

    def run(batches):
        held: list = []
        for b in batches:
            names = ("global_step", "epoch", "step", "idx", "shape", "max_shape")
            for row, tensor in zip(zip(*(b.column(n).to_pylist() for n in names), strict=True), b.column("tensor"), strict=True):
                if held and held[0][0] != row[0]:
                    yield filled(held)
                    held = []
                held.append((*row, numbers(tensor)))
        if held:
            yield filled(held)

    return run


def packer(dtype: DType):
    """The same for ``mapInArrow``: rows of ``SCHEMA``."""
    fill = filler(dtype)

    def run(batches):
        for b in fill(batches):
            yield batch_row(b.epoch, b.step, b.values, b.indices.tolist())

    return run


def written_batches(items: DataFrame, options: StreamOptions, folder: str, layout: Layout | None = None, first: int = 1) -> list[tuple[str, int, int]]:
    """Packs batches like ``packed_batches``, straight into tensor files of a shared ``folder``: (file, place and size of its index), in order of steps.

    A batch is two tensors: its values (idx 0) and its items' numbers (idx -1). A task writes one file; what failed attempts leave is not in the list.
    """
    dtype, n = dt.dtype_of(items, "tensor"), items.count()
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("global_step") * parts / max(1, flow.total_steps(n, options))).cast("int")
    rows = placed_items(items, options, layout, n, first).repartitionById(parts, part).sortWithinPartitions("global_step", "pos_in_batch")
    fill = filler(dtype)
    stored = dt.F32 if dtype is dt.BF16 else dtype

    def encoded(batches):
        for b in fill(batches):
            both = []
            for x, kind in ((b.values, stored), (b.indices, dt.I64)):
                strides = [int(np.prod(x.shape[k + 1 :], dtype=np.int64)) for k in range(x.ndim)]
                both.append(codec.encode([], x.shape, strides, kind) + x.tobytes())
            yield pa.RecordBatch.from_pydict({"epoch": pa.array([b.epoch] * 2, pa.int32()), "step": pa.array([b.step] * 2), "idx": pa.array([0, -1]), "value": pa.array(both, pa.binary())})

    def run(batches):
        for name, _, _, at, size, *_ in write_file(folder, encoded(batches)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "file": [name], "at": pa.array([at]), "size": pa.array([size])})

    found = rows.mapInArrow(run, "part int, file string, at long, size long").collect()
    return [(r.file, r["at"], r["size"]) for r in sorted(found, key=lambda r: r.part)]


def mapped_batches(folder: str, files: list[tuple[str, int, int]]) -> Iterator[Batch]:
    """The batches of ``written_batches``, mapped into memory, not read, where the folder is on a local disk; a file goes when its batches are given."""
    store, root = store_of(folder)
    for name, at, size in files:
        path = f"{root}/{name}"
        if isinstance(store, LocalFileSystem):
            with pa.memory_map(path) as f:
                raw = f.read_buffer()
        else:
            with store.open_input_file(path) as f:
                raw = f.read_buffer()
        with pa.ipc.open_stream(raw.slice(at, size)) as stream:
            index = stream.read_all().to_pylist()
        store.delete_file(path)  # what is mapped stays
        for values, ids in zip(index[::2], index[1::2], strict=True):
            arrays = []
            for r in (values, ids):
                kind, _, shape, _, start, data, _ = codec.parse(r["head"])
                arrays.append(np.frombuffer(raw, dt.BY_NAME[kind].numpy, data // dt.BY_NAME[kind].size, r["at"] + start).reshape(shape))
            yield Batch(values["epoch"], values["step"], *arrays)


class BatchStream:
    """Iterates over a stream epoch by epoch; each iteration over the object is the next epoch, without end where ``epochs`` is None.

    ``items`` has idx, tensor and, unless all tensors are one-dimensional, shape, of any rank; ``layout(indices)`` may give the item
    shape of a batch. Every epoch has a plan of its own; the seed of an unseeded shuffle is drawn once.

    With a ``folder`` that the driver and all executors share, an epoch's batches are written there by the executors and mapped into the driver's
    memory: they go through no socket and are not copied. The folder then needs room for an epoch. Otherwise rows are fetched, a partition ahead.
    """

    def __init__(self, items: DataFrame, options: StreamOptions, dims: int | None = None, layout: Layout | None = None, folder: str | None = None):
        self.folder = folder
        self.items, self.options, self.layout, self.epoch, self.steps = items, options, layout, 0, 0
        self.dtype = dt.dtype_of(items, "tensor")
        if dims is not None and dims > 1 and "shape" not in items.columns:
            raise ValueError("tensors of several dimensions need a shape")
        self.seed = flow.drawn_seed(options.seed) if options.shuffle else None

    def epoch_batches(self, epoch: int) -> Iterator[Batch]:
        """The batches of one epoch in order."""
        once = StreamOptions(self.options.batch_size, 1, self.options.shuffle, self.seed, arithmetic=self.options.arithmetic)
        if self.folder is not None:
            for b in mapped_batches(self.folder, written_batches(self.items, once, self.folder, self.layout, epoch)):
                if self.options.max_steps is not None and self.steps >= self.options.max_steps:
                    return
                self.steps += 1
                yield b
            return
        plan = packed_batches(self.items, once, self.layout, epoch)
        for r in plan.toLocalIterator(prefetchPartitions=True):
            if self.options.max_steps is not None and self.steps >= self.options.max_steps:
                return
            self.steps += 1
            yield Batch(epoch, r.step, np.frombuffer(bytes(r.data), numpy_type(self.dtype)).reshape(r.shape), np.array(r.indices, np.int64))

    def __iter__(self) -> Iterator[Batch]:
        self.epoch += 1
        if self.options.epochs is not None and self.epoch > self.options.epochs:
            return iter(())
        return self.epoch_batches(self.epoch)


def stream_batches(
    spark: SparkSession, path: str, schema, batch_size: int, sink: Callable[[DataFrame, int], None], checkpoint: str, key: str = "idx", files: int = 1,
    across: bool = False,
):
    """Starts a query that numbers and batches the new files' rows and gives each micro-batch to ``sink``.

    Backpressure is ``files`` a trigger; the checkpoint folder makes restarts go on where the query stopped. Each micro-batch is an epoch of its
    own, whose last batch may be short; with ``across``, its rows that fill no whole batch wait for the next one, in a folder beside the
    checkpoint's: ``epoch`` is 0 throughout, steps count on, and what waits at the end is given by ``waiting_rows``.
    """

    def numbered(df: DataFrame, first: int) -> DataFrame:
        rows = flow.with_index(df, key, "pos") if not df.isEmpty() else df.withColumn("pos", F.lit(0).cast("bigint"))
        return rows.withColumn("pos", F.col("pos") + first)

    def each(df: DataFrame, number: int) -> None:
        sink(flow.with_batches(numbered(df, 0).withColumn("epoch", F.lit(number)), batch_size), number)

    def each_across(df: DataFrame, number: int) -> None:
        before, first = None, 0
        if number > 0:
            before = spark.read.parquet(f"{checkpoint}-waiting/{number - 1}")
            first = (before.agg(F.max("pos")).first()[0] if not before.isEmpty() else -1) + 1
        start = first // batch_size * batch_size
        rows = numbered(df, first)
        if before is not None:
            rows = before.where(F.col("pos") >= start).unionByName(rows)
        last = rows.agg(F.max("pos")).first()[0]
        total = first if last is None else last + 1
        end = total // batch_size * batch_size
        sink(flow.with_batches(rows.where(F.col("pos") < end).withColumn("epoch", F.lit(0)), batch_size), number)
        # the last row given stays, too, where nothing waits, so that positions go on
        kept = rows if before is None else before.where(F.col("pos") < start).unionByName(rows)
        kept.where(F.col("pos") >= end - 1).write.mode("overwrite").parquet(f"{checkpoint}-waiting/{number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    done = each_across if across else each
    return source.writeStream.foreachBatch(done).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def waiting_rows(spark: SparkSession, checkpoint: str, number: int, batch_size: int) -> DataFrame:
    """The rows, with their positions, that fill no whole batch after micro-batch ``number`` of a stream ``across`` micro-batches."""
    rows = spark.read.parquet(f"{checkpoint}-waiting/{number}")
    last = rows.agg(F.max("pos")).first()[0]
    return rows.where(F.col("pos") >= (0 if last is None else (last + 1) // batch_size * batch_size))
