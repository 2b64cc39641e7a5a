"""Consumption of a stream by many workers at once: one barrier stage, a rank a task.

Every step belongs to one rank, dealt in turn. Items are shuffled straight to the rank that needs them and packed there, and the user's function gets
numpy batches in the task itself: nothing passes through the driver. All ranks start together, and none begins an epoch before all have ended the one before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave import dtypes as dt
from gridweave.plans.flow import StreamOptions, drawn_seed
from gridweave.streaming.batches import Batch, Layout, filler, placed_items

#: What a rank does with its batches: (rank, batches) -> Arrow batches of results.
Work = Callable[[int, Iterator[Batch]], Iterable[pa.RecordBatch]]


def sharded(items: DataFrame, options: StreamOptions, ranks: int, work: Work, schema: str, layout: Layout | None = None) -> DataFrame:
    """What ``work(rank, batches)`` yields on each of ``ranks`` workers, as rows of ``schema``.

    A rank gets the steps whose number, counted through all epochs, leaves its own when divided by ``ranks``, in order. The cluster needs ``ranks`` free
    slots at once; if a rank fails, the stage begins anew with all of them. A rank need not take all its batches. Endless streams can't be sharded.
    """
    if ranks < 1:
        raise ValueError("there is at least one rank")
    dtype, seed = dt.dtype_of(items, "tensor"), drawn_seed(options.seed) if options.shuffle else None
    options = StreamOptions(options.batch_size, options.epochs, options.shuffle, seed, options.max_steps, options.arithmetic)
    rows = placed_items(items, options, layout, items.count())
    rank = F.pmod("global_step", F.lit(ranks)).cast("int")
    rows = rows.repartitionById(ranks, rank).sortWithinPartitions("global_step", "pos_in_batch")
    fill, epochs = filler(dtype), options.epochs

    def run(batches):
        context = BarrierTaskContext.get()
        mine = context.partitionId()
        if len(context.allGather(str(mine))) != ranks:
            raise RuntimeError(f"{ranks} ranks were asked for")
        epoch = 1

        def together():
            nonlocal epoch
            for b in fill(batches):
                while epoch < b.epoch:
                    context.barrier()
                    epoch += 1
                yield b

        yield from work(mine, together())
        while epoch <= epochs:  # a rank without steps, or one that stopped early, holds nobody up
            context.barrier()
            epoch += 1

    return rows.mapInArrow(run, schema, barrier=True)
