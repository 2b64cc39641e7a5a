"""Batches of a stream of items, across micro-batches: the rows that fill no whole batch wait in the state store.

Items are dealt to lanes by a hash of their idx; each lane makes its own batches, so a stream is batched by as many tasks as there are lanes. What
waits is state like any other: it is versioned with the checkpoint, restored after a restart, and lies in no folder of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _plain(value):
    """A value as the state store takes it: no numpy types."""
    return value.tolist() if isinstance(value, (np.ndarray, np.generic)) else value


class _Batcher(StatefulProcessor):
    """Keeps a lane's waiting rows and the number of steps it has given."""

    def __init__(self, item: StructType, batch_size: int):
        self.item, self.batch_size = item, batch_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.item)
        self.steps = handle.getValueState("steps", StructType([StructField("steps", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.item.names
        # a micro-batch that is run again must give the same batches: its rows are taken by idx
        new = sorted((tuple(map(_plain, r)) for frame in rows for r in frame[names].itertuples(index=False, name=None)), key=lambda r: r[0])
        held = [tuple(map(_plain, r)) for r in self.waiting.get()] + new
        first = self.steps.get()[0] if self.steps.exists() else 0
        whole = len(held) // self.batch_size
        if whole:
            given = held[: whole * self.batch_size]
            out = pd.DataFrame({n: [r[k] for r in given] for k, n in enumerate(names)})
            out.insert(0, "lane", key[0])
            out.insert(1, "step", [first + k // self.batch_size for k in range(len(given))])
            out.insert(2, "pos_in_batch", [k % self.batch_size for k in range(len(given))])
            yield out
            self.steps.update((first + whole,))
        rest = held[whole * self.batch_size :]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def batched_across(stream: DataFrame, batch_size: int, lanes: int = 8) -> DataFrame:
    """``stream(idx, ...)``, a streaming DataFrame, as lane, step (from 0 in each lane), pos_in_batch and its own columns, in whole batches only.

    A lane's rows of one micro-batch are in memory at once. Rows come in order of the micro-batches and, in one, of idx. What waits when a query is stopped
    is given by the next one with the same checkpoint once enough has come; ``spark.read.format('statestore')`` shows it.
    """
    if batch_size < 1 or lanes < 1:
        raise ValueError("a batch holds at least one item, and there is at least one lane")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    columns = ["idx", *(c for c in stream.columns if c != "idx")]
    rows = stream.select(F.pmod(F.xxhash64("idx"), F.lit(lanes)).cast("int").alias("lane"), *columns)
    item = StructType([StructField(f.name, f.dataType) for f in stream.select(*columns).schema])
    out = StructType([StructField("lane", IntegerType()), StructField("step", LongType()), StructField("pos_in_batch", LongType()), *item])
    return rows.groupBy("lane").transformWithStateInPandas(_Batcher(item, batch_size), out, "Append", "None")
