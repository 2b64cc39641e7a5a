"""A user's batch layout as a table function: it sees each batch once, in order, and gives its padded rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType
from pyspark.sql.udtf import AnalyzeResult

from gridweave.streaming.epochs import packed

COLUMNS = ("epoch", "step", "pos_in_batch", "idx", "shape", "tensor")


def register_layout(spark: SparkSession, name: str, layout: Callable[[Sequence[int]], Sequence[int]]) -> None:
    """Makes ``name`` callable from SQL: ``name(TABLE(t) PARTITION BY (epoch, step) ORDER BY pos_in_batch)``.

    ``t`` has epoch, step, pos_in_batch, idx, shape and tensor; ``layout(indices)`` gives the shape of the batch's items. Rows come back with
    that shape and their tensors padded to it with zeros, in the type they had. An item that does not fit, or a table without these columns, is an error.
    """

    class Layout:
        @staticmethod
        def analyze(table) -> AnalyzeResult:
            if not table.isTable or [f.name for f in table.dataType] != list(COLUMNS):
                raise ValueError(f"a table with the columns {', '.join(COLUMNS)} is needed")
            out = StructType()
            for f in table.dataType:
                out = out.add(f.name, ArrayType(LongType()) if f.name == "shape" else f.dataType)
            return AnalyzeResult(out)

        def __init__(self):
            self.rows = []

        def eval(self, row):
            self.rows.append(row)

        def terminate(self):
            if not self.rows:
                return
            indices = [r["idx"] for r in self.rows]
            target = tuple(int(d) for d in layout(indices))
            items = [np.array(r["tensor"]).reshape(r["shape"]) for r in self.rows]
            for r, x in zip(self.rows, packed(items, indices, target, np.result_type(*items)), strict=True):
                yield r["epoch"], r["step"], r["pos_in_batch"], r["idx"], list(target), x.reshape(-1).tolist()

    spark.udtf.register(name, F.udtf(Layout))
