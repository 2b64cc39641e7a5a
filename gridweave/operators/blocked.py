"""Tensors too large for a row: items in blocks (idx, block, tensor), transformed block by block, whole or not at all.

An element that must not occur is looked for in every block first; only the numbers of items that have one are brought together. Then every block is
transformed where it is, or stays as it was if any block of its item failed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridweave import dtypes as dt
from gridweave.dtypes import DType
from gridweave.operators.transforms import Transform


def in_blocks(items: DataFrame, size: int) -> DataFrame:
    """``items`` with a row for each ``size`` elements of a tensor: block (from 0) and tensor. An empty tensor is one empty block."""
    if size < 1:
        raise ValueError("a block holds at least one element")
    kind = items.schema["tensor"]
    last = F.greatest(F.ceil(F.size("tensor") / size) - 1, F.lit(0)).cast("bigint")
    rows = items.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    part = F.slice("tensor", (F.col("block") * size + 1).cast("int"), size)
    return rows.withColumn("tensor", part.alias("tensor", metadata=kind.metadata))


def in_one(blocks: DataFrame) -> DataFrame:
    """idx and tensor again, for items that fit into a row."""
    kind = blocks.schema["tensor"]
    parts = F.array_sort(F.collect_list(F.struct("block", "tensor")))
    whole = F.flatten(F.transform(parts, lambda r: r["tensor"]))
    return blocks.groupBy("idx").agg(whole.alias("tensor")).withColumn("tensor", F.col("tensor").alias("tensor", metadata=kind.metadata))


def failing_items(blocks: DataFrame, transform: Transform, dtype: DType) -> DataFrame | None:
    """idx of items with an element that the transform can't change; None for transforms that never fail."""
    bad = transform.resolve(dtype).bad
    return None if bad is None else blocks.where(F.exists("tensor", bad)).select("idx").distinct()


def apply_blocked(blocks: DataFrame, transform: Transform, dtype: DType | None = None, on_error: str = "raise") -> DataFrame:
    """``blocks(idx, block, tensor, ...)`` with transformed tensors.

    With ``on_error='flag'`` there is a column error, and items with a bad element in any block stay as they are in all; otherwise a bad element raises.
    Blocks are transformed where they are; the numbers of failing items are broadcast if they are few, joined otherwise.
    """
    dtype = dtype or dt.dtype_of(blocks, "tensor")
    kind = blocks.schema["tensor"].metadata
    if on_error != "flag":
        return blocks.withColumn("tensor", transform.apply(F.col("tensor"), dtype, on_error).alias("tensor", metadata=kind))
    failing = failing_items(blocks, transform, dtype)
    if failing is None:
        return blocks.withColumn("tensor", transform.apply(F.col("tensor"), dtype).alias("tensor", metadata=kind)).withColumn("error", F.lit(None).cast("string"))
    marked = blocks.join(failing.withColumn("error", F.lit("Overflow")), "idx", "left")
    each = transform.resolve(dtype).each
    changed = F.when(F.col("error").isNull(), F.transform("tensor", each)).otherwise(F.col("tensor"))
    return marked.withColumn("tensor", changed.alias("tensor", metadata=kind)).select(*blocks.columns, "error")
