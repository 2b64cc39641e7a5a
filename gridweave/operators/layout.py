"""Tensor layouts as column expressions: sizes, strides, strided views, slices, slots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.dtypes import DType
from gridweave.errors import BufferOverflow, InvalidShape, InvalidSlot


def long_array(values: Sequence[int]) -> Column:
    return F.array(*(F.lit(v).cast("bigint") for v in values)) if values else F.array().cast("array<bigint>")


def total_elements(shape: Column) -> Column:
    """Product of the dimensions; 1 for an empty shape."""
    return F.aggregate(shape.cast("array<bigint>"), F.lit(1).cast("bigint"), lambda a, d: a * d)


def total_bytes(shape: Column, dtype: DType) -> Column:
    return total_elements(shape) * dtype.size


def row_major_strides(shape: Column) -> Column:
    """Strides in elements: each the product of the later dimensions."""
    n = F.size(shape)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda k: total_elements(F.slice(shape, k + 1, F.greatest(n - k, F.lit(0)))),
        )
    )


def batch_strides(item_shape: Column, as_shipped: bool = False) -> Column:
    """Strides of a batch of items: [item elements, *item strides]; ``as_shipped`` gives [*item strides, 1]."""
    own = row_major_strides(item_shape)
    one = F.array(F.lit(1).cast("bigint"))
    return F.concat(own, one) if as_shipped else F.concat(F.array(total_elements(item_shape)), own)


def view_span(shape: Column, strides: Column) -> Column:
    """Elements that a view needs: one more than its largest offset."""
    reach = F.zip_with(shape.cast("array<bigint>"), strides.cast("array<bigint>"), lambda d, s: (d - 1) * s)
    return F.aggregate(reach, F.lit(1).cast("bigint"), lambda a, x: a + x)


def strided_view(flat: Column, shape: Column, strides: Column) -> Column:
    """The view's elements in row-major order; raises 'InvalidShape' or 'Shape' for a view that can't be."""
    steps = row_major_strides(shape)
    index = F.sequence(F.lit(0).cast("bigint"), F.greatest(total_elements(shape) - 1, F.lit(0).cast("bigint")))

    def offset(k: Column) -> Column:
        parts = F.zip_with(
            F.zip_with(shape.cast("array<bigint>"), steps, lambda d, e: F.struct(d.alias("d"), e.alias("e"))),
            strides.cast("array<bigint>"),
            lambda x, s: (F.floor(k / x["e"]) % x["d"]) * s,
        )
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a + x)

    seen = F.transform(index, lambda k: F.element_at(flat, (offset(k) + 1).cast("int")))
    return (
        F.when(F.size(shape) != F.size(strides), F.raise_error("InvalidShape"))
        .when(F.exists(shape, lambda d: d <= 0), F.raise_error("InvalidShape"))
        .when(view_span(shape, strides) > F.size(flat), F.raise_error("Shape"))
        .otherwise(seen)
    )


def item_slice(flat: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` elements from ``start`` (from 0); raises 'BufferOverflow' beyond the end."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(start + length > F.size(flat), F.raise_error("BufferOverflow")).otherwise(F.slice(flat, start + 1, length))


def capacity_error(shape: Column, count: Column, dtype: DType, capacity: int) -> Column:
    """'BufferOverflow' where a batch of ``count`` items needs more bytes than there are."""
    return F.when(total_bytes(shape, dtype) * count > capacity, "BufferOverflow")


def check_layout(shape: Sequence[int], strides: Sequence[int], dtype: DType, capacity: int | None = None, count: int = 1) -> None:
    """The same checks for a layout that is known when the plan is built."""
    if len(shape) != len(strides) or any(d <= 0 for d in shape):
        raise InvalidShape(f"shape {list(shape)}, strides {list(strides)}")
    n = dtype.size * count
    for d in shape:
        n *= d
    if capacity is not None and n > capacity:
        raise BufferOverflow(capacity, n)


#: Alignment of slots (fixed value).
RECORD = 64


def round_slot(size: int, record: int = RECORD) -> int:
    """The slot size rounded up to whole records."""
    return -(-size // record) * record


def check_slots(count: int, size: int, record: int = RECORD) -> None:
    if count <= 0:
        raise InvalidSlot("no slots")
    if size <= 0 or size % record:
        raise InvalidSlot(f"size {size} is not a multiple of {record}")


def slot_plan(size: Column, count: int, head: Column, base: int = 192, record: int = RECORD) -> Column:
    """struct(slot_size, slot, offset) of the slot that batch ``head`` takes in a ring of ``count``."""
    rounded = (F.ceil(size / record) * record).cast("bigint")
    slot = F.pmod(head, F.lit(count)).cast("bigint")
    return F.struct(rounded.alias("slot_size"), slot.alias("slot"), (slot * rounded + base).alias("offset"))
