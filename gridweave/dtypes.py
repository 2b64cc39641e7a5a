"""The eight element types of tensors and how Spark stores them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class DType:
    """``spark`` is the element type of the array column; ``numpy`` the type of encoded bytes."""

    name: str
    code: int
    size: int
    spark: str
    numpy: str
    low: int | float
    high: int | float
    is_int: bool

    def array(self) -> str:
        return f"array<{self.spark}>"

    def __reduce__(self):
        return named, (self.name,)  # there is one of each, in workers too


def named(name: str) -> DType:
    return BY_NAME[name]


# Wire codes, widths and ranges (fixed values).
F16 = DType("f16", 0, 2, "float", "<f2", -65504.0, 65504.0, False)
F32 = DType("f32", 1, 4, "float", "<f4", -3.4028234663852886e38, 3.4028234663852886e38, False)
F64 = DType("f64", 2, 8, "double", "<f8", -1.7976931348623157e308, 1.7976931348623157e308, False)
BF16 = DType("bf16", 3, 2, "float", "<u2", -3.3895313892515355e38, 3.3895313892515355e38, False)
I8 = DType("i8", 4, 1, "tinyint", "<i1", -(2**7), 2**7 - 1, True)
I32 = DType("i32", 5, 4, "int", "<i4", -(2**31), 2**31 - 1, True)
I64 = DType("i64", 6, 8, "bigint", "<i8", -(2**63), 2**63 - 1, True)
U8 = DType("u8", 7, 1, "smallint", "<u1", 0, 255, True)

ALL = (F16, F32, F64, BF16, I8, I32, I64, U8)
BY_CODE = {d.code: d for d in ALL}
BY_NAME = {d.name: d for d in ALL}
HALVES = (F16, BF16)
#: Key of a column's metadata that holds its dtype's name.
METADATA = "tensor.dtype"


def bf16_bits(x: np.ndarray) -> np.ndarray:
    """Upper half of float32 patterns, rounded to nearest even; NaN stays NaN."""
    bits = np.asarray(x, np.float32).view(np.uint32)
    up = bits + np.uint32(0x7FFF) + ((bits >> np.uint32(16)) & np.uint32(1))
    quiet = (bits >> np.uint32(16)) | np.uint32(0x40)
    return np.where(np.isnan(np.asarray(x, np.float32)), quiet, up >> np.uint32(16)).astype(np.uint16)


def to_odd(x) -> np.ndarray:
    """float32 values of ``x``; one that is not exact is the neighbour with an odd last bit, so that rounding it once more is like rounding ``x`` once."""
    x = np.asarray(x, np.float64)
    near = x.astype(np.float32)
    over = np.isfinite(x) & (np.abs(near.astype(np.float64)) > np.abs(x))
    near = np.where(over, np.nextafter(near, np.float32(0)), near)
    inexact = np.isfinite(near) & (near.astype(np.float64) != x)
    return (near.view(np.uint32) | inexact.astype(np.uint32)).view(np.float32)


def bf16_values(bits: np.ndarray) -> np.ndarray:
    return (np.asarray(bits, np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def rounded(x, dtype: DType) -> np.ndarray:
    """float or int values as the dtype would hold them, rounded once, in float32 (float64 for F64)."""
    with np.errstate(over="ignore", invalid="ignore"):
        if dtype is F16:
            return np.asarray(x).astype(np.float16).astype(np.float32)
        if dtype is BF16:
            return bf16_values(bf16_bits(np.atleast_1d(to_odd(x)))).reshape(np.shape(x))
        return np.asarray(x).astype(np.float32 if dtype is F32 else np.float64)


def tagged(column, name: str, dtype: DType):
    """The column under ``name`` with its dtype in the metadata."""
    return column.cast(dtype.array()).alias(name, metadata={METADATA: dtype.name})


def tagged_bytes(column, name: str, dtype: DType):
    """A binary column of little-endian tensors under ``name`` with their dtype in the metadata."""
    return column.cast("binary").alias(name, metadata={METADATA: dtype.name})


def tagged_halves(column, name: str, dtype: DType):
    """An array<smallint> column of two-byte patterns (``functions.columns.packed_halves``) under ``name`` with its dtype in the metadata."""
    return column.cast("array<smallint>").alias(name, metadata={METADATA: dtype.name})


def dtype_of(df, name: str) -> DType:
    """A column's dtype from its metadata, else from its element type (never u8, f16 or bf16)."""
    field = df.schema[name]
    if METADATA in field.metadata:
        return BY_NAME[field.metadata[METADATA]]
    element = field.dataType.elementType.simpleString()
    return {"float": F32, "double": F64, "tinyint": I8, "int": I32, "bigint": I64}[element]
