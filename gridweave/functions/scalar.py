"""Dynamically typed numbers: checked conversion, promotion, arithmetic and comparison.

Parameters of transforms are scalars, so all of this runs when a plan is built.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

from gridweave import dtypes as dt
from gridweave.dtypes import DType
from gridweave.errors import ConversionFractional, ConversionInvalid, ConversionOverflow


def _number(s: "Scalar"):
    """The value as numpy converts it: an integer goes to a float type in one step."""
    return np.int64(s.value) if s.dtype.is_int else float(s.value)


@dataclass(frozen=True, eq=False)
class Scalar:
    """A number and its dtype; ``value`` is a Python int or float that the dtype can hold."""

    value: int | float
    dtype: DType

    @staticmethod
    def of(value, dtype: DType | None = None) -> Scalar:
        """A scalar from a number: ints are I64 and floats F64 unless a dtype is given."""
        if isinstance(value, Scalar):
            return value if dtype is None else value.to(dtype)
        if dtype is None:
            dtype = dt.I64 if isinstance(value, (int, np.integer)) else dt.F64
        if dtype.is_int:
            value = int(value)
            if not dtype.low <= value <= dtype.high:
                raise ConversionOverflow
            return Scalar(value, dtype)
        return Scalar(float(dt.rounded(float(value), dtype)), dtype)

    @staticmethod
    def option(value, dtype: DType | None = None) -> Scalar | None:
        return None if value is None else Scalar.of(value, dtype)

    def to(self, dtype: DType) -> Scalar:
        """Checked conversion: exact for ints, range-checked for halves, lossy for F32 and F64."""
        x, source = self.value, self.dtype
        if dtype.is_int:
            if not source.is_int:
                if not math.isfinite(x):
                    raise ConversionInvalid
                if x != math.floor(x):
                    raise ConversionFractional
                # 2^63 passes for I64 and saturates
                if x > float(dtype.high) or x < float(dtype.low):
                    raise ConversionOverflow
                return Scalar(min(int(x), dtype.high), dtype)
            if not dtype.low <= x <= dtype.high:
                raise ConversionOverflow
            return Scalar(x, dtype)
        if dtype in dt.HALVES and source not in dt.HALVES and not (not source.is_int and not math.isfinite(x)):
            if not dtype.low <= x <= dtype.high:
                raise ConversionOverflow
        return Scalar(float(dt.rounded(_number(self), dtype)), dtype)

    def f64(self) -> float:
        return float(self.value)

    def f32(self) -> float:
        return float(dt.rounded(_number(self), dt.F32))

    @property
    def is_nan(self) -> bool:
        return not self.dtype.is_int and math.isnan(self.value)

    @property
    def is_finite(self) -> bool:
        return self.dtype.is_int or math.isfinite(self.value)

    @property
    def is_infinite(self) -> bool:
        return not self.dtype.is_int and math.isinf(self.value)

    @property
    def is_zero(self) -> bool:
        return self.value == 0

    @property
    def is_whole(self) -> bool:
        """Whether a finite value has no fraction."""
        return self.is_finite and self.value == math.floor(self.value)

    def _arith(self, other, op: str) -> Scalar:
        other = Scalar.of(other)
        kind = promoted(self.dtype, other.dtype)
        if kind.is_int:
            a, b = int(self.value), int(other.value)
            if op == "/":
                if b == 0:
                    raise ZeroDivisionError("integer division by zero")
                n = abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
            else:
                n = a + b if op == "+" else a - b if op == "-" else a * b
            if not kind.low <= n <= kind.high:
                raise ConversionOverflow
            return Scalar(n, kind)
        work = np.float64 if kind is dt.F64 else np.float32
        a, b = work(self.value), work(other.value)
        with np.errstate(all="ignore"):
            x = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else np.divide(a, b)
        return Scalar(float(dt.rounded(x, kind)), kind)

    def __add__(self, other):
        return self._arith(other, "+")

    def __sub__(self, other):
        return self._arith(other, "-")

    def __mul__(self, other):
        return self._arith(other, "*")

    def __truediv__(self, other):
        return self._arith(other, "/")

    def __neg__(self) -> Scalar:
        if self.dtype is dt.U8:
            return Scalar(-self.value, dt.I32)
        return Scalar.of(-self.value, self.dtype)

    def __invert__(self) -> Scalar:
        """Bit complement of ints; floats stay as they are."""
        if not self.dtype.is_int:
            return self
        return Scalar(255 - self.value if self.dtype is dt.U8 else ~self.value, self.dtype)

    def _pair(self, other) -> tuple:
        other = Scalar.of(other)
        if self.dtype is other.dtype:
            return self.value, other.value
        return self.f64(), other.f64()

    def __eq__(self, other) -> bool:
        a, b = self._pair(other)
        return a == b

    def __lt__(self, other) -> bool:
        a, b = self._pair(other)
        return a < b

    def __le__(self, other) -> bool:
        a, b = self._pair(other)
        return a <= b

    def __gt__(self, other) -> bool:
        a, b = self._pair(other)
        return a > b

    def __ge__(self, other) -> bool:
        a, b = self._pair(other)
        return a >= b

    __hash__ = None


def promoted(a: DType, b: DType) -> DType:
    """The dtype of arithmetic between two dtypes; symmetric."""
    if a is b:
        return a
    both = {a, b}
    if dt.F64 in both or both == {dt.I64, dt.F32}:
        return dt.F64
    if all(d.is_int for d in both):
        return dt.I64 if dt.I64 in both else dt.I32
    return dt.F32


def half_away(x: float) -> float:
    """Rounds to the nearest whole number, halves away from zero."""
    if not math.isfinite(x) or abs(x) >= 2.0**52:
        return x
    return float(Decimal(x).quantize(Decimal(1), rounding=ROUND_HALF_UP))
