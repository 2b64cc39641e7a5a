"""Element-wise transforms of tensor columns: Add, Scale, Clamp, Standardize.

A transform is resolved for a dtype when the plan is built: its parameters are converted and checked then, and what
is left is a map over the elements with, for checked integers, a test that must hold for no element.
A tensor either changes as a whole or, on an error, not at all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave import dtypes as dt
from gridweave.dtypes import DType
from gridweave.errors import ConversionFractional, ConversionOverflow, InvalidParameter, UnsupportedDtype
from gridweave.functions.columns import half_rounded, let
from gridweave.functions.scalar import Scalar, half_away

Element = Callable[[Column], Column]


class AddOverflow(Enum):
    ERROR = "error"
    WRAP = "wrap"


class ClampOverflow(Enum):
    ERROR = "error"
    CLAMP = "clamp"


class IntRounding(Enum):
    ERROR = "error"
    ROUND = "round"
    FLOOR = "floor"
    CEIL = "ceil"


@dataclass(frozen=True)
class Resolved:
    """``each`` maps an element (None: nothing to do); ``bad`` marks an element that must not occur."""

    each: Element | None = None
    bad: Element | None = None


class Transform:
    """Base of transforms; subclasses give ``resolve``."""

    def resolve(self, dtype: DType) -> Resolved:
        raise NotImplementedError

    def apply(self, tensor: Column, dtype: DType, on_error: str = "raise") -> Column:
        """The transformed array column; with ``on_error='flag'`` struct(tensor, error), unchanged tensor on an error."""
        r = self.resolve(dtype)
        out = tensor if r.each is None else F.transform(tensor, r.each)
        bad = None if r.bad is None else F.exists(tensor, r.bad)
        if on_error == "flag":
            error = F.lit(None).cast("string") if bad is None else F.when(bad, "Overflow")
            return F.struct((out if bad is None else F.when(bad, tensor).otherwise(out)).alias("tensor"), error.alias("error"))
        return out if bad is None else F.when(bad, F.raise_error("Overflow")).otherwise(out)

    def element(self, x: Column, dtype: DType) -> Column:
        """The transform of a plain number column, for data in long form; a bad element raises. Not for F16 and BF16."""
        if dtype in dt.HALVES:
            raise UnsupportedDtype
        r = self.resolve(dtype)
        out = x if r.each is None else r.each(x)
        return out if r.bad is None else F.when(r.bad(x), F.raise_error("Overflow")).otherwise(out)


def _lit(value, dtype: DType) -> Column:
    return F.lit(value).cast(dtype.spark)


def _in_half(op: Element, dtype: DType) -> Resolved:
    """``op`` works in single precision; its result is rounded to the dtype."""
    return Resolved(lambda x: half_rounded(op(x.cast("float")).cast("float"), dtype))


def _wrapped(x: Column, v: int, dtype: DType) -> Column:
    """x + v modulo the dtype's width."""
    if dtype is dt.U8:
        return F.pmod(x.cast("int") + v, F.lit(256)).cast("smallint")
    wide = "decimal(20,0)" if dtype is dt.I64 else "bigint"
    low, span = F.lit(str(-dtype.low)).cast(wide), F.lit(str(dtype.high - dtype.low + 1)).cast(wide)
    return (F.pmod(x.cast(wide) + F.lit(str(v)).cast(wide) + low, span) - low).cast(dtype.spark)


class Add(Transform):
    """x + value; a value that is zero changes nothing, for any dtype."""

    def __init__(self, value, overflow: AddOverflow = AddOverflow.ERROR):
        self.value, self.overflow = Scalar.of(value), overflow

    def resolve(self, dtype: DType) -> Resolved:
        if self.value.is_zero:
            return Resolved()
        if dtype is dt.U8:
            v = self.value.to(dt.I32).value
            if not -255 <= v <= 255:
                raise ConversionOverflow
            if self.overflow is AddOverflow.WRAP:
                return Resolved(lambda x: _wrapped(x, v, dtype))
            total = lambda x: x.cast("int") + v
            return Resolved(lambda x: total(x).cast("smallint"), lambda x: ~total(x).between(0, 255))
        v = self.value.to(dtype).value
        if dtype in dt.HALVES:
            return _in_half(lambda x: x + _lit(v, dtype), dtype)
        if not dtype.is_int:
            return Resolved(lambda x: (x + _lit(v, dtype)).cast(dtype.spark))
        if self.overflow is AddOverflow.WRAP:
            return Resolved(lambda x: _wrapped(x, v, dtype))
        total = lambda x: F.try_add(x, _lit(v, dtype))
        return Resolved(total, lambda x: total(x).isNull())


class Scale(Transform):
    """x * factor; the factor must be exact in an integer dtype."""

    def __init__(self, factor):
        self.factor = Scalar.of(factor)

    def resolve(self, dtype: DType) -> Resolved:
        v = self.factor.to(dtype).value
        if dtype in dt.HALVES:
            return _in_half(lambda x: x * _lit(v, dtype), dtype)
        if not dtype.is_int:
            return Resolved(lambda x: (x * _lit(v, dtype)).cast(dtype.spark))
        if dtype is dt.U8:
            product = lambda x: x.cast("int") * v
            return Resolved(lambda x: product(x).cast("smallint"), lambda x: ~product(x).between(0, 255))
        product = lambda x: F.try_multiply(x, _lit(v, dtype))
        return Resolved(product, lambda x: product(x).isNull())


class Clamp(Transform):
    """Elements held between optional bounds."""

    def __init__(self, low=None, high=None, rounding: IntRounding = IntRounding.ERROR, overflow: ClampOverflow = ClampOverflow.ERROR):
        self.low, self.high = Scalar.option(low), Scalar.option(high)
        self.rounding, self.overflow = rounding, overflow
        if any(b is not None and b.is_nan for b in (self.low, self.high)):
            raise InvalidParameter("a bound is NaN")
        if self.low is not None and self.high is not None and self.high < self.low:
            raise InvalidParameter("the upper bound is below the lower")

    def bound(self, b: Scalar | None, dtype: DType):
        """A bound's value in the dtype, rounded and saturated as the options say."""
        if b is None:
            return None
        try:
            return b.to(dtype).value
        except ConversionFractional:
            if self.rounding is IntRounding.ERROR:
                raise
            fit = {IntRounding.ROUND: half_away, IntRounding.FLOOR: math.floor, IntRounding.CEIL: math.ceil}[self.rounding]
            try:
                return Scalar.of(float(fit(b.value))).to(dtype).value
            except ConversionOverflow:
                if self.overflow is ClampOverflow.ERROR:
                    raise
        except ConversionOverflow:
            if self.overflow is ClampOverflow.ERROR:
                raise
        return dtype.low if b.f64() < float(dtype.low) else dtype.high

    def resolve(self, dtype: DType) -> Resolved:
        low, high = self.bound(self.low, dtype), self.bound(self.high, dtype)
        if low is None and high is None:
            return Resolved()
        lo = None if low is None else _lit(low, dtype)
        hi = None if high is None else _lit(high, dtype)
        if dtype.is_int:
            held = lambda x: x if hi is None else F.least(x, hi)
            return Resolved(lambda x: held(x) if lo is None else F.greatest(held(x), lo))
        if lo is None:  # the smaller of NaN and a bound is the bound
            held = lambda x: F.least(x, hi)
        elif hi is None:
            held = lambda x: F.when(F.isnan(x), lo).otherwise(F.greatest(x, lo))
        else:
            held = lambda x: F.when(F.isnan(x), x).otherwise(F.greatest(F.least(x, hi), lo))
        return _in_half(held, dtype) if dtype in dt.HALVES else Resolved(held)


class Standardize(Transform):
    """(x - mean) / std with given mean and std; float dtypes only."""

    def __init__(self, mean, std):
        self.mean, self.std = Scalar.of(mean), Scalar.of(std)
        if not self.mean.is_finite or not self.std.is_finite or self.std.is_zero:
            raise InvalidParameter("mean and std must be finite and std not zero")

    def resolve(self, dtype: DType) -> Resolved:
        if dtype.is_int:
            raise UnsupportedDtype
        mean, std = self.mean.to(dtype), self.std.to(dtype)
        if std.is_zero:
            raise InvalidParameter("std is zero in the dtype")
        m, s = mean.value, std.value
        if dtype in dt.HALVES:
            return _in_half(lambda x: half_rounded((x - _lit(m, dtype)).cast("float"), dtype) / _lit(s, dtype), dtype)
        return Resolved(lambda x: ((x - _lit(m, dtype)).cast(dtype.spark) / _lit(s, dtype)).cast(dtype.spark))


class Custom(Transform):
    """A user's transform: ``each`` maps an element column, ``bad`` marks elements that are errors.

    Results are rounded to F16 and BF16 like those of the other transforms; integers that the dtype can't hold are errors.
    """

    def __init__(self, each: Element, bad: Element | None = None, dtypes: Sequence[DType] = dt.ALL):
        self.each, self.bad, self.dtypes = each, bad, tuple(dtypes)

    def resolve(self, dtype: DType) -> Resolved:
        if dtype not in self.dtypes:
            raise UnsupportedDtype
        if not dtype.is_int:
            if dtype in dt.HALVES:
                return Resolved(lambda x: half_rounded(self.each(x), dtype), self.bad)
            return Resolved(lambda x: self.each(x).cast(dtype.spark), self.bad)
        beyond = lambda y: (y < F.lit(dtype.low)) | (y > F.lit(dtype.high))
        bad = lambda x: F.coalesce(let(self.each(x), beyond), F.lit(False)) | (F.lit(False) if self.bad is None else self.bad(x))
        return Resolved(lambda x: let(self.each(x), lambda y: F.when(~beyond(y), y)).cast(dtype.spark), bad)


def _then(f, g):
    return lambda x: g(f(x))


class Chain(Transform):
    """Transforms one after another; neighbours without checks are fused into one pass over the array."""

    def __init__(self, *steps: Transform):
        self.steps = steps

    def fused(self, dtype: DType) -> list[Resolved]:
        out: list[Resolved] = []
        for step in self.steps:
            r = step.resolve(dtype)
            if r.each is None:
                continue
            if out and dtype not in dt.HALVES and out[-1].bad is None and r.bad is None:
                out[-1] = Resolved(_then(out[-1].each, r.each))
            else:
                out.append(r)
        return out

    def apply(self, tensor: Column, dtype: DType, on_error: str = "raise") -> Column:
        """The first error wins, and the tensor is then the chain's input."""
        now, error = tensor, F.lit(None).cast("string")
        for r in self.fused(dtype):
            one = _One(r).apply(now, dtype, on_error)
            if on_error == "flag":
                error = F.coalesce(error, one["error"])
                now = one["tensor"]
            else:
                now = one
        if on_error == "flag":
            return F.struct(F.when(error.isNull(), now).otherwise(tensor).alias("tensor"), error.alias("error"))
        return now


class _One(Transform):
    def __init__(self, resolved: Resolved):
        self.resolved = resolved

    def resolve(self, dtype: DType) -> Resolved:
        return self.resolved
