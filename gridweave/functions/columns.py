"""Scalar functions over columns: checked conversion, promoted arithmetic, comparison.

A value of dtype U8 is a SMALLINT column; F16 and BF16 are FLOAT columns that hold only values of the dtype.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave import dtypes as dt
from gridweave.dtypes import DType
from gridweave.functions.scalar import promoted

INF = float("inf")


def _flagged(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def whole(x: Column) -> Column:
    """Whether a finite double has no fraction."""
    return x == F.rint(x)


def float_to_int(x: Column, dtype: DType) -> Column:
    """struct(value, error) of a checked conversion; not finite, then fractional, then out of range."""
    x = x.cast("double")
    error = (
        F.when(F.isnan(x) | (F.abs(x) == INF), "InvalidValue")
        .when(~whole(x), "FractionalValue")
        .when((x > float(dtype.high)) | (x < float(dtype.low)), "Overflow")
    )
    # a bigint cast of 2^63 saturates, as the conversion does
    return _flagged(F.when(error.isNull(), x).cast("bigint").cast(dtype.spark), error)


def int_to_int(x: Column, dtype: DType) -> Column:
    wide = x.cast("decimal(20,0)")
    error = F.when((wide > F.lit(dtype.high).cast("decimal(20,0)")) | (wide < F.lit(dtype.low).cast("decimal(20,0)")), "Overflow")
    return _flagged(F.when(error.isNull(), x).cast(dtype.spark), error)


def to_float(x: Column, dtype: DType) -> Column:
    """Lossy conversion to F32 or F64, rounded once; never fails."""
    return x.cast(dtype.spark)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Bits of the fraction and smallest exponent of the half precision types.
FRACTION = {dt.F16: (10, -14), dt.BF16: (7, -126)}


def half_rounded(x: Column, dtype: DType) -> Column:
    """A number as F16 or BF16 would hold it, rounded once to the nearest, ties to even; beyond the range infinite."""
    bits, least = FRACTION[dtype]

    def near(v: Column) -> Column:
        size = F.abs(v)
        exponent = F.floor(F.log2(size)).cast("double")
        # just below a power of two the logarithm may say the power: that rounds to the power either way
        step = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(float(least))) - bits)
        return let(F.rint(v / step) * step, lambda r: F.when(F.abs(r) > dtype.high, F.when(r > 0, INF).otherwise(-INF)).otherwise(r))

    plain = lambda v: (v == 0) | F.isnan(v) | (F.abs(v) == INF)
    return let(x.cast("double"), lambda v: F.when(plain(v), v).otherwise(near(v))).cast("float")


def to_half(x: Column, dtype: DType) -> Column:
    """struct(value, error) of a conversion to F16 or BF16 from a wider type."""
    wide = x.cast("double")
    error = F.when(~F.isnan(wide) & (F.abs(wide) != INF) & (F.abs(wide) > dtype.high), "Overflow")
    return _flagged(half_rounded(x, dtype), error)


def half_bits(x: Column, dtype: DType) -> Column:
    """The two bytes of a number as F16 or BF16, rounded to nearest even, as a SMALLINT; every NaN has the same, null stays null."""
    bits, least = FRACTION[dtype]
    top = 1 << bits

    def finite(size: Column) -> Column:
        # halves are far enough below a power of two for the logarithm's error, and a little more, to be told apart from it
        exponent = F.greatest(F.floor(F.log2(size) + 1e-6), F.lit(least))
        whole = lambda e: (size / F.pow(F.lit(2.0), e - bits)).cast("int")
        number = lambda e: let(whole(e), lambda m: F.when(m < top, m).otherwise((e - least + 1).cast("int") * top + m - top))
        return let(exponent, number)

    all_ones = (1 << 15) - top  # the exponent of infinity and NaN

    def pattern(v: Column) -> Column:
        size = F.abs(v)
        number = F.when(F.isnan(v), all_ones + top // 2).when(size == INF, all_ones).when(size == 0, 0).otherwise(finite(F.when((size > 0) & (size < INF), size).otherwise(1.0)))
        minus = F.when(v == 0, v.cast("string").startswith("-")).otherwise((v < 0) & ~F.isnan(v))
        return F.when(v.isNotNull(), F.when(minus, number - (1 << 15)).otherwise(number)).cast("smallint")

    return let(half_rounded(x, dtype).cast("double"), pattern)


def half_value(pattern: Column, dtype: DType) -> Column:
    """The FLOAT that two bytes (a SMALLINT) of F16 or BF16 stand for."""
    bits, least = FRACTION[dtype]
    top = 1 << bits

    def value(b: Column) -> Column:
        exponent, fraction = F.shiftright(b, bits).bitwiseAND((1 << (15 - bits)) - 1), b.bitwiseAND(top - 1)
        normal = (fraction + top) * F.pow(F.lit(2.0), (exponent + (least - bits - 1)).cast("double"))
        special = F.when(fraction == 0, F.lit(INF)).otherwise(F.lit(float("nan")))
        size = F.when(exponent == (1 << (15 - bits)) - 1, special).when(exponent == 0, fraction * F.lit(2.0 ** (least - bits))).otherwise(normal)
        return F.when(b.bitwiseAND(1 << 15) != 0, -size).otherwise(size).cast("float")

    return let(pattern.cast("int"), value)


def packed_halves(tensor: Column, dtype: DType) -> Column:
    """An array of F16 or BF16 numbers at its size: array<smallint> of their two bytes."""
    return F.transform(tensor, lambda x: half_bits(x, dtype))


def unpacked_halves(tensor: Column, dtype: DType) -> Column:
    """The array<float> of what ``packed_halves`` gives."""
    return F.transform(tensor, lambda x: half_value(x, dtype))


def is_nan(x: Column, dtype: DType) -> Column:
    """Whether a number is NaN; of null, as in SQL, that is not known."""
    return F.lit(False) if dtype.is_int else F.when(x.isNotNull(), F.isnan(x))


def is_infinite(x: Column, dtype: DType) -> Column:
    return F.lit(False) if dtype.is_int else F.abs(x) == INF


def is_finite(x: Column, dtype: DType) -> Column:
    return F.lit(True) if dtype.is_int else ~F.isnan(x) & (F.abs(x) != INF)


def is_zero(x: Column) -> Column:
    return x == 0


def _quotient(a: Column, b: Column) -> Column:
    """IEEE division of doubles: zero divisors give infinities or NaN instead of an error."""
    negative = b.cast("string").startswith("-") != (a < 0)
    by_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(negative, -INF).otherwise(INF)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def arithmetic(op: str, a: Column, a_type: DType, b: Column, b_type: DType) -> tuple[Column, DType]:
    """Promoted ``a op b`` and its dtype; integer overflow and division by zero raise."""
    kind = promoted(a_type, b_type)
    a, b = a.cast(kind.spark), b.cast(kind.spark)
    if not kind.is_int:
        out = _quotient(a.cast("double"), b.cast("double")) if op == "/" else {"+": a + b, "-": a - b, "*": a * b}[op]
        return out.cast(kind.spark), kind
    if kind is dt.U8:
        a, b = a.cast("int"), b.cast("int")
    if op == "/":
        out = F.call_function("div", a, b)
        over = F.lit(False) if kind is dt.U8 else (a == kind.low) & (b == -1)
        return F.when(over, F.raise_error("Overflow")).otherwise(out).cast(kind.spark), kind
    out = {"+": a + b, "-": a - b, "*": a * b}[op]
    if kind is dt.U8:
        out = F.when(out.between(0, 255), out).otherwise(F.raise_error("Overflow"))
    return out.cast(kind.spark), kind


def negated(x: Column, dtype: DType) -> tuple[Column, DType]:
    if dtype is dt.U8:
        return -x.cast("int"), dt.I32
    return (-x).cast(dtype.spark), dtype


def complement(x: Column, dtype: DType) -> Column:
    if not dtype.is_int:
        return x
    return (255 - x).cast("smallint") if dtype is dt.U8 else F.bitwise_not(x)


def compare(op: str, a: Column, a_type: DType, b: Column, b_type: DType) -> Column:
    """Comparison: like types as they are, others as doubles; NaN is unordered and unequal."""
    if a_type is not b_type:
        a, b = a.cast("double"), b.cast("double")
    out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "=": a == b}[op]
    if a_type.is_int and b_type.is_int:
        return out
    return out & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))
