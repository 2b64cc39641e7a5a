import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from gridweave import dtypes as dt
from gridweave.errors import ConversionFractional, ConversionInvalid, ConversionOverflow
from gridweave.functions.scalar import Scalar, half_away, promoted

INTS = [dt.I8, dt.I32, dt.I64, dt.U8]


@pytest.mark.parametrize("source", INTS)
@pytest.mark.parametrize("target", INTS)
def test_int_to_int_is_range_checked(source, target):
    for v in (source.low, source.high, 0, 1):
        s = Scalar.of(v, source)
        if target.low <= v <= target.high:
            assert s.to(target).value == v
        else:
            with pytest.raises(ConversionOverflow):
                s.to(target)


@pytest.mark.parametrize("target", INTS)
def test_float_to_int_errors_in_order(target):
    for v in (math.nan, math.inf, -math.inf):
        with pytest.raises(ConversionInvalid):
            Scalar.of(v).to(target)
    for v in (0.5, -1.25):
        with pytest.raises(ConversionFractional):
            Scalar.of(v).to(target)
    with pytest.raises(ConversionOverflow):
        Scalar.of(1e300).to(target)
    assert Scalar.of(5.0).to(target).value == 5


def test_two_to_the_63_saturates():
    assert Scalar.of(2.0**63).to(dt.I64).value == dt.I64.high
    with pytest.raises(ConversionOverflow):
        Scalar.of(2.0**63 * 1.01).to(dt.I64)


def test_halves():
    assert Scalar.of(65504.0).to(dt.F16).value == 65504.0
    with pytest.raises(ConversionOverflow):
        Scalar.of(70000.0).to(dt.F16)
    with pytest.raises(ConversionOverflow):
        Scalar.of(70000, dt.I32).to(dt.F16)
    assert math.isinf(Scalar.of(math.inf).to(dt.F16).value)
    assert Scalar.of(math.nan).to(dt.BF16).is_nan
    assert math.isinf(Scalar.of(1e30, dt.BF16).to(dt.F16).value)  # unchecked between halves
    assert math.isinf(Scalar.of(1e300).to(dt.F32).value)


@given(st.floats(width=32, allow_nan=False, allow_infinity=False))
def test_bf16_rounds_to_nearest_even(x):
    got = float(dt.rounded(x, dt.BF16))
    if math.isinf(got):
        assert abs(x) > dt.BF16.high
        return
    bits = int(dt.bf16_bits(np.array([x], np.float32))[0])
    near = [float(dt.bf16_values(np.array([b & 0xFFFF], np.uint16))[0]) for b in (bits - 1, bits + 1)]
    assert all(abs(got - x) <= abs(n - x) for n in near if math.isfinite(n))


PROMOTIONS = {
    ("u8", "i8"): "i32", ("u8", "i32"): "i32", ("i8", "i32"): "i32", ("u8", "i64"): "i64", ("i32", "i64"): "i64",
    ("u8", "f32"): "f32", ("i8", "f32"): "f32", ("i32", "f32"): "f32", ("f16", "f32"): "f32", ("i64", "f32"): "f64",
    ("f16", "bf16"): "f32", ("f64", "i8"): "f64", ("f64", "f16"): "f64", ("i64", "f16"): "f32", ("i8", "bf16"): "f32",
}


@pytest.mark.parametrize("pair", PROMOTIONS)
def test_promotion_is_symmetric(pair):
    a, b = (dt.BY_NAME[n] for n in pair)
    assert promoted(a, b) is promoted(b, a) is dt.BY_NAME[PROMOTIONS[pair]]


def test_arithmetic():
    assert (Scalar.of(200, dt.U8) + Scalar.of(100, dt.I8)).value == 300
    assert (Scalar.of(-7, dt.I8) / Scalar.of(2, dt.I8)).value == -3
    with pytest.raises(ConversionOverflow):
        Scalar.of(127, dt.I8) + Scalar.of(1, dt.I8)
    with pytest.raises(ZeroDivisionError):
        Scalar.of(1) / Scalar.of(0)
    assert (Scalar.of(1.0) / Scalar.of(0.0)).is_infinite
    assert (Scalar.of(1, dt.I64) + Scalar.of(0.5, dt.F32)).dtype is dt.F64
    assert (-Scalar.of(5, dt.U8)).dtype is dt.I32
    assert (~Scalar.of(5, dt.U8)).value == 250
    assert (~Scalar.of(5, dt.I8)).value == -6
    assert (~Scalar.of(2.5)).value == 2.5


def test_comparison():
    nan = Scalar.of(math.nan)
    assert not nan == nan and not nan < nan and not nan >= nan
    assert Scalar.of(2**53 + 1, dt.I64) == Scalar.of(float(2**53))  # through doubles
    assert Scalar.of(3, dt.U8) < Scalar.of(4, dt.I64)
    assert Scalar.of(-0.0).is_zero and not nan.is_zero


@given(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e6, max_value=1e6))
def test_half_away(x):
    want = math.floor(abs(x) + 0.5) if abs(x) % 1 != 0.49999999999999994 else math.floor(abs(x))
    assert half_away(x) == math.copysign(want, x) or abs(half_away(x) - x) <= 0.5
    assert half_away(2.5) == 3 and half_away(-2.5) == -3
