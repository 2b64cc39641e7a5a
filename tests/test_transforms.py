import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave import dtypes as dt
from gridweave.errors import ConversionFractional, ConversionInvalid, ConversionOverflow, InvalidParameter, UnsupportedDtype
from gridweave.operators.transforms import Add, AddOverflow, Chain, Clamp, ClampOverflow, Custom, IntRounding, Scale, Standardize


def run(spark, values, dtype, transform, on_error="raise"):
    df = spark.createDataFrame([(values,)], f"t {dtype.array()}")
    return df.select(transform.apply(F.col("t"), dtype, on_error).alias("x")).first().x


CASES = [
    (dt.F32, [1.0, 2.0, 3.0, 4.0], Add(0.5), [1.5, 2.5, 3.5, 4.5]),
    (dt.F64, [1.0, 2.0], Add(2), [3.0, 4.0]),
    (dt.F16, [1.0, 2.0, 3.0], Add(0.5), [1.5, 2.5, 3.5]),
    (dt.BF16, [1.0, 2.0, 3.0], Add(2), [3.0, 4.0, 5.0]),
    (dt.I8, [127, 126, 100], Add(1, AddOverflow.WRAP), [-128, 127, 101]),
    (dt.I8, [-128, -127, -100], Add(-1, AddOverflow.WRAP), [127, -128, -101]),
    (dt.U8, [0, 10, 100], Add(20), [20, 30, 120]),
    (dt.U8, [1, 2, 3], Add(-1), [0, 1, 2]),
    (dt.U8, [0, 255], Add(-1, AddOverflow.WRAP), [255, 254]),
    (dt.I32, [2**31 - 1, -(2**31)], Add(1, AddOverflow.WRAP), [-(2**31), -(2**31) + 1]),
    (dt.I64, [2**63 - 1, -(2**63), 5], Add(-6, AddOverflow.WRAP), [2**63 - 7, 2**63 - 6, -1]),
    (dt.F32, [-2.0, 0.0, 3.0], Scale(-2), [4.0, -0.0, -6.0]),
    (dt.U8, [0, 1, 10, 100], Scale(2), [0, 2, 20, 200]),
    (dt.I8, [-10, 0, 5, 50], Scale(2), [-20, 0, 10, 100]),
    (dt.F32, [-10.0, 0.0, 5.0, 10.0, 20.0], Clamp(0, 10), [0.0, 0.0, 5.0, 10.0, 10.0]),
    (dt.F16, [-10.0, 5.0, 20.0], Clamp(low=0), [0.0, 5.0, 20.0]),
    (dt.I8, [0, 1, 5, 10], Clamp(0.5, 5.5, rounding=IntRounding.FLOOR), [0, 1, 5, 5]),
    (dt.I8, [0, 1, 5, 10], Clamp(0.5, 5.5, rounding=IntRounding.CEIL), [1, 1, 5, 6]),
    (dt.I8, [0, 1, 5, 10], Clamp(0.5, 5.5, rounding=IntRounding.ROUND), [1, 1, 5, 6]),
    (dt.I8, [-128, 127], Clamp(-200, 100, overflow=ClampOverflow.CLAMP), [-128, 100]),
    (dt.I8, [3], Clamp(), [3]),
    (dt.F64, [1.0, 3.0, 5.0], Standardize(3, 2), [-1.0, 0.0, 1.0]),
    (dt.F32, [1.0, 3.0, 5.0], Standardize(3, -2), [1.0, -0.0, -1.0]),
    (dt.BF16, [1.0, 3.0, 5.0], Standardize(3, 2), [-1.0, 0.0, 1.0]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_values(spark, k):
    dtype, values, transform, want = CASES[k]
    got = run(spark, values, dtype, transform)
    assert list(map(repr, got)) == list(map(repr, want))


ALL_OR_NOTHING = [(dt.I8, [100, 120, 127], Add(10)), (dt.U8, [10, 127, 200], Scale(2)), (dt.I32, [2**31 - 1, 10], Scale(2)), (dt.I64, [2**63 - 1, 10], Scale(2))]


@pytest.mark.parametrize("dtype,values,transform", ALL_OR_NOTHING)
def test_overflow_leaves_the_tensor(spark, dtype, values, transform):
    got = run(spark, values, dtype, transform, "flag")
    assert got.tensor == values and got.error == "Overflow"
    with pytest.raises(Exception, match="Overflow"):
        run(spark, values, dtype, transform)


def test_nan_elements(spark):
    v = [math.nan, 0.0, 9.0]
    assert math.isnan(run(spark, v, dt.F64, Clamp(1, 5))[0])
    assert run(spark, v, dt.F64, Clamp(low=1)) == [1.0, 1.0, 9.0]
    assert run(spark, v, dt.F64, Clamp(high=5)) == [5.0, 0.0, 5.0]
    assert run(spark, v, dt.F16, Clamp(high=5)) == [5.0, 0.0, 5.0]


def test_add_zero_keeps_negative_zero(spark):
    assert repr(run(spark, [-0.0], dt.F64, Add(0))) == "[-0.0]"


@pytest.mark.parametrize(
    "make,error",
    [
        (lambda: Scale(2.5).resolve(dt.I8), ConversionFractional),
        (lambda: Scale(-1).resolve(dt.U8), ConversionOverflow),
        (lambda: Add(256).resolve(dt.U8), ConversionOverflow),
        (lambda: Add(math.nan).resolve(dt.I32), ConversionInvalid),
        (lambda: Add(1e6).resolve(dt.F16), ConversionOverflow),
        (lambda: Clamp(math.nan, 1), InvalidParameter),
        (lambda: Clamp(2, 1), InvalidParameter),
        (lambda: Clamp(0.5).resolve(dt.I8), ConversionFractional),
        (lambda: Clamp(-200).resolve(dt.I8), ConversionOverflow),
        (lambda: Clamp(-math.inf, overflow=ClampOverflow.CLAMP).resolve(dt.I8), ConversionInvalid),
        (lambda: Standardize(0, 0), InvalidParameter),
        (lambda: Standardize(math.inf, 1), InvalidParameter),
        (lambda: Standardize(0, 1e-100).resolve(dt.F32), InvalidParameter),
        (lambda: Standardize(0, 1).resolve(dt.I32), UnsupportedDtype),
        (lambda: Custom(lambda x: x, dtypes=[dt.F32]).resolve(dt.I8), UnsupportedDtype),
    ],
)
def test_plan_time_errors(make, error):
    with pytest.raises(error):
        make()


def test_chain_fuses_floats_and_keeps_the_first_error(spark):
    floats = Chain(Standardize(3, 2), Scale(2), Add(0), Clamp(-1, 1))
    assert len(floats.fused(dt.F32)) == 1
    assert run(spark, [1.0, 3.0, 5.0], dt.F32, floats) == [-1.0, 0.0, 1.0]
    ints = Chain(Add(100), Scale(2))
    got = run(spark, [10, 20], dt.I8, ints, "flag")
    assert got.tensor == [10, 20] and got.error == "Overflow"
    assert run(spark, [10, 20], dt.I8, Chain(Add(1), Scale(2)), "flag").tensor == [22, 42]
    assert run(spark, [1.0], dt.F16, Chain(Add(1), Scale(2))) == [4.0]


def test_custom(spark):
    square = Custom(lambda x: x * x, lambda x: x > 10)
    assert run(spark, [1.0, 3.0], dt.F64, square) == [1.0, 9.0]
    assert run(spark, [1.0, 30.0], dt.F64, square, "flag").error == "Overflow"


def test_wrapping_matches_numpy(spark):
    rng = np.random.RandomState(1)
    for dtype, kind in ((dt.I8, np.int8), (dt.I32, np.int32), (dt.I64, np.int64), (dt.U8, np.uint8)):
        low, high = (-255, 255) if dtype is dt.U8 else (dtype.low, dtype.high)
        x = [dtype.low, dtype.high, 0, 1, *(int(v) for v in rng.randint(-100 if dtype.low else 0, 100, 5))]
        for v in (low, high, 1, -1, 77):
            with np.errstate(over="ignore"):
                want = (np.array(x, kind) + np.array(v).astype(kind)).tolist()
            assert run(spark, x, dtype, Add(v, AddOverflow.WRAP)) == want


def test_elements_in_long_form(spark):
    df = spark.createDataFrame([(100,), (7,)], "x tinyint")
    assert [r.y for r in df.select(Add(20).element(F.col("x"), dt.I8).alias("y")).collect()] == [120, 27]
    with pytest.raises(Exception, match="Overflow"):
        df.select(Add(100).element(F.col("x"), dt.I8)).collect()
    with pytest.raises(UnsupportedDtype):
        Add(1).element(F.col("x"), dt.F16)


def test_custom_holds_to_the_dtype(spark):
    assert run(spark, [1.0], dt.F16, Custom(lambda x: x + F.lit(0.1))) == [float(dt.rounded(1.1, dt.F16))]
    assert run(spark, [1.0], dt.BF16, Custom(lambda x: x + F.lit(0.1))) == [float(dt.rounded(1.1, dt.BF16))]
    assert run(spark, [200, 3], dt.U8, Custom(lambda x: x.cast("int") * 2), "flag").error == "Overflow"
    assert run(spark, [100, 3], dt.U8, Custom(lambda x: x.cast("int") * 2), "flag").tensor == [200, 6]


@pytest.mark.parametrize("dtype", dt.HALVES, ids=lambda d: d.name)
def test_halves_match_numpy(spark, dtype):
    rng = np.random.RandomState(7)
    x = np.concatenate((rng.standard_normal(300) * 10.0 ** rng.randint(-9, 6, 300), 2.0 ** np.arange(-30, 16), [0.0, -0.0, 65504.0, 65519.9, 65520.0, 1e300, -1e300, 3.39e38]))
    x = np.concatenate((x, np.nextafter(x, np.inf), x * (1 + 2.0**-9), x * (1 + 2.0**-8), x * (1 + 2.0**-11), x * (1 + 2.0**-12 + 2.0**-40)))
    from gridweave.functions.columns import half_rounded

    got = [r.y for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(half_rounded(F.col("x"), dtype).alias("y")).collect()]
    want = dt.rounded(x, dtype)
    assert [repr(float(a)) for a in got] == [repr(float(b)) for b in want]


def test_one_rounding():
    from gridweave.functions.scalar import Scalar

    n = 2**53 + 2**29 + 1
    assert Scalar.of(n).to(dt.F32).value == Scalar.of(n).f32() == 9007200328482816.0
    assert float(dt.rounded(1 + 2.0**-8 + 2.0**-40, dt.BF16)) == 1 + 2.0**-7
    assert float(dt.rounded(1 + 2.0**-8, dt.BF16)) == 1.0
