"""The transforms and conversions by name from SQL text: temporary SQL functions, which Spark inlines like any expression.

Arrays change as a whole: ``tensor_<op>_<dtype>`` raises 'Overflow' where an integer element leaves its type, ``try_tensor_<op>_<dtype>`` gives
a struct of the unchanged tensor and the error's name instead.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridweave import dtypes as dt
from gridweave.dtypes import DType

#: Dtypes that have SQL functions: those whose column type can do their arithmetic. Halves go through FLOAT and ``half_bits_*``.
NAMED = (dt.F32, dt.F64, dt.I8, dt.U8, dt.I32, dt.I64)


def _wide(dtype: DType) -> str:
    """A type in which a sum or product of two elements can't overflow."""
    return "DECIMAL(38,0)" if dtype is dt.I64 else "BIGINT"


def _bounded(name: str, dtype: DType, more: str, value: str) -> list[str]:
    """A checked function over arrays and its flagging twin; ``value`` is the new element in terms of x, in a wide type for integers."""
    array = f"ARRAY<{dtype.spark}>"
    args = f"t {array}, {more}"
    done = f"transform(t, x -> cast({value} AS {dtype.spark}))"
    if not dtype.is_int:
        return [f"{name}_{dtype.name}({args}) RETURNS {array} RETURN {done}"]
    bad = f"exists(t, x -> {value} NOT BETWEEN {dtype.low} AND {dtype.high})"
    flagged = f"CASE WHEN {bad} THEN named_struct('tensor', t, 'error', 'Overflow') ELSE named_struct('tensor', {done}, 'error', cast(null AS STRING)) END"
    return [
        f"{name}_{dtype.name}({args}) RETURNS {array} RETURN CASE WHEN {bad} THEN raise_error('Overflow') ELSE {done} END",
        f"try_{name}_{dtype.name}({args}) RETURNS STRUCT<tensor: {array}, error: STRING> RETURN {flagged}",
    ]


def _transforms(dtype: DType) -> list[str]:
    wide = _wide(dtype) if dtype.is_int else dtype.spark
    x, kind = f"cast(x AS {wide})", dtype.spark
    # parameters of the checked integer functions are taken as wide as sums and products are
    param = "BIGINT" if dtype.is_int else kind
    out = _bounded("tensor_add", dtype, f"v {param}", f"{x} + cast(v AS {wide})") + _bounded("tensor_scale", dtype, f"v {param}", f"{x} * cast(v AS {wide})")
    if dtype.is_int:
        span = dtype.high - dtype.low + 1
        turned = "DECIMAL(38,0)"
        value = f"pmod(cast(x AS {turned}) + cast(v AS {turned}) - ({dtype.low}BD), {span}BD) + ({dtype.low}BD)"
        out.append(f"tensor_add_wrap_{dtype.name}(t ARRAY<{kind}>, v BIGINT) RETURNS ARRAY<{kind}> RETURN transform(t, x -> cast({value} AS {kind}))")
        value = "greatest(least(x, high), low)"
    else:
        # NaN stays NaN between two limits
        value = "CASE WHEN isnan(x) THEN x ELSE greatest(least(x, high), low) END"
        out.append(
            f"tensor_standardize_{dtype.name}(t ARRAY<{kind}>, mean {kind}, deviation {kind}) RETURNS ARRAY<{kind}> "
            f"RETURN CASE WHEN deviation = 0 OR isnan(deviation) THEN raise_error('InvalidValue') ELSE transform(t, x -> cast((x - mean) / nullif(deviation, 0) AS {kind})) END"
        )
    out.append(f"tensor_clamp_{dtype.name}(t ARRAY<{kind}>, low {kind}, high {kind}) RETURNS ARRAY<{kind}> RETURN transform(t, x -> {value})")
    return out


def _conversion(dtype: DType) -> str:
    error = (
        "CASE WHEN isnan(x) OR abs(x) = double('Infinity') THEN 'InvalidValue' WHEN x <> rint(x) THEN 'FractionalValue' "
        f"WHEN x > {float(dtype.high)!r}D OR x < {float(dtype.low)!r}D THEN 'Overflow' END"
    )
    value = f"cast(cast(CASE WHEN {error} IS NULL THEN x END AS BIGINT) AS {dtype.spark})"
    return f"to_{dtype.name}(x DOUBLE) RETURNS STRUCT<value: {dtype.spark}, error: STRING> RETURN named_struct('value', {value}, 'error', {error})"


def definitions() -> list[str]:
    """The functions, each as text behind CREATE TEMPORARY FUNCTION."""
    return [f for d in NAMED for f in _transforms(d)] + [_conversion(d) for d in NAMED if d.is_int]


def register(spark: SparkSession) -> list[str]:
    """Creates all functions in a session and gives their names."""
    for text in definitions():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    return [d.partition("(")[0] for d in definitions()]
