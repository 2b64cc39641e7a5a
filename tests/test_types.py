"""Halves in two bytes, transforms from SQL text, tensors in blocks, layouts as a table function."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave import dtypes as dt
from gridweave import queries as tensors
from gridweave.functions import columns as C
from gridweave.functions.sql import NAMED, register
from gridweave.operators.blocked import apply_blocked, failing_items, in_blocks, in_one
from gridweave.operators.transforms import Add, AddOverflow, Clamp, Scale, Standardize
from gridweave.plans.flow import StreamOptions
from gridweave.streaming.batches import BatchStream
from gridweave.streaming.layout_function import register_layout
from tests.oracle import compare


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- halves ---


@pytest.mark.parametrize("dtype", dt.HALVES, ids=lambda d: d.name)
def test_every_pattern_comes_back(spark, dtype):
    df = spark.range(-32768, 32768).select(F.col("id").cast("smallint").alias("bits"))
    df = df.withColumn("value", C.half_value(F.col("bits"), dtype)).withColumn("again", C.half_bits(F.col("value"), dtype))
    assert "Python" not in plan(df)
    rows = df.collect()
    raw = np.array([r.bits for r in rows], np.int16).view(np.uint16)
    want = (dt.bf16_values(raw) if dtype is dt.BF16 else raw.view(np.float16)).astype(np.float64)
    for r, w in zip(rows, want.tolist(), strict=True):
        if math.isnan(w):
            assert math.isnan(r.value) and r.again == ((1 << 15) - (1 << C.FRACTION[dtype][0]) + (1 << C.FRACTION[dtype][0] >> 1))
        else:
            assert r.value == w and math.copysign(1, r.value) == math.copysign(1, w) and r.again == r.bits, r


@pytest.mark.parametrize("dtype", dt.HALVES, ids=lambda d: d.name)
def test_numbers_become_halves(spark, dtype):
    rng = np.random.RandomState(4)
    x = np.r_[rng.standard_normal(3000) * 10.0 ** rng.randint(-42, 6, 3000), 2.0 ** np.arange(-150, 100), -(2.0 ** np.arange(-30, 16)) * (1 + 2**-11), 65519.9, 65520.0, 3.4e38].astype(np.float32)
    got = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "k int, x float").select("k", C.half_bits(F.col("x"), dtype).alias("b")).orderBy("k").collect()
    with np.errstate(over="ignore"):
        want = dt.bf16_bits(x) if dtype is dt.BF16 else x.astype(np.float16).view(np.uint16)
    assert [r.b for r in got] == want.view(np.int16).tolist()


@pytest.mark.parametrize("dtype", dt.HALVES, ids=lambda d: d.name)
def test_batches_of_packed_halves(spark, dtype):
    items = spark.range(7).select(F.col("id").alias("idx"), F.array(F.col("id") / 2, F.lit(-1.5)).cast("array<float>").alias("tensor"))
    packed = items.select("idx", dt.tagged_halves(C.packed_halves(F.col("tensor"), dtype), "tensor", dtype))
    assert packed.schema["tensor"].dataType.simpleString() == "array<smallint>"
    wide = items.select("idx", dt.tagged(F.col("tensor"), "tensor", dtype))
    for a, b in zip(BatchStream(packed, StreamOptions(3)), BatchStream(wide, StreamOptions(3)), strict=True):
        assert a.values.dtype == b.values.dtype and np.array_equal(a.values, b.values)
    back = packed.select("idx", C.unpacked_halves(F.col("tensor"), dtype).alias("t")).collect()
    assert {r.idx: r.t for r in back} == {k: [k / 2, -1.5] for k in range(7)}


def test_halves_of_tiny_numbers_like_sql(spark, tmp_path):
    """Numbers that round to negative zero, which tables with few vectors don't hold, and null."""
    rows = [(0, [-1e-9, 1e-9, -0.0, 0.0, -2.0**-25, -2.0**-24, None, -1e-44]), (1, [-1e-41, -6e-8, 1.5, -1.5, 65504.0, None, 3e-8, -3e-8])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "embeddings.parquet")
    compare(spark, str(tmp_path), "codec_half_bits", tensors.queries(), tensors.oracle_sql())
    got = spark.range(1).select(C.half_bits(F.lit(-1e-9), dt.F16).alias("bits"), C.half_bits(F.lit(None).cast("float"), dt.F16).alias("none")).first()
    assert (got.bits, got.none) == (-32768, None)  # the conversion itself keeps the sign


@pytest.mark.parametrize("name", ["sc_to_f16", "sc_to_bf16", "sc_float_class"])
def test_null_numbers_like_sql(spark, tmp_path, name):
    rows = [(1, k, 1, 1, q, p) for k in range(1, 8) for q, p in ((None, None), (3.0, -0.0), (3.0, 65519.9), (3.0, -1e-9))]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"
    spark.createDataFrame(rows, names).coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    compare(spark, str(tmp_path), name, tensors.queries(), tensors.oracle_sql())


# --- SQL text ---


def test_functions_by_name(spark):
    names = register(spark)
    assert {f"tensor_add_{d.name}" for d in NAMED} <= set(names) and "to_u8" in names
    for d in NAMED:
        values = [d.low, 0, 3, d.high] if d.is_int else [-2.5, 0.0, 3.0, 1e30]
        spark.createDataFrame([(0, values), (1, [1, 2, 3] if d.is_int else [1.0, math.nan, 3.0])], f"idx int, tensor {d.array()}").createOrReplaceTempView("named_items")
        df = spark.table("named_items")
        t, flag = F.col("tensor"), "flag"

        def same(text, column, df=df):
            found = spark.sql(f"SELECT idx, {text} AS r FROM named_items")
            assert "Python" not in plan(found)
            want = {r.idx: r.r for r in df.select("idx", column.alias("r")).collect()}
            assert repr({r.idx: r.r for r in found.collect()}) == repr(want), text

        if d.is_int:
            for v in (5, -5, 120):
                same(f"try_tensor_add_{d.name}(tensor, {v})", Add(v).apply(t, d, flag))
                if v >= d.low:  # a factor is a value of the dtype
                    same(f"try_tensor_scale_{d.name}(tensor, {v})", Scale(v).apply(t, d, flag))
                same(f"tensor_add_wrap_{d.name}(tensor, {v})", Add(v, AddOverflow.WRAP).apply(t, d))
            same(f"tensor_clamp_{d.name}(tensor, 1, 100)", Clamp(1, 100).apply(t, d))
            with pytest.raises(Exception, match="Overflow"):
                spark.sql(f"SELECT tensor_add_{d.name}(tensor, 1) FROM named_items").collect()
        else:
            same(f"tensor_add_{d.name}(tensor, 0.5)", Add(0.5).apply(t, d))
            same(f"tensor_scale_{d.name}(tensor, 1.5)", Scale(1.5).apply(t, d))
            same(f"tensor_clamp_{d.name}(tensor, -1, 2)", Clamp(-1, 2).apply(t, d))
            same(f"tensor_standardize_{d.name}(tensor, 0.5, 2)", Standardize(0.5, 2).apply(t, d))
            with pytest.raises(Exception, match="InvalidValue"):
                spark.sql(f"SELECT tensor_standardize_{d.name}(tensor, 0, 0) FROM named_items").collect()


def test_conversions_by_name(spark):
    register(spark)
    x = [0.0, -0.0, 1.5, 127.0, 128.0, -129.0, 2.0**31, 2.0**63, -(2.0**63), math.nan, math.inf, 300.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "k int, x double")
    df.createOrReplaceTempView("numbers")
    for d in NAMED:
        if d.is_int:
            got = spark.sql(f"SELECT k, to_{d.name}(x) AS r FROM numbers ORDER BY k").collect()
            want = df.select("k", C.float_to_int(F.col("x"), d).alias("r")).orderBy("k").collect()
            assert [(r.k, r.r.value, r.r.error) for r in got] == [(r.k, r.r.value, r.r.error) for r in want]


# --- blocks ---


def test_blocks_are_changed_together_or_not_at_all(spark):
    rng = np.random.RandomState(6)
    rows = [(k, rng.randint(0, 60 if k % 3 else 40, n).tolist()) for k, n in enumerate([0, 1, 7, 8, 9, 100, 1000, 64, 63, 65])]
    items = spark.createDataFrame(rows, "idx long, tensor array<smallint>")
    items = items.select("idx", dt.tagged(F.col("tensor"), "tensor", dt.U8))
    blocks = in_blocks(items, 8)
    assert blocks.groupBy("idx").agg(F.max(F.size("tensor")).alias("m")).where("m > 8").count() == 0
    assert {r.idx: r.tensor for r in in_one(blocks).collect()} == dict(rows)
    for transform in (Scale(5), Add(200), Add(0), Clamp(3, 50), Add(250, AddOverflow.WRAP)):
        whole = items.select("idx", transform.apply(F.col("tensor"), dt.U8, "flag").alias("r")).collect()
        done = apply_blocked(blocks, transform, on_error="flag")
        assert dt.dtype_of(done, "tensor") is dt.U8
        assert {r.idx: r.tensor for r in in_one(done).collect()} == {r.idx: r.r.tensor for r in whole}
        assert {(r.idx, r.error) for r in done.collect()} == {(r.idx, r.r.error) for r in whole}
    assert failing_items(blocks, Clamp(3, 50), dt.U8) is None
    with pytest.raises(Exception, match="Overflow"):
        apply_blocked(blocks, Scale(5)).collect()
    assert in_one(apply_blocked(blocks, Scale(2))).count() == 10


# --- layouts ---


def test_layout_function(spark):
    register_layout(spark, "one_wider", lambda indices: [2, 1 + max(indices) % 3 + 2])
    rows = [(1, k // 3, k % 3, k, [1 + k % 2, 1 + k % 3], [float(k)] * ((1 + k % 2) * (1 + k % 3))) for k in range(8)]
    names = "epoch int, step long, pos_in_batch long, idx long, shape array<long>, tensor array<double>"
    spark.createDataFrame(rows, names).createOrReplaceTempView("laid_out")
    text = "SELECT * FROM one_wider(TABLE({}) PARTITION BY (epoch, step) ORDER BY pos_in_batch)"
    got = spark.sql(text.format("laid_out")).collect()
    assert len(got) == 8
    for r in got:
        last = min(3 * r.step + 2, 7)
        shape = [2, 3 + max(range(3 * r.step, last + 1)) % 3]
        want = np.zeros(shape)
        want[: 1 + r.idx % 2, : 1 + r.idx % 3] = r.idx
        assert r["shape"] == shape and r.tensor == want.reshape(-1).tolist()
    register_layout(spark, "too_small", lambda indices: [1, 1])
    with pytest.raises(Exception, match="Shape"):
        spark.sql(text.replace("one_wider", "too_small").format("laid_out")).collect()
    spark.range(3).createOrReplaceTempView("not_laid_out")
    with pytest.raises(Exception, match="columns"):
        spark.sql("SELECT * FROM one_wider(TABLE(not_laid_out) PARTITION BY id)").collect()


def test_a_batch_of_many_items_is_laid_out_by_grouping(spark):
    from gridweave.plans import flow

    items = spark.range(8000).select(F.col("id").alias("idx"), F.array(1 + F.col("id") % 5, 1 + F.col("id") % 7).alias("shape"))
    out = flow.batches(items, StreamOptions(8000), ["shape"])
    assert out.select("max_shape").distinct().collect()[0].max_shape == [5, 7]
    assert "Window" not in plan(out)
    empty = items.limit(3).withColumn("shape", F.array().cast("array<bigint>"))
    assert flow.batches(empty, StreamOptions(2), ["shape"]).select("max_shape").distinct().collect()[0].max_shape == []
