import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweave import dtypes as dt
from gridweave import queries as tensors
from gridweave.errors import BufferOverflow, InvalidShape, InvalidSlot, MalformedMessage, ProtocolError
from gridweave.operators import layout as L
from gridweave.plans import flow
from gridweave.plans.flow import StreamOptions
from gridweave.sources import codec
from gridweave.sources.dataset import Dataset, check_dense, check_values, is_empty, length, read_dataset
from gridweave.streaming.batches import BatchStream, stream_batches, waiting_rows


def items(spark, n):
    return spark.range(n).select(F.col("id").alias("idx"), F.array(F.col("id").cast("float")).alias("tensor"))


def order(spark, n, **options):
    rows = flow.batches(items(spark, n), StreamOptions(4, shuffle=True, **options)).collect()
    out = {}
    for r in rows:
        out.setdefault(r.epoch, {})[r.pos] = r.idx
    return {e: [p[k] for k in sorted(p)] for e, p in out.items()}


def test_shuffle_is_a_seeded_permutation(spark):
    a, b, c = (order(spark, 50, epochs=2, seed=s) for s in (3, 3, 4))
    assert a == b and a != c and a[1] != a[2]
    assert all(sorted(x) == list(range(50)) for x in (*a.values(), *c.values()))
    assert order(spark, 50, epochs=1, seed=4)[1] == a[2]  # an epoch's seed is the seed plus its number
    order(spark, 5, epochs=1, seed=2**63 - 1)  # wraps
    assert sorted(order(spark, 9)[1]) == list(range(9))


def test_batches(spark):
    rows = flow.batches(items(spark, 10), StreamOptions(4)).groupBy("step").count().orderBy("step").collect()
    assert [r["count"] for r in rows] == [4, 4, 2]
    capped = flow.batches(items(spark, 10), StreamOptions(4, epochs=3, max_steps=5))
    assert capped.select("global_step").distinct().count() == 5 and capped.count() == 10 + 8
    assert flow.batches(items(spark, 10), StreamOptions(0)).count() == 0
    assert flow.batches(items(spark, 0), StreamOptions(4, epochs=2, shuffle=True, seed=1)).count() == 0
    with pytest.raises(ValueError):
        StreamOptions(-1)


def test_index(spark):
    df = spark.createDataFrame([(k,) for k in (10**12, -5, 7, 3 * 10**12, 8)], "k long")
    got = {r.k: r.idx for r in flow.with_index(df, "k").collect()}
    assert [got[k] for k in sorted(got)] == list(range(5))
    assert flow.with_index(df.where("false"), "k").count() == 0


def test_index_beside_other_columns(spark):
    """Narrow rows are ranked as they are, wide ones joined to their numbers; no bucket is computed again to filter the source."""
    df = spark.createDataFrame([(k, 2 * k) for k in (10**12, -5, 7, 3 * 10**12, 8)], "k long, twice long")
    for more in (df, df.withColumn("name", F.col("twice").cast("string"))):
        out = flow.with_index(more, "k")
        assert out.columns == [*more.columns, "idx"]
        assert [(r.k, r.twice, r.idx) for r in out.orderBy("k").collect()] == [(k, 2 * k, n) for n, k in enumerate((-5, 7, 8, 10**12, 3 * 10**12))]
    out = flow.with_index(spark.range(1000).select((F.col("id") % 500).alias("k")).distinct(), "k")
    assert "isnotnull(aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["flow_pad_2d", "flow_flagship"])
def test_padded_orders_read_the_lines_once_for_their_tensors(spark, name):
    df = tensors.queries()[name](spark, "/root/testdata/sf0.001")
    scans = df._jdf.queryExecution().executedPlan().toString().split("FileScan parquet")[1:]
    assert sum("lineitem.parquet" in x for x in scans) == 1


VIEWS = [([4], [1], range(4)), ([2, 3], [3, 1], range(6)), ([2, 2], [3, 1], [0, 1, 3, 4]), ([2, 3, 4], [12, 4, 1], range(24)), ([2, 3, 2, 2], [12, 4, 2, 1], range(24)), ([], [], [0])]


@pytest.mark.parametrize("shape,strides,want", VIEWS)
def test_views(spark, shape, strides, want):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda x: x.cast("float")).alias("t"))
    assert df.select(L.strided_view(F.col("t"), L.long_array(shape), L.long_array(strides)).alias("v")).first().v == list(map(float, want))


@pytest.mark.parametrize("shape,strides,error", [([4, 8], [8, 1], "Shape"), ([2], [1, 1], "InvalidShape"), ([0], [1], "InvalidShape")])
def test_bad_views(spark, shape, strides, error):
    df = spark.range(1).select(F.array(*(F.lit(float(k)) for k in range(8))).alias("t"))
    with pytest.raises(Exception, match=error):
        df.select(L.strided_view(F.col("t"), L.long_array(shape), L.long_array(strides))).collect()


def test_layout_checks():
    L.check_layout([2, 3], [3, 1], dt.F32, 24)
    for bad in (([2], [3, 1]), ([0], [1])):
        with pytest.raises(InvalidShape):
            L.check_layout(*bad, dt.F32)
    with pytest.raises(BufferOverflow):
        L.check_layout([2, 3], [3, 1], dt.F32, 23)
    assert L.round_slot(65) == 128 and L.round_slot(64) == 64
    L.check_slots(2, 128)
    for bad in ((0, 64), (1, 0), (1, 65)):
        with pytest.raises(InvalidSlot):
            L.check_slots(*bad)


def test_ragged_batches(spark):
    rng = np.random.RandomState(2)
    shapes = [(int(h), int(w)) for h, w in rng.randint(2, 6, (12, 2))]
    arrays = [np.arange(h * w, dtype=np.float32).reshape(h, w) + 100 * k for k, (h, w) in enumerate(shapes)]
    df = spark.createDataFrame([(k, list(a.shape), a.reshape(-1).tolist()) for k, a in enumerate(arrays)], "idx long, shape array<long>, tensor array<float>")
    stream = BatchStream(df, StreamOptions(4, epochs=3, shuffle=True, seed=8), dims=2)
    for epoch in (1, 2, 3):
        seen = []
        for b in stream:
            assert b.epoch == epoch
            h, w = (max(shapes[i][d] for i in b.indices) for d in (0, 1))
            want = np.zeros((len(b.indices), h, w), np.float32)
            for j, i in enumerate(b.indices):
                want[j, : shapes[i][0], : shapes[i][1]] = arrays[i]
            assert np.array_equal(b.values, want)
            seen += b.indices.tolist()
        assert sorted(seen) == list(range(12))
    assert list(stream) == []


def test_padding_1d(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0]), (2, [])], "idx long, tensor array<float>")
    (b,) = BatchStream(df, StreamOptions(3))
    assert b.values.tolist() == [[1, 0, 0], [1, 2, 3], [0, 0, 0]]


def test_padding_of_any_rank(spark):
    rng = np.random.RandomState(5)
    rows, want = [], []
    for k, (shape, target) in enumerate((((2, 3, 4), (2, 3, 4)), ((1, 2, 2), (3, 2, 4)), ((2, 1, 3, 2), (2, 4, 3, 5)), ((4,), (7,)), ((), ()), ((2, 0), (3, 2)))):
        x = rng.randint(1, 99, shape).astype(np.float64)
        full = np.zeros(target)
        full[tuple(map(slice, shape))] = x
        rows.append((k, x.reshape(-1).tolist(), list(shape), list(target)))
        want.append(full.reshape(-1).tolist())
    df = spark.createDataFrame(rows, "k int, t array<double>, s array<bigint>, m array<bigint>")
    got = df.select("k", flow.padded(F.col("t"), F.col("s"), F.col("m"), F.lit(0.0)).alias("p")).orderBy("k").collect()
    assert [r.p for r in got] == want
    for bad in ([1], [2, 1]):
        with pytest.raises(Exception, match="Shape"):
            df.where("k = 1").select(flow.padded(F.col("t"), F.col("s"), L.long_array(bad), F.lit(0.0))).collect()


def test_index_with_an_outlier(spark, monkeypatch):
    monkeypatch.setattr(flow, "BUCKET_ROWS", 100)
    df = spark.range(5000).selectExpr("id * 7 AS k").union(spark.range(1).selectExpr(f"{2**60} AS k")).withColumn("other", F.lit("x"))
    got = sorted((r.k, r.idx) for r in flow.with_index(df, "k").collect())
    assert [i for _, i in got] == list(range(5001)) and got == sorted(got)
    counts = df.groupBy(flow.quantile_bucket(F.col("k"), [100 * j for j in range(1, 64)]).alias("b")).count().collect()
    assert len(counts) == 64
    cuts = df.agg(F.percentile_approx("k", [j / 51 for j in range(1, 51)], 10_000)).first()[0]
    assert max(r["count"] for r in df.groupBy(flow.quantile_bucket(F.col("k"), cuts).alias("b")).count().collect()) < 300


@pytest.mark.parametrize("dtype", dt.ALL, ids=lambda d: d.name)
def test_batches_have_the_items_type(spark, dtype):
    rows = [(k, [1, 2, 2], [k + j for j in range(4)]) for k in range(5)]
    kind = "double" if not dtype.is_int else "bigint"
    df = spark.createDataFrame([(k, s, list(map(float, t)) if not dtype.is_int else t) for k, s, t in rows], f"idx long, shape array<long>, tensor array<{kind}>")
    df = df.select("idx", "shape", dt.tagged(F.col("tensor"), "tensor", dtype))
    got = list(BatchStream(df, StreamOptions(3)))
    assert [b.values.shape for b in got] == [(3, 1, 2, 2), (2, 1, 2, 2)]
    assert all(b.values.dtype == np.dtype("<f4" if dtype is dt.BF16 else dtype.numpy) for b in got)
    assert np.concatenate([b.values for b in got]).reshape(5, 4).tolist() == [t for _, _, t in rows]
    raw = spark.createDataFrame([(k, s, codec.to_bytes(t, dtype)) for k, s, t in rows], "idx long, shape array<long>, tensor binary")
    raw = raw.select("idx", "shape", dt.tagged_bytes(F.col("tensor"), "tensor", dtype))
    for source in (raw, raw.drop("shape")):
        back = list(BatchStream(source, StreamOptions(3)))
        assert all(b.values.dtype == got[0].values.dtype for b in back)
        assert np.concatenate([b.values for b in back]).reshape(5, 4).tolist() == [t for _, _, t in rows]


def test_batch_layout_of_a_user(spark):
    df = read_dataset(spark, Squares(), "laid_squares", 2)
    own = Squares()
    got = list(BatchStream(df, StreamOptions(3, shuffle=True, seed=6), layout=lambda items: [d + 1 for d in own.layout(items)]))
    for b in got:
        h, w = (d + 1 for d in own.layout(b.indices.tolist()))
        assert b.values.shape == (len(b.indices), h, w) and b.values.dtype == np.int32
        for x, i in zip(b.values, b.indices, strict=True):
            assert (x[:2, : i + 1] == i * i).all() and x.sum() == 2 * (i + 1) * i * i
    with pytest.raises(Exception, match="Shape"):
        list(BatchStream(df, StreamOptions(3), layout=lambda items: [2, 1]))


def test_endless_stream(spark):
    stream = BatchStream(items(spark, 10), StreamOptions(4, epochs=None, shuffle=True, seed=9, max_steps=8))
    seen = [[b.indices.tolist() for b in stream] for _ in range(4)]
    assert [len(x) for x in seen] == [3, 3, 2, 0]
    assert [sorted(sum(x, [])) for x in seen[:2]] == [list(range(10))] * 2 and seen[0] != seen[1]
    fixed = order(spark, 10, epochs=2, seed=9)
    assert [sum(x, []) for x in seen[:2]] == [fixed[1], fixed[2]]


class Squares(Dataset):
    dtype = dt.I32

    def __len__(self):
        return 7

    def write(self, idx):
        if idx == self.fail:
            raise ValueError("no such item")
        return np.full((2, idx + 1), idx * idx)

    fail = -1


def test_python_dataset(spark):
    df = read_dataset(spark, Squares(), "squares", 3)
    rows = {r.idx: r for r in df.collect()}
    assert sorted(rows) == list(range(7)) and rows[3].shape == [2, 4] and rows[3].tensor == [9] * 8
    assert dt.dtype_of(df, "tensor") is dt.I32 and length(df) == 7 and not is_empty(df)
    assert Squares().layout([0, 3, 1]) == (2, 4)
    check_dense(df)
    bad = Squares()
    bad.fail = 4
    with pytest.raises(Exception, match="item 4"):
        read_dataset(spark, bad, "bad_squares", 2).collect()


class Ramp(Dataset):
    def __init__(self, dtype, top=3):
        self.dtype, self.top = dtype, top

    def __len__(self):
        return 2500

    def write(self, idx):
        return np.arange(self.top) + (idx % 2)


@pytest.mark.parametrize("dtype", dt.ALL, ids=lambda d: d.name)
def test_python_dataset_of_each_type(spark, dtype):
    rows = {r.idx: r.tensor for r in read_dataset(spark, Ramp(dtype), f"ramp_{dtype.name}", 2).collect()}
    assert len(rows) == 2500 and all(t == [j + i % 2 for j in range(3)] for i, t in rows.items())
    if dtype in (dt.I8, dt.U8):
        with pytest.raises(Exception, match=f"is not of {dtype.name}"):
            read_dataset(spark, Ramp(dtype, 300), f"far_{dtype.name}", 2).collect()


def test_null_items_are_named(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [None])], "idx long, tensor array<float>")
    with pytest.raises(Exception, match="item 1"):
        check_values(df).collect()


@pytest.mark.parametrize("dtype", dt.ALL, ids=lambda d: d.name)
def test_codec(dtype):
    values = [0, 1, 2, 100, 3, 4]
    raw = codec.encode(values, [2, 3], [3, 1], dtype)
    name, n, shape, strides, at, size, ready = codec.parse(raw)
    assert (name, n, shape, strides, size, ready) == (dtype.name, 2, [2, 3], [3, 1], 6 * dtype.size, True)
    assert codec.from_bytes(raw[at : at + size], dtype).tolist() == values
    with pytest.raises(MalformedMessage):
        codec.parse(bytes([32]) + raw[1:])
    with pytest.raises(MalformedMessage):
        codec.parse(raw[:20])
    with pytest.raises(InvalidShape):
        codec.encode(values, [2, 3], [1], dtype)


def test_handshake(spark):
    line = spark.createDataFrame([("ZT 1 slots=2 shape_type_size=8",)], "line string")
    got = line.select(codec.handshake_fields(F.col("line")).alias("m")).first().m
    assert got["slots"] == "2" and got["shape_type_size"] == "8"


def test_handshake_is_said_and_understood():
    line = codec.handshake_line("0.1", {"cb_size": 192})
    assert line.startswith("ZT 0.1 ") and codec.parse_handshake(line, "0.1")["cb_size"] == 192
    assert codec.parse_handshake(line, "0.1")["shape_type_size"] == 8
    for bad, error in ((line.replace("ZT", "XX"), ProtocolError), (line.replace("0.1", "0.2"), ProtocolError), ("ZT 0.1 dt_offset=0", ProtocolError), (line.replace("=192", "=x"), MalformedMessage)):
        with pytest.raises(error):
            codec.parse_handshake(bad, "0.1")


@pytest.mark.parametrize("dtype", dt.ALL, ids=lambda d: d.name)
def test_codec_columns(spark, dtype):
    rows = [(0, [1, 2, 3, 4, 5, 6], [2, 3], [3, 1]), (1, [7], [1], [1]), (2, [8, 9], [2], [1])]
    df = spark.createDataFrame(rows, "idx int, t array<int>, s array<bigint>, r array<bigint>").withColumn("t", F.col("t").cast(dtype.array()))
    got = df.select("idx", "s", codec.encoder(dtype)("t", "s", "r").alias("raw")).select("idx", "s", codec.header_parser()("raw").alias("h"), codec.decoder(dtype)("raw").alias("t"))
    for r, (_, t, s, strides) in zip(got.orderBy("idx").collect(), rows, strict=True):
        assert r.t == t and r.h.shape == s and r.h.strides == strides and r.h.data_size == len(t) * dtype.size
    assert df.where("false").select(codec.encoder(dtype)("t", "s", "r")).count() == 0
    for r in df.select("idx", codec.encoder(dtype)("t", "s", "r").alias("raw")).collect():
        assert bytes(r.raw) == codec.encode(rows[r.idx][1], rows[r.idx][2], rows[r.idx][3], dtype)


@pytest.mark.parametrize("size", [4, 5])
def test_stream_across_micro_batches(spark, tmp_path, size):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    for k in range(3):
        items(spark, 10).withColumn("idx", F.col("idx") + 10 * k).coalesce(1).write.mode("append").parquet(source)
    seen = []

    def sink(df, number):
        seen.extend((r.step, r.pos_in_batch, r.idx) for r in df.collect())

    stream_batches(spark, source, "idx long, tensor array<float>", size, sink, check, across=True).awaitTermination()
    whole = 30 // size * size
    assert len(seen) == len(set(seen)) == whole and sorted((s, p) for s, p, _ in seen) == [(k // size, k % size) for k in range(whole)]
    rest = [r.idx for r in waiting_rows(spark, check, 2, size).collect()]
    assert sorted([i for _, _, i in seen] + rest) == list(range(30)) and len(rest) == 30 - whole


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        items(spark, 10).withColumn("idx", F.col("idx") + 10 * k).coalesce(1).write.mode("append").parquet(source)
    seen = []

    def sink(df, number):
        seen.extend((number, r.idx, r.step, r.pos_in_batch) for r in df.collect())

    q = stream_batches(spark, source, "idx long, tensor array<float>", 4, sink, str(tmp_path / "check"))
    q.awaitTermination()
    assert len(seen) == 30 and len({s[0] for s in seen}) == 3
    assert sorted(s[1] for s in seen) == list(range(30))
    assert max(s[2] for s in seen) == 2
