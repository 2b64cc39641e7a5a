"""Arithmetic shuffles, tensor files, endless streams and ranks."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridweave import dtypes as dt
from gridweave.errors import DatasetError, MalformedMessage
from gridweave.plans import flow
from gridweave.plans.flow import StreamOptions
from gridweave.plans.permute import Permutation, members
from gridweave.sources import codec
from gridweave.sources import tensor_files as tf
from gridweave.sources.dataset import Dataset
from gridweave.streaming.batches import BatchStream, packed_batches
from gridweave.streaming.epochs import epoch_stream
from gridweave.streaming.ranks import sharded
from gridweave.streaming.stateful import batched_across


def ragged(spark, n, kind="float"):
    """Items of two dimensions, 1 x 1 to 3 x 4, whose elements tell them apart."""
    shape = F.array(1 + F.col("id") % 3, 1 + F.col("id") % 4)
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), shape[0] * shape[1] - 1), lambda k: (F.col("id") * 100 + k).cast(kind))
    return spark.range(0, n, 1, 3).select(F.col("id").alias("idx"), shape.alias("shape"), cells.alias("tensor"))


def ragged_item(i):
    h, w = 1 + i % 3, 1 + i % 4
    return (100 * i + np.arange(h * w)).reshape(h, w)


# --- permutation ---


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10, 64, 99, 100, 101, 4097])
def test_permutation_and_its_inverse(n):
    seen = set()
    for seed in (0, -3, 5, 2**62):
        p = Permutation(n, seed)
        for epoch in (1, 2, 10**9):
            assert p.walk([epoch]) <= max(0, p.low * p.high - n)
            at = p.positions(np.arange(n), epoch)
            assert sorted(at.tolist()) == list(range(n)) and p.indices(at, epoch).tolist() == list(range(n))
            seen.add(tuple(at.tolist()))
    assert n < 99 or len(seen) == 12


def test_permutation_is_even():
    y = Permutation(100_003, 4).positions(np.arange(100_003), 1)
    cells = np.histogram2d(np.arange(100_000) // 1000, y[:100_000] // 1001, bins=100)[0]
    assert 0.9 < ((cells - 10) ** 2 / 10).sum() / 99**2 < 1.1
    assert abs(np.corrcoef(y[:-1], y[1:])[0, 1]) < 0.02 and (y == np.arange(100_003)).sum() < 10
    huge = Permutation(10**15, 9)
    x = np.arange(10**15 - 500, 10**15)
    assert (huge.indices(huge.positions(x, 3), 3) == x).all() and huge.positions(x, 3).max() < 10**15


@pytest.mark.parametrize("n", [1, 10, 101, 1000])
def test_permutation_of_columns_needs_no_exchange(spark, n):
    p = Permutation(n, 77)
    df = p.with_positions(flow.with_epochs(spark.range(n).withColumnRenamed("id", "idx"), 3), range(1, 4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    for epoch in (1, 2, 3):
        rows = df.where(F.col("epoch") == epoch).orderBy("idx").collect()
        assert [r.pos for r in rows] == p.positions(np.arange(n), epoch).tolist()
    pos = flow.with_epochs(spark.range(n).withColumnRenamed("id", "pos"), 3)
    back = p.with_indices(pos, range(1, 4))
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    for r in back.collect():
        assert p.positions([r.idx], r.epoch).tolist() == [r.pos]


def test_members_of_steps(spark):
    steps = spark.createDataFrame([(e, s) for e in (1, 2) for s in range(4)], "epoch int, step long")
    found = members(steps, 10, 3, 5, [1, 2])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    placed = flow.placed(spark.range(10).withColumnRenamed("id", "idx"), StreamOptions(3, 2, True, 5, arithmetic=True))
    names = ["epoch", "step", "pos", "pos_in_batch", "idx"]
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, placed.select(*names).collect()))
    assert sorted(r.idx for r in members(steps, 10, 3, None, [1, 2]).where("epoch = 2").collect()) == list(range(10))


def test_arithmetic_batches(spark):
    stream = BatchStream(ragged(spark, 23), StreamOptions(4, 2, True, 6, arithmetic=True))
    order = [[i for b in stream for i in b.indices.tolist()] for _ in range(2)]
    assert order == [Permutation(23, 6).indices(np.arange(23), e).tolist() for e in (1, 2)]


# --- files ---


def encoded(df, dtype=dt.F32):
    from gridweave.operators.layout import row_major_strides

    none = F.lit(None)
    return df.select(none.alias("epoch"), none.alias("step"), "idx", codec.encoder(dtype)("tensor", "shape", row_major_strides(F.col("shape"))).alias("value"))


def test_written_items_come_back(spark, tmp_path):
    path = str(tmp_path / "t")
    tf.write_items(ragged(spark, 50), path)
    df = tf.read_tensors(spark, path)
    back = {r.idx: r for r in df.withColumn("x", codec.decoder(dt.F32)("value")).collect()}
    assert sorted(back) == list(range(50))
    for i, r in back.items():
        want = ragged_item(i)
        assert r.shape == list(want.shape) and r.x == want.reshape(-1).tolist() and r.dtype == "f32" and r.epoch is None
    heads = tf.read_tensors(spark, path, headers_only=True)
    assert sorted((r.idx, *r.shape) for r in heads.where("value is null").collect()) == sorted((i, *ragged_item(i).shape) for i in range(50))
    tf.write_items(ragged(spark, 5), path, "overwrite")
    assert tf.read_tensors(spark, path).count() == 5
    assert len([f for f in os.listdir(path) if f.endswith(".tensors")]) == tf.manifest(path).num_rows
    tf.write_tensors(encoded(ragged(spark, 5)).where("false"), path)
    assert tf.read_tensors(spark, path).count() == 5


def test_bytes_read_with_and_without_conditions(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    big = spark.range(0, 64, 1, 8).select(F.col("id").alias("idx"), F.array_repeat(F.col("id").cast("double"), 20_000).alias("tensor"))
    tf.write_items(big.select("idx", dt.tagged(F.col("tensor"), "tensor", dt.F64)), path)
    seen = [0]

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read_at(self, size, at):
            seen[0] += size
            return self.f.read_at(size, at)

    plain = tf.open_file
    monkeypatch.setattr(tf, "open_file", lambda p: Counted(plain(p)))

    def read(filters=(), headers_only=False):
        seen[0] = 0
        reader = tf._Reader(path, headers_only)
        assert list(reader.pushFilters(list(filters))) == []
        rows = [i for p in reader.partitions() for b in reader.read(p) for i in b.column("idx").to_pylist()]
        return sorted(rows), seen[0]

    every, all_bytes = read()
    assert every == list(range(64)) and all_bytes > 64 * 160_000
    one, few_bytes = read([tf.EqualTo(("idx",), 17)])
    assert one == [17] and few_bytes < 160_000 + 20_000
    some, _ = read([tf.GreaterThan(("idx",), 10), tf.LessThanOrEqual(("idx",), 13)])
    assert some == [11, 12, 13]
    assert read([tf.In(("idx",), (3, 60, 99))])[0] == [3, 60] and read([tf.IsNotNull(("step",))])[0] == []
    heads, head_bytes = read(headers_only=True)
    assert heads == every and head_bytes < 20_000
    monkeypatch.setattr(tf, "open_file", plain)
    filtered = tf.read_tensors(spark, path).where("idx between 20 and 22 and size > 10")
    assert "EqualTo" in str(filtered.where("idx = 21")._jdf.queryExecution().executedPlan()) or filtered.count() == 3
    assert sorted(r.idx for r in filtered.collect()) == [20, 21, 22]


def test_a_failing_job_leaves_nothing_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    good = encoded(ragged(spark, 20))
    bad = good.withColumn("value", F.when(F.col("idx") == 19, F.lit(b"junk")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="header|dtype"):
        tf.write_tensors(bad, path)
    assert tf.manifest(path).num_rows == 0 and tf.read_tensors(spark, path).count() == 0
    tf.write_tensors(good, path)
    assert tf.read_tensors(spark, path).count() == 20
    with pytest.raises(Exception, match="header|dtype"):
        tf.write_tensors(bad, path)
    assert sorted(r.idx for r in tf.read_tensors(spark, path).collect()) == list(range(20))
    open(f"{path}/lost.tensors", "wb").write(b"part of a task that was lost")
    assert tf.clean(path) >= 1 and tf.read_tensors(spark, path).count() == 20


def test_batches_in_files(spark, tmp_path):
    """What is written and read again is what the iterator packs."""
    from gridweave.operators.layout import row_major_strides

    path, options = str(tmp_path / "t"), StreamOptions(4, 2, True, 3, arithmetic=True)
    batches = packed_batches(ragged(spark, 21), options)
    rows = batches.select("epoch", "step", F.col("step").alias("idx"), codec.framer(dt.F32)("data", "shape", row_major_strides(F.col("shape"))).alias("value"))
    tf.write_tensors(rows, path)
    back = tf.read_tensors(spark, path).where("epoch = 2").withColumn("x", codec.decoder(dt.F32)("value")).orderBy("step").collect()
    want = list(BatchStream(ragged(spark, 21), options).epoch_batches(2))
    assert [(r.step, r.shape, r.x) for r in back] == [(b.step, list(b.values.shape), b.values.reshape(-1).tolist()) for b in want]


def test_items_by_number(spark, tmp_path):
    path = str(tmp_path / "t")
    tf.write_items(ragged(spark, 300), path)
    files = tf.TensorFiles(path)
    assert len(files) == 300 and files.dtype is dt.F32
    for i in (0, 299, 7, 150):
        assert np.array_equal(files.write(i), ragged_item(i))
    assert files.layout([0, 1, 6]) == (2, 3)
    for i in (-1, 300):
        with pytest.raises(DatasetError):
            files.write(i)
    tf.write_items(ragged(spark, 3), path)
    with pytest.raises(DatasetError, match="overlap"):
        tf.TensorFiles(path)


@pytest.mark.parametrize("dtype", dt.ALL, ids=lambda d: d.name)
def test_files_of_each_type(spark, tmp_path, dtype):
    df = spark.range(6).select(F.col("id").alias("idx"), dt.tagged(F.array("id", F.col("id") + 1), "tensor", dtype))
    tf.write_items(df, str(tmp_path / "t"))
    assert [tf.TensorFiles(str(tmp_path / "t")).write(i).tolist() for i in range(6)] == [[i, i + 1] for i in range(6)]


def test_cut_off_tensors_are_errors(spark):
    raw = codec.encode([1, 2, 3], [3], [1], dt.F32)
    for bad in (raw[:-1], raw[:12], b"", bytes([99]) + raw[1:]):
        df = spark.createDataFrame([(raw,), (bad,)], "raw binary").coalesce(1)
        with pytest.raises(Exception, match="Malformed|cut off|header|dtype|said"):
            df.select(codec.decoder(dt.F32)("raw")).collect()
    with pytest.raises(MalformedMessage):
        codec.header_size(b"\x63" * 9)


# --- endless streams ---


class Ragged(Dataset):
    dtype = dt.F32

    def __init__(self, n, fail=-1):
        self.n, self.fail = n, fail

    def __len__(self):
        return self.n

    def write(self, idx):
        if idx == self.fail:
            raise ValueError("no such item")
        return ragged_item(idx)


def started(stream, seen, checkpoint, most=None):
    """A query that keeps each micro-batch's steps and stops by an error once it has ``most`` of them."""

    def sink(df, number):
        if most is not None and len(seen) >= most:
            raise RuntimeError("stopped here")
        seen[number] = [(r.epoch, r.step, tuple(r.indices), bytes(r.data)) for r in df.collect()]

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def settled(q, seconds=40):
    """Waits until a query has stopped by itself or waits for data, and stops it; raises its error."""
    end = time.monotonic() + seconds
    while q.isActive and not q.status["message"].startswith("Waiting") and time.monotonic() < end:
        time.sleep(0.2)
    error = q.exception()
    q.stop()
    if error is not None:
        raise error
    assert time.monotonic() < end


def test_an_endless_stream_goes_on_where_it_stopped(spark, tmp_path):
    n, options = 22, StreamOptions(4, None, True, 12, max_steps=40)
    stream = epoch_stream(spark, Ragged(n), options, "ragged_epochs", a_trigger=5, tasks=3)
    seen: dict = {}
    with pytest.raises(Exception, match="stopped here"):
        settled(started(stream, seen, str(tmp_path / "c"), 3))
    assert sorted(seen) == [0, 1, 2]  # stopped in mid-epoch, its fourth micro-batch planned but not done
    q = started(epoch_stream(spark, Ragged(n), options, "ragged_epochs", a_trigger=5, tasks=3), seen, str(tmp_path / "c"))
    settled(q)
    q = started(epoch_stream(spark, Ragged(n), options, "ragged_epochs", a_trigger=5, tasks=3), seen, str(tmp_path / "c"))
    settled(q)  # nothing is left
    rows = sorted(r for batch in seen.values() for r in batch)
    assert [(e, s) for e, s, *_ in rows] == [(1 + k // 6, k % 6) for k in range(40)]
    order = Permutation(n, 12)
    for epoch, step, indices, data in rows:
        assert list(indices) == order.indices(np.arange(4 * step, min(4 * step + 4, n)), epoch).tolist()
        h, w = (max(ragged_item(i).shape[d] for i in indices) for d in (0, 1))
        want = np.zeros((len(indices), h, w), np.float32)
        for k, i in enumerate(indices):
            x = ragged_item(i)
            want[k, : x.shape[0], : x.shape[1]] = x
        assert data == want.tobytes()
    batches = BatchStream(ragged(spark, n), StreamOptions(4, 2, True, 12, arithmetic=True))
    assert [tuple(b.indices.tolist()) for b in batches] == [r[2] for r in rows[:6]]


def test_streams_that_end_and_empty_ones(spark, tmp_path):
    for k, (dataset, options, want) in enumerate(((Ragged(9), StreamOptions(4, 2), 6), (Ragged(0), StreamOptions(4, None), 0), (Ragged(9), StreamOptions(0, None), 0))):
        seen: dict = {}
        q = started(epoch_stream(spark, dataset, options, f"ends_{k}", a_trigger=4), seen, str(tmp_path / f"c{k}"))
        settled(q)
        rows = sorted(r[:3] for batch in seen.values() for r in batch)
        assert len(rows) == want and rows[:1] == ([(1, 0, (0, 1, 2, 3))] if want else [])
    q = started(epoch_stream(spark, Ragged(9, fail=6), StreamOptions(4, 1), "fails"), {}, str(tmp_path / "f"))
    with pytest.raises(Exception, match="item 6"):
        settled(q)


def test_a_stream_from_files(spark, tmp_path):
    tf.write_items(ragged(spark, 40), str(tmp_path / "t"))
    seen: dict = {}
    stream = epoch_stream(spark, tf.TensorFiles(str(tmp_path / "t")), StreamOptions(8, 1, True, 2), "from_files", a_trigger=3, tasks=2)
    q = started(stream, seen, str(tmp_path / "c"))
    settled(q)
    rows = sorted(r for batch in seen.values() for r in batch)
    want = list(BatchStream(ragged(spark, 40), StreamOptions(8, 1, True, 2, arithmetic=True)))
    assert [(s, list(i), d) for _, s, i, d in rows] == [(b.step, b.indices.tolist(), b.values.tobytes()) for b in want]


# --- ranks ---

STEP = "rank int, epoch int, step long, indices array<long>, total double"


def every_step(rank, batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"rank": pa.array([rank], pa.int32()), "epoch": pa.array([b.epoch], pa.int32()), "step": [b.step], "indices": [b.indices.tolist()], "total": [float(b.values.sum())]})


def test_ranks_share_all_steps(spark):
    items, options = ragged(spark, 45), StreamOptions(4, 2, True, 8)
    rows = sharded(items, options, 3, every_step, STEP).collect()
    want = list(BatchStream(items, options)) + list(BatchStream(items, StreamOptions(4, 2, True, 8)).epoch_batches(2))
    got = {(r.epoch, r.step): r for r in rows}
    assert len(rows) == len(got) == len(want) == 24
    for b in want:
        r = got[b.epoch, b.step]
        assert r.indices == b.indices.tolist() and r.total == b.values.sum() and r.rank == ((b.epoch - 1) * 12 + b.step) % 3
    for rank in range(3):
        mine = [(r.epoch, r.step) for r in rows if r.rank == rank]
        assert mine == sorted(mine)


def test_ranks_without_steps_and_ranks_that_stop(spark):
    few = sharded(ragged(spark, 5), StreamOptions(4, 3), 4, every_step, STEP).collect()
    assert sorted((r.epoch, r.step, r.rank) for r in few) == [(1, 0, 0), (1, 1, 1), (2, 0, 2), (2, 1, 3), (3, 0, 0), (3, 1, 1)]
    assert sharded(ragged(spark, 0), StreamOptions(4, 2), 2, every_step, STEP).collect() == []

    def first_only(rank, batches):
        for b in batches:
            yield from every_step(rank, [b])
            return

    assert len(sharded(ragged(spark, 40), StreamOptions(4, 2, max_steps=15), 2, first_only, STEP).collect()) == 2

    def fails(rank, batches):
        if rank == 1:
            raise ValueError("rank 1 fails")
        yield from every_step(rank, batches)

    with pytest.raises(Exception, match="rank 1 fails"):
        sharded(ragged(spark, 40), StreamOptions(4), 2, fails, STEP).collect()


@pytest.mark.parametrize("dtype", [dt.F32, dt.BF16, dt.U8, dt.I64], ids=lambda d: d.name)
def test_mapped_batches(spark, tmp_path, dtype):
    items = ragged(spark, 21, "int").select("idx", "shape", dt.tagged(F.transform("tensor", lambda x: x % 100), "tensor", dtype))
    options = StreamOptions(4, 2, True, 3, max_steps=9)
    mapped = BatchStream(items, options, folder=str(tmp_path / "m"))
    fetched = BatchStream(items, options)
    for _ in range(2):
        for a, b in zip(mapped, fetched, strict=True):
            assert (a.epoch, a.step) == (b.epoch, b.step) and a.indices.tolist() == b.indices.tolist()
            assert a.values.dtype == b.values.dtype and np.array_equal(a.values, b.values)
            assert a.values.ctypes.data % 64 == 0
    assert len(os.listdir(tmp_path / "m")) <= 2  # of the epoch that max_steps cut off


# --- state ---


def test_waiting_rows_are_state(spark, tmp_path):
    """Batches go on across micro-batches and restarts; what waits lies in the checkpoint."""
    source, check, sizes = str(tmp_path / "in"), str(tmp_path / "c"), (10, 3, 1, 15, 6)
    seen: dict = {}

    def sink(df, number):
        seen[number] = [(r.lane, r.step, r.pos_in_batch, r.idx, r.tensor) for r in df.collect()]

    def run():
        stream = spark.readStream.schema("idx long, tensor array<float>").option("maxFilesPerTrigger", 1).parquet(source)
        q = batched_across(stream, 4, lanes=2).writeStream.foreachBatch(sink).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(90)

    first = 0
    for k, n in enumerate(sizes):
        part = spark.range(first, first + n).select(F.col("id").alias("idx"), F.array(F.col("id").cast("float")).alias("tensor"))
        part.coalesce(1).write.mode("append").parquet(source)
        first += n
        if k in (1, 4):
            run()
    rows = [r for number in sorted(seen) for r in seen[number]]
    assert all(t == [float(i)] for *_, i, t in rows) and len({r[3] for r in rows}) == len(rows)
    for lane in (0, 1):
        mine = [(s, p, i) for x, s, p, i, _ in rows if x == lane]
        assert [(s, p) for s, p, _ in mine] == [(k // 4, k % 4) for k in range(len(mine))]
        assert [i for *_, i in mine] == sorted(i for *_, i in mine)  # files came in order of idx
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load(check).count()
    assert len(rows) + waiting == sum(sizes) and waiting < 8
    assert sorted(os.listdir(tmp_path)) == ["c", "in"]
