"""Files of encoded tensors: a sink that commits, and readers by byte range.

A file holds encoded tensors, the data of each at a multiple of ``ALIGNED`` bytes, and behind them an index: epoch, step, idx, place, size and header of every
tensor. Nothing refers to a file but a manifest, which is written, in one move, when all tasks of a job are done; files of tasks and jobs that failed
are therefore never seen. Readers skip files by the manifest's bounds and tensors by the index; shapes alone are read from the index only.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

from gridweave import dtypes as dt
from gridweave.errors import DatasetError, MalformedMessage
from gridweave.operators.layout import row_major_strides
from gridweave.sources import codec
from gridweave.sources.dataset import Dataset

FORMAT = "gridweave_tensors"
MAGIC, ALIGNED, MANIFESTS = b"GWTF0001", 64, "_manifests"
#: Tensors and bytes of a reading task; bytes that are rather read along than left out between two tensors, and bytes of one read.
TASK_TENSORS, TASK_BYTES, GAP, READ = 100_000, 1 << 27, 1 << 16, 1 << 23
KEYS = ("epoch", "step", "idx")
READ_SCHEMA = "epoch int, step bigint, idx bigint, dtype string, shape array<bigint>, strides array<bigint>, size bigint, value binary"
_INDEX = pa.schema([("epoch", pa.int32()), ("step", pa.int64()), ("idx", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("head", pa.binary())])
_MANIFEST = pa.schema(
    [("file", pa.string()), ("rows", pa.int64()), ("bytes", pa.int64()), ("index_at", pa.int64()), ("index_size", pa.int64())]
    + [(f"{end}_{k}", pa.int64()) for k in KEYS for end in ("low", "high")]
)


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# --- writing ---


def write_file(path: str, batches: Iterator[pa.RecordBatch]) -> list[tuple]:
    """Writes ``batches(epoch, step, idx, value)`` to a new file of a folder and gives its row for the manifest; none without tensors."""
    files, root = store_of(path)
    name = f"{uuid.uuid4().hex}.tensors"
    files.create_dir(root, recursive=True)
    index: list[pa.RecordBatch] = []
    at = len(MAGIC)
    try:
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(MAGIC)
            for b in batches:
                places, sizes, heads = [], [], []
                for v in b.column("value"):
                    raw = v.as_buffer()
                    if raw is None:
                        raise MalformedMessage("a tensor can't be null")
                    head = codec.header_size(memoryview(raw))
                    # the data, not the header, begins at a multiple
                    gap = -(at + head) % ALIGNED
                    out.write(bytes(gap))
                    out.write(raw)
                    places.append(at + gap)
                    sizes.append(raw.size)
                    heads.append(raw[:head].to_pybytes())
                    at += gap + raw.size
                keys = [b.column(k).cast(_INDEX.field(k).type) for k in KEYS]
                index.append(pa.RecordBatch.from_arrays([*keys, pa.array(places, pa.int64()), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary())], schema=_INDEX))
            table = pa.Table.from_batches(index, _INDEX)
            if not table.num_rows:
                raise _Nothing
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _INDEX) as stream:
                stream.write_table(table)
            footer = sink.getvalue()
            out.write(footer)
            out.write(MAGIC)
    except BaseException as e:
        files.delete_file(f"{root}/{name}")
        if isinstance(e, _Nothing):
            return []
        raise
    bounds = []
    for k in KEYS:
        ends = pc.min_max(table[k]).as_py()
        bounds += [ends["min"], ends["max"]]
    return [(name, table.num_rows, at, at, footer.size, *bounds)]


@dataclass
class _Written(WriterCommitMessage):
    rows: list[tuple]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        return _Written(write_file(self.path, iterator))

    def commit(self, messages) -> None:
        files, root = store_of(self.path)
        before = _manifests(files, root) if self.overwrite else []
        rows = [r for m in messages if m is not None for r in m.rows]
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(_MANIFEST), _MANIFEST, strict=True)], schema=_MANIFEST)
        table = table.replace_schema_metadata({"replaces": json.dumps(before)})
        name = f"{root}/{MANIFESTS}/{uuid.uuid4().hex}"
        files.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        with files.open_output_stream(f"{name}.new") as out, pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        files.move(f"{name}.new", f"{name}.arrow")
        if before:
            clean(self.path)

    def abort(self, messages) -> None:
        files, root = store_of(self.path)
        for m in messages:
            for r in m.rows if m is not None else ():
                files.delete_file(f"{root}/{r[0]}")


class _Nothing(Exception):
    """A task without rows leaves no file."""


def _manifests(files: fs.FileSystem, root: str) -> list[str]:
    """Names of the manifests that hold, oldest of the listing first."""
    found = files.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    names = sorted(f.base_name for f in found if f.base_name.endswith(".arrow"))
    gone = {x for n in names for x in json.loads(_manifest(files, f"{root}/{MANIFESTS}/{n}").schema.metadata[b"replaces"])}
    return [n for n in names if n not in gone]


def _manifest(files: fs.FileSystem, path: str) -> pa.Table:
    with files.open_input_file(path) as f, pa.ipc.open_stream(f) as stream:
        return stream.read_all()


def manifest(path: str) -> pa.Table:
    """All committed files of a folder, by name."""
    files, root = store_of(path)
    tables = [_manifest(files, f"{root}/{MANIFESTS}/{n}").replace_schema_metadata(None) for n in _manifests(files, root)]
    return pa.concat_tables([_MANIFEST.empty_table(), *tables]).sort_by("file")


def clean(path: str) -> int:
    """Deletes files that no manifest names: what failed or lost tasks left, and what was overwritten. Not while a job writes there."""
    files, root = store_of(path)
    holding = _manifests(files, root)
    known = set(manifest(path)["file"].to_pylist())
    gone = [f.path for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".tensors") and f.base_name not in known]
    gone += [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True)) if f.base_name not in holding]
    for p in gone:
        files.delete_file(p)
    return len(gone)


# --- reading ---


def open_file(path: str):
    """A file open for reads at any place."""
    files, at = store_of(path)
    return files.open_input_file(at)


def index_of(file, index_at: int, index_size: int) -> pa.Table:
    raw = file.read_at(index_size, index_at)
    with pa.ipc.open_stream(raw) as stream:
        return stream.read_all()


@dataclass
class _Task(InputPartition):
    file: str
    index_at: int
    index_size: int
    first: int
    last: int

    def __post_init__(self):
        InputPartition.__init__(self, None)


_OPERATIONS = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


def _holds(f: Filter, column: pa.ChunkedArray):
    if isinstance(f, IsNotNull):
        return column.is_valid()
    if isinstance(f, In):
        return pc.is_in(column, pa.array([x for x in f.value if x is not None], column.type))
    return pc.fill_null(_OPERATIONS[type(f)](column, pa.scalar(f.value, column.type)), False)


def _may_hold(f: Filter, low: int | None, high: int | None) -> bool:
    """Whether a file with such bounds (null: only nulls) may have rows that a filter holds for."""
    if low is None:
        return False
    if isinstance(f, EqualTo):
        return low <= f.value <= high
    if isinstance(f, In):
        return any(x is not None and low <= x <= high for x in f.value)
    if isinstance(f, GreaterThan):
        return high > f.value
    if isinstance(f, GreaterThanOrEqual):
        return high >= f.value
    if isinstance(f, LessThan):
        return low < f.value
    return isinstance(f, IsNotNull) or low <= f.value


class _Reader(DataSourceReader):
    def __init__(self, path: str, headers_only: bool):
        self.path, self.headers_only, self.filters = path, headers_only, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (*_OPERATIONS, In, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in KEYS and (isinstance(f, IsNotNull) or f.value is not None):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        out = []
        for r in manifest(self.path).to_pylist():
            if all(_may_hold(f, r[f"low_{f.attribute[0]}"], r[f"high_{f.attribute[0]}"]) for f in self.filters):
                tasks = max(1, -(-r["rows"] // TASK_TENSORS), 1 if self.headers_only else -(-r["bytes"] // TASK_BYTES))
                cuts = [r["rows"] * k // tasks for k in range(tasks + 1)]
                out += [_Task(r["file"], r["index_at"], r["index_size"], a, z) for a, z in zip(cuts, cuts[1:], strict=False) if a < z]
        return out or [_Task("", 0, 0, 0, 0)]

    def read(self, partition):
        if not partition.file:
            return
        with open_file(f"{self.path}/{partition.file}") as file:
            index = index_of(file, partition.index_at, partition.index_size).slice(partition.first, partition.last - partition.first)
            for f in self.filters:
                index = index.filter(_holds(f, index[f.attribute[0]]))
            for part in _runs(index):
                yield _rows(part, None if self.headers_only else _values(file, part))


def _runs(index: pa.Table) -> Iterator[pa.Table]:
    """Slices of an index whose tensors are read together, in order of place."""
    at, size = index["at"].to_numpy(), index["size"].to_numpy()
    first = 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] > at[k - 1] + size[k - 1] + GAP or at[k] + size[k] - at[first] > READ:
            yield index.slice(first, k - first)
            first = k


def _values(file, index: pa.Table) -> pa.Array:
    """Tensors of a run with one read; without a copy where they lie end to end."""
    at, size = index["at"].to_numpy(), index["size"].to_numpy()
    raw = file.read_at(int(at[-1] + size[-1] - at[0]), int(at[0]))
    view = memoryview(raw)
    return pa.array([view[a : a + n] for a, n in zip((at - at[0]).tolist(), size.tolist(), strict=True)], pa.binary())


def _rows(index: pa.Table, values: pa.Array | None) -> pa.RecordBatch:
    heads = [codec.parse(h) for h in index["head"].to_pylist()]
    longs = pa.list_(pa.int64())
    columns = [index[k].combine_chunks() for k in KEYS]
    columns += [pa.array([h[0] for h in heads]), pa.array([h[2] for h in heads], longs), pa.array([h[3] for h in heads], longs), index["size"].combine_chunks()]
    columns.append(pa.nulls(index.num_rows, pa.binary()) if values is None else values)
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in READ_SCHEMA.split(", ")])


class TensorFileSource(DataSource):
    """``spark.read.format('gridweave_tensors')`` and ``df.write``; option ``headers_only`` leaves values null and reads no data."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("headers_only", "false").lower() == "true")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def read_tensors(spark: SparkSession, path: str, headers_only: bool = False) -> DataFrame:
    """The committed tensors of a folder; conditions on epoch, step and idx reach the files."""
    spark.dataSource.register(TensorFileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).option("headers_only", str(headers_only).lower()).load(path)


def write_tensors(df: DataFrame, path: str, mode: str = "append") -> None:
    """Writes ``df(epoch, step, idx, value)``, values encoded as by ``codec.encoder``; nothing is readable before all of it is."""
    df.sparkSession.dataSource.register(TensorFileSource)
    keys = [F.col(k).cast("int" if k == "epoch" else "bigint").alias(k) for k in KEYS]
    df.select(*keys, "value").write.format(FORMAT).mode(mode).save(path)


def write_items(items: DataFrame, path: str, mode: str = "append") -> None:
    """Writes ``items(idx, tensor[, shape])`` in order of idx, a range of them a file: what ``TensorFiles`` reads."""
    dtype = dt.dtype_of(items, "tensor")
    is_array = items.schema["tensor"].dataType.typeName() == "array"
    size = F.size("tensor") if is_array else (F.length("tensor") / dtype.size)
    shape = F.col("shape").cast("array<bigint>") if "shape" in items.columns else F.array(size.cast("bigint"))
    rows = items.withColumn("shape", shape).repartitionByRange("idx").sortWithinPartitions("idx")
    encode = codec.encoder(dtype) if is_array else codec.framer(dtype)
    none = F.lit(None)
    write_tensors(rows.select(none.alias("epoch"), none.alias("step"), "idx", encode("tensor", "shape", row_major_strides(F.col("shape"))).alias("value")), path, mode)


class TensorFiles(Dataset):
    """Items written by ``write_items``, read one by one by byte range. An item's file is found by the manifest, its place by the file's index."""

    def __init__(self, path: str):
        self.path = path
        self.files = manifest(path).sort_by("low_idx").to_pylist()
        self.first = np.array([f["low_idx"] for f in self.files], np.int64)
        for a, b in zip(self.files, self.files[1:], strict=False):
            if a["high_idx"] >= b["low_idx"]:
                raise DatasetError("files of items overlap")
        if self.files:
            self.dtype = dt.BY_NAME[codec.parse(self._index(0)["head"][0].as_py())[0]]

    def __len__(self) -> int:
        return sum(f["rows"] for f in self.files)

    @functools.cached_property
    def _held(self) -> dict[int, tuple]:
        """Indexes and open files of this process."""
        return {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_held"}

    def _index(self, k: int) -> pa.Table:
        return self._opened(k)[1]

    def _opened(self, k: int) -> tuple:
        if k not in self._held:
            if len(self._held) >= 64:
                self._held.pop(next(iter(self._held)))[0].close()
            f = self.files[k]
            file = open_file(f"{self.path}/{f['file']}")
            self._held[k] = (file, index_of(file, f["index_at"], f["index_size"]))
        return self._held[k]

    def _found(self, idx: int) -> tuple:
        """(file, place, size, header) of an item."""
        k = int(np.searchsorted(self.first, idx, "right")) - 1
        if k < 0:
            raise DatasetError("no such item", idx)
        file, index = self._opened(k)
        ids = index["idx"].to_numpy()
        j = int(np.searchsorted(ids, idx))
        if j == len(ids) or ids[j] != idx:
            raise DatasetError("no such item", idx)
        return file, index["at"][j].as_py(), index["size"][j].as_py(), index["head"][j].as_py()

    def write(self, idx: int) -> np.ndarray:
        file, at, size, head = self._found(idx)
        _, _, shape, _, start, data, _ = codec.parse(head)
        return codec.from_bytes(file.read_at(data, at + start), self.dtype).reshape(shape)

    def layout(self, items: Sequence[int]) -> tuple[int, ...]:
        """The largest of each dimension, from the indexes alone."""
        return tuple(max(d) for d in zip(*(codec.parse(self._found(i)[3])[2] for i in items), strict=True))
