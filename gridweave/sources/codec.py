"""Binary tensors: header, shape, strides and data in one value.

Header of 8 bytes (dtype code, number of dimensions, ready flag, zeros), then the dimensions and strides as unsigned 64-bit
numbers, then the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gridweave import dtypes as dt
from gridweave.dtypes import DType
from gridweave.errors import InvalidShape, MalformedMessage, ProtocolError

DECODED = "dtype string, ndims int, shape array<bigint>, strides array<bigint>, data_offset int, data_size bigint, ready boolean"


def to_bytes(values, dtype: DType) -> bytes:
    x = np.asarray(values)
    if dtype is dt.BF16:
        return dt.bf16_bits(x.astype(np.float32)).astype(dtype.numpy).tobytes()
    with np.errstate(over="ignore"):
        return x.astype(dtype.numpy).tobytes()


def from_bytes(raw: bytes, dtype: DType) -> np.ndarray:
    x = np.frombuffer(raw, dtype.numpy)
    return dt.bf16_values(x) if dtype is dt.BF16 else x.astype(np.float32) if dtype is dt.F16 else x


def encode(values, shape, strides, dtype: DType, ready: bool = True) -> bytes:
    if len(shape) != len(strides) or len(shape) > 255:
        raise InvalidShape
    head = bytes([dtype.code, len(shape), int(ready), 0, 0, 0, 0, 0])
    dims = np.array([*shape, *strides], "<u8").tobytes()
    return head + dims + to_bytes(values, dtype)


def parse(raw: bytes) -> tuple:
    """(dtype, ndims, shape, strides, data_offset, data_size, ready) of an encoded tensor."""
    if len(raw) < 8 or raw[0] not in dt.BY_CODE:
        raise MalformedMessage(f"unknown dtype code {raw[0] if raw else None}")
    dtype, n = dt.BY_CODE[raw[0]], raw[1]
    at = 8 + 16 * n
    if len(raw) < at:
        raise MalformedMessage("the header is cut off")
    dims = np.frombuffer(raw[8:at], "<u8").astype(np.int64)
    shape, strides = dims[:n].tolist(), dims[n:].tolist()
    return dtype.name, n, shape, strides, at, int(np.prod(shape, dtype=np.int64)) * dtype.size, bool(raw[2])


def header_size(raw) -> int:
    """Bytes of an encoded tensor before its data."""
    if len(raw) < 8 or raw[0] not in dt.BY_CODE:
        raise MalformedMessage(f"unknown dtype code {raw[0] if len(raw) else None}")
    return 8 + 16 * raw[1]


def _flat(lists: pd.Series, kind) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of arrays, end to end, and where each row's begin and the last ends."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    values = np.concatenate(lists.to_list()) if len(lists) else np.zeros(0)
    return values.astype(kind, copy=False), np.r_[0, np.cumsum(sizes)]


def encoder(dtype: DType):
    """Column function (tensor, shape, strides) -> binary."""

    @F.pandas_udf("binary")
    def run(tensor: pd.Series, shape: pd.Series, strides: pd.Series) -> pd.Series:
        values, at = _flat(tensor, None)
        data = memoryview(to_bytes(values, dtype))  # one conversion for all rows
        heads: dict[tuple, bytes] = {}
        out = []
        for k, (s, r) in enumerate(zip(shape, strides, strict=True)):
            layout = (tuple(s), tuple(r))
            head = heads.get(layout)
            if head is None:
                head = heads[layout] = encode([], s, r, dtype)
            out.append(head + data[at[k] * dtype.size : at[k + 1] * dtype.size])
        return pd.Series(out)

    return run


def framer(dtype: DType):
    """Column function (little-endian bytes, shape, strides) -> binary."""

    @F.pandas_udf("binary")
    def run(raw: pd.Series, shape: pd.Series, strides: pd.Series) -> pd.Series:
        heads: dict[tuple, bytes] = {}
        out = []
        for x, s, r in zip(raw, shape, strides, strict=True):
            layout = (tuple(s), tuple(r))
            if layout not in heads:
                heads[layout] = encode([], s, r, dtype)
            out.append(heads[layout] + bytes(x))
        return pd.Series(out)

    return run


def _by_header(raw: pa.Array):
    """(rows, headers as bytes, where each row's data begins in the column's bytes, those bytes) of encoded tensors with as many dimensions."""
    kind = np.int64 if pa.types.is_large_binary(raw.type) else np.int32
    _, offsets, data = raw.buffers()
    at = np.frombuffer(offsets, kind)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    sizes = np.diff(at)
    if raw.null_count or (sizes < 8).any():
        raise MalformedMessage("a tensor is null or has no header")
    dims = flat[at[:-1] + 1].astype(np.int64)
    for n in np.unique(dims).tolist():
        rows = np.nonzero(dims == n)[0]
        head = 8 + 16 * n
        if (sizes[rows] < head).any():
            raise MalformedMessage("the header is cut off")
        yield rows, flat[at[rows, None] + np.arange(head)], at[rows] + head, flat


def _numbers(heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shapes and strides of headers with as many dimensions."""
    dims = np.ascontiguousarray(heads[:, 8:]).view("<u8").astype(np.int64).reshape(len(heads), -1)
    return dims[:, : dims.shape[1] // 2], dims[:, dims.shape[1] // 2 :]


def _lists(parts: list, rows: int) -> pa.Array:
    """One array of lists from (rows, matrix) pairs."""
    sizes = np.zeros(rows, np.int64)
    for at, m in parts:
        sizes[at] = m.shape[1]
    ends = np.r_[0, np.cumsum(sizes)]
    flat = np.zeros(ends[-1], np.int64)
    for at, m in parts:
        flat[ends[at][:, None] + np.arange(m.shape[1])] = m
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def header_parser():
    """Column function binary -> struct of the header's fields."""

    @F.arrow_udf(DECODED)
    def run(raw: pa.Array) -> pa.Array:
        n = len(raw)
        codes, ndims, ready = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, bool)
        sizes, shapes, strides = np.zeros(n, np.int64), [], []
        for rows, heads, _, _ in _by_header(raw):
            codes[rows], ndims[rows], ready[rows] = heads[:, 0], heads[:, 1], heads[:, 2] != 0
            if unknown := set(codes[rows].tolist()) - set(dt.BY_CODE):
                raise MalformedMessage(f"unknown dtype code {unknown.pop()}")
            s, r = _numbers(heads)
            shapes.append((rows, s))
            strides.append((rows, r))
            sizes[rows] = s.prod(axis=1) * np.array([dt.BY_CODE[c].size for c in codes[rows].tolist()], np.int64)
        names = [dt.BY_CODE[c].name for c in codes.tolist()]
        columns = [pa.array(names, pa.string()), pa.array(ndims), _lists(shapes, n), _lists(strides, n), pa.array(8 + 16 * ndims, pa.int32()), pa.array(sizes), pa.array(ready)]
        return pa.StructArray.from_arrays(columns, names=[x.split()[0] for x in DECODED.split(", ")])

    return run


def decoder(dtype: DType):
    """Column function binary -> array of the tensor's data."""

    @F.arrow_udf(dtype.array())
    def run(raw: pa.Array) -> pa.Array:
        n = len(raw)
        first, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        flat = np.zeros(0, np.uint8)
        for rows, heads, at, flat in _by_header(raw):  # noqa: B007
            if others := set(heads[:, 0].tolist()) - {dtype.code}:
                code = others.pop()
                raise MalformedMessage(f"{dt.BY_CODE[code].name if code in dt.BY_CODE else code} where {dtype.name} was said")
            first[rows], size[rows] = at, _numbers(heads)[0].prod(axis=1) * dtype.size
        if n and (first + size > np.frombuffer(raw.buffers()[1], np.int32 if not pa.types.is_large_binary(raw.type) else np.int64)[raw.offset + 1 : raw.offset + n + 1]).any():
            raise MalformedMessage("the data is cut off")
        ends = np.cumsum(size)
        view = memoryview(flat)
        values = from_bytes(b"".join([view[a : a + k] for a, k in zip(first.tolist(), size.tolist(), strict=True)]), dtype)
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends // dtype.size], pa.int32()), pa.array(values))
        return lists.cast(pa.list_(_ARROW[dtype.spark]))

    return run


_ARROW = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}

#: Fields of the header as a handshake announces them (fixed values).
HEADER = {
    "header_size": 8, "dt_offset": 0, "dt_size": 1, "ndims_offset": 1, "ndims_size": 1, "is_ready_offset": 2, "is_ready_size": 1, "shape_type_size": 8,
}


def handshake_line(version: str, fields: dict[str, int] | None = None) -> str:
    """'ZT <version> key=value ...': the line that announces the encoding to a consumer."""
    return " ".join(["ZT", version, *(f"{k}={v}" for k, v in (HEADER | (fields or {})).items())]) + "\n"


def parse_handshake(line: str, version: str, needed=tuple(HEADER)) -> dict[str, int]:
    """The numbers of a handshake line; raises for another protocol or version, a value that is no number, or a missing field."""
    parts = line.split()
    if len(parts) < 2 or parts[0] != "ZT":
        raise ProtocolError(f"no handshake: {line!r}")
    if parts[1] != version:
        raise ProtocolError(f"version {parts[1]} where {version} is spoken")
    out = {}
    for key, mark, value in (p.partition("=") for p in parts[2:]):
        if mark:
            try:
                out[key] = int(value)
            except ValueError as e:
                raise MalformedMessage(f"{key} is no number: {value}") from e
    if gone := [k for k in needed if k not in out]:
        raise ProtocolError(f"missing in the handshake: {', '.join(gone)}")
    return out


def handshake_fields(line):
    """Column: key=value pairs of a handshake line as a map."""
    return F.str_to_map(line, F.lit(" "), F.lit("="))
