"""Errors of conversion, transforms, layouts and streams."""

from __future__ import annotations


class GridweaveError(Exception):
    """Base of all errors; ``kind`` is the short name that flag columns use."""

    kind = "Error"

    def __init__(self, message: str = ""):
        super().__init__(message or self.kind)


class ScalarConversionError(GridweaveError):
    kind = "ScalarConversion"


class ConversionOverflow(ScalarConversionError):
    kind = "Overflow"


class ConversionInvalid(ScalarConversionError):
    kind = "InvalidValue"


class ConversionFractional(ScalarConversionError):
    kind = "FractionalValue"


class TransformError(GridweaveError):
    kind = "Transform"


class UnsupportedDtype(TransformError):
    kind = "UnsupportedDtype"


class OverflowInTensor(TransformError):
    kind = "Overflow"


class InvalidParameter(TransformError):
    kind = "InvalidValue"


class CustomTransformError(TransformError):
    kind = "Custom"


class ViewError(GridweaveError):
    kind = "View"


class CastError(ViewError):
    kind = "Cast"


class ShapeError(ViewError):
    kind = "Shape"


class InvalidShape(GridweaveError):
    kind = "InvalidShape"


class BufferOverflow(GridweaveError):
    kind = "BufferOverflow"

    def __init__(self, total: int, needed: int):
        super().__init__(f"{needed} bytes needed, {total} there")
        self.total, self.needed = total, needed


class InvalidSlot(GridweaveError):
    kind = "InvalidSlot"


class DatasetError(GridweaveError):
    kind = "DatasetError"

    def __init__(self, source: str, idx: int | None = None):
        super().__init__(f"item {idx}: {source}" if idx is not None else source)
        self.source, self.idx = source, idx


class StreamError(GridweaveError):
    kind = "Stream"


class MalformedMessage(StreamError):
    kind = "MalformedMessage"


class ProtocolError(StreamError):
    kind = "Protocol"


class ConnectionLost(StreamError):
    kind = "Connection"
