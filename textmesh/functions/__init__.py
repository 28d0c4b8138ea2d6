"""Column helpers: code units of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def text_units(text: Column) -> Column:
    """Code units of a text; null for null."""
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def as_units(text: Column) -> Column:
    """The code units of a text as array<int>, half of a pair at a time."""
    raw = F.hex(F.encode(text, "UTF-16LE"))
    at = F.when(F.length(raw) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.length(raw) - 3, F.lit(4)))
    return F.transform(at, lambda i: F.conv(F.concat(F.substring(raw, i + 2, F.lit(2)), F.substring(raw, i, F.lit(2))), 16, 10).cast("int"))


def is_empty(text: Column) -> Column:
    """Whether a text, or UTF-16LE value, has no unit; null for null."""
    return F.octet_length(text) == 0


def utf16_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code units, row offsets) of a string, array<int> or UTF-16LE binary
    column; null rows are empty."""
    n = len(column)
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        size = np.array(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
        values = column.drop_null().flatten().to_numpy(zero_copy_only=False) if column.null_count else column.flatten().to_numpy(zero_copy_only=False)
        return values.astype(np.int64).astype(np.uint16), np.concatenate(([0], np.cumsum(size)))
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        parts = [b or b"" for b in column.to_pylist()]
        if any(len(b) % 2 for b in parts):
            raise ValueError("a UTF-16LE value has an odd number of bytes")
        size = np.array([len(b) // 2 for b in parts], np.int64)
        return np.frombuffer(b"".join(parts), "<u2"), np.concatenate(([0], np.cumsum(size)))
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    if data is None or not n:
        return np.zeros(0, np.uint16), np.zeros(n + 1, np.int64)
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    if not len(raw) or raw.max() < 128:
        return raw.astype(np.uint16), off
    # a unit for each byte that begins a character, two for those of four bytes
    made = np.concatenate(([0], np.cumsum(((raw & 0xC0) != 0x80).astype(np.int64) + (raw >= 0xF0))))
    return np.frombuffer(raw.tobytes().decode().encode("utf-16-le"), "<u2"), made[off]


import pyarrow.compute  # noqa: E402, F401
