"""Arrow strings as numpy arrays, without a call per row."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa


def as_string(arr: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """One contiguous 32-bit-offset string array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    return arr if arr.type == pa.string() else arr.cast(pa.string())


def raw_bytes(arr: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the byte offset of each row (n + 1 values); a null row is empty."""
    off = np.frombuffer(arr.buffers()[1], dtype=np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    if arr.buffers()[2] is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def code_points(arr: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all rows and the offset of each row in them."""
    data, off = raw_bytes(arr)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, lead[off]


def from_code_points(points: np.ndarray, off: np.ndarray, mask: np.ndarray | None = None) -> pa.StringArray:
    """The inverse of code_points; mask is true for null rows."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
    at = np.concatenate(([0], np.cumsum(width)))[off].astype(np.int32)
    valid = None if mask is None or not mask.any() else pa.py_buffer(np.packbits(~mask, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(data), valid)


SENTENCE = re.compile(r"[^\n.!?…]*(?:[.!?…](?=[^\s”’»\"')\]])[^\n.!?…]*)*[.!?…]*[”’»\"')\]]*", re.UNICODE)


def sentences(text: str) -> list[str]:
    """Pieces that end at a line break, or at an end mark (with closing quotes) before a blank."""
    return [s for m in SENTENCE.finditer(text) if (s := m.group().strip())]
