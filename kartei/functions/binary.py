"""Functions over bytes, in Arrow batches where Spark has no built-in."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 64 * 1024


@F.pandas_udf(T.StringType())
def valid_utf8_prefix(data: pd.Series) -> pd.Series:
    """The longest prefix that is valid UTF-8; NULL for NULL, '' if the first byte is bad."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode("utf-8")
        except UnicodeDecodeError as e:
            return bytes(b)[: e.start].decode("utf-8")

    return data.map(one)


def text_of(data: Column, max_bytes: int = 1 << 20) -> Column:
    """Text of at most so many bytes: UTF-16 with a byte order mark, UTF-8, else windows-1252.

    A character that the byte budget cuts is dropped first, so that a long UTF-8 text stays one.
    """
    return _text_of(F.substring(data, 1, max_bytes + 4), F.lit(max_bytes))


@F.pandas_udf(T.StringType())
def _text_of(data: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else decode_text(bytes(b), int(n)) for b, n in zip(data, budget, strict=True)], dtype=object)


def decode_text(data: bytes, max_bytes: int) -> str:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        cut = data[: max_bytes - max_bytes % 2]
        return cut[2:].decode("utf-16-le" if data[:2] == b"\xff\xfe" else "utf-16-be", "ignore")
    cut = data[:max_bytes]
    if len(data) > max_bytes:  # back to the start of a character
        k = max_bytes
        while k > max(0, max_bytes - 4) and data[k] & 0xC0 == 0x80:
            k -= 1
        cut = data[:k]
    cut = cut.removeprefix(b"\xef\xbb\xbf")
    try:
        return cut.decode("utf-8")
    except UnicodeDecodeError:
        return cut.decode("cp1252", "replace")


@F.pandas_udf(T.StringType())
def ends_hash(data: pd.Series) -> pd.Series:
    """The wrapping sum of the size and of the first and last 64 KiB as 64-bit words, as hexadecimal; NULL for small files."""

    def one(b: bytes | None) -> str | None:
        if b is None or len(b) < BLOCK:
            return None
        b = bytes(b)
        total = len(b)
        for part in (b[:BLOCK], b[-BLOCK:]):
            total += sum(struct.unpack(f"<{BLOCK // 8}Q", part))
        return f"{total & 0xFFFFFFFFFFFFFFFF:016x}"

    return data.map(one)


@F.pandas_udf(T.StringType())
def octal_unescape(text: pd.Series) -> pd.Series:
    r"""\ooo triplets as the bytes they stand for."""
    import re

    def one(t: str | None) -> str | None:
        if t is None or "\\" not in t:
            return t
        raw = re.sub(rb"\\([0-3][0-7]{2})", lambda m: bytes([int(m.group(1), 8)]), t.encode("utf-8"))
        return raw.decode("utf-8", "replace")

    return text.map(one)


@F.pandas_udf(T.StringType())
def guess_encoding(data: pd.Series) -> pd.Series:
    """utf-8, utf-16 with a mark, or windows-1252."""

    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        b = bytes(b)
        if b[:2] in (b"\xff\xfe", b"\xfe\xff"):
            return "utf-16"
        try:
            b.decode("utf-8")
        except UnicodeDecodeError as e:
            return "utf-8" if e.start >= len(b) - 3 and e.reason.startswith("unexpected end") else "windows-1252"
        return "utf-8"

    return data.map(one)
