"""Properties written back into files: an XMP packet in images, tags in MP3 and FLAC.

What a file holds besides is kept: other segments, chunks, frames and comments, and the image or sound itself byte for byte.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from kartei.extract.audio import FRAMES, VORBIS
from kartei.extract.base import Unreadable
from kartei.extract.pipeline import xmp_sidecar

XMP_HEAD = b"http://ns.adobe.com/xap/1.0/\0"
#: Frames that properties go to; of several frames for one property the first is written, all are removed.
FRAME_OF = {prop: name for name, prop in reversed(FRAMES.items())} | {"nmm:trackNumber": "TRCK", "nmm:setNumber": "TPOS"}
COMMENT_OF = {frame: key for key, frame in reversed(VORBIS.items())}


def into_jpeg(content: bytes, packet: bytes) -> bytes:
    """The packet as the last of the segments before the image, in place of an older one."""
    if content[:2] != b"\xff\xd8":
        raise Unreadable("no JPEG")
    if len(packet) + len(XMP_HEAD) + 2 > 0xFFFF:
        raise ValueError("the packet is too long for a segment")
    out, at = bytearray(content[:2]), 2
    while at + 4 <= len(content) and content[at] == 0xFF and 0xE0 <= content[at + 1] <= 0xEF:
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        if not (content[at + 1] == 0xE1 and content[at + 4 :].startswith(XMP_HEAD)):
            out += content[at : at + 2 + size]
        at += 2 + size
    segment = XMP_HEAD + packet
    return bytes(out) + b"\xff\xe1" + struct.pack(">H", len(segment) + 2) + segment + content[at:]


def into_png(content: bytes, packet: bytes) -> bytes:
    """The packet as a text chunk behind the header, in place of an older one."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise Unreadable("no PNG")
    body = b"XML:com.adobe.xmp\0\0\0\0\0" + packet
    chunk = struct.pack(">I", len(body)) + b"iTXt" + body + struct.pack(">I", zlib.crc32(b"iTXt" + body))
    out, at = bytearray(content[:8]), 8
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        part = content[at : at + 12 + size]
        at += 12 + size
        if not (kind == b"iTXt" and part[8:].startswith(b"XML:com.adobe.xmp\0")):
            out += part
        if kind == b"IHDR":
            out += chunk
    return bytes(out)


def into_gif(content: bytes, packet: bytes) -> bytes:
    """The packet as an application block before the trailer; the bytes behind it lead any reader of blocks to its end."""
    if content[:6] not in (b"GIF87a", b"GIF89a"):
        raise Unreadable("no GIF")
    head, tail = b"\x21\xff\x0bXMP DataXMP", b"\x01" + bytes(range(255, -1, -1)) + b"\0"
    start = content.find(head)
    if start >= 0:
        end = content.find(tail, start)
        if end < 0:
            raise Unreadable("a broken packet")
        content = content[:start] + content[end + len(tail) :]
    if content[-1:] != b"\x3b":
        raise Unreadable("no trailer")
    return b"GIF89a" + content[6:-1] + head + packet + tail + b"\x3b"


def into_tiff(content: bytes, packet: bytes) -> bytes:
    """The packet behind the file, with a new first directory that names it; the old one is left unused."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8:
        raise Unreadable("no TIFF header")
    at = struct.unpack(order + "I", content[4:8])[0]
    if at + 2 > len(content):
        raise Unreadable("no directory")
    n = struct.unpack(order + "H", content[at : at + 2])[0]
    entries = [content[at + 2 + 12 * k : at + 14 + 12 * k] for k in range(n)]
    follows = content[at + 2 + 12 * n : at + 6 + 12 * n].ljust(4, b"\0")
    content += bytes(len(content) % 2)
    place = len(content)
    content += packet + bytes(len(packet) % 2)
    tag = struct.pack(order + "HHII", 0x02BC, 1, max(len(packet), 5), place)
    entries = sorted([e for e in entries if struct.unpack(order + "H", e[:2])[0] != 0x02BC] + [tag], key=lambda e: struct.unpack(order + "H", e[:2])[0])
    directory = struct.pack(order + "H", len(entries)) + b"".join(entries) + follows
    return content[:4] + struct.pack(order + "I", len(content)) + content[8:] + directory


def _safe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return sum((x & 0x7F) << s for x, s in zip(b, (21, 14, 7, 0), strict=True))


def _frames(content: bytes) -> tuple[list[tuple[str, bytes]], int]:
    """The raw frames of a version 2.3 or 2.4 tag, and where the sound begins."""
    if content[:3] != b"ID3" or len(content) < 10:
        return [], 0
    version, flags, size = content[3], content[5], _unsafe(content[6:10])
    if version not in (3, 4) or flags & 0xC0:
        raise ValueError("a tag of this kind is not rewritten")
    body, at, out = content[10 : 10 + size], 0, []
    while at + 10 <= len(body) and body[at]:
        n = struct.unpack(">I", body[at + 4 : at + 8])[0] if version == 3 else _unsafe(body[at + 4 : at + 8])
        out.append((body[at : at + 4].decode("latin-1"), body[at + 10 : at + 10 + n]))
        at += 10 + n
    return out, 10 + size


def into_mp3(content: bytes, props: dict[str, list[str]]) -> bytes:
    """A tag of version 2.4 with the properties, the other frames as they were, and the sound."""
    old, start = _frames(content)
    new = {FRAME_OF[p]: v for p, v in props.items() if p in FRAME_OF and v}
    gone = {name for name, prop in FRAMES.items() if prop in props} | set(new)
    frames = [(n, b) for n, b in old if n not in gone] + [(n, b"\x03" + "\0".join(v).encode()) for n, v in sorted(new.items())]
    body = b"".join(n.encode() + _safe(len(b)) + b"\0\0" + b for n, b in frames)
    return b"ID3\x04\0\0" + _safe(len(body)) + body + content[start:]


def into_flac(content: bytes, props: dict[str, list[str]]) -> bytes:
    """The block of comments with the properties and all others, behind the first block."""
    if content[:4] != b"fLaC":
        raise Unreadable("no FLAC")
    blocks, at, last = [], 4, 0
    while not last and at + 4 <= len(content):
        last, kind, size = content[at] >> 7, content[at] & 0x7F, int.from_bytes(content[at + 1 : at + 4], "big")
        blocks.append((kind, content[at + 4 : at + 4 + size]))
        at += 4 + size
    new = {COMMENT_OF[f]: v for p, v in props.items() if v and (f := FRAME_OF.get(p)) in COMMENT_OF}
    maker, held = b"", []
    for kind, body in blocks:
        if kind == 4:
            n = struct.unpack("<I", body[:4])[0]
            maker, k = body[4 : 4 + n], 8 + n
            for _ in range(struct.unpack("<I", body[4 + n : 8 + n])[0]):
                n = struct.unpack("<I", body[k : k + 4])[0]
                held.append(body[k + 4 : k + 4 + n])
                k += 4 + n
    held = [h for h in held if h.split(b"=")[0].decode("latin-1").lower() not in new] + [f"{k.upper()}={x}".encode() for k, v in sorted(new.items()) for x in v]
    text = lambda b: struct.pack("<I", len(b)) + b
    blocks = [b for b in blocks if b[0] != 4]
    blocks.insert(1, (4, text(maker) + struct.pack("<I", len(held)) + b"".join(map(text, held))))
    joined = b"".join(bytes([kind | (0x80 if k == len(blocks) - 1 else 0)]) + len(b).to_bytes(3, "big") + b for k, (kind, b) in enumerate(blocks))
    return b"fLaC" + joined + content[at:]


IMAGES = {"image/jpeg": into_jpeg, "image/png": into_png, "sketch/png": into_png, "image/gif": into_gif, "image/tiff": into_tiff}
SOUNDS = {"audio/mpeg": into_mp3, "audio/x-mp3": into_mp3, "audio/flac": into_flac, "audio/x-flac": into_flac}


def rewritten(content: bytes, mime: str, props: dict[str, list[str]]) -> bytes:
    """A file with the properties in it; ValueError for types and tags that are not written."""
    if mime in IMAGES:
        return IMAGES[mime](content, xmp_sidecar(props).encode())
    if mime in SOUNDS:
        return SOUNDS[mime](content, props)
    raise ValueError(f"{mime} is not written")


def _props(value) -> dict[str, list[str]]:
    return {k: list(v) for k, v in dict(value or {}).items()}


def rewrite(files: DataFrame) -> DataFrame:
    """files(url, mime_type, content, props) to (url, mime_type, content, error); content is NULL where it was not written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                try:
                    rows.append((r.url, r.mime_type, rewritten(bytes(r.content or b""), r.mime_type, _props(r.props)), None))
                except Exception as e:  # a file that can't be written is data
                    rows.append((r.url, r.mime_type, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["url", "mime_type", "content", "error"])

    return files.select("url", "mime_type", "content", "props").mapInPandas(run, "url string, mime_type string, content binary, error string")


def write_files(files: DataFrame) -> DataFrame:
    """files(path, mime_type, props) rewritten in place, each by a temporary file and an atomic rename: (path, error)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                error = None
                try:
                    with open(r.path, "rb") as f:
                        data = rewritten(f.read(), r.mime_type, _props(r.props))
                    with open(f"{r.path}.part", "wb") as f:
                        f.write(data)
                    os.replace(f"{r.path}.part", r.path)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"[:500]
                rows.append((r.path, error))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return files.select("path", "mime_type", "props").mapInPandas(run, "path string, error string")
