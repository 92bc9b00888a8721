"""Image headers."""

from __future__ import annotations

import re
import struct
import zlib

from kartei.extract.base import Info, Resource, Unreadable
from kartei.extract.photo import apply_exif, apply_iptc, apply_xmp, exif_date, photoshop_iptc, read_tiff
from kartei.functions.media import DLNA_JPEG


def _size(r: Resource, width: int, height: int) -> None:
    if width <= 0 or height <= 0:
        raise Unreadable("no size")
    r.set("nfo:width", width)
    r.set("nfo:height", height)


def _sidecar(r: Resource, info: Info) -> None:
    for data in info.sidecars.values():
        apply_xmp(r, data)


def jpeg(content: bytes, info: Info) -> Resource:
    if content[:2] != b"\xff\xd8":
        raise Unreadable("no JPEG")
    r, at, tiff, iptc, xmp = Resource(), 2, None, None, None
    width = height = 0
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            at += 1
            continue
        marker = content[at + 1]
        if marker in (0xFF, 0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker in (0xD9, 0xDA):
            break
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        body = content[at + 4 : at + 2 + size]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = struct.unpack(">HH", body[1:5])
        elif marker == 0xE1 and body.startswith(b"Exif\0\0"):
            tiff = tiff or body[6:]
        elif marker == 0xE1 and body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
            xmp = xmp or body[29:]
        elif marker == 0xED and body.startswith(b"Photoshop 3.0\0"):
            iptc = iptc or photoshop_iptc(body[14:])
        elif marker == 0xFE:
            r.set("nie:comment", body.decode("utf-8", "replace"))
        elif marker == 0xE0 and body.startswith(b"JFIF\0") and len(body) >= 12:
            unit, x, y = struct.unpack(">BHH", body[7:12])
            if unit and x and y:
                r.set("nfo:horizontalResolution", x * (2.54 if unit == 2 else 1.0))
                r.set("nfo:verticalResolution", y * (2.54 if unit == 2 else 1.0))
        at += 2 + size
    _size(r, width, height)
    _sidecar(r, info)
    if xmp:
        apply_xmp(r, xmp)
    if tiff:
        apply_exif(r, read_tiff(tiff))
    if iptc:
        apply_iptc(r, iptc)
    if profile := next((n for w, h, n in DLNA_JPEG if width <= w and height <= h), None):
        r.set("nmm:dlnaProfile", profile)
        r.set("nmm:dlnaMime", "image/jpeg")
    return r


# PNG text keywords.
PNG_TEXT = {"title": "nie:title", "author": "nco:creator", "creator": "nco:creator", "description": "nie:description", "comment": "nie:comment", "copyright": "nie:copyright", "disclaimer": "nie:license", "creation time": "nie:contentCreated", "software": "nie:generator"}


def png(content: bytes, info: Info) -> Resource:
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise Unreadable("no PNG")
    r, at, width, height, depth = Resource(), 8, 0, 0, 8
    texts: dict[str, str] = {}
    while at + 8 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR" and len(body) >= 10:
            width, height, bits, colour = struct.unpack(">IIBB", body[:10])
            depth = bits * {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour, 1)
        elif kind == b"tEXt" and b"\0" in body:
            k, v = body.split(b"\0", 1)
            texts.setdefault(k.decode("latin-1"), v.decode("latin-1"))
        elif kind == b"zTXt" and b"\0" in body:
            k, v = body.split(b"\0", 1)
            texts.setdefault(k.decode("latin-1"), _inflate(v[1:]).decode("latin-1"))
        elif kind == b"iTXt" and body.count(b"\0") >= 3:
            k, rest = body.split(b"\0", 1)
            packed, rest = rest[:1] == b"\1", rest[2:]
            _, _, v = (rest.split(b"\0", 2) + [b"", b""])[:3]
            texts.setdefault(k.decode("latin-1"), (_inflate(v) if packed else v).decode("utf-8", "replace"))
        elif kind == b"eXIf":
            apply_exif(r, read_tiff(body))
        elif kind == b"pHYs" and len(body) >= 9 and body[8] == 1:
            r.set("nfo:horizontalResolution", round(struct.unpack(">I", body[:4])[0] / 100 * 2.54, 4))
            r.set("nfo:verticalResolution", round(struct.unpack(">I", body[4:8])[0] / 100 * 2.54, 4))
        elif kind in (b"IEND", b"IDAT") and kind == b"IEND":
            break
    _size(r, width, height)
    _sidecar(r, info)
    for k, v in texts.items():
        low = k.lower()
        if low == "xml:com.adobe.xmp":
            apply_xmp(r, v.encode())
        elif low in ("raw profile type exif", "raw profile type app1"):
            raw = bytes.fromhex(re.sub(r"\s", "", "".join(v.strip().split("\n")[2:])))
            apply_exif(r, read_tiff(raw.removeprefix(b"Exif\0\0")))
        elif low in PNG_TEXT:
            (r.add if PNG_TEXT[low].startswith("nco:") else r.set)(PNG_TEXT[low], v)
    if "screenshot" in info.url.lower():
        r.add("nie:isPartOf", "nfo:image-category-screenshot")
    small = {(120, 120): "PNG_LRG_ICO", (48, 48): "PNG_SM_ICO"}.get((width, height))
    r.set("nmm:dlnaProfile", small or ("PNG_TN" if max(width, height) <= 160 else "PNG_LRG" if depth <= 32 and max(width, height) <= 4096 else None))
    return r


def _inflate(data: bytes, most: int = 1 << 24) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, most)
    except zlib.error:
        return b""


def gif(content: bytes, info: Info) -> Resource:
    if content[:6] not in (b"GIF87a", b"GIF89a") or len(content) < 13:
        raise Unreadable("no GIF")
    r = Resource()
    width, height, flags = struct.unpack("<HHB", content[6:11])
    _size(r, width, height)
    at = 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    _sidecar(r, info)
    while at < len(content) and content[at] != 0x3B:
        if content[at] == 0x2C:
            if at + 10 > len(content):
                break
            f = content[at + 9]
            at += 10 + (3 << ((f & 7) + 1) if f & 0x80 else 0) + 1
            _, at = _blocks(content, at)
        elif content[at] == 0x21 and at + 1 < len(content):
            kind = content[at + 1]
            first = at + 2
            data, at = _blocks(content, first)
            if kind == 0xFE:
                r.set("nie:comment", data.decode("utf-8", "replace"))
            elif kind == 0xFF and data.startswith(b"XMP DataXMP") and b"<" in content[first:at]:
                raw = content[first + 12 : at]
                apply_xmp(r, raw)
        else:
            break
    return r


def _blocks(content: bytes, at: int) -> tuple[bytes, int]:
    """Data sub-blocks joined, and what follows them."""
    out = bytearray()
    while at < len(content) and content[at]:
        n = content[at]
        out += content[at + 1 : at + 1 + n]
        at += 1 + n
    return bytes(out), at + 1


def tiff(content: bytes, info: Info) -> Resource:
    t, r = read_tiff(content), Resource()
    if isinstance(t.get("width"), int) and isinstance(t.get("height"), int):
        _size(r, t["width"], t["height"])
    else:
        raise Unreadable("no size")
    xmp, iptc = t.get("xmp"), t.get("iptc")
    if isinstance(xmp, bytes):
        apply_xmp(r, xmp)
    _sidecar(r, info)
    apply_exif(r, t)
    if isinstance(iptc, bytes):
        apply_iptc(r, iptc)
    r.set("nie:contentCreated", exif_date(t.get("datetime")))
    return r


def raw(content: bytes, info: Info) -> Resource:
    """Camera raw formats built on TIFF: the sizes of the EXIF directory come first."""
    t, r = read_tiff(content), Resource()
    width, height = t.get("pixel_x") or t.get("width"), t.get("pixel_y") or t.get("height")
    if isinstance(width, int) and isinstance(height, int):
        _size(r, width, height)
    apply_exif(r, t)
    return r


def webp(content: bytes, info: Info) -> Resource:
    if content[:4] != b"RIFF" or content[8:12] != b"WEBP":
        raise Unreadable("no WebP")
    r, kind, b = Resource(), content[12:16], content[20:]
    if kind == b"VP8X":
        width, height = 1 + int.from_bytes(b[4:7], "little"), 1 + int.from_bytes(b[7:10], "little")
    elif kind == b"VP8L" and b[:1] == b"\x2f":
        bits = int.from_bytes(b[1:5], "little")
        width, height = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    elif kind == b"VP8 " and b[3:6] == b"\x9d\x01\x2a":
        width, height = (x & 0x3FFF for x in struct.unpack("<HH", b[6:10]))
    else:
        raise Unreadable("no frame")
    _size(r, width, height)
    return r


def bmp(content: bytes, info: Info) -> Resource:
    if content[:2] != b"BM" or len(content) < 26:
        raise Unreadable("no BMP")
    r = Resource()
    header = struct.unpack("<I", content[14:18])[0]
    width, height = struct.unpack("<HH", content[18:22]) if header == 12 else struct.unpack("<ii", content[18:26])
    _size(r, width, abs(height))
    return r


def icon(content: bytes, info: Info) -> Resource:
    """The largest size of the directory; 0 stands for 256."""
    if len(content) < 6 or struct.unpack("<HH", content[:4])[0] != 0 or content[2] not in (1, 2):
        raise Unreadable("no icon")
    n = struct.unpack("<H", content[4:6])[0]
    sizes = [(content[6 + 16 * k] or 256, content[7 + 16 * k] or 256) for k in range(n) if 22 + 16 * k <= len(content)]
    if not sizes:
        raise Unreadable("an empty directory")
    r = Resource()
    _size(r, max(w for w, _ in sizes), max(h for _, h in sizes))
    return r
