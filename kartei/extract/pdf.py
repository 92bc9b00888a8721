"""PDF without a library: document information, page count and the text of plain content streams."""

from __future__ import annotations

import re
import zlib

from kartei.extract.base import Info, Resource, Unreadable, limit_text
from kartei.extract.documents import ps_date
from kartei.extract.photo import apply_xmp

STREAM = re.compile(rb"<<(.{0,4000}?)>>\s*stream\r?\n", re.DOTALL)
LIMIT = 64 << 20


def _string(data: bytes) -> str:
    """A literal or hexadecimal string."""
    if data[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", data).decode().ljust(2, "0")[: len(data) // 2 * 2])
    else:
        raw = re.sub(rb"\\([nrtbf()\\]|[0-7]{1,3}|\r?\n)", lambda m: _escape(m.group(1)), data[1:-1])
    if raw[:2] == b"\xfe\xff":
        return raw[2:].decode("utf-16-be", "replace")
    return raw.decode("utf-8") if _is_utf8(raw) else raw.decode("cp1252", "replace")


def _is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def _escape(c: bytes) -> bytes:
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    if c[:1] in b"01234567":
        return bytes([int(c, 8) & 255])
    return named.get(c, b"" if c.strip() == b"" else c)


TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|T[jJ*]|'|\"|Td|TD|ET|-?\d*\.?\d+", re.DOTALL)


def pdf(content: bytes, info: Info) -> Resource:
    if b"%PDF-" not in content[:1024]:
        raise Unreadable("no PDF")
    r, objects, parts, left = Resource(), content, [], info.max_text
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        r.set("nfo:isContentEncrypted", "true")
    for m in STREAM.finditer(content):
        end = content.find(b"endstream", m.end())
        body, head = content[m.end() : end if end > 0 else len(content)], m[1]
        if b"FlateDecode" in head:
            unpack = zlib.decompressobj()
            try:
                body = unpack.decompress(body, LIMIT)
            except zlib.error:
                continue
            if unpack.unconsumed_tail:
                raise Unreadable(f"a stream of more than {LIMIT} bytes")
        if b"/ObjStm" in head:
            objects += b"\n" + body
        elif b"/Metadata" in head and b"/XML" in head:
            try:
                apply_xmp(r, body)
            except Unreadable:
                continue
        elif b"BT" in body and left > 0 and "nfo:isContentEncrypted" not in r.props:
            text = _page_text(body)
            if text:
                parts.append(text)
                left -= len(text.encode()) + 1
    info_object, outline = _directories(objects)
    for key, prop in ((b"Title", "nie:title"), (b"Subject", "nie:subject"), (b"Author", "nco:creator"), (b"Creator", "nie:generator"), (b"Keywords", "keywords"), (b"CreationDate", "nie:contentCreated")):
        m = re.search(rb"/" + key + rb"\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]+>)", info_object, re.DOTALL)
        if not m or "nfo:isContentEncrypted" in r.props:
            continue
        value = _string(m[1])
        if prop == "keywords":
            for k in re.split("[,;]", value):
                r.add("nie:keyword", k)
        else:
            r.set(prop, ps_date(value) if key == b"CreationDate" else value)
    r.set("nfo:pageCount", len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", objects)) or None)
    if "nfo:isContentEncrypted" not in r.props:
        r.set("nfo:tableOfContents", " ".join(outline))
    r.set("nie:plainTextContent", limit_text(" ".join(parts), info.max_text))
    return r


OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
TITLE = re.compile(rb"/Title\s*(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]+>)", re.DOTALL)


def _directories(objects: bytes) -> tuple[bytes, list[str]]:
    """The information object, or everything where none is named, and the titles of the outline in their order."""
    named = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", objects)
    found, outline = objects, []
    for m in OBJECT.finditer(objects):
        if named and m[1] == named[1]:
            found = m[2]
        elif b"/Parent" in m[2] and b"/Title" in m[2] and (t := TITLE.search(m[2])):
            outline.append(_string(t[1]))
    return found, outline


def _page_text(body: bytes) -> str:
    """Shown strings of the text blocks; large negative kerning is a blank."""
    out: list[str] = []
    held: list[str] = []
    for t in TOKEN.findall(body):
        if t[:1] in (b"(", b"<"):
            held.append(_string(t))
        elif t in (b"Tj", b"TJ", b"'", b'"'):
            out.extend(held)
            held = []
        elif t in (b"Td", b"TD", b"T*", b"ET"):
            out.append(" ")
            held = []
        elif held and t[:1] == b"-" and t[1:].replace(b".", b"").isdigit() and float(t) < -200:
            held.append(" ")
    return " ".join("".join(out).split())
