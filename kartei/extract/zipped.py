"""Documents in ZIP files: EPUB, OpenDocument, Office Open XML and XPS."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

from kartei.extract.base import Info, Resource, Unreadable, limit_text
from kartei.extract.documents import html

#: A member that unpacks to more makes its file unreadable: an error row, not a shorter text.
MEMBER_LIMIT = 64 << 20


def _open(content: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Unreadable(str(e)) from e


def _read(z: zipfile.ZipFile, name: str) -> bytes | None:
    if name not in z.NameToInfo:
        return None
    if z.getinfo(name).file_size > MEMBER_LIMIT:
        raise Unreadable(f"{name}: more than {MEMBER_LIMIT} bytes")
    return z.read(name)


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    data = _read(z, name)
    if data is None:
        return None
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise Unreadable(f"{name}: {e}") from e


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _join(parts: list[str], budget: int) -> str:
    return limit_text(" ".join(" ".join(p.split()) for p in parts if p.strip()), budget)


def epub(content: bytes, info: Info) -> Resource:
    z, r = _open(content), Resource()
    box = _xml(z, "META-INF/container.xml")
    opf_path = next((_attr(e, "full-path") for e in box.iter() if _local(e) == "rootfile"), None) if box is not None else None
    opf = _xml(z, opf_path) if opf_path else None
    if opf is None:
        raise Unreadable("no package document")
    base = opf_path.rsplit("/", 1)[0] + "/" if "/" in opf_path else ""
    roles = {"aut": "nco:creator", "edt": "nco:publisher", "ill": "nco:contributor", "trl": "nco:contributor"}
    items, spine = {}, []
    for e in opf.iter():
        tag, text = _local(e), (e.text or "").strip()
        if tag == "title":
            r.set("nie:title", text)
        elif tag == "creator":
            r.add(roles.get(_attr(e, "role") or "aut", "nco:contributor"), text)
        elif tag == "contributor":
            r.add("nco:contributor", text)
        elif tag == "publisher":
            r.add("nco:publisher", text)
        elif tag == "subject":
            r.add("nie:subject", text)
        elif tag == "language":
            r.set("nie:language", text)
        elif tag == "date":
            r.set("nie:contentCreated", text)
        elif tag == "description":
            r.set("nie:description", text)
        elif tag == "item":
            items[_attr(e, "id")] = _attr(e, "href")
        elif tag == "itemref":
            spine.append(_attr(e, "idref"))
    parts, left = [], info.max_text
    for ref in spine:
        if left <= 0 or not items.get(ref):
            continue
        page = _read(z, base + items[ref])
        if page:
            text = html(page, Info(info.url, info.mime, left)).get("nie:plainTextContent") or ""
            parts.append(text)
            left -= len(text.encode()) + 1
    r.set("nie:plainTextContent", _join(parts, info.max_text))
    return r


def oasis(content: bytes, info: Info) -> Resource:
    z, r = _open(content), Resource()
    meta = _xml(z, "meta.xml")
    for e in meta.iter() if meta is not None else ():
        tag, text = _local(e), (e.text or "").strip()
        if tag == "title":
            r.set("nie:title", text)
        elif tag == "subject":
            r.set("nie:subject", text)
        elif tag in ("creator", "initial-creator"):
            r.set("nco:publisher", text)
        elif tag == "keyword":
            for k in re.split("[,;]", text):
                r.add("nie:keyword", k)
        elif tag == "description":
            r.set("nie:comment", text)
        elif tag == "generator":
            r.set("nie:generator", text)
        elif tag == "creation-date":
            r.set("nie:contentCreated", text)
        elif tag == "document-statistic":
            r.set("nfo:pageCount", _attr(e, "page-count"))
            r.set("nfo:wordCount", _attr(e, "word-count"))
    body = _xml(z, "content.xml")
    if body is None:
        raise Unreadable("no content")
    parts: list[str] = []

    def walk(e: ET.Element) -> None:
        if e.text:
            parts.append(e.text)
        for c in e:
            if _local(c) in ("s", "tab", "line-break"):
                parts.append(" ")
            walk(c)
            if c.tail:
                parts.append(c.tail)

    for e in body.iter():
        if _local(e) in ("p", "h"):
            walk(e)
            parts.append("\n")
    r.set("nie:plainTextContent", limit_text(" ".join("".join(parts).split()), info.max_text))
    return r


def msoffice_xml(content: bytes, info: Info) -> Resource:
    z, r = _open(content), Resource()
    names = z.namelist()
    core, app = _xml(z, "docProps/core.xml"), _xml(z, "docProps/app.xml")
    for e in core.iter() if core is not None else ():
        tag, text = _local(e), (e.text or "").strip()
        for key, prop in (("title", "nie:title"), ("subject", "nie:subject"), ("creator", "nco:creator"), ("description", "nie:comment"), ("created", "nie:contentCreated"), ("modified", "nie:contentLastModified")):
            if tag == key:
                r.set(prop, text)
        if tag == "keywords":
            for k in re.split("[,;]", text):
                r.add("nie:keyword", k)
    for e in app.iter() if app is not None else ():
        tag, text = _local(e), (e.text or "").strip()
        for key, prop in (("Pages", "nfo:pageCount"), ("Slides", "nfo:pageCount"), ("Words", "nfo:wordCount"), ("Lines", "nfo:lineCount"), ("Application", "nie:generator")):
            if tag == key:
                r.set(prop, text)
    parts: list[str] = []
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    if "word/document.xml" in names:
        parts = _runs(_xml(z, "word/document.xml"), {"t"}, {"p"})
    elif "xl/sharedStrings.xml" in names:
        parts = [t for t in _runs(_xml(z, "xl/sharedStrings.xml"), {"t"}, {"si"}) if not t.strip().isdigit()]
    else:
        for n in sorted((n for n in names if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=number):
            parts += _runs(_xml(z, n), {"t"}, {"p"})
    if not parts and not any(n.startswith(("word/", "xl/", "ppt/")) for n in names):
        raise Unreadable("no Office document")
    r.set("nie:plainTextContent", _join(parts, info.max_text))
    return r


def _runs(root: ET.Element | None, texts: set[str], blocks: set[str]) -> list[str]:
    out: list[str] = []
    for e in root.iter() if root is not None else ():
        if _local(e) in blocks:
            out.append("".join(t.text or "" for t in e.iter() if _local(t) in texts))
    return out


def xps(content: bytes, info: Info) -> Resource:
    z, r = _open(content), Resource()
    r.set("nfo:pageCount", sum(n.lower().endswith(".fpage") for n in z.namelist()))
    core = next((n for n in z.namelist() if n.lower().endswith("core.xml") or n.lower().startswith("metadata/")), None)
    root = _xml(z, core) if core else None
    for e in root.iter() if root is not None else ():
        if _local(e) == "title":
            r.set("nie:title", e.text)
        elif _local(e) == "creator":
            r.add("nco:creator", e.text)
    return r
