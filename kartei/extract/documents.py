"""Text, HTML, PostScript, AbiWord and desktop entries."""

from __future__ import annotations

import gzip
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

from kartei.extract.base import Info, Resource, Unreadable
from kartei.functions.binary import decode_text

PS_SCAN = 20 << 20


def text(content: bytes, info: Info) -> Resource:
    r = Resource()
    r.set("nie:plainTextContent", decode_text(content, info.max_text))
    return r


class _Page(HTMLParser):
    """Title, meta data, licence and the text of the body, each text followed by a blank."""

    def __init__(self, r: Resource, budget: int):
        super().__init__(convert_charrefs=True)
        self.r, self.budget = r, budget
        self.title, self.parts, self.stack, self.in_body, self.skip = [], [], [], False, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag == "body":
            self.in_body = True
        elif tag in ("script", "style"):
            self.skip += 1
        elif tag == "title":
            self.stack.append(tag)
        elif tag == "meta":
            name, value = a.get("name", "").lower(), a.get("content", "")
            if name == "author":
                self.r.add("nco:creator", value)
            elif name == "description":
                self.r.set("nie:description", value)
            elif name == "keywords":
                for k in re.split("[,;]", value):
                    self.r.add("nie:keyword", k)
        elif tag == "a" and "license" in a.get("rel", "").lower().split():
            self.r.set("nie:license", a.get("href"))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "title" and self.stack:
            self.stack.pop()

    def handle_data(self, data: str) -> None:
        if self.stack:
            self.title.append(data)
        elif self.in_body and not self.skip and self.budget > 0:
            words = " ".join(data.split())
            if words:
                self.parts.append(words)
                self.budget -= len(words.encode("utf-8", "replace")) + 1


def html(content: bytes, info: Info) -> Resource:
    r = Resource()
    head = content[:2048].decode("ascii", "ignore")
    charset = re.search(r"charset=[\"']?([\w-]+)", head, re.IGNORECASE)
    try:
        source = content.decode(charset[1]) if charset else decode_text(content, len(content) or 1)
    except (LookupError, UnicodeDecodeError):
        source = decode_text(content, len(content) or 1)
    p = _Page(r, info.max_text)
    p.feed(source)
    p.close()
    r.set("nie:title", " ".join("".join(p.title).split()))
    r.set("nie:plainTextContent", " ".join(p.parts))
    return r


PS_DATES = ((r"^(\d{1,2}):(\d{2}) (\w{3}) (\d{1,2}), (\d{4})", "hm"), (r"^\w{3} (\w{3}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})", "c"), (r"^D:(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})([+-]\d{2}'\d{2}|Z)?", "pdf"), (r"^(\d{4})-(\d{2})-(\d{2})", "iso"))
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def ps_date(value: str) -> str | None:
    """ISO 8601 for the date forms found in document headers."""
    value = value.strip().strip("()")
    for pattern, kind in PS_DATES:
        if not (m := re.match(pattern, value)):
            continue
        if kind == "hm":
            return f"{m[5]}-{MONTHS.index(m[3]) + 1:02d}-{int(m[4]):02d}T{int(m[1]):02d}:{m[2]}:00" if m[3] in MONTHS else None
        if kind == "c":
            return f"{m[4]}-{MONTHS.index(m[1]) + 1:02d}-{int(m[2]):02d}T{m[3]}" if m[1] in MONTHS else None
        if kind == "pdf":
            zone = (m[7] or "Z").replace("'", ":").rstrip(":")
            return f"{m[1]}-{m[2]}-{m[3]}T{m[4]}:{m[5]}:{m[6]}{zone}"
        return value
    return None


def postscript(content: bytes, info: Info) -> Resource:
    """The structuring comments; a page count "(atend)" is looked up in the trailer."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    if not content.startswith(b"%!"):
        raise Unreadable("no PostScript header")
    r, waiting = Resource(), False
    names = {"Title": "nie:title", "Creator": "nco:creator", "Copyright": "nie:copyright", "For": "nco:publisher"}
    for line in content[:PS_SCAN].decode("latin-1").splitlines():
        m = re.match(r"%%(\w+):\s*(.*)", line)
        if m:
            key, value = m[1], m[2].strip().strip("()")
            if key in names:
                r.set(names[key], value)
            elif key == "CreationDate":
                r.set("nie:contentCreated", ps_date(m[2]))
            elif key == "Pages":
                if "atend" in value:
                    waiting = True
                elif n := re.match(r"\d+", value):
                    r.set("nfo:pageCount", n[0])
                    if waiting:
                        break
        elif line.startswith("%%EndComments") and not waiting:
            break
    return r


def abiword(content: bytes, info: Info) -> Resource:
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    r = Resource()
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        raise Unreadable(str(e)) from e
    names = {"dc.title": "nie:title", "dc.subject": "nie:subject", "dc.creator": "nco:creator", "abiword.generator": "nie:generator", "dc.description": "nie:comment"}
    for m in root.iter():
        tag = m.tag.rsplit("}", 1)[-1]
        if tag == "m" and (key := m.get("key")):
            if key in names:
                r.set(names[key], m.text)
            elif key == "abiword.keywords":
                for k in re.split("[,;]", m.text or ""):
                    r.add("nie:keyword", k)
    parts = [" ".join("".join(p.itertext()).split()) for p in root.iter() if p.tag.rsplit("}", 1)[-1] == "p"]
    r.set("nie:plainTextContent", " ".join(p for p in parts if p))
    return r


def desktop(content: bytes, info: Info) -> Resource:
    """Application and link entries; hidden ones and those without a name are rejected."""
    entry: dict[str, str] = {}
    section = None
    for line in content.decode("utf-8", "replace").splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            section = line[1:-1]
        elif section == "Desktop Entry" and "=" in line and not line.startswith("#"):
            k, v = line.split("=", 1)
            entry.setdefault(k.strip(), v.strip())
    kind, name = entry.get("Type"), entry.get("Name")
    if not kind or not name:
        raise Unreadable("no type or name")
    if entry.get("Hidden", "").lower() == "true":
        raise Unreadable("hidden")
    r = Resource()
    r.set("nie:title", name)
    r.set("nie:comment", entry.get("Comment"))
    if kind == "Application":
        if not entry.get("Exec"):
            raise Unreadable("an application without a command")
        r.types = ["nfo:SoftwareApplication"]
        r.set("nfo:softwareCmdLine", entry["Exec"])
        if icon := entry.get("Icon"):
            r.set("nfo:softwareIcon", f"urn:theme-icon:{icon}")
    elif kind == "Link":
        if not entry.get("URL"):
            raise Unreadable("a link without a url")
        r.types = ["nfo:Bookmark"]
        r.set("nfo:bookmarks", entry["URL"])
    else:
        raise Unreadable(f"a desktop entry of type {kind}")
    for c in entry.get("Categories", "").split(";"):
        if c:
            r.add("nie:isLogicalPartOf", f"urn:software-category:{c}")
    return r
