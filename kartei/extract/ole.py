"""Old Office files: compound files with property sets and, for Word, the text."""

from __future__ import annotations

import re
import struct
from datetime import datetime, timedelta

from kartei.extract.base import Info, Resource, Unreadable, limit_text

FREE = 0xFFFFFFFA  # sector numbers from here on are marks
# Property numbers of the summary information.
SUMMARY = {2: "nie:title", 3: "nie:subject", 4: "nco:creator", 5: "keywords", 6: "nie:comment", 12: "nie:contentCreated", 13: "nie:contentLastModified", 14: "nfo:pageCount", 15: "nfo:wordCount", 16: "nfo:characterCount", 18: "nie:generator"}


class Compound:
    """The streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
            raise Unreadable("no compound file")
        self.data = data
        self.size, self.small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        first_dir, self.cutoff, first_mini = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < FREE]
        self.fat = [x for s in sectors for x in self._numbers(s)]
        directory = self._chain(first_dir)
        mini = self._chain(first_mini)
        self.mini_fat = list(struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4]))
        self.entries: dict[str, tuple[int, int]] = {}
        root = None
        for k in range(0, len(directory) - 127, 128):
            e = directory[k : k + 128]
            n = struct.unpack_from("<H", e, 64)[0]
            name = e[: max(0, n - 2)].decode("utf-16-le", "replace")
            start, size = struct.unpack_from("<II", e, 116)
            if e[66] == 5:
                root = (start, size)
            elif e[66] == 2:
                self.entries.setdefault(name, (start, size))
        self.mini = self._chain(root[0]) if root and root[0] < FREE else b""

    def _numbers(self, sector: int) -> tuple[int, ...]:
        at = 512 + sector * self.size if self.size == 512 else (sector + 1) * self.size
        part = self.data[at : at + self.size]
        return struct.unpack(f"<{len(part) // 4}I", part[: len(part) // 4 * 4])

    def _chain(self, sector: int) -> bytes:
        out, seen = [], set()
        while sector < FREE and sector not in seen and sector < len(self.fat):
            seen.add(sector)
            at = (sector + 1) * self.size
            out.append(self.data[at : at + self.size])
            sector = self.fat[sector]
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        start, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen = [], set()
        while start < FREE and start not in seen and start < len(self.mini_fat):
            seen.add(start)
            out.append(self.mini[start * self.small : (start + 1) * self.small])
            start = self.mini_fat[start]
        return b"".join(out)[:size]


def properties(data: bytes) -> dict[int, object]:
    """The first section of a property set."""
    if len(data) < 48:
        return {}
    at = struct.unpack_from("<I", data, 44)[0]
    out: dict[int, object] = {}
    if at + 8 > len(data):
        return out
    page = 1252
    for k in range(struct.unpack_from("<I", data, at + 4)[0]):
        if at + 16 + 8 * k > len(data):
            break
        number, offset = struct.unpack_from("<II", data, at + 8 + 8 * k)
        p = at + offset
        if p + 8 > len(data):
            continue
        kind = struct.unpack_from("<I", data, p)[0]
        if kind == 2:
            v: object = struct.unpack_from("<h", data, p + 4)[0]
            if number == 1:
                page = v & 0xFFFF
        elif kind == 3:
            v = struct.unpack_from("<i", data, p + 4)[0]
        elif kind in (30, 31):
            n = struct.unpack_from("<I", data, p + 4)[0]
            raw = data[p + 8 : p + 8 + n * (2 if kind == 31 else 1)]
            name = "utf-16-le" if kind == 31 or page == 1200 else "utf-8" if page == 65001 else f"cp{page}"
            try:
                v = raw.decode(name, "replace").split("\0")[0]
            except LookupError:
                v = raw.decode("cp1252", "replace").split("\0")[0]
        elif kind == 64:
            ticks = struct.unpack_from("<Q", data, p + 4)[0]
            v = (datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%dT%H:%M:%SZ") if 0 < ticks < 1 << 62 else None
        else:
            continue
        out[number] = v
    return out


def msoffice(content: bytes, info: Info) -> Resource:
    c, r = Compound(content), Resource()
    for number, value in properties(c.stream("\x05SummaryInformation") or b"").items():
        prop = SUMMARY.get(number)
        if prop == "keywords":
            for k in re.split("[,;]", str(value)):
                r.add("nie:keyword", k)
        elif prop:
            r.set(prop, value)
    if "EncryptedPackage" in c.entries or "EncryptionInfo" in c.entries:
        r.set("nfo:isContentEncrypted", "true")
    elif (doc := c.stream("WordDocument")) is not None and len(doc) > 0x200:
        r.set("nie:plainTextContent", limit_text(_word(doc, c), info.max_text))
    return r


def _word(doc: bytes, c: Compound) -> str:
    """The pieces of a Word document by its piece table."""
    flags = struct.unpack_from("<H", doc, 10)[0]
    table = c.stream("1Table" if flags & 0x200 else "0Table") or b""
    at, size = struct.unpack_from("<II", doc, 0x01A2)
    clx, k = table[at : at + size], 0
    while k < len(clx) and clx[k] == 1:
        k += 3 + struct.unpack_from("<H", clx, k + 1)[0]
    if k >= len(clx) or clx[k] != 2:
        return ""
    n = struct.unpack_from("<I", clx, k + 1)[0]
    plc = clx[k + 5 : k + 5 + n]
    pieces = (n - 4) // 12
    ends = struct.unpack_from(f"<{pieces + 1}I", plc, 0)
    out = []
    for i in range(pieces):
        fc = struct.unpack_from("<I", plc, 4 * (pieces + 1) + 8 * i + 2)[0]
        chars = ends[i + 1] - ends[i]
        if fc & 0x40000000:
            start = (fc & 0x3FFFFFFF) // 2
            out.append(doc[start : start + chars].decode("cp1252", "replace"))
        else:
            out.append(doc[fc : fc + 2 * chars].decode("utf-16-le", "replace"))
    return " ".join(re.sub(r"[\x00-\x1f]", " ", "".join(out)).split())
