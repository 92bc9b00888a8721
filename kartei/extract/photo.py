"""EXIF, XMP and IPTC: embedded or from a sidecar."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET

from kartei.extract.base import Resource, Unreadable
from kartei.functions.media import METERING, ORIENTATION, REGION

# Tag numbers of the TIFF and EXIF directories.
TAGS = {0x0100: "width", 0x0101: "height", 0x010E: "description", 0x010F: "make", 0x0110: "model", 0x0112: "orientation", 0x011A: "xres", 0x011B: "yres", 0x0128: "resunit", 0x0131: "software", 0x0132: "datetime", 0x013B: "artist", 0x8298: "copyright", 0x829A: "exposure", 0x829D: "fnumber", 0x8827: "iso", 0x9003: "original", 0x9004: "digitized", 0x9207: "metering", 0x9209: "flash", 0x920A: "focal", 0x9286: "comment", 0xA002: "pixel_x", 0xA003: "pixel_y", 0xA403: "white_balance", 0x8769: "exif_ifd", 0x8825: "gps_ifd", 0x02BC: "xmp", 0x83BB: "iptc"}
GPS_TAGS = {1: "lat_ref", 2: "lat", 3: "lon_ref", 4: "lon", 5: "alt_ref", 6: "alt", 29: "gps_date"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CM_PER_INCH = 2.54


def read_tiff(data: bytes) -> dict[str, object]:
    """The known tags of the first directory and of its EXIF and GPS directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] not in (42, 0x4F52, 0x55):
        raise Unreadable("no TIFF header")
    out: dict[str, object] = {}
    seen: set[int] = set()

    def value(kind: int, count: int, raw: bytes, at: int) -> object:
        size = SIZES.get(kind, 0) * count
        if not size or count > 1 << 22:
            return None
        if size > 4:
            start = struct.unpack(order + "I", raw)[0]
            raw = data[start : start + size]
            if len(raw) < size:
                return None
        raw = raw[:size]
        if kind == 2:
            return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
        if kind in (1, 6, 7):
            return raw
        if kind in (5, 10):
            n = struct.unpack(order + ("ii" if kind == 10 else "II") * count, raw)
            vals = [a / b if b else None for a, b in zip(n[::2], n[1::2], strict=True)]
        else:
            vals = list(struct.unpack(order + {3: "H", 4: "I", 8: "h", 9: "i", 11: "f", 12: "d"}[kind] * count, raw))
        return vals[0] if count == 1 else vals

    def directory(at: int, names: dict[int, str]) -> None:
        if at in seen or at + 2 > len(data):
            return
        seen.add(at)
        for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            e = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(e) < 12:
                return
            tag, kind, count = struct.unpack(order + "HHI", e[:8])
            if tag in names and (v := value(kind, count, e[8:], at)) is not None:
                out.setdefault(names[tag], v)

    directory(struct.unpack(order + "I", data[4:8])[0], TAGS)
    for name, names in (("exif_ifd", TAGS), ("gps_ifd", GPS_TAGS)):
        if isinstance(out.get(name), int):
            directory(out[name], names)
    return out


def _degrees(value: object, ref: object) -> float | None:
    parts = value if isinstance(value, list) else [value]
    if any(p is None for p in parts):
        return None
    d = sum(p / 60**k for k, p in enumerate(parts))
    return -d if ref in ("S", "W") else d


def exif_date(value: object) -> str | None:
    m = re.match(r"(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})", str(value or ""))
    return f"{m[1]}-{m[2]}-{m[3]}T{m[4]}" if m and m[2] != "00" else None


def apply_exif(r: Resource, t: dict[str, object]) -> None:
    r.set("nie:contentCreated", exif_date(t.get("original")) or exif_date(t.get("datetime")))
    r.set("nie:description", t.get("description"))
    r.set("nie:copyright", t.get("copyright"))
    r.add("nco:creator", t.get("artist"))
    if t.get("make") or t.get("model"):
        r.child("nfo:Equipment", 1, nfo__manufacturer=t.get("make"), nfo__model=t.get("model"))
    if isinstance(o := t.get("orientation"), int):
        r.set("nfo:orientation", f"nfo:orientation-{ORIENTATION.get(o, 'top')}")
    if isinstance(m := t.get("metering"), int):
        r.set("nmm:meteringMode", f"nmm:metering-mode-{METERING.get(m, 'other')}")
    if isinstance(f := t.get("flash"), int):
        r.set("nmm:flash", "nmm:flash-on" if f & 1 else "nmm:flash-off")
    if isinstance(w := t.get("white_balance"), int):
        r.set("nmm:whiteBalance", "nmm:white-balance-manual" if w == 1 else "nmm:white-balance-auto")
    for key, prop in (("exposure", "nmm:exposureTime"), ("fnumber", "nmm:fnumber"), ("iso", "nmm:isoSpeed"), ("focal", "nmm:focalLength")):
        v = t.get(key)
        r.set(prop, v[0] if isinstance(v, list) else v)
    unit = CM_PER_INCH if t.get("resunit") == 3 else 1.0
    for key, prop in (("xres", "nfo:horizontalResolution"), ("yres", "nfo:verticalResolution")):
        if isinstance(v := t.get(key), (int, float)):
            r.set(prop, v * unit)
    if "lat" in t and "lon" in t:
        lat, lon = _degrees(t["lat"], t.get("lat_ref")), _degrees(t["lon"], t.get("lon_ref"))
        alt = t.get("alt")
        if lat is not None and lon is not None:
            low = t.get("alt_ref") in (1, b"\x01")
            r.child("slo:GeoLocation", 1, slo__latitude=lat, slo__longitude=lon, slo__altitude=-alt if isinstance(alt, float) and low else alt)


# XMP properties and what they become; the first value wins.
XMP = {"title": "nie:title", "description": "nie:description", "rights": "nie:copyright", "UsageTerms": "nie:license", "date": "nie:contentCreated", "CreateDate": "nie:contentCreated", "DateTimeOriginal": "nie:contentCreated", "language": "nie:language", "identifier": "nie:identifier", "CreatorTool": "nie:generator", "Headline": "nie:subject", "Rating": "nao:numericRating", "Make": "nfo:manufacturer", "Model": "nfo:model", "ExposureTime": "nmm:exposureTime", "FNumber": "nmm:fnumber", "FocalLength": "nmm:focalLength", "ISOSpeedRatings": "nmm:isoSpeed", "City": "nco:locality", "Country": "nco:country", "State": "nco:region", "Location": "nco:streetAddress"}
XMP_MANY = {"creator": "nco:creator", "contributor": "nco:contributor", "publisher": "nco:publisher", "subject": "nie:keyword", "hierarchicalSubject": "nie:keyword"}


def apply_xmp(r: Resource, data: bytes) -> None:
    """A packet or sidecar. Properties stand as elements or attributes of descriptions."""
    m = re.search(rb"<(?:\w+:)?xmpmeta.*</(?:\w+:)?xmpmeta>|<rdf:RDF.*</rdf:RDF>", data, re.DOTALL)
    try:
        root = ET.fromstring(m.group() if m else data)
    except ET.ParseError as e:
        raise Unreadable(f"XMP: {e}") from e
    local = lambda n: n.rsplit("}", 1)[-1]

    def values(e: ET.Element) -> list[str]:
        items = [x for x in e.iter() if local(x.tag) == "li"]
        return [(x.text or "").strip() for x in items] if items else [(e.text or "").strip()]

    def put(name: str, vals: list[str]) -> None:
        if name in XMP:
            r.set(XMP[name], vals[0] if vals else None)
        elif name in XMP_MANY:
            for v in vals:
                r.add(XMP_MANY[name], v)
        elif name in ("Orientation", "MeteringMode", "Flash") and vals:
            m = re.match(r"\s*(\d+)", vals[0])
            n = int(m[1]) if m else 0
            if name == "Orientation":
                r.set("nfo:orientation", f"nfo:orientation-{ORIENTATION.get(n, 'top')}")
            elif name == "MeteringMode":
                r.set("nmm:meteringMode", f"nmm:metering-mode-{METERING.get(n, 'other')}")
            else:
                r.set("nmm:flash", "nmm:flash-on" if n & 1 else "nmm:flash-off")
        elif name == "WhiteBalance" and vals:
            r.set("nmm:whiteBalance", "nmm:white-balance-manual" if vals[0] == "1" else "nmm:white-balance-auto")

    for d in root.iter():
        if local(d.tag) != "Description":
            continue
        for k, v in d.attrib.items():
            put(local(k), [v])
        for e in d:
            if local(e.tag) == "RegionList" or local(e.tag) == "Regions":
                continue
            put(local(e.tag), values(e))
    n = 0
    for lst in root.iter():
        if local(lst.tag) != "RegionList":
            continue
        for li in (x for x in lst.iter() if local(x.tag) == "li"):
            got = {local(k): v for x in li.iter() for k, v in x.attrib.items()} | {local(x.tag): x.text.strip() for x in li.iter() if x.text and x.text.strip()}
            kind = next((c for word, c in REGION if got.get("Type", "").lower().startswith(word)), "nfo:roi-content-undefined")
            n += 1
            r.child("nfo:RegionOfInterest", n, nie__title=got.get("Name"), nfo__regionOfInterestType=kind if got.get("Type") else "nfo:region-content-undefined", nfo__regionOfInterestX=got.get("x"), nfo__regionOfInterestY=got.get("y"), nfo__regionOfInterestWidth=got.get("w"), nfo__regionOfInterestHeight=got.get("h"), nie__description=got.get("Description"))


IPTC = {(2, 5): "nie:title", (2, 25): "keyword", (2, 55): "date", (2, 80): "byline", (2, 90): "city", (2, 92): "sublocation", (2, 95): "state", (2, 101): "country", (2, 105): "headline", (2, 110): "credit", (2, 116): "nie:copyright", (2, 120): "nie:description", (2, 131): "orientation"}


def apply_iptc(r: Resource, data: bytes) -> None:
    """IPTC records; without keywords, byline, copyright or city they are dropped."""
    got: dict[str, list[str]] = {}
    at = 0
    while at + 5 <= len(data):
        if data[at] != 0x1C:
            at += 1
            continue
        record, number, size = data[at + 1], data[at + 2], struct.unpack(">H", data[at + 3 : at + 5])[0]
        value = data[at + 5 : at + 5 + size]
        at += 5 + size
        if name := IPTC.get((record, number)):
            try:
                got.setdefault(name, []).append(value.decode("utf-8"))
            except UnicodeDecodeError:
                got.setdefault(name, []).append(value.decode("cp1252", "replace"))
    if not {"keyword", "byline", "nie:copyright", "city"} & got.keys():
        return
    for k in got.get("keyword", []):
        r.add("nie:keyword", k)
    for b in got.get("byline", []):
        r.add("nco:creator", b)
    for name in ("nie:title", "nie:copyright", "nie:description"):
        r.set(name, got.get(name, [None])[0])
    if "orientation" in got:
        r.set("nfo:orientation", "nfo:orientation-left" if got["orientation"][0] == "P" else "nfo:orientation-top")
    place = {k: got[k][0] for k in ("city", "state", "country", "sublocation") if k in got}
    if place:
        r.child("nco:PostalAddress", 1, nco__locality=place.get("city"), nco__region=place.get("state"), nco__country=place.get("country"), nco__streetAddress=place.get("sublocation"))


def photoshop_iptc(data: bytes) -> bytes | None:
    """The IPTC block of Photoshop resources."""
    at = 0
    while (at := data.find(b"8BIM", at)) >= 0:
        number = struct.unpack(">H", data[at + 4 : at + 6])[0] if at + 6 <= len(data) else 0
        name = data[at + 6] if at + 6 < len(data) else 0
        start = at + 6 + (name + 1 + 1) // 2 * 2
        if start + 4 > len(data):
            return None
        size = struct.unpack(">I", data[start : start + 4])[0]
        if number == 0x0404:
            return data[start + 4 : start + 4 + size]
        at = start + 4 + size
    return None
