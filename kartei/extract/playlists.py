"""Playlists, CUE sheets, game discs and ISO images."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from kartei.extract.base import Info, Resource, Unreadable
from kartei.functions.binary import decode_text

MAX_ENTRIES = 1000
FRAMES = 75


def playlist(content: bytes, info: Info) -> Resource:
    """Entries in order; the kind is told by the content. Entries past 1000 are counted but not kept."""
    source = decode_text(content, len(content) or 1)
    entries = _pls(source) if re.search(r"^\s*\[playlist\]", source, re.IGNORECASE | re.MULTILINE) else _xspf(source) if "<" in source[:200] else _m3u(source)
    if not entries:
        raise Unreadable("no entries")
    r = Resource(types=["nmm:Playlist", "nfo:MediaList"])
    r.set("nfo:entryCounter", len(entries))
    total = sum(d for _, _, d in entries[:MAX_ENTRIES] if d and d > 0)
    if total:
        r.set("nfo:listDuration", total)
    for n, (url, title, _) in enumerate(entries[:MAX_ENTRIES], 1):
        r.child("nfo:MediaFileListEntry", n, nfo__entryUrl=url, nie__title=title, nfo__listPosition=n)
    return r


def _m3u(source: str) -> list[tuple[str, str | None, int | None]]:
    out, title, length = [], None, None
    for line in map(str.strip, source.splitlines()):
        if m := re.match(r"#EXTINF:\s*(-?\d+)[^,]*,(.*)", line):
            length, title = int(m[1]), m[2].strip()
        elif line and not line.startswith("#"):
            out.append((line, title, length))
            title = length = None
    return out


def _pls(source: str) -> list[tuple[str, str | None, int | None]]:
    found: dict[int, dict[str, str]] = {}
    for m in re.finditer(r"^\s*(File|Title|Length)(\d+)\s*=\s*(.*?)\s*$", source, re.IGNORECASE | re.MULTILINE):
        found.setdefault(int(m[2]), {})[m[1].lower()] = m[3]
    length = lambda e: int(e["length"]) if re.fullmatch(r"-?\d+", e.get("length", "")) else None
    return [(e["file"], e.get("title"), length(e)) for _, e in sorted(found.items()) if "file" in e]


def _xspf(source: str) -> list[tuple[str, str | None, int | None]]:
    try:
        root = ET.fromstring(source.encode())
    except ET.ParseError as e:
        raise Unreadable(str(e)) from e
    out = []
    for t in root.iter():
        tag = t.tag.rsplit("}", 1)[-1].lower()
        if tag == "track":
            got = {c.tag.rsplit("}", 1)[-1]: (c.text or "").strip() for c in t}
            if got.get("location"):
                out.append((got["location"], got.get("title"), int(got["duration"]) // 1000 if got.get("duration", "").isdigit() else None))
        elif tag in ("media", "ref") and (url := t.get("src") or t.get("href")):
            out.append((url, t.get("title"), None))
    return out


@dataclass
class CueTrack:
    """start in seconds within its file; the duration is None for a last track of unknown length."""

    number: int
    file: str | None
    fields: dict[str, str] = field(default_factory=dict)
    start: float | None = None
    duration: int | None = None
    data: bool = False


def parse_cue(source: str, total: float | None = None) -> tuple[dict[str, str], list[CueTrack]]:
    """The fields of the sheet and its tracks. The last track's duration needs the total length."""
    sheet: dict[str, str] = {}
    tracks: list[CueTrack] = []
    file = None
    for line in map(str.strip, source.splitlines()):
        m = re.match(r'(REM\s+)?(\w+)\s+(.*)$', line)
        if not m:
            continue
        key, rest = m[2].upper(), m[3].strip()
        value = (re.match(r'"([^"]*)"', rest) or re.match(r"(.*)", rest))[1]
        if key == "FILE":
            file = value
        elif key == "TRACK" and not m[1]:
            n = re.match(r"(\d+)\s*(\w*)", rest)
            if n:
                tracks.append(CueTrack(int(n[1]), file, data=n[2].upper().startswith("MODE")))
        elif key == "INDEX" and tracks:
            t = re.match(r"0*(\d+)\s+(\d+):(\d{2}):(\d{2})", rest)
            if t and int(t[1]) == 1:
                tracks[-1].start = int(t[2]) * 60 + int(t[3]) + int(t[4]) / FRAMES
        elif tracks:
            tracks[-1].fields.setdefault(key, value)
        else:
            sheet.setdefault(key, value)
    for a, b in zip(tracks, tracks[1:], strict=False):
        if a.file == b.file and a.start is not None and b.start is not None:
            a.duration = int(b.start - a.start)
    if tracks and total is not None and tracks[-1].start is not None and total > tracks[-1].start:
        tracks[-1].duration = int(total - tracks[-1].start)
    return sheet, tracks


def cue_tracks(content: bytes, audio_name: str, total: float | None) -> Resource:
    """The tracks of one audio file: the FILE entry is compared without endings and in any letter case."""
    bare = lambda n: re.sub(r"\.[^.]*$", "", n.rsplit("/", 1)[-1]).lower()
    sheet, tracks = parse_cue(decode_text(content, len(content) or 1), total)
    r = Resource(types=["nmm:MusicPiece", "nfo:Audio"])
    r.set("nie:title", sheet.get("TITLE"))
    for t in tracks:
        if t.file is None or bare(t.file) == bare(audio_name):
            r.child("nmm:MusicPiece", t.number, nie__title=t.fields.get("TITLE"), nmm__artist=t.fields.get("PERFORMER") or sheet.get("PERFORMER"), nmm__musicAlbum=sheet.get("TITLE"), nfo__audioOffset=t.start, nfo__duration=t.duration, nmm__trackNumber=t.number, nfo__gain=t.fields.get("REPLAYGAIN_TRACK_GAIN"), nfo__peakGain=t.fields.get("REPLAYGAIN_TRACK_PEAK"))
    return r


def disc(content: bytes, info: Info) -> Resource:
    """A CUE sheet of a disc image: a game image if its first track is data."""
    sheet, tracks = parse_cue(decode_text(content, len(content) or 1))
    if not tracks:
        raise Unreadable("no tracks")
    r = Resource(types=["nfo:GameImage" if tracks[0].data or any(t.data for t in tracks) else "nfo:Software"])
    r.set("nie:title", sheet.get("TITLE"))
    for n in dict.fromkeys(t.file for t in tracks if t.file):
        r.add("nie:isStoredAs", n)
    return r


def iso(content: bytes, info: Info) -> Resource:
    """The primary volume of an ISO 9660 image, and whether it can boot."""
    if content[32769:32774] != b"CD001":
        raise Unreadable("no volume descriptor")
    r = Resource(types=["nfo:FilesystemImage"])
    r.set("nie:title", content[32808:32840].decode("ascii", "replace"))
    r.set("nfo:occupiedSpace", struct.unpack_from("<I", content, 32848)[0] * struct.unpack_from("<H", content, 32896)[0])
    at, boot = 32768, False
    while at + 2048 <= len(content) and content[at + 1 : at + 6] == b"CD001" and content[at] != 255:
        boot |= content[at] == 0 and content[at + 7 : at + 30] == b"EL TORITO SPECIFICATION"
        at += 2048
    if boot:
        r.types = ["nfo:FilesystemImage", "nfo:OperatingSystem"]
        r.set("osinfo:bootable", "true")
    return r


def write_m3u(entries: list[tuple[int, str]]) -> str:
    """A playlist of entries by position; gaps are skipped."""
    return "\n".join(["#EXTM3U", *(u for _, u in sorted(entries))]) + "\n"
