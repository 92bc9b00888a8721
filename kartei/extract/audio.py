"""Audio: ID3 tags and MPEG frames, FLAC, Ogg Vorbis, WAV and MP4."""

from __future__ import annotations

import re
import struct

from kartei.extract.base import Info, Resource, Unreadable

MP3_READ = 5 << 20
# MPEG bit rates in kbit/s by (version, layer), sample rates in Hz by version, and the ID3v1 genre names in order.
BITRATES = {(1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
GENRES = (
    "Blues|Classic Rock|Country|Dance|Disco|Funk|Grunge|Hip-Hop|Jazz|Metal|New Age|Oldies|Other|Pop|R&B|Rap|Reggae|Rock|Techno|Industrial|Alternative|Ska|Death Metal|Pranks|Soundtrack|Euro-Techno|"
    "Ambient|Trip-Hop|Vocal|Jazz+Funk|Fusion|Trance|Classical|Instrumental|Acid|House|Game|Sound Clip|Gospel|Noise|Alt. Rock|Bass|Soul|Punk|Space|Meditative|Instrumental Pop|Instrumental Rock|"
    "Ethnic|Gothic|Darkwave|Techno-Industrial|Electronic|Pop-Folk|Eurodance|Dream|Southern Rock|Comedy|Cult|Gangsta Rap|Top 40|Christian Rap|Pop/Funk|Jungle|Native American|Cabaret|New Wave|"
    "Psychedelic|Rave|Showtunes|Trailer|Lo-Fi|Tribal|Acid Punk|Acid Jazz|Polka|Retro|Musical|Rock & Roll|Hard Rock|"
    "Folk|Folk/Rock|National Folk|Swing|Fast-Fusion|Bebob|Latin|Revival|Celtic|Bluegrass|Avantgarde|Gothic Rock|Progressive Rock|Psychedelic Rock|Symphonic Rock|Slow Rock|Big Band|Chorus|"
    "Easy Listening|Acoustic|Humour|Speech|Chanson|Opera|Chamber Music|Sonata|Symphony|Booty Bass|Primus|Porn Groove|Satire|Slow Jam|Club|Tango|Samba|Folklore|Ballad|Power Ballad|Rhythmic Soul|"
    "Freestyle|Duet|Punk Rock|Drum Solo|A Cappella|Euro-House|Dance Hall|Goa|Drum & Bass|Club-House|Hardcore|Terror|Indie|BritPop|Negerpunk|Polsk Punk|Beat|Christian Gangsta Rap|Heavy Metal|"
    "Black Metal|Crossover|Contemporary Christian|Christian Rock|Merengue|Salsa|Thrash Metal|Anime|JPop|Synthpop"
).split("|")
#: ID3 frames by version 2.3 and 2.4, and by 2.2.
FRAMES = {"TIT2": "nie:title", "TPE1": "nmm:artist", "TPE2": "nmm:albumArtist", "TALB": "nmm:musicAlbum", "TCOM": "nmm:composer", "TEXT": "nmm:lyricist", "TCON": "nfo:genre", "TIT1": "group", "TIT3": "nie:comment", "TCOP": "nie:copyright", "TPUB": "nco:publisher", "TENC": "nfo:encodedBy", "TRCK": "track", "TPOS": "disc", "TDRC": "nie:contentCreated", "TYER": "nie:contentCreated", "TDRL": "nmm:releaseDate", "TLAN": "nie:language", "TSST": "nmm:discSubtitle"}
FRAMES_22 = {"TT2": "TIT2", "TP1": "TPE1", "TP2": "TPE2", "TAL": "TALB", "TCM": "TCOM", "TXT": "TEXT", "TCO": "TCON", "TT1": "TIT1", "TT3": "TIT3", "TCR": "TCOP", "TPB": "TPUB", "TEN": "TENC", "TRK": "TRCK", "TPA": "TPOS", "TYE": "TYER", "TLA": "TLAN", "COM": "COMM", "ULT": "USLT", "TXX": "TXXX", "UFI": "UFID"}
REFERENCES = {"musicbrainz track id": "Track", "musicbrainz artist id": "Artist", "musicbrainz album id": "Release", "musicbrainz release group id": "Release_Group", "musicbrainz release track id": "Recording", "acoustid fingerprint": "chromaprint"}


def genre_name(text: str) -> str | None:
    """A name for "(n)", "n" or a name; an unknown number is None."""
    m = re.match(r"\((\d+)\)", text) or re.fullmatch(r"(\d+)", text.strip())
    if m:
        n = int(m[1])
        rest = text[m.end() :].strip() if text.startswith("(") else ""
        return rest or (GENRES[n] if n < len(GENRES) else None)
    return None if text.strip().lower() == "unknown" else text


def _decode(data: bytes) -> str:
    if not data:
        return ""
    enc, body = data[0], data[1:]
    if enc == 1:
        return body.decode("utf-16", "replace") if body[:2] in (b"\xff\xfe", b"\xfe\xff") else body.decode("utf-16-le", "replace")
    if enc == 2:
        return body.decode("utf-16-be", "replace")
    if enc == 3:
        return body.decode("utf-8", "replace")
    try:
        return body.decode("utf-8") if not body.isascii() else body.decode("ascii")
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


def read_id3v2(data: bytes) -> tuple[int, dict[str, list[str]], int]:
    """(minor version, frame -> values, size of the tag); user frames are stored as TXXX:description."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}, 0
    version, flags = data[3], data[5]
    size = sum((b & 0x7F) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    body = data[10 : 10 + size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    at = 0
    if flags & 0x40 and version >= 3 and len(body) >= 4:
        n = struct.unpack(">I", body[:4])[0] if version == 3 else sum((b & 0x7F) << s for b, s in zip(body[:4], (21, 14, 7, 0), strict=True))
        at = n + 4 if version == 3 else n
    out: dict[str, list[str]] = {}
    head = 6 if version == 2 else 10
    while at + head <= len(body) and body[at]:
        if version == 2:
            name, n = body[at : at + 3].decode("latin-1"), int.from_bytes(body[at + 3 : at + 6], "big")
            name = FRAMES_22.get(name, name)
        else:
            name = body[at : at + 4].decode("latin-1")
            n = struct.unpack(">I", body[at + 4 : at + 8])[0] if version == 3 else sum((b & 0x7F) << s for b, s in zip(body[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
        raw = body[at + head : at + head + n]
        at += head + n
        if not re.fullmatch(r"[A-Z0-9]{3,4}", name):
            break
        if name == "TXXX":
            d, _, v = _decode(raw).partition("\0")
            out.setdefault(f"TXXX:{d.strip().lower()}", []).append(v.lstrip("﻿").strip("\0"))
        elif name in ("COMM", "USLT"):
            text = _decode(raw[:1] + raw[4:])
            out.setdefault(name, []).append(text.partition("\0")[2].lstrip("﻿").strip("\0") or text.strip("\0"))
        elif name == "UFID":
            owner, _, ident = raw.partition(b"\0")
            out.setdefault(f"UFID:{owner.decode('latin-1').lower()}", []).append(ident.decode("latin-1"))
        elif name.startswith("T"):
            out.setdefault(name, []).extend(v for v in _decode(raw).strip("\0").split("\0") if v)
    return version, out, 10 + size


def read_id3v1(data: bytes) -> dict[str, list[str]]:
    tag = data[-128:]
    if len(tag) < 128 or tag[:3] != b"TAG":
        return {}
    field = lambda a, b: tag[a:b].split(b"\0")[0].decode("cp1252", "replace").strip()
    out = {"TIT2": field(3, 33), "TPE1": field(33, 63), "TALB": field(63, 93), "TYER": field(93, 97), "COMM": field(97, 127)}
    if tag[125] == 0 and tag[126]:
        out["TRCK"] = str(tag[126])
    if tag[127] < len(GENRES):
        out["TCON"] = GENRES[tag[127]]
    return {k: [v] for k, v in out.items() if v}


def mpeg_frames(data: bytes, start: int, total: int) -> dict[str, float]:
    """Rate, channels, bit rate and duration from the first frame and its VBR header, else from the frames that follow."""
    at = start
    while at + 4 <= len(data):
        at = data.find(b"\xff", at)
        if at < 0 or at + 4 > len(data):
            return {}
        h = struct.unpack(">I", data[at : at + 4])[0]
        frame = _frame(h)
        if frame and (at + frame["size"] + 4 > len(data) or _frame(struct.unpack(">I", data[at + frame["size"] : at + frame["size"] + 4])[0])):
            break
        at += 1
    else:
        return {}
    side = at + 4 + ({True: 32, False: 17}[frame["channels"] == 2] if frame["version"] == 1 else {True: 17, False: 9}[frame["channels"] == 2])
    out = {k: frame[k] for k in ("version", "layer", "rate", "channels", "bitrate")}
    samples = frame["samples"]
    if data[side : side + 4] in (b"Xing", b"Info") and data[side + 7] & 1:
        frames = struct.unpack(">I", data[side + 8 : side + 12])[0]
        out["duration"] = frames * samples / frame["rate"]
        out["bitrate"] = (total - start) * 8 / out["duration"] / 1000 if out["duration"] else frame["bitrate"]
    else:
        out["duration"] = (total - at) * 8 / (frame["bitrate"] * 1000)
    return out


def _frame(h: int) -> dict[str, float] | None:
    if h >> 21 != 0x7FF:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(h >> 19 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(h >> 17 & 3)
    b, s, pad = h >> 12 & 15, h >> 10 & 3, h >> 9 & 1
    if version is None or layer is None or b in (0, 15) or s == 3:
        return None
    bitrate, rate = BITRATES[1 if version == 1 else 2, layer][b], RATES[version][s]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12 * bitrate * 1000 // rate + pad) * 4 if layer == 1 else samples // 8 * bitrate * 1000 // rate + pad
    return {"version": version, "layer": layer, "bitrate": bitrate, "rate": rate, "samples": samples, "size": size, "channels": 1 if h >> 6 & 3 == 3 else 2}


def apply_tags(r: Resource, tags: dict[str, list[str]]) -> None:
    """Tags named like ID3 frames."""
    for name, values in tags.items():
        prop, value = FRAMES.get(name), values[0] if values else None
        if value is None:
            continue
        if name == "TPE1":
            for v in values:
                r.add("nmm:artist", v)
        elif name == "TCON":
            r.set("nfo:genre", genre_name(value))
        elif name in ("TRCK", "TPOS"):
            if m := re.match(r"\s*(\d+)(?:\s*/\s*(\d+))?", value):
                r.set("nmm:trackNumber" if name == "TRCK" else "nmm:setNumber", int(m[1]))
                if m[2]:
                    r.set("nmm:albumTrackCount" if name == "TRCK" else "nmm:setCount", int(m[2]))
        elif name.startswith("TXXX:"):
            if kind := REFERENCES.get(name[5:]):
                r.add(f"tracker:hasExternalReference:{kind}", value)
        elif name.startswith("UFID:") and "musicbrainz" in name:
            r.add("tracker:hasExternalReference:Track", value)
        elif name == "USLT":
            r.set("nie:plainTextContent", value)
        elif prop and prop != "group":
            r.set(prop, value)
    if "TIT1" in tags:
        r.set("nfo:genre", genre_name(tags["TIT1"][0]))
    if "COMM" in tags:
        r.set("nie:comment", tags["COMM"][0])


def mp3(content: bytes, info: Info) -> Resource:
    """Tags of version 2.4 win over 2.3, 2.2 and 1; frames give duration and rates."""
    r = Resource()
    found, start = [], 0
    while content[start : start + 3] == b"ID3":
        version, tags, size = read_id3v2(content[start:])
        if not size:
            break
        found.append((version, tags))
        start += size
    for _, tags in sorted(found, key=lambda x: -x[0]):
        apply_tags(r, tags)
    apply_tags(r, read_id3v1(content))
    frames = mpeg_frames(content[:MP3_READ], start, len(content) - (128 if content[-128:-125] == b"TAG" else 0))
    if not frames and not r.props:
        raise Unreadable("neither tags nor frames")
    if frames:
        r.set("nfo:sampleRate", int(frames["rate"]))
        r.set("nfo:channels", int(frames["channels"]))
        r.set("nfo:averageBitrate", round(frames["bitrate"] * 1000))
        r.set("nfo:duration", int(frames["duration"]))
        r.set("nfo:codec", "MPEG")
        if frames["layer"] == 3:
            r.set("nmm:dlnaProfile", "MP3" if frames["version"] == 1 and 32 <= frames["bitrate"] <= 320 else "MP3X" if 8 <= frames["bitrate"] <= 320 else None)
    return r


# Vorbis comment names and MP4 atoms as ID3 frames.
VORBIS = {"title": "TIT2", "artist": "TPE1", "albumartist": "TPE2", "album": "TALB", "composer": "TCOM", "lyricist": "TEXT", "genre": "TCON", "tracknumber": "TRCK", "discnumber": "TPOS", "date": "TDRC", "copyright": "TCOP", "organization": "TPUB", "comment": "COMM", "description": "TIT3", "discsubtitle": "TSST", "lyrics": "USLT"}
VORBIS_REFERENCES = {"musicbrainz_trackid": "Recording", "musicbrainz_artistid": "Artist", "musicbrainz_albumid": "Release", "musicbrainz_releasegroupid": "Release_Group", "musicbrainz_releasetrackid": "Track", "acoustid_fingerprint": "chromaprint"}
MP4 = {b"\xa9nam": "TIT2", b"\xa9ART": "TPE1", b"aART": "TPE2", b"\xa9alb": "TALB", b"\xa9wrt": "TCOM", b"\xa9gen": "TCON", b"\xa9day": "TDRC", b"cprt": "TCOP", b"\xa9cmt": "COMM", b"desc": "TIT3"}


def apply_vorbis(r: Resource, data: bytes) -> None:
    """A block of comments."""
    at = 4 + struct.unpack("<I", data[:4])[0]
    count = struct.unpack("<I", data[at : at + 4])[0]
    at += 4
    tags: dict[str, list[str]] = {}
    for _ in range(count):
        if at + 4 > len(data):
            break
        n = struct.unpack("<I", data[at : at + 4])[0]
        k, _, v = data[at + 4 : at + 4 + n].decode("utf-8", "replace").partition("=")
        at += 4 + n
        k = k.lower()
        if k in VORBIS and v:
            tags.setdefault(VORBIS[k], []).append(v)
        elif k in VORBIS_REFERENCES:
            r.add(f"tracker:hasExternalReference:{VORBIS_REFERENCES[k]}", v)
        elif k in ("tracktotal", "totaltracks") and v.isdigit():
            r.set("nmm:albumTrackCount", int(v))
    apply_tags(r, tags)


def container(content: bytes, info: Info) -> Resource:
    """Told by the content: FLAC, Ogg, WAV or MP4; anything else is unreadable here."""
    r = Resource()
    if content[:4] == b"fLaC":
        at = 4
        while at + 4 <= len(content):
            last, kind, size = content[at] >> 7, content[at] & 0x7F, int.from_bytes(content[at + 1 : at + 4], "big")
            body = content[at + 4 : at + 4 + size]
            if kind == 0 and len(body) >= 18:
                bits = int.from_bytes(body[10:18], "big")
                rate, channels, samples = bits >> 44, (bits >> 41 & 7) + 1, bits & (1 << 36) - 1
                _sound(r, rate, channels, samples / rate if rate else 0, "FLAC", len(content))
            elif kind == 4:
                apply_vorbis(r, body)
            at += 4 + size
            if last:
                break
        return r
    if content[:4] == b"OggS":
        i = content.find(b"\x01vorbis")
        if i < 0:
            raise Unreadable("no Vorbis stream")
        channels, rate = struct.unpack("<BI", content[i + 11 : i + 16])
        last = content.rfind(b"OggS")
        samples = struct.unpack("<q", content[last + 6 : last + 14])[0]
        _sound(r, rate, channels, samples / rate if rate and samples > 0 else 0, "Vorbis", len(content))
        j = content.find(b"\x03vorbis")
        if j >= 0:
            apply_vorbis(r, content[j + 7 :])
        return r
    if content[:4] == b"RIFF" and content[8:12] == b"WAVE":
        at = 12
        rate = channels = per_second = 0
        while at + 8 <= len(content):
            kind, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
            if kind == b"fmt ":
                _, channels, rate, per_second = struct.unpack("<HHII", content[at + 8 : at + 20])
            elif kind == b"data":
                _sound(r, rate, channels, size / per_second if per_second else 0, "PCM", size)
                break
            at += 8 + size + size % 2
        return r
    if content[4:8] == b"ftyp":
        _atoms(r, content, 0, len(content))
        return r
    raise Unreadable("an unknown container")


def _sound(r: Resource, rate: int, channels: int, seconds: float, codec: str, size: int) -> None:
    r.set("nfo:sampleRate", rate)
    r.set("nfo:channels", channels)
    r.set("nfo:duration", int(seconds))
    r.set("nfo:codec", codec)
    if seconds:
        r.set("nfo:averageBitrate", int(size * 8 / seconds))


def _atoms(r: Resource, d: bytes, at: int, end: int) -> None:
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", d[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", d[at + 8 : at + 16])[0], 16
        size = size or end - at
        if size < head:
            return
        body, stop = at + head, min(end, at + size)
        if kind in (b"moov", b"udta", b"ilst", b"trak", b"mdia"):
            _atoms(r, d, body, stop)
        elif kind == b"meta":
            _atoms(r, d, body + 4, stop)
        elif kind == b"mvhd":
            scale, length = struct.unpack(">II", d[body + 12 : body + 20]) if d[body] == 0 else struct.unpack(">IQ", d[body + 20 : body + 32])
            r.set("nfo:duration", int(length / scale) if scale else None)
        elif kind == b"tkhd":
            w, h = struct.unpack(">II", d[stop - 8 : stop])
            if w >> 16 and h >> 16:
                r.set("nfo:width", w >> 16)
                r.set("nfo:height", h >> 16)
        elif kind in MP4 and d[body + 4 : body + 8] == b"data":
            apply_tags(r, {MP4[kind]: [d[body + 16 : stop].decode("utf-8", "replace")]})
        elif kind in (b"trkn", b"disk") and d[body + 4 : body + 8] == b"data":
            n, total = struct.unpack(">HH", d[body + 18 : body + 22])
            apply_tags(r, {"TRCK" if kind == b"trkn" else "TPOS": [f"{n}/{total}" if total else str(n)]})
        at += size
