"""Queries of the extractors of binary formats: files of each format are made from table rows, and read again.

The builders write the formats by their published layouts and share nothing with the extractors; what must come out is
stated in SQL over the same rows.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.extract import writeback
from kartei.extract.base import extract
from kartei.functions import binary
from kartei.plans.registry import query


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(df: DataFrame, module: str, build: Callable[..., bytes], mime: str = "x/y", *types: str) -> DataFrame:
    """Files with the content that ``build`` makes of the columns of each row; the first column is the url."""
    columns = df.columns[1:]

    def run(batches):
        for b in batches:
            rows = zip(*(b[c].tolist() for c in columns), strict=True)
            yield pd.DataFrame({"url": b.iloc[:, 0].astype(str), "content": [build(*r) for r in rows]})

    made = df.mapInPandas(run, "url string, content binary")
    return made.select("url", F.lit(mime).alias("mime_type"), F.lit(module).alias("module"), F.array(*[F.lit(t) for t in types]).cast("array<string>").alias("rdf_types"), "content")


def _p(name: str, kind: str = "string") -> Column:
    """The first value of a property."""
    return F.try_element_at(F.col("props")[name], F.lit(1)).cast(kind)


def _child(name: str, kind: str = "string") -> Column:
    return F.try_element_at("children", F.lit(1)).props[name].cast(kind)


def _part(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", *columns)


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def _xml(text: object) -> str:
    return str(text).replace("&", "&amp;").replace("<", "&lt;")


# documents


def _pdf(title: str, author: str, pages: int) -> bytes:
    objects = [b"<< /Title (Part %d) /Parent 99 0 R /Dest [1 0 R /Fit] >>" % n for n in range(1, pages % 3 + 2)]
    for n in range(1, pages % 3 + 2):
        words = f"BT /F1 9 Tf ({title} page) Tj 0 -12 Td [(nu) -20 (mber) -300 ({n})] TJ ET".encode("cp1252")
        packed = zlib.compress(words) if n % 2 else words
        objects.append(b"<< /Type /Page >>")
        objects.append(b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(packed), b"/Filter /FlateDecode " if n % 2 else b"", packed))
    info = b"<< /Title <FEFF%s> /Author (%s \\(of parts\\)) /Keywords (one, two) /CreationDate (D:20240428180000Z) >>" % (title.encode("utf-16-be").hex().upper().encode(), author.encode("cp1252"))
    body = b"".join(b"%d 0 obj %s endobj\n" % (k, o) for k, o in enumerate([*objects, info], 1))
    return b"%PDF-1.5\n" + body + b"trailer << /Info %d 0 R >>\n%%%%EOF\n" % (len(objects) + 1)


@query("x03_pdf", """
select p_partkey::varchar as url, p_name as title, p_brand || ' (of parts)' as author, 'one,two' as keywords, (p_size % 3 + 1)::int as pages, '2024-04-28T18:00:00Z' as created,
array_to_string(list_transform(range(1, p_size % 3 + 2), lambda n: 'Part ' || n), ' ') as contents,
array_to_string(list_transform(range(1, p_size % 3 + 2), lambda n: p_name || ' page number ' || n), ' ') as plain_text from part""")
def x03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one to three pages with an outline, every other stream deflated, the title in UTF-16."""
    out = extract(_made(_part(spark, sf_dir, "p_name", "p_brand", "p_size"), "pdf", _pdf))
    return out.select("url", "title", _p("nco:creator").alias("author"), F.array_join(F.col("props")["nie:keyword"], ",").alias("keywords"), _p("nfo:pageCount", "int").alias("pages"), _p("nie:contentCreated").alias("created"), _p("nfo:tableOfContents").alias("contents"), "plain_text")


def _epub(title: str, author: str, size: int) -> bytes:
    chapters = range(1, size % 4 + 1)
    items = "".join(f'<item id="c{k}" href="c{k}.xhtml"/>' for k in chapters)
    order = "".join(f'<itemref idref="c{k}"/>' for k in reversed(chapters))
    opf = f'<package xmlns:dc="d" xmlns:opf="o"><metadata><dc:title>{_xml(title)}</dc:title><dc:creator opf:role="aut">{_xml(author)}</dc:creator><dc:creator opf:role="edt">Ed</dc:creator><dc:language>en</dc:language></metadata><manifest>{items}</manifest><spine>{order}</spine></package>'
    pages = {f"book/c{k}.xhtml": f"<html><head><title>no</title></head><body><p>Chapter {k}</p><p>of {_xml(title)}</p></body></html>" for k in chapters}
    return _zip({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="book/x.opf"/></rootfiles></container>', "book/x.opf": opf, **pages})


@query("x04_epub", """
select p_partkey::varchar as url, p_name as title, p_brand as author, 'Ed' as publisher, 'en' as lang,
nullif(array_to_string(list_transform(list_reverse(range(1, p_size % 4 + 1)), lambda n: 'Chapter ' || n || ' of ' || p_name), ' '), '') as plain_text from part""")
def x04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose spine turns the chapters round."""
    out = extract(_made(_part(spark, sf_dir, "p_name", "p_brand", "p_size"), "epub", _epub))
    return out.select("url", "title", _p("nco:creator").alias("author"), _p("nco:publisher").alias("publisher"), _p("nie:language").alias("lang"), "plain_text")


def _odt(title: str, author: str, size: int) -> bytes:
    meta = f'<o:document-meta xmlns:o="o" xmlns:dc="d" xmlns:meta="m"><o:meta><dc:title>{_xml(title)}</dc:title><dc:creator>{_xml(author)}</dc:creator><meta:keyword>a; b</meta:keyword><meta:document-statistic meta:page-count="{size}" meta:word-count="{size * 7}"/></o:meta></o:document-meta>'
    body = f'<o:document-content xmlns:o="o" xmlns:text="t"><o:body><text:h>Head</text:h><text:p>{_xml(title)}<text:tab/>by <text:span>{_xml(author)}</text:span><text:line-break/>end</text:p></o:body></o:document-content>'
    return _zip({"mimetype": "application/vnd.oasis.opendocument.text", "content.xml": body, "meta.xml": meta})


@query("x05_odf", """
select p_partkey::varchar as url, p_name as title, p_brand as author, p_size::int as pages, (p_size * 7)::int as words, 'Head ' || p_name || ' by ' || p_brand || ' end' as plain_text from part""")
def x05(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_made(_part(spark, sf_dir, "p_name", "p_brand", "p_size"), "oasis", _odt))
    return out.select("url", "title", _p("nco:publisher").alias("author"), _p("nfo:pageCount", "int").alias("pages"), _p("nfo:wordCount", "int").alias("words"), "plain_text")


def _ooxml(key: int, title: str, author: str, size: int) -> bytes:
    core = f'<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>{_xml(title)}</dc:title><dc:creator>{_xml(author)}</dc:creator></cp:coreProperties>'
    count = "Slides" if key % 3 == 2 else "Pages"
    members = {"docProps/core.xml": core, "docProps/app.xml": f"<Properties><{count}>{size}</{count}><Application>Office</Application></Properties>"}
    if key % 3 == 0:
        members["word/document.xml"] = f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{_xml(title)}</w:t></w:r><w:r><w:t> and more</w:t></w:r></w:p><w:p><w:r><w:t>{_xml(author)}</w:t></w:r></w:p></w:body></w:document>'
    elif key % 3 == 1:
        members["xl/sharedStrings.xml"] = f'<sst xmlns="s"><si><t>{_xml(title)}</t></si><si><t>{size}</t></si><si><r><t>{_xml(author)}</t></r></si></sst>'
    else:
        # slide 10 comes after slide 2
        for n in (10, 1, 2):
            members[f"ppt/slides/slide{n}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>slide {n}</a:t></a:r></a:p></p:sld>'
    return _zip(members)


@query("x06_ooxml", """
select p_partkey::varchar as url, p_name as title, p_brand as author, p_size::int as pages,
case p_partkey % 3 when 0 then p_name || ' and more ' || p_brand when 1 then p_name || ' ' || p_brand else 'slide 1 slide 2 slide 10' end as plain_text from part""")
def x06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, sheets (numbers are no text) and slides (in the order of their numbers)."""
    df = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("key"), "p_name", "p_brand", "p_size")
    out = extract(_made(df, "msoffice-xml", _ooxml))
    return out.select("url", "title", _p("nco:creator").alias("author"), _p("nfo:pageCount", "int").alias("pages"), "plain_text")


def _property_set(values: dict[int, object]) -> bytes:
    """A summary information stream: text, numbers and a code page of UTF-8."""
    body, index = b"", b""
    at = 8 + 8 * (len(values) + 1)
    for number, v in {1: None, **values}.items():
        if v is None:
            raw = struct.pack("<IhH", 2, -535, 0)
        elif isinstance(v, int):
            raw = struct.pack("<Ii", 3, v)
        else:
            data = str(v).encode() + b"\0"
            raw = struct.pack("<II", 30, len(data)) + data + bytes(-len(data) % 4)
        index += struct.pack("<II", number, at + len(body))
        body += raw
    section = struct.pack("<II", 8 + len(index) + len(body), len(values) + 1) + index + body
    return struct.pack("<HHI16sI16sI", 0xFFFE, 0, 0, bytes(16), 1, bytes(16), 48) + section


def _compound(streams: dict[str, bytes]) -> bytes:
    """A compound file with sectors of 512 bytes; every stream is padded beyond the limit of small ones."""
    end, sector = 0xFFFFFFFE, 512
    fat, data, starts = [0xFFFFFFFD], b"", {}
    for name, body in streams.items():
        n = -(-max(len(body), 4096) // sector)
        starts[name] = len(fat)
        fat += [*range(len(fat) + 1, len(fat) + n), end]
        data += body.ljust(n * sector, b"\0")
    entries = [("Root Entry", 5, end, 0), *((name, 2, starts[name], max(len(b), 4096)) for name, b in streams.items())]
    directory = b""
    for name, kind, start, size in entries:
        raw = name.encode("utf-16-le") + b"\0\0"
        directory += raw.ljust(64, b"\0") + struct.pack("<HBB12s16s20sIII", len(raw), kind, 1, b"\xff" * 12, bytes(16), bytes(20), start, size, 0)
    n = -(-len(directory) // sector)
    first = len(fat)
    fat += [*range(first + 1, first + n), end]
    data += directory.ljust(n * sector, b"\0")
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH6sIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, bytes(6), 0, 1, first, 0, 4096, end, 0, end, 0)
    head += struct.pack("<I", 0) + b"\xff" * 432
    return head + b"".join(struct.pack("<I", x) for x in fat).ljust(sector, b"\xff") + data


def _doc(title: str, author: str, size: int) -> bytes:
    """A Word file of two pieces, one of them in single bytes."""
    one, two = f"{title}\r".encode("cp1252"), f"written by {author}".encode("utf-16-le")
    text = bytes(0x400) + one + bytes(len(one) % 2) + two
    ends = struct.pack("<III", 0, len(one), len(one) + len(two) // 2)
    at = 0x400 + len(one) + len(one) % 2
    pieces = b"".join(struct.pack("<HIH", 0, fc, 0) for fc in (0x400 * 2 | 0x40000000, at))
    table = b"\x02" + struct.pack("<I", len(ends + pieces)) + ends + pieces
    doc = bytearray(text)
    doc[0:2], doc[10:12] = b"\xec\xa5", struct.pack("<H", 0x200)
    doc[0x01A2:0x01AA] = struct.pack("<II", 0, len(table))
    return _compound({"WordDocument": bytes(doc), "1Table": table, "\x05SummaryInformation": _property_set({2: title, 4: author, 5: "a, b", 14: size, 15: 3 * size})})


@query("x07_word", "select p_partkey::varchar as url, p_name as title, p_brand as author, p_size::int as pages, (3 * p_size)::int as words, p_name || ' written by ' || p_brand as plain_text from part")
def x07(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_made(_part(spark, sf_dir, "p_name", "p_brand", "p_size"), "msoffice", _doc))
    return out.select("url", "title", _p("nco:creator").alias("author"), _p("nfo:pageCount", "int").alias("pages"), _p("nfo:wordCount", "int").alias("words"), "plain_text")


def _xps(title: str, size: int) -> bytes:
    return _zip({f"Documents/1/Pages/{n}.fpage": "<FixedPage/>" for n in range(size % 5 + 1)} | {"docProps/core.xml": f'<cp xmlns:dc="d"><dc:title>{_xml(title)}</dc:title></cp>'})


@query("x10_xps", "select p_partkey::varchar as url, p_name as title, (p_size % 5 + 1)::int as pages from part")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_made(_part(spark, sf_dir, "p_name", "p_size"), "xps", _xps))
    return out.select("url", "title", _p("nfo:pageCount", "int").alias("pages"))


# sound


def _comments(tags: dict[str, str]) -> bytes:
    text = lambda s: struct.pack("<I", len(s.encode())) + s.encode()
    return text("maker") + struct.pack("<I", len(tags)) + b"".join(text(f"{k}={v}") for k, v in tags.items())


def _flac(name: str, artist: str, n: int) -> bytes:
    info = struct.pack(">HHHIHI", 4096, 4096, 0, 0, 0, 0)[:10] + (44100 << 44 | 1 << 41 | 15 << 36 | 44100 * (n + 1)).to_bytes(8, "big") + bytes(16)
    tags = _comments({"TITLE": name, "artist": artist, "TRACKNUMBER": str(n + 1), "MUSICBRAINZ_ALBUMID": f"id-{n}"})
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x84" + len(tags).to_bytes(3, "big") + tags


def _ogg(name: str, artist: str, n: int) -> bytes:
    page = lambda at, body: b"OggS\0\0" + struct.pack("<q", at) + bytes(12) + bytes([1, min(255, len(body))]) + body
    head = b"\x01vorbis" + struct.pack("<IBIiii", 0, 2, 8000, 0, 0, 0) + b"\xb8\x01"
    return page(0, head) + page(0, b"\x03vorbis" + _comments({"title": name, "ARTIST": artist, "tracknumber": str(n + 1)})) + page(8000 * (n + 1), b"")


def _mp4(name: str, artist: str, n: int) -> bytes:
    atom = lambda kind, body: struct.pack(">I4s", len(body) + 8, kind) + body
    item = lambda kind, v: atom(kind, atom(b"data", struct.pack(">II", 1, 0) + v.encode()))
    moov = atom(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 600, 600 * (n + 1)) + bytes(80)) + atom(b"udta", atom(b"meta", bytes(4) + atom(b"ilst", item(b"\xa9nam", name) + item(b"\xa9ART", artist))))
    return atom(b"ftyp", b"M4A \0\0\0\0") + atom(b"mdat", bytes(20)) + atom(b"moov", moov)


def _sound(key: int, name: str, artist: str, n: int) -> bytes:
    return (_flac, _ogg, _mp4)[key % 3](name, artist, n)


@query("x14_containers", """
select c_custkey::varchar as url, c_name as title, c_mktsegment as artist, case when c_custkey % 3 < 2 then c_nationkey + 1 end::int as track, (c_nationkey + 1)::int as seconds,
case c_custkey % 3 when 0 then 'FLAC' when 1 then 'Vorbis' end as codec from customer""")
def x14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLAC, Ogg Vorbis and MP4 with tags."""
    df = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("key"), "c_name", "c_mktsegment", "c_nationkey")
    out = extract(_made(df, "libav", _sound))
    return out.select("url", "title", _p("nmm:artist").alias("artist"), _p("nmm:trackNumber", "int").alias("track"), _p("nfo:duration", "int").alias("seconds"), _p("nfo:codec").alias("codec"))


def _wav(n: int) -> bytes:
    return b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", 32000 * (n + 1))


@query("x15_wave", "select c_custkey::varchar as url, (c_nationkey + 1)::int as seconds, 2 as channels, 8000 as rate, 256000 as bitrate from customer")
def x15(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(_made(_read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "libav", _wav))
    return out.select("url", _p("nfo:duration", "int").alias("seconds"), _p("nfo:channels", "int").alias("channels"), _p("nfo:sampleRate", "int").alias("rate"), _p("nfo:averageBitrate", "int").alias("bitrate"))


def _id3(version: int, frames: dict[str, str]) -> bytes:
    safe = lambda n: bytes(n >> s & 0x7F for s in (21, 14, 7, 0))
    body = b""
    for name, v in frames.items():
        raw = b"\x01" + v.encode("utf-16")
        body += name.encode() + (len(raw).to_bytes(3, "big") if version == 2 else struct.pack(">I", len(raw)) + b"\0\0") + raw
    return b"ID3" + bytes([version, 0, 0]) + safe(len(body)) + body


#: Codes at the ends and turns of the numbered genres, and three that have no name.
CODES = (0, 7, 17, 40, 59, 79, 80, 85, 90, 101, 115, 125, 131, 137, 147, 148, 200, 255)


def _mp3(key: int, name: str) -> bytes:
    old = key % 2
    frame = struct.pack(">I", 0xFFFB9000) + bytes(413)  # MPEG 1 layer 3, 128 kbit/s, 44.1 kHz: 417 bytes
    tags = {"TT2" if old else "TIT2": name, "TCO" if old else "TCON": f"({CODES[key % len(CODES)]})"}
    return _id3(2 if old else 3, tags) + frame * 39


@query("sc25_genre_names", """
select c_custkey::varchar as url, c_name as title, 128000 as bitrate, 1 as seconds, ['Blues', 'Hip-Hop', 'Rock', 'Alt. Rock', 'Gangsta Rap', 'Hard Rock', 'Folk', 'Bebob', 'Avantgarde', 'Speech', 'Folklore', 'Dance Hall', 'Indie', 'Heavy Metal', 'Synthpop', null, null, null][c_custkey % 18 + 1] as genre from customer""")
def sc25_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of numbered genres from tags of versions 2.2 and 2.3 in UTF-16, before frames of a constant rate."""
    out = extract(_made(_read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("key"), "c_name"), "mp3", _mp3))
    return out.select("url", "title", _p("nfo:averageBitrate", "int").alias("bitrate"), _p("nfo:duration", "int").alias("seconds"), _p("nfo:genre").alias("genre"))


# images


def _tiff(entries: list[tuple[int, int, bytes]], order: str = "<", more: dict[int, list[tuple[int, int, bytes]]] | None = None) -> bytes:
    """A TIFF file of (tag, kind, raw value) entries; ``more`` gives directories behind a tag."""
    sizes = {2: 1, 3: 2, 4: 4, 5: 8, 7: 1}
    entries = sorted([*entries, *((tag, 4, b"\0\0\0\0") for tag in more or {})])
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8))

    def directory(items: list[tuple[int, int, bytes]]) -> dict[int, int]:
        at = len(out)
        out.extend(struct.pack(order + "H", len(items)) + bytes(12 * len(items) + 4))
        places = {}
        for k, (tag, kind, raw) in enumerate(items):
            places[tag] = at + 2 + 12 * k + 8
            value = raw.ljust(4, b"\0")
            if len(raw) > 4:
                value = struct.pack(order + "I", len(out))
                out.extend(raw + bytes(len(raw) % 2))
            out[at + 2 + 12 * k : at + 14 + 12 * k] = struct.pack(order + "HHI", tag, kind, len(raw) // sizes[kind]) + value
        return places

    places = directory(entries)
    for tag, items in (more or {}).items():
        out[places[tag] : places[tag] + 4] = struct.pack(order + "I", len(out))
        directory(sorted(items))
    return bytes(out)


def _number(n: int, order: str = "<") -> bytes:
    return struct.pack(order + "H", n)


def _tiff_file(key: int, name: str, size: int) -> bytes:
    order = "<" if key % 2 else ">"
    return _tiff([(0x100, 3, _number(size, order)), (0x101, 3, _number(key % 5000 + 1, order)), (0x10E, 2, name.encode() + b"\0"), (0x132, 2, b"2021:03:04 05:06:07\0")], order)


@query("x19_tiff", "select p_partkey::varchar as url, p_size::int as width, (p_partkey % 5000 + 1)::int as height, p_name as description, '2021-03-04T05:06:07' as created from part")
def x19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both byte orders."""
    df = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("key"), "p_name", "p_size")
    out = extract(_made(df, "tiff", _tiff_file))
    return out.select("url", _p("nfo:width", "int").alias("width"), _p("nfo:height", "int").alias("height"), _p("nie:description").alias("description"), _p("nie:contentCreated").alias("created"))


def _exif(name: str, maker: str, size: int) -> bytes:
    ratio = lambda *v: struct.pack(f"<{len(v)}I", *v)
    camera = [(0x829A, 5, ratio(1, size + 1)), (0x829D, 5, ratio(28, 10)), (0x8827, 3, _number(100 * (size % 4 + 1))), (0x9003, 2, b"2020:01:02 03:04:05\0"), (0x9207, 3, _number(5)), (0x9209, 3, _number(size % 2)), (0x920A, 5, ratio(50, 1)), (0xA403, 3, _number(size % 2))]
    place = [(1, 2, b"S\0"), (2, 5, ratio(41, 1, 30, 1, 0, 1)), (3, 2, b"E\0"), (4, 5, ratio(2, 1, 15, 1, 0, 1))]
    return _tiff([(0x10E, 2, name.encode() + b"\0"), (0x10F, 2, maker.encode() + b"\0"), (0x112, 3, _number(size % 8 + 1))], "<", {0x8769: camera, 0x8825: place})


def _jpeg(width: int, height: int, *segments: tuple[int, bytes]) -> bytes:
    seg = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    return b"\xff\xd8" + b"".join(seg(m, d) for m, d in segments) + seg(0xC0, b"\x08" + struct.pack(">HH", height, width) + b"\x03") + b"\xff\xd9"


def _photo(name: str, maker: str, size: int) -> bytes:
    return _jpeg(640, 480, (0xE1, b"Exif\0\0" + _exif(name, maker, size)), (0xFE, b"note"))


@query("x25_exif", """
select p_partkey::varchar as url, 640 as width, p_name as description, 'note' as comment, p_brand as maker, '2020-01-02T03:04:05' as created, (1.0 / (p_size + 1))::float as exposure, 2.8::float as fnumber, (100 * (p_size % 4 + 1))::int as iso,
case when p_size % 2 = 1 then 'nmm:flash-on' else 'nmm:flash-off' end as flash, case when p_size % 2 = 1 then 'nmm:white-balance-manual' else 'nmm:white-balance-auto' end as white,
'nfo:orientation-' || ['top', 'top-mirror', 'bottom', 'bottom-mirror', 'left-mirror', 'right', 'right-mirror', 'left'][p_size % 8 + 1] as orientation, -41.5::float as latitude, 2.25::float as longitude from part""")
def x25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photographs with camera and place directories."""
    out = extract(_made(_part(spark, sf_dir, "p_name", "p_brand", "p_size"), "jpeg", _photo))
    kid = lambda kind, name: F.try_element_at(F.filter("children", lambda c: c.kind == kind), F.lit(1)).props[name]
    return out.select(
        "url", _p("nfo:width", "int").alias("width"), _p("nie:description").alias("description"), _p("nie:comment").alias("comment"), kid("nfo:Equipment", "nfo:manufacturer").alias("maker"), _p("nie:contentCreated").alias("created"), _p("nmm:exposureTime", "float").alias("exposure"), _p("nmm:fnumber", "float").alias("fnumber"),
        _p("nmm:isoSpeed", "int").alias("iso"), _p("nmm:flash").alias("flash"), _p("nmm:whiteBalance").alias("white"), _p("nfo:orientation").alias("orientation"), kid("slo:GeoLocation", "slo:latitude").cast("float").alias("latitude"), kid("slo:GeoLocation", "slo:longitude").cast("float").alias("longitude"),
    )


def _xmp(name: str, author: str, size: int) -> bytes:
    bag = lambda *v: "<r:Bag>" + "".join(f"<r:li>{_xml(x)}</r:li>" for x in v) + "</r:Bag>"
    region = f'<m:RegionList>{bag("")[:-8]}<r:li><r:Description m:Name="{_xml(name)}" m:Type="Face"><m:Area s:x="0.{size:02d}" s:y="0.5" s:w="0.1" s:h="0.2"/></r:Description></r:li></r:Bag></m:RegionList>'.replace("<r:li></r:li>", "")
    body = f'<r:Description p:Rating="{size % 6}" p:City="Town {size}"><d:title><r:Alt><r:li>{_xml(name)}</r:li></r:Alt></d:title><d:creator>{bag(author)}</d:creator><d:subject>{bag("one", f"k{size}")}</d:subject><t:Orientation>{size % 8 + 1}</t:Orientation><e:MeteringMode>{size % 8}</e:MeteringMode><e:Flash>{size % 4}</e:Flash><e:WhiteBalance>{size % 3}</e:WhiteBalance><m:Regions>{region}</m:Regions></r:Description>'
    return f'<x:xmpmeta xmlns:x="adobe:ns:meta/" xmlns:r="r" xmlns:d="d" xmlns:p="p" xmlns:t="t" xmlns:e="e" xmlns:m="m" xmlns:s="s"><r:RDF>{body}</r:RDF></x:xmpmeta>'.encode()


def _with_xmp(name: str, author: str, size: int) -> bytes:
    return _jpeg(size, 10, (0xE1, b"http://ns.adobe.com/xap/1.0/\0" + _xmp(name, author, size)))


@query("x26_xmp", """
select p_partkey::varchar as url, p_name as title, p_brand as author, 'one,k' || p_size as keywords, (p_size % 6)::varchar as rating, 'Town ' || p_size as city,
'nfo:orientation-' || ['top', 'top-mirror', 'bottom', 'bottom-mirror', 'left-mirror', 'right', 'right-mirror', 'left'][p_size % 8 + 1] as orientation, p_name as region, 'nfo:roi-content-face' as region_type, (p_size / 100.0)::float as x,
'nmm:metering-mode-' || ['other', 'average', 'center-weighted-average', 'spot', 'multispot', 'pattern', 'partial', 'other'][p_size % 8 + 1] as metering, case when p_size % 4 in (1, 3) then 'nmm:flash-on' else 'nmm:flash-off' end as flash, case when p_size % 3 = 1 then 'nmm:white-balance-manual' else 'nmm:white-balance-auto' end as white from part""")
def x26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with elements, attributes, lists and a region."""
    out = extract(_made(_part(spark, sf_dir, "p_name", "p_brand", "p_size"), "jpeg", _with_xmp))
    return out.select("url", "title", _p("nco:creator").alias("author"), F.array_join(F.col("props")["nie:keyword"], ",").alias("keywords"), _p("nao:numericRating").alias("rating"), _p("nco:locality").alias("city"), _p("nfo:orientation").alias("orientation"), _child("nie:title").alias("region"), _child("nfo:regionOfInterestType").alias("region_type"), _child("nfo:regionOfInterestX", "float").alias("x"), _p("nmm:meteringMode").alias("metering"), _p("nmm:flash").alias("flash"), _p("nmm:whiteBalance").alias("white"))


def _with_iptc(key: int, name: str, author: str) -> bytes:
    rec = lambda n, v: b"\x1c\x02" + bytes([n]) + struct.pack(">H", len(v.encode())) + v.encode()
    data = rec(5, name) + (rec(25, "k1") + rec(25, f"k{key}") + rec(80, author) + rec(90, "Town") + rec(101, "Land") if key % 2 else b"") + rec(131, "P" if key % 4 == 1 else "L")
    block = b"8BIM\x04\x04\0\0" + struct.pack(">I", len(data)) + data + bytes(len(data) % 2)
    return _jpeg(20, 10, (0xED, b"Photoshop 3.0\0" + b"8BIM\x03\xed\0\0" + struct.pack(">I", 2) + b"ab" + block))


@query("x27_iptc", """
select p_partkey::varchar as url, case when p_partkey % 2 = 1 then p_name end as title, case when p_partkey % 2 = 1 then 'k1' || case when p_partkey = 1 then '' else ',k' || p_partkey end end as keywords, case when p_partkey % 2 = 1 then p_brand end as author,
case when p_partkey % 2 = 1 then 'Town, Land' end as place, case p_partkey % 4 when 1 then 'nfo:orientation-left' when 3 then 'nfo:orientation-top' end as orientation from part""")
def x27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records behind another resource; without keywords, byline, copyright or city they are dropped."""
    df = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("key"), "p_name", "p_brand")
    out = extract(_made(df, "jpeg", _with_iptc))
    place = F.concat(_child("nco:locality"), F.lit(", "), _child("nco:country"))
    return out.select("url", "title", F.array_join(F.col("props")["nie:keyword"], ",").alias("keywords"), _p("nco:creator").alias("author"), place.alias("place"), _p("nfo:orientation").alias("orientation"))


def _png(name: str, author: str, size: int) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    text = chunk(b"tEXt", b"Title\0" + name.encode("latin-1")) + chunk(b"zTXt", b"Author\0\0" + zlib.compress(author.encode("latin-1"))) + chunk(b"iTXt", b"Description\0\0\0en\0\0" + f"größe {size}".encode())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", size, 9, 8, 6, 0, 0, 0)) + text + chunk(b"IEND", b"")


@query("x18_png_text", "select p_partkey::varchar as url, p_size::int as width, p_name as title, p_brand as author, 'größe ' || p_size as description from part")
def x18_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain, packed and international text chunks."""
    out = extract(_made(_part(spark, sf_dir, "p_name", "p_brand", "p_size"), "png", _png))
    return out.select("url", _p("nfo:width", "int").alias("width"), "title", _p("nco:creator").alias("author"), _p("nie:description").alias("description"))


def _gif(name: str, size: int) -> bytes:
    raw = name.encode()
    blocks = b"".join(bytes([len(raw[k : k + 9])]) + raw[k : k + 9] for k in range(0, len(raw), 9))
    return b"GIF89a" + struct.pack("<HHBBB", size, 3, 0, 0, 0) + b"\x21\xfe" + blocks + b"\0\x3b"


@query("x20_gif_comment", "select p_partkey::varchar as url, p_size::int as width, p_name as comment from part")
def x20_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments cut into blocks."""
    out = extract(_made(_part(spark, sf_dir, "p_name", "p_size"), "gif", _gif))
    return out.select("url", _p("nfo:width", "int").alias("width"), _p("nie:comment").alias("comment"))


def _webp(key: int, size: int) -> bytes:
    w, h = size, key % 5000 + 1
    if key % 3 == 0:
        body = b"VP8X\0\0\0\0" + bytes(4) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little")
    elif key % 3 == 1:
        body = b"VP8L\0\0\0\0\x2f" + ((w - 1) | (h - 1) << 14).to_bytes(4, "little")
    else:
        body = b"VP8 \0\0\0\0" + bytes(3) + b"\x9d\x01\x2a" + struct.pack("<HH", w, h)
    return b"RIFF\0\0\0\0WEBP" + body


def _image_sizes(df: DataFrame) -> DataFrame:
    return extract(df).select("url", _p("nfo:width", "int").alias("width"), _p("nfo:height", "int").alias("height"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("key"), "p_size")


@query("x21_webp", "select p_partkey::varchar as url, p_size::int as width, (p_partkey % 5000 + 1)::int as height from part")
def x21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extended, lossless and lossy frames."""
    return _image_sizes(_made(_keyed(spark, sf_dir), "webp", _webp))


def _ico(key: int, size: int) -> bytes:
    entry = lambda w, h: bytes([w % 256, h % 256]) + bytes(14)
    return struct.pack("<HHH", 0, 1, 2) + entry(size, 16) + entry(8, key % 256 + 1)


@query("x23_ico", "select p_partkey::varchar as url, greatest(p_size, 8)::int as width, greatest(p_partkey % 256 + 1, 16)::int as height from part")
def x23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest sides of the directory; 256 is stored as 0."""
    return _image_sizes(_made(_keyed(spark, sf_dir), "icon", _ico))


def _raw(key: int, size: int) -> bytes:
    inner = [(0xA002, 4, struct.pack("<I", size)), (0xA003, 4, struct.pack("<I", key % 5000 + 1))] if key % 2 else [(0x8827, 3, _number(100))]
    return _tiff([(0x100, 3, _number(size if key % 2 == 0 else 1)), (0x101, 3, _number(key % 5000 + 1 if key % 2 == 0 else 1))], "<", {0x8769: inner})


@query("x24_raw", "select p_partkey::varchar as url, p_size::int as width, (p_partkey % 5000 + 1)::int as height from part")
def x24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera files, led to their module by the rules: the sizes of the camera directory come before those of the thumbnail."""
    from kartei.extract import pipeline
    from kartei.operators.rules import shipped_rules

    files = _made(_keyed(spark, sf_dir), "", _raw, "image/x-adobe-dng").select("url", "mime_type", "content")
    ies, _ = pipeline.run(files, shipped_rules(spark))
    return ies.select(F.col("stored_as")[0].alias("url"), _p("nfo:width", "int").alias("width"), _p("nfo:height", "int").alias("height"))


# written back and read again


def _written(files: DataFrame, props: Column, module: Column) -> DataFrame:
    """The files with properties written into them twice, the second time over the first."""
    first = F.transform_values(props, lambda k, v: F.array(F.lit("to be replaced")))
    once = writeback.rewrite(files.withColumn("props", first)).select("url", "mime_type", "content")
    twice = writeback.rewrite(once.withColumn("props", props))
    return extract(twice.select("url", "mime_type", module.alias("module"), F.array().cast("array<string>").alias("rdf_types"), "content"))


def _plain_image(key: int) -> bytes:
    kinds = (lambda: _jpeg(30, 20, (0xFE, b"kept")), lambda: _png("kept", "Me", 30), lambda: _gif("kept", 30), lambda: _tiff([(0x100, 3, _number(30)), (0x101, 3, _number(20)), (0x10E, 2, b"kept\0")]))
    return kinds[key % 4]()


@query("q19_embedded_xmp", """
select p_partkey::varchar as url, 'Part ' || p_partkey as title, 'one,k' || p_partkey as keywords, 30 as width,
case p_partkey % 4 when 1 then null when 3 then null else 'kept' end as comment from part""")
def q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets in four kinds of images, whose own comments and sizes stay; a packet comes before the texts of a PNG."""
    mime = F.element_at(F.array(*[F.lit(f"image/{k}") for k in ("jpeg", "png", "gif", "tiff")]), (F.col("url").cast("int") % 4 + 1).cast("int"))
    files = _made(_read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("key")), "", _plain_image).select("url", mime.alias("mime_type"), "content")
    props = F.create_map(F.lit("nie:title"), F.array(F.concat(F.lit("Part "), F.col("url"))), F.lit("nie:keyword"), F.array(F.lit("one"), F.concat(F.lit("k"), F.col("url"))))
    out = _written(files, props, F.regexp_extract("mime_type", "/(.*)", 1))
    return out.select("url", "title", F.array_join(F.col("props")["nie:keyword"], ",").alias("keywords"), _p("nfo:width", "int").alias("width"), _p("nie:comment").alias("comment"))


def _plain_sound(key: int, name: str) -> bytes:
    if key % 2:
        return _flac("old title", name, 4)
    return _id3(3, {"TIT2": "old title", "TCOM": name}) + (struct.pack(">I", 0xFFFB9000) + bytes(413)) * 39


@query("q20_audio_tags", """
select c_custkey::varchar as url, 'Song ' || c_custkey as title, 'Ärtist ' || c_custkey as artist, (c_custkey % 90 + 1)::int as track, case when c_custkey % 2 = 0 then c_name end as composer, case when c_custkey % 2 = 1 then 5 else 1 end as seconds from customer""")
def q20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags in MP3 and FLAC: what is not written stays, the sound too."""
    df = _read(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("key"), "c_name")
    odd = F.col("url").cast("int") % 2 == 1
    files = _made(df, "", _plain_sound).select("url", F.when(odd, "audio/flac").otherwise("audio/mpeg").alias("mime_type"), "content")
    props = F.create_map(F.lit("nie:title"), F.array(F.concat(F.lit("Song "), F.col("url"))), F.lit("nmm:artist"), F.array(F.concat(F.lit("Ärtist "), F.col("url"))), F.lit("nmm:trackNumber"), F.array((F.col("url").cast("int") % 90 + 1).cast("string")))
    out = _written(files, props, F.when(F.col("mime_type") == "audio/flac", "libav").otherwise("mp3"))
    return out.select("url", "title", F.array_join(F.col("props")["nmm:artist"], ",").alias("artist"), _p("nmm:trackNumber", "int").alias("track"), _p("nmm:composer").alias("composer"), _p("nfo:duration", "int").alias("seconds"))


# discs


def _iso(key: int, name: str) -> bytes:
    volume = bytearray(2048)
    volume[0:6], volume[40:72] = b"\x01CD001", name.encode("ascii", "replace")[:32].ljust(32)
    volume[80:84], volume[128:130] = struct.pack("<I", key), struct.pack("<H", 2048)
    boot = (b"\0CD001\x01EL TORITO SPECIFICATION").ljust(2048, b"\0") if key % 2 else b""
    return bytes(32768) + bytes(volume) + boot + b"\xffCD001\x01".ljust(2048, b"\0")


@query("x28_iso", "select s_suppkey::varchar as url, left(s_name, 32) as title, (s_suppkey * 2048)::bigint as bytes, s_suppkey % 2 = 1 as bootable from supplier")
def x28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes, every other one with a boot record."""
    out = extract(_made(_read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("key"), "s_name"), "iso", _iso))
    return out.select("url", "title", _p("nfo:occupiedSpace", "bigint").alias("bytes"), F.array_contains("rdf_types", "nfo:OperatingSystem").alias("bootable"))


@query("x29_disc", """
select s_suppkey::varchar as url, s_name as title, case when s_suppkey % 2 = 1 then 'nfo:GameImage' else 'nfo:Software' end as type, 'disc-' || s_suppkey || '.bin' as image from supplier""")
def x29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of disc images: data tracks make a game image."""
    key = F.col("s_suppkey").cast("string")
    sheet = F.concat(F.lit('TITLE "'), "s_name", F.lit('"\nFILE "disc-'), key, F.lit('.bin" BINARY\n  TRACK 01 '), F.when(F.col("s_suppkey") % 2 == 1, "MODE2/2352").otherwise("AUDIO"), F.lit("\n    INDEX 01 00:00:00\n"))
    files = _read(spark, sf_dir, "supplier").select(key.alias("url"), F.lit("application/x-cue").alias("mime_type"), F.lit("disc-generic").alias("module"), F.array().cast("array<string>").alias("rdf_types"), F.encode(sheet, "UTF-8").alias("content"))
    return extract(files).select("url", "title", F.col("rdf_types")[0].alias("type"), _p("nie:isStoredAs").alias("image"))


@query("x30_no_module", "select doc_id::varchar as url, 'nfo:EBook' as type, null::varchar as plain_text, false as failed from documents")
def x30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types without a module are catalogued and not read."""
    d = _read(spark, sf_dir, "documents")
    files = d.select(F.col("doc_id").cast("string").alias("url"), F.lit("application/x-cbz").alias("mime_type"), F.lit(None).cast("string").alias("module"), F.array(F.lit("nfo:EBook")).alias("rdf_types"), F.encode("text", "UTF-8").alias("content"))
    return extract(files).select("url", F.col("rdf_types")[0].alias("type"), "plain_text", F.col("error").isNotNull().alias("failed"))


@query("sc29_ends_hash", "select doc_id, case when doc_id % 4 > 0 then lower(printf('%016x', (131072 + 2 * 8192 * (doc_id % 7))::bigint)) end as hash from documents")
def sc29(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of 128 KiB of one small number in every word; every fourth is too small for a hash."""
    word = F.unhex(F.concat(F.lpad(F.hex(F.col("doc_id") % 7), 2, "0"), F.lit("00" * 7)))
    whole = F.encode(F.repeat(F.decode(word, "ISO-8859-1"), 16384), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 4 > 0, whole).otherwise(F.encode(F.lit("small"), "UTF-8"))
    return _read(spark, sf_dir, "documents").select("doc_id", binary.ends_hash(content).alias("hash"))
