"""Extractors on files made by hand."""

from __future__ import annotations

import io
import struct
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from kartei.extract import audio, base, documents, images, ole, pdf, photo, pipeline, playlists, zipped
from kartei.extract.base import Info, Resource, Unreadable, extract, extract_one
from kartei.sources import reports, walk
from kartei.sources.settings import Settings

INFO = Info("file:///x", "x/y")


def zipped_file(**members: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), body)
    return out.getvalue()


def test_html():
    r = documents.html(b'<html><head><title> A  b </title><meta name="keywords" content="k, l"></head><body>1<script>no</script><p>2 <a rel="license" href="http://l">3</a></p></body></html>', INFO)
    assert r.get("nie:title") == "A b" and r.props["nie:keyword"] == ["k", "l"]
    assert r.get("nie:plainTextContent") == "1 2 3" and r.get("nie:license") == "http://l"


def test_postscript():
    r = documents.postscript(b"%!PS-Adobe-3.0\n%%Title: (T)\n%%Creator: C\n%%Copyright: Z\n%%Pages: (atend)\n%%CreationDate: D:20240428180000+02'00\n%%EndComments\n...\n%%Pages: 1\n", INFO)
    assert (r.get("nie:title"), r.get("nfo:pageCount"), r.get("nie:contentCreated")) == ("T", "1", "2024-04-28T18:00:00+02:00")
    with pytest.raises(Unreadable):
        documents.postscript(b"hello", INFO)


def test_desktop():
    r = documents.desktop(b"[Desktop Entry]\nType=Application\nName=App\nExec=app %U\nIcon=app\nCategories=A;B;\n", INFO)
    assert r.get("nfo:softwareCmdLine") == "app %U" and len(r.props["nie:isLogicalPartOf"]) == 2
    for broken in (b"", b"[Desktop Entry]\nType=Application\nName=App\n", b"[Desktop Entry]\nType=Link\nName=L\n", b"[Desktop Entry]\nType=Application\nName=A\nExec=a\nHidden=true\n"):
        with pytest.raises(Unreadable):
            documents.desktop(broken, INFO)


def test_abiword():
    r = documents.abiword(b'<abiword><metadata><m key="dc.title">T</m><m key="abiword.keywords">a,b</m></metadata><section><p>one <c>two</c></p><p>three</p></section></abiword>', INFO)
    assert r.get("nie:title") == "T" and r.get("nie:plainTextContent") == "one two three"


def test_zip_family():
    docx = zipped_file(word__document_dot_xml='<d xmlns:w="w"><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:t>World</w:t></w:p></d>', docProps__app_dot_xml="<P><Pages>3</Pages></P>")
    r = zipped.msoffice_xml(docx, INFO)
    assert r.get("nie:plainTextContent") == "Hello World" and r.get("nfo:pageCount") == "3"
    odt = zipped_file(content_dot_xml='<o xmlns:t="t"><t:h>Head</t:h><t:p>a<t:s/>b<t:span>c</t:span></t:p></o>', meta_dot_xml='<m xmlns:x="x"><x:title>T</x:title><x:keyword>k,l</x:keyword></m>')
    r = zipped.oasis(odt, INFO)
    assert r.get("nie:plainTextContent") == "Head a bc" and r.props["nie:keyword"] == ["k", "l"]
    pages = {"META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>', "o/p.opf": '<p xmlns:d="d" xmlns:o="o"><d:title>B</d:title><d:creator o:role="aut">Me</d:creator><item id="i" href="a.html"/><itemref idref="i"/></p>', "o/a.html": "<body>text</body>"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in pages.items():
            z.writestr(k, v)
    r = zipped.epub(out.getvalue(), INFO)
    assert (r.get("nie:title"), r.get("nco:creator"), r.get("nie:plainTextContent")) == ("B", "Me", "text")
    with pytest.raises(Unreadable):
        zipped.epub(b"no zip", INFO)


def test_playlists():
    pls = b"[playlist]\nFile2=b.mp3\nLength2=10\nFile1=a.mp3\nTitle1=A\nLength1=5\n"
    r = playlists.playlist(pls, INFO)
    assert [c[2]["nfo:entryUrl"] for c in r.children] == ["a.mp3", "b.mp3"] and r.get("nfo:listDuration") == "15"
    many = b"#EXTM3U\n" + b"".join(b"#EXTINF:1,T\nf%d.mp3\n" % k for k in range(1200))
    r = playlists.playlist(many, INFO)
    assert (r.get("nfo:entryCounter"), len(r.children), r.get("nfo:listDuration")) == ("1200", 1000, "1000")
    xspf = b'<playlist><trackList><track><location>x.ogg</location><duration>2500</duration></track></trackList></playlist>'
    assert playlists.playlist(xspf, INFO).children[0][2]["nfo:entryUrl"] == "x.ogg"
    assert playlists.write_m3u([(3, "c"), (1, "a")]) == "#EXTM3U\na\nc\n"


def test_cue():
    sheet = b'TITLE "Al"\nPERFORMER "P"\nFILE "Song.flac" WAVE\n TRACK 01 AUDIO\n  TITLE "One"\n  INDEX 01 00:00:00\n TRACK 02 AUDIO\n  TITLE "Two"\n  INDEX 00 04:10:00\n  INDEX 01 04:17:52\n'
    r = playlists.cue_tracks(sheet, "SONG.mp3", 360.0)
    (_, _, a), (_, _, b) = r.children
    assert (a["nfo:duration"], b["nfo:duration"], b["nfo:audioOffset"], a["nmm:artist"]) == ("257", "102", "257.6933333", "P")
    assert playlists.cue_tracks(sheet, "other.mp3", 360.0).children == []
    assert playlists.disc(b'FILE "g.bin" BINARY\n TRACK 01 MODE2/2352\n  INDEX 01 00:00:00\n', INFO).types == ["nfo:GameImage"]


def png_file(chunks) -> bytes:
    body = b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in chunks)
    return b"\x89PNG\r\n\x1a\n" + body


def tiff_file(entries, tail=b"") -> bytes:
    at = 8 + 2 + 12 * len(entries) + 4
    data, extra = b"", b""
    for tag, kind, values in entries:
        raw = values if isinstance(values, bytes) else b"".join(struct.pack("<H" if kind == 3 else "<I", v) for v in values)
        n = len(raw) // photo.SIZES[kind] if kind != 5 else len(raw) // 8
        if len(raw) <= 4:
            data += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            data += struct.pack("<HHII", tag, kind, n, at + len(extra))
            extra += raw
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + data + struct.pack("<I", 0) + extra + tail


EXIF = tiff_file([(0x010F, 2, b"Make\0"), (0x0112, 3, [6]), (0x9209, 3, [1]), (0x829A, 5, struct.pack("<II", 1, 50)), (0x9003, 2, b"2020:01:02 03:04:05\0")])
XMP = b'<x:xmpmeta xmlns:x="adobe:ns:meta/"><r:RDF xmlns:r="r"><r:Description xmlns:d="d"><d:title><r:Alt><r:li>X title</r:li></r:Alt></d:title><d:subject><r:Bag><r:li>a</r:li><r:li>b</r:li></r:Bag></d:subject></r:Description></r:RDF></x:xmpmeta>'


def test_images():
    r = images.png(png_file([(b"IHDR", struct.pack(">IIBBBBB", 100, 90, 8, 6, 0, 0, 0)), (b"tEXt", b"Title\0Hello"), (b"eXIf", EXIF), (b"IEND", b"")]), INFO)
    assert (r.get("nfo:width"), r.get("nfo:height"), r.get("nie:title"), r.get("nfo:orientation"), r.get("nmm:dlnaProfile")) == ("100", "90", "Hello", "nfo:orientation-right", "PNG_TN")
    assert r.get("nmm:flash") == "nmm:flash-on" and r.get("nmm:exposureTime") == "0.02"
    seg = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    jpg = b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + EXIF) + seg(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + XMP) + seg(0xFE, b"note") + seg(0xC0, b"\x08" + struct.pack(">HH", 480, 640) + b"\x03") + b"\xff\xd9"
    r = images.jpeg(jpg, INFO)
    assert (r.get("nfo:width"), r.get("nie:title"), r.get("nie:comment"), r.get("nmm:dlnaProfile")) == ("640", "X title", "note", "JPEG_SM")
    assert r.get("nie:contentCreated") == "2020-01-02T03:04:05" and r.props["nie:keyword"] == ["a", "b"]
    r = images.gif(b"GIF89a" + struct.pack("<HHBBB", 5, 6, 0, 0, 0) + b"\x21\xfe\x03hey\0\x3b", INFO)
    assert (r.get("nfo:width"), r.get("nie:comment")) == ("5", "hey")
    assert images.bmp(b"BM" + bytes(12) + struct.pack("<Iii", 40, 7, -8), INFO).get("nfo:height") == "8"
    assert images.icon(struct.pack("<HHH", 0, 1, 2) + b"\x10\x10" + bytes(14) + b"\0\0" + bytes(14), INFO).get("nfo:width") == "256"
    assert images.webp(b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\0\0\0\0" + (9).to_bytes(3, "little") + (19).to_bytes(3, "little"), INFO).get("nfo:height") == "20"
    assert images.tiff(tiff_file([(0x100, 3, [30]), (0x101, 3, [40])]), INFO).get("nfo:height") == "40"
    for bad in (images.png, images.jpeg, images.gif, images.bmp, images.icon, images.webp, images.tiff):
        with pytest.raises(Unreadable):
            bad(b"broken content", INFO)


def test_iptc():
    rec = lambda n, v: b"\x1c\x02" + bytes([n]) + struct.pack(">H", len(v)) + v
    r = Resource()
    photo.apply_iptc(r, rec(25, b"k1") + rec(25, b"k2") + rec(90, b"Town") + rec(131, b"P"))
    assert r.props["nie:keyword"] == ["k1", "k2"] and r.get("nfo:orientation") == "nfo:orientation-left"
    empty = Resource()
    photo.apply_iptc(empty, rec(5, b"title only"))
    assert empty.props == {}


def id3(frames, version=4) -> bytes:
    body = b"".join(k + (struct.pack(">I", len(v)) if version == 3 else bytes([len(v) >> 21 & 127, len(v) >> 14 & 127, len(v) >> 7 & 127, len(v) & 127])) + b"\0\0" + v for k, v in frames)
    n = len(body)
    return b"ID3" + bytes([version, 0, 0, n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def test_mp3():
    frame = struct.pack(">I", 0xFFFB9000) + bytes(413)  # MPEG 1 layer 3, 128 kbit/s, 44.1 kHz: 417 bytes
    data = id3([(b"TIT2", b"\x03T\xc3\xa4g"), (b"TCON", b"\x03(17)"), (b"TRCK", b"\x033/12"), (b"TXXX", b"\x03MusicBrainz Album Id\0abc")]) + frame * 100 + b"TAG" + b"Old".ljust(30, b"\0") + b"Artist".ljust(30, b"\0") + bytes(64) + b"\xff"
    r = audio.mp3(data, INFO)
    assert (r.get("nie:title"), r.get("nfo:genre"), r.get("nmm:trackNumber"), r.get("nmm:artist")) == ("Täg", "Rock", "3", "Artist")
    assert (r.get("nfo:sampleRate"), r.get("nfo:averageBitrate"), r.get("nfo:duration"), r.get("nmm:dlnaProfile")) == ("44100", "128000", "2", "MP3")
    with pytest.raises(Unreadable):
        audio.mp3(b"nothing here", INFO)


def test_flac_and_wav():
    comment = lambda kv: struct.pack("<I", len(kv)) + kv
    block = struct.pack("<I", 0) + struct.pack("<I", 2) + comment(b"TITLE=F") + comment(b"TRACKTOTAL=9")
    info = bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 441000).to_bytes(8, "big") + bytes(16)
    flac = b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x84" + len(block).to_bytes(3, "big") + block
    r = audio.container(flac, INFO)
    assert (r.get("nie:title"), r.get("nfo:duration"), r.get("nfo:channels"), r.get("nmm:albumTrackCount")) == ("F", "10", "2", "9")
    wav = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 64000)
    assert audio.container(wav, INFO).get("nfo:duration") == "2"


def test_pdf():
    stream = zlib.compress(b"BT (Hello) Tj 0 -10 Td [(W) -20 (orld)] TJ ET")
    doc = b"%PDF-1.4\n1 0 obj <</Type /Page>> endobj\n2 0 obj <</Length 9 /Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj\n3 0 obj <</Title (T \\(x\\)) /Author <FEFF00C4> /CreationDate (D:20240428180000Z)>> endobj"
    r = pdf.pdf(doc, INFO)
    assert (r.get("nie:title"), r.get("nco:creator"), r.get("nfo:pageCount"), r.get("nie:plainTextContent")) == ("T (x)", "Ä", "1", "Hello World")


def test_ole_rejects_garbage():
    with pytest.raises(Unreadable):
        ole.msoffice(b"\xd0\xcf\x11\xe0", INFO)


def test_bad_rows_are_quarantined(spark, monkeypatch):
    rows = [("a", "application/postscript", "ps", bytearray(b"%!PS\n%%Title: A\n")), ("b", "application/postscript", "ps", bytearray(b"broken")), ("c", "x/none", None, None), ("d", "image/png", "png", bytearray(b"")), ("e", None, "text", bytearray(b"plain"))]
    df = spark.createDataFrame(rows, "url string, mime_type string, module string, content binary").withColumn("rdf_types", F.array(F.lit("nfo:Document")))
    got = {r.url: r for r in extract(df).collect()}
    assert len(got) == 5 and got["a"].title == "A" and got["a"].error is None
    assert "Unreadable" in got["b"].error and "Unreadable" in got["d"].error
    assert got["c"].error is None and got["e"].plain_text == "plain"
    assert base.errors(extract(df)).count() == 2


def test_a_stalled_module_meets_its_deadline():
    def stall(name):
        def run(content, info):
            time.sleep(30)

        return run

    began = time.time()
    assert "TimeoutError" in extract_one(b"", "u", "m", "x", [], deadline=0.2, registry=stall)[-1]
    assert time.time() - began < 5


def test_text_budget():
    assert extract_one("é".encode() * 10, "u", "text/plain", "text", [], max_text=5)[5] == "éé"


def test_writeback_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.jpg")
    df = spark.createDataFrame([(path, {"nie:title": ["T & t"], "nie:keyword": ["k", "l"]})], "path string, props map<string,array<string>>")
    assert pipeline.write_sidecars(df).first().error is None
    r = Resource()
    photo.apply_xmp(r, (tmp_path / "a.jpg.xmp").read_bytes())
    assert r.get("nie:title") == "T & t" and r.props["nie:keyword"] == ["k", "l"]


def test_walk(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/f.txt").write_text("x")
    (tmp_path / ".hidden").write_text("")
    (tmp_path / "link").symlink_to(tmp_path / "d")
    walk.register(spark)
    got = {r.path.removeprefix(f"{tmp_path}/"): r for r in spark.read.format("filewalk").option("path", str(tmp_path)).option("partitions", "2").load().collect()}
    assert set(got) == {"d", "d/e", "d/e/f.txt", ".hidden"} and got["d/e/f.txt"].file_size == 1 and got[".hidden"].is_hidden
    flat = spark.read.format("filewalk").option("path", str(tmp_path)).option("recursive", "false").load()
    assert flat.count() == 2
    assert walk.with_content(spark, str(tmp_path), "*.txt").first().content == b"x"


def test_settings():
    s = Settings.load(Settings(max_bytes=5).dump())
    assert s.max_bytes == 5 and s.filters.file == Settings().ignored_files
    with pytest.raises(ValueError):
        Settings(max_bytes=11 << 20)


def test_reports(spark):
    empty = spark.createDataFrame([], reports.SCHEMA)
    one = reports.save(empty, spark.createDataFrame([("file:///a%20b", "m", None)], "uri string, message string, sparql string"))
    files = spark.createDataFrame([("file:///a%20b",)], "url string")
    assert reports.current(one, files, ["a b"]).count() == 1
    assert reports.current(one, files, ["zzz"]).count() == 0
    assert reports.forget(one, files.withColumnRenamed("url", "uri")).count() == 0


def test_writing_back_in_place(spark, tmp_path):
    from kartei.extract import writeback

    seg = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    jpg = b"\xff\xd8" + seg(0xE1, b"Exif\0\0" + EXIF) + seg(0xC0, b"\x08" + struct.pack(">HH", 480, 640) + b"\x03") + b"\xff\xd9"
    song = id3([(b"TIT2", b"\x03Old"), (b"TXXX", b"\x03MusicBrainz Album Id\0abc")]) + struct.pack(">I", 0xFFFB9000) + bytes(413)
    for name, data in (("a.jpg", jpg), ("b.mp3", song), ("c.txt", b"text"), ("d.jpg", b"broken")):
        (tmp_path / name).write_bytes(data)
    rows = [(str(tmp_path / n), m, {"nie:title": ["Neu & gut"]}) for n, m in (("a.jpg", "image/jpeg"), ("b.mp3", "audio/mpeg"), ("c.txt", "text/plain"), ("d.jpg", "image/jpeg"), ("gone.jpg", "image/jpeg"))]
    df = spark.createDataFrame(rows, "path string, mime_type string, props map<string,array<string>>")
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in writeback.write_files(df).collect()}
    assert errors["a.jpg"] is None and errors["b.mp3"] is None and "not written" in errors["c.txt"] and "no JPEG" in errors["d.jpg"] and errors["gone.jpg"]
    r = images.jpeg((tmp_path / "a.jpg").read_bytes(), INFO)
    assert r.get("nie:title") == "Neu & gut" and r.get("nie:contentCreated") == "2020-01-02T03:04:05"
    assert audio.mp3((tmp_path / "b.mp3").read_bytes(), INFO).get("nie:title") == "Neu & gut" and (tmp_path / "b.mp3").read_bytes().endswith(song[-417:])
    assert b"abc" in (tmp_path / "b.mp3").read_bytes() and (tmp_path / "c.txt").read_bytes() == b"text" and (tmp_path / "d.jpg").read_bytes() == b"broken"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.jpg", "b.mp3", "c.txt", "d.jpg"]
