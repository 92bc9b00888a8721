"""Extraction rules: which module, graph and types a MIME type gets."""

from __future__ import annotations

import configparser
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.operators.eligibility import glob_regex

SCHEMA = "ord int, rule_file string, allow array<string>, block array<string>, rdf_types array<string>, graph string, hash string, module string"

# The shipped rules in order: file, MIME patterns, types, graph, module.
SHIPPED = """
10-abw|application/x-abiword|nfo:Document|Documents|abw
10-bmp|image/bmp|nfo:Image;nmm:Photo|Pictures|bmp
10-comics|application/x-cbr;application/x-cbz;application/x-cbt;application/x-cb7;application/vnd.comicbook+zip|nfo:EBook|Documents|
10-desktop|application/x-desktop|nfo:SoftwareApplication|Software|desktop
10-ebooks|application/x-zip-compressed-fb2;application/x-fictionbook+xml;application/x-mobipocket-ebook;image/vnd.djvu+multipage|nfo:EBook;nfo:PaginatedTextDocument|Documents|
10-epub|application/epub+zip|nfo:EBook;nfo:TextDocument|Documents|epub
10-folder|inode/directory|nfo:Folder||
10-gif|image/gif|nfo:Image;nmm:Photo|Pictures|gif
10-html|text/html;application/xhtml+xml|nfo:HtmlDocument|Documents|html
10-ico|image/vnd.microsoft.icon|nfo:Image;nfo:Icon|Pictures|icon
10-jpeg|image/jpeg|nfo:Image;nmm:Photo|Pictures|jpeg
10-mp3|audio/mpeg;audio/x-mp3|nmm:MusicPiece;nfo:Audio|Audio|mp3
10-msoffice|application/msword;application/vnd.ms-word;application/vnd.ms-word.*;application/vnd.ms-powerpoint;application/vnd.ms-excel;application/vnd.ms-access;application/vnd.ms-publisher|nfo:Document|Documents|msoffice
10-oasis|application/vnd.oasis.opendocument.*|nfo:PaginatedTextDocument|Documents|oasis
10-pdf|application/pdf|nfo:PaginatedTextDocument|Documents|pdf
10-png|image/png;sketch/png|nfo:Image;nmm:Photo|Pictures|png
10-ps|application/x-gzpostscript;application/postscript|nfo:PaginatedTextDocument|Documents|ps
10-raw|image/x-dcraw;image/x-adobe-dng;image/x-canon-cr2;image/x-canon-crw;image/x-epson-erf;image/x-fuji-raf;image/x-minolta-mrw;image/x-nikon-nef;image/x-olympus-orf;image/x-panasonic-rw;image/x-pentax-pef;image/x-raw;image/x-samsung-raw;image/x-sigma-x3f;image/x-sony-arw;image/x-sony-srf;image/x-sony-sr2|nfo:Image;nmm:Photo|Pictures|raw
10-svg|image/svg+xml;image/svg+xml-compressed|nfo:Image;nfo:VectorImage|Pictures|
10-tiff|image/tiff|nfo:Image;nmm:Photo|Pictures|tiff
10-webp|image/webp|nfo:Image;nmm:Photo|Pictures|webp
10-xps|application/oxps;application/vnd.ms-xpsdocument|nfo:PaginatedTextDocument|Documents|xps
11-iso|application/x-cd-image;application/vnd.efi.iso|nfo:FilesystemImage|Software|iso
11-msoffice-xml|application/vnd.openxmlformats-officedocument.presentationml.presentation;application/vnd.openxmlformats-officedocument.presentationml.slideshow;application/vnd.openxmlformats-officedocument.spreadsheetml.sheet;application/vnd.openxmlformats-officedocument.wordprocessingml.document|nfo:PaginatedTextDocument|Documents|msoffice-xml
15-executable|application/x-ms-dos-executable|nfo:Executable;nfo:SoftwareApplication|Software|
15-games|application/vnd.nintendo.snes.rom;application/x-amiga-disk-format;application/x-atari-2600-rom;application/x-atari-7800-rom;application/x-atari-lynx-rom;application/x-dc-rom;application/x-doom-wad;application/x-fds-disk;application/x-gameboy-color-rom;application/x-gameboy-rom;application/x-gamecube-rom;application/x-gamegear-rom;application/x-gba-rom;application/x-genesis-32x-rom;application/x-genesis-rom;application/x-n64-rom;application/x-neo-geo-pocket-color-rom;application/x-neo-geo-pocket-rom;application/x-nes-rom;application/x-nintendo-ds-rom;application/x-pc-engine-rom;application/x-saturn-rom;application/x-sega-cd-rom;application/x-sega-pico-rom;application/x-sg1000-rom;application/x-sms-rom;application/x-virtual-boy-rom;application/x-wii-rom;application/x-wii-wad;application/x-wonderswan-color-rom;application/x-wonderswan-rom;application/x-msx-rom;application/x-nintendo-3ds-rom;application/x-nintendo-3ds-executable;application/x-discjuggler-cd-image;application/x-gd-rom-cue;application/x-pc-engine-cd-rom;application/x-playstation-rom|nfo:GameImage|Software|
15-libav-guess|video/3gpp;video/mp4;video/x-ms-asf;application/vnd.ms-asf;application/vnd.rn-realmedia|nfo:Media;nfo:Video|Video|libav
15-playlist|audio/x-mpegurl;audio/mpegurl;audio/x-scpls;audio/x-pn-realaudio;application/ram;application/vnd.ms-wpl|nmm:Playlist;nfo:MediaList|Audio|playlist
15-text|text/plain;text/markdown|nfo:Document;nfo:PlainTextDocument|Documents|text
90-disc-generic|application/x-cue|nfo:Software|Software|disc-generic
90-libav-audio-generic|audio/*|nmm:MusicPiece;nfo:Audio|Audio|libav
90-libav-video-generic|video/*|nmm:Video|Video|libav
"""


def shipped_rules(spark: SparkSession, sound: str = "libav") -> DataFrame:
    """The shipped rules; the hash of a rule is made of its content.

    sound: which of two alternative modules reads sound and video, "libav" or "mediainfo"; their rules differ in no more.
    """
    import hashlib

    if sound not in ("libav", "mediainfo"):
        raise ValueError(f"no module {sound}")
    rows = []
    for n, line in enumerate(SHIPPED.replace("libav-", f"{'lib' if sound == 'mediainfo' else ''}{sound}-").replace("|libav", f"|{sound}").split()):
        name, allow, types, graph, module = line.split("|")
        rows.append((n, name, allow.split(";"), [], types.split(";"), f"tracker:{graph}" if graph else None, hashlib.md5(line.encode()).hexdigest()[:12] if graph else None, module or None))
    return spark.createDataFrame(rows, SCHEMA)


def parse_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules from the key files of a folder on the driver, in the order of their names."""
    return parse_texts(spark, {p.name: p.read_text(encoding="utf-8") for p in Path(folder).glob("*.rule")})


def parse_texts(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Rules from the texts of key files, in the order of their names."""
    rows = []
    for n, (name, text) in enumerate(sorted(files.items())):
        p = configparser.ConfigParser(interpolation=None, strict=False)
        p.read_string(text)
        s = p["ExtractorRule"] if p.has_section("ExtractorRule") else {}
        many = lambda k, s=s: [x for x in s.get(k, "").split(";") if x]
        rows.append((n, name, many("MimeTypes"), many("BlockMimeTypes"), many("FallbackRdfTypes"), s.get("Graph"), s.get("Hash"), s.get("ModulePath")))
    return spark.createDataFrame(rows, SCHEMA)


def _as_regex(glob: Column) -> Column:
    """An anchored regular expression for a column of globs."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}\[\]|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def match_rules(mimes: DataFrame, rules: DataFrame, most_rules: int = 10_000) -> DataFrame:
    """(mime_type, module, graph, hash, rdf_types, rules) of every distinct MIME type.

    A rule holds if a pattern of its list matches and none of its block list does. Each attribute comes from the first
    rule, in order, that defines it. Patterns without a wildcard meet in an equi join; only the few with one are tried on
    every distinct MIME type. The rules are a configuration of at most ``most_rules`` patterns, which is checked.
    """
    kinds = mimes.select("mime_type").where("mime_type is not null").distinct()
    each = rules.select("ord", F.explode("allow").alias("glob"))
    wild = each.where(F.col("glob").rlike(r"[*?]"))
    patterns = [(r.ord, glob_regex(r.glob)) for r in wild.limit(most_rules + 1).collect()]
    if len(patterns) > most_rules:
        raise ValueError(f"more than {most_rules} patterns")
    hit = kinds.join(each.withColumnRenamed("glob", "mime_type"), "mime_type").select("mime_type", "ord")
    if patterns:
        tried = F.filter(F.array(*[F.when(F.col("mime_type").rlike(p), F.lit(o)) for o, p in patterns]), lambda x: x.isNotNull())
        hit = hit.unionByName(kinds.select("mime_type", F.explode(tried).alias("ord")))
    full = hit.distinct().join(rules, "ord")
    blocked = F.exists("block", lambda b: F.regexp_like(F.col("mime_type"), _as_regex(b)))
    full = full.where(~F.coalesce(blocked, F.lit(False)))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)
    got = full.groupBy("mime_type").agg(first("module"), first("graph"), first("hash"), F.min_by("rdf_types", F.when(F.size("rdf_types") > 0, F.col("ord"))).alias("rdf_types"), F.count(F.lit(1)).alias("rules"))
    return kinds.join(got, "mime_type", "left").withColumn("rules", F.coalesce("rules", F.lit(0)))
