"""Enumerations, coordinates, profiles and genres of media files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the closed sets.
ORIENTATION = dict(enumerate("top top-mirror bottom bottom-mirror left-mirror right right-mirror left".split(), 1))
METERING = {1: "average", 2: "center-weighted-average", 3: "spot", 4: "multispot", 5: "pattern", 6: "partial"}
DLNA_JPEG = ((640, 480, "JPEG_SM"), (1024, 768, "JPEG_MED"), (4096, 4096, "JPEG_LRG"))
REGION = (("face", "nfo:roi-content-face"), ("pet", "nfo:roi-content-pet"), ("focus", "nfo:roi-content-focus"), ("barcode", "nfo:roi-content-barcode"))


def _named(prefix: str, names: dict[int, str], code: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, f"{prefix}{v}")]), code)


def orientation(code: Column) -> Column:
    """EXIF and XMP orientation 1 to 8; anything else is top."""
    return F.coalesce(_named("nfo:orientation-", ORIENTATION, code.cast("int")), F.lit("nfo:orientation-top"))


def metering(code: Column) -> Column:
    return F.coalesce(_named("nmm:metering-mode-", METERING, code.cast("int")), F.lit("nmm:metering-mode-other"))


def flash(code: Column) -> Column:
    """The lowest bit tells whether the flash fired."""
    return F.when(code.cast("int").bitwiseAND(1) == 1, "nmm:flash-on").otherwise("nmm:flash-off")


def white_balance(code: Column) -> Column:
    return F.when(code.cast("string") == "1", "nmm:white-balance-manual").otherwise("nmm:white-balance-auto")


def iptc_orientation(code: Column) -> Column:
    return F.when(code == "P", "nfo:orientation-left").otherwise("nfo:orientation-top")


def region_type(name: Column) -> Column:
    """The kind of an image region by the beginning of its name, in any letter case; no name has a kind of its own."""
    out = F.lit("nfo:roi-content-undefined")
    for word, kind in reversed(REGION):
        out = F.when(F.startswith(F.lower(name), F.lit(word)), kind).otherwise(out)
    return F.when(name.isNull(), "nfo:region-content-undefined").otherwise(out)


def ratio(text: Column) -> Column:
    """a/b as a number, NULL for b = 0; plain numbers as they are."""
    return F.when(text.contains("/"), F.try_divide(_number(text, 1), _number(text, 2))).otherwise(F.nullif(F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)\s*$", 1), F.lit("")).try_cast("double"))


def _number(text: Column, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, r"^\s*(-?\d+(?:\.\d+)?)\s*/\s*(-?\d+(?:\.\d+)?)\s*$", group), F.lit("")).try_cast("double")


def gps_coordinate(text: Column) -> Column:
    """deg,min.mmR or deg,min,secR as signed degrees; S and W are negative."""
    p = r"^\s*(\d+),(\d+(?:\.\d+)?)(?:,(\d+(?:\.\d+)?))?\s*([NSEW])\s*$"
    g = lambda n: F.coalesce(F.nullif(F.regexp_extract(text, p, n), F.lit("")).try_cast("double"), F.lit(0.0))
    value = g(1) + g(2) / 60 + g(3) / 3600
    ref = F.regexp_extract(text, p, 4)
    return F.when(ref != "", F.when(ref.isin("S", "W"), -value).otherwise(value))


def png_profile(width: Column, height: Column, depth: Column) -> Column:
    return (
        F.when((width == 120) & (height == 120), "PNG_LRG_ICO")
        .when((width == 48) & (height == 48), "PNG_SM_ICO")
        .when((width <= 160) & (height <= 160), "PNG_TN")
        .when((depth <= 32) & (width <= 4096) & (height <= 4096), "PNG_LRG")
    )


def jpeg_profile(width: Column, height: Column) -> Column:
    out = F.lit(None).cast("string")
    for w, h, name in reversed(DLNA_JPEG):
        out = F.when((width <= w) & (height <= h), name).otherwise(out)
    return out


def mp3_profile(version: Column, layer: Column, bitrate: Column, rate: Column, channels: Column) -> Column:
    """version: 1 or 2; bitrate in kbit/s; rate in Hz."""
    ok = (layer == 3) & channels.between(1, 2)
    one, two = rate.isin(44100, 48000, 32000), rate.isin(22050, 24000, 16000)
    return F.when(ok & (version == 1) & bitrate.between(32, 320) & one, "MP3").when(ok & bitrate.between(8, 320) & (one | two), "MP3X")


def genre_number(text: Column) -> Column:
    """The number of "(n)", else of trailing digits; NULL if there is none."""
    inner = F.nullif(F.regexp_extract(text, r"^\((\d+)\)", 1), F.lit(""))
    return F.coalesce(inner, F.nullif(F.regexp_extract(text, r"(\d+)$", 1), F.lit(""))).try_cast("int")


def track_of(text: Column) -> Column:
    """(n, total) of "n/total"."""
    p = r"^\s*(\d+)\s*(?:/\s*(\d+))?"
    g = lambda n: F.nullif(F.regexp_extract(text, p, n), F.lit("")).try_cast("int")
    return F.struct(g(1).alias("n"), g(2).alias("total"))
