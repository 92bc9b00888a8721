"""Deterministic identifiers of shared entities: equal names give equal identifiers, so entities merge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def escape(x: Column) -> Column:
    """RFC 3986 escapes: url_encode without its plus signs and without escaping of unreserved marks."""
    e = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    e = F.replace(e, F.lit("*"), F.lit("%2A"))
    return F.replace(e, F.lit("%7E"), F.lit("~"))


def artist(name: Column) -> Column:
    return F.concat(F.lit("urn:artist:"), escape(name))


def contact(name: Column) -> Column:
    return F.concat(F.lit("urn:contact:"), escape(name))


def tag(label: Column) -> Column:
    return F.concat(F.lit("urn:tag:"), escape(label))


def tv_series(name: Column) -> Column:
    return F.concat(F.lit("urn:tv-series:"), escape(name))


def tv_season(name: Column, season: Column) -> Column:
    return F.concat(F.lit("urn:tv-season:"), escape(F.concat(name, F.lit("-S"), F.lpad(season.cast("string"), 2, " "))))


def equipment(make: Column, model: Column) -> Column:
    return F.concat(F.lit("urn:equipment:"), escape(F.coalesce(make, F.lit(""))), F.lit(":"), escape(F.coalesce(model, F.lit(""))), F.lit(":"))


def album(title: Column, album_artist: Column, date: Column) -> Column:
    """Title, then the album artist and the first ten characters of the date where there are any."""
    return F.concat_ws(":", F.lit("urn:album"), escape(title), escape(album_artist), F.left(date, F.lit(10)))


def album_disc(album_urn: Column, number: Column) -> Column:
    """The disc of an album; numbers below 1 count as 1."""
    return F.concat(F.regexp_replace(album_urn, "^urn:album:", "urn:album-disc:"), F.lit(":Disc"), F.greatest(F.coalesce(number, F.lit(1)), F.lit(1)).cast("string"))


def external_reference(source: Column, identifier: Column) -> Column:
    return F.concat(F.lit("urn:ExternalReference:"), source, F.lit(":"), identifier)


def content_id(identifier: Column, suffix: Column) -> Column:
    """The identifier of a part of a file."""
    return F.when(suffix.isNull(), identifier).otherwise(F.concat(identifier, F.lit("/"), suffix))


def child_id(parent: Column, ordinal: Column) -> Column:
    """A stable identifier for a nested entity, so that repeated runs agree."""
    return F.concat(F.lit("urn:child:"), F.sha2(F.concat_ws("\n", parent, ordinal.cast("string")), 256))
