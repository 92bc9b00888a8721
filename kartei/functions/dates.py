"""Dates: formatting, parsing and guessing. Offsets are kept in the ISO text, which a timestamp column can't."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_iso8601(ts: Column, offset_minutes: Column | int = 0) -> Column:
    """A timestamp as ISO 8601 text: Z for UTC, else +hh:mm; microseconds only if there are any. Session zone: UTC."""
    off = F.lit(offset_minutes) if isinstance(offset_minutes, int) else offset_minutes
    local = F.timestamp_seconds(F.unix_micros(ts) / F.lit(1e6)) + F.make_dt_interval(F.lit(0), F.lit(0), off, F.lit(0))
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    zone = F.when(off == 0, "Z").otherwise(F.concat(F.when(off < 0, "-").otherwise("+"), F.lpad((F.abs(off) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(off) % 60).cast("string"), 2, "0")))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), zone)


def _zone_suffix(local_iso: Column, zone: str) -> Column:
    """The offset that a zone has at a local time, as +hh:mm."""
    at = F.try_to_timestamp(local_iso, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    seconds = F.unix_seconds(at) - F.unix_seconds(F.to_utc_timestamp(at, zone))
    return F.concat(F.when(seconds < 0, "-").otherwise("+"), F.lpad((F.abs(seconds) / 3600).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad(((F.abs(seconds) % 3600) / 60).cast("int").cast("string"), 2, "0"))


_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
ISO = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"


def date_guess(text: Column, zone: str = "UTC") -> Column:
    """The ISO 8601 text meant by one of seven shapes, told apart by length; NULL if none fits.

    YYYY; YYYY-MM-DD; YYYYMMDDhhmmss with or without Z or an offset; "Mon Jun 14 04:20:20 2008"; EXIF "2008:06:14 04:20:20";
    else ISO itself. Times without a zone are local times of ``zone``.
    """
    return _let(F.trim(text), lambda t: F.when(F.length(t) < 4, F.lit(None)).when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01T00:00:00Z"))).otherwise(_let(_as_iso(t), lambda iso: _checked(iso, zone))))


COMPACT = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:\d{2})?Z?$"
NAMED = r"^\w{3} (\w{3}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, wherever the body uses it: keeps generated code short."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _as_iso(t: Column) -> Column:
    """The shapes of fixed length as ISO; anything else as it is."""
    n = F.length(t)
    month = F.lpad(((F.instr(F.lit("".join(_MONTHS)), F.regexp_extract(t, NAMED, 1)) + 2) / 3).cast("int").cast("string"), 2, "0")
    named = F.concat(F.regexp_extract(t, NAMED, 4), F.lit("-"), month, F.lit("-"), F.lpad(F.regexp_extract(t, NAMED, 2), 2, "0"), F.lit("T"), F.regexp_extract(t, NAMED, 3))
    return (
        F.when(n == 10, F.regexp_replace(t, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00"))
        .when(F.substring(t, 1, 14).rlike(r"^\d{14}$"), F.regexp_replace(t, COMPACT, "$1-$2-$3T$4:$5:$6$7"))
        .when(F.substring(t, 4, 1) == " ", F.when(t.rlike(NAMED) & F.regexp_extract(t, NAMED, 1).isin(*_MONTHS), named))
        .when(n == 19, F.regexp_replace(t, r"^(\d{4}):(\d{2}):(\d{2}) (\d{2}:\d{2}:\d{2})$", "$1-$2-$3T$4"))
        .otherwise(t)
    )


def _checked(iso: Column, zone: str) -> Column:
    """ISO text with its fraction at six digits and, where it has none, the offset of the zone; NULL if it is no time."""
    base, fraction, end = F.left(iso, F.lit(19)), F.regexp_extract(iso, ISO, 3), F.regexp_extract(iso, ISO, 4)
    good = iso.rlike(ISO) & F.try_to_timestamp(base, F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    return F.when(good, F.concat(base, F.when(fraction != "", F.rpad(F.left(fraction, F.lit(7)), 7, "0")).otherwise(""), F.when(end == "", _zone_suffix(base, zone)).otherwise(end)))


def parse_with(text: Column, pattern: str, zone: str = "UTC") -> Column:
    """Text in one pattern as ISO 8601 local to a zone; NULL where it doesn't fit."""
    at = F.date_format(F.try_to_timestamp(text, F.lit(pattern)), "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(at.isNotNull(), F.concat(at, _zone_suffix(at, zone)))


def seconds_estimate(elapsed: Column, done: Column, remaining: Column) -> Column:
    """Seconds left at the pace so far; 0 if anything isn't positive."""
    return F.when((elapsed > 0) & (done > 0) & (remaining > 0), F.floor(elapsed / done * remaining)).otherwise(F.lit(0)).cast("long")


def seconds_to_string(seconds: Column, short: bool = True) -> Column:
    """A duration in words."""
    s = F.floor(seconds).cast("long")
    parts = [(s / 86400).cast("int"), (s / 3600 % 24).cast("int"), (s / 60 % 60).cast("int"), (s % 60).cast("int")]
    if short:
        named = [F.concat(p.cast("string") if i == 0 else F.lpad(p.cast("string"), 2, "0"), F.lit(u)) for i, (p, u) in enumerate(zip(parts, "dhms", strict=True))]
    else:
        named = [F.concat(p.cast("string") if i == 0 else F.lpad(p.cast("string"), 2, "0"), F.lit(f" {u}"), F.when(p == 1, "").otherwise("s")) for i, (p, u) in enumerate(zip(parts, ("day", "hour", "minute", "second"), strict=True))]
    text = F.array_join(F.array_compact(F.array(*[F.when(p > 0, x) for p, x in zip(parts, named, strict=True)])), " ")
    return F.when(text == "", "less than one second").otherwise(text)
