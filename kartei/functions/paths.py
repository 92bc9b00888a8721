"""Paths and urls."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_in_path(path: Column, base: Column) -> Column:
    """True for the base itself and what lies below it; slash-safe."""
    bare = F.regexp_replace(base, r"(?<=.)/+$", "")
    return (F.regexp_replace(path, r"(?<=.)/+$", "") == bare) | F.startswith(path, F.concat(bare, F.lit("/")))


def relative_to(uri: Column, base: Column) -> Column:
    """The part of a uri below a base; NULL for siblings and the base's own prefix."""
    root = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(uri, root), F.substring(uri, F.length(root) + 1, F.length(uri)))


def resolve_relative(relative: Column, base: Column) -> Column:
    """file:name below a base as a full uri; other uris as they are."""
    return F.when(relative.rlike(r"^file:[^/]"), F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.substring(relative, 6, 1 << 30))).otherwise(relative)


def is_relative(uri: Column) -> Column:
    return uri.rlike(r"^file:[^/]")


def object_path(text: Column) -> Column:
    """Every byte that is no ASCII letter or digit as _ and its hexadecimal value."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    pairs = F.filter(F.split(F.regexp_replace(hexed, "(..)", "$1 "), " "), lambda h: h != "")
    one = lambda h: F.when(h.rlike("^(3[0-9]|4[1-9A-F]|5[0-9A]|6[1-9A-F]|7[0-9A])$"), F.decode(F.unhex(h), "UTF-8")).otherwise(F.concat(F.lit("_"), F.lower(F.regexp_replace(h, "^0(?=.)", ""))))
    return F.array_join(F.transform(pairs, one), "")


def evaluate_name(name: str, aliases: dict[str, str] | None = None) -> str | None:
    """A configured path with ~, $VAR, ${VAR} and &ALIAS replaced, on the driver; None if it can't be."""
    if not name:
        return None
    if name.startswith("&"):
        return (aliases or {}).get(name)
    if name.startswith("~"):
        name = os.path.expanduser(name)
    if "/" not in name and not name.startswith("$"):
        return None
    missing = False

    def value(m: re.Match) -> str:
        nonlocal missing
        got = os.environ.get(m.group(1) or m.group(2))
        missing |= got is None
        return got or ""

    out = re.sub(r"\$(?:\{(\w+)\}|(\w+))", value, name)
    if missing:
        return None
    return out.rstrip("/") or "/"


def compress_uri(uri: Column, prefixes: dict[str, str]) -> Column:
    """A uri with the longest namespace of a table as its prefix."""
    out = uri
    for p, ns in sorted(prefixes.items(), key=lambda kv: len(kv[1])):
        out = F.when(F.startswith(uri, F.lit(ns)), F.concat(F.lit(f"{p}:"), F.substring(uri, len(ns) + 1, 1 << 30))).otherwise(out)
    return out


def expand_uri(name: Column, prefixes: dict[str, str]) -> Column:
    """The full uri of a prefixed name; others as they are."""
    out = name
    for p, ns in prefixes.items():
        out = F.when(F.startswith(name, F.lit(f"{p}:")), F.concat(F.lit(ns), F.substring(name, len(p) + 2, 1 << 30))).otherwise(out)
    return out


# Namespaces of the public ontologies.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "nao": "http://www.semanticdesktop.org/ontologies/2007/08/15/nao#",
    "nie": "http://www.semanticdesktop.org/ontologies/2007/01/19/nie#",
    "nfo": "http://www.semanticdesktop.org/ontologies/2007/03/22/nfo#",
    "nco": "http://www.semanticdesktop.org/ontologies/2007/03/22/nco#",
}
