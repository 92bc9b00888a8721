"""What may be indexed."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.operators.prefix import climb, deepest_prefix

# Locations that are never roots.
NEVER_ROOTS = ("/dev", "/lib", "/proc", "/sys", "/tmp")


@dataclass(frozen=True)
class Filters:
    """Globs on base names. parent_directory names exclude the folder that holds them."""

    file: tuple[str, ...] = ("*~", "*.o", "*.la", "*.lo", "*.tmp", "*.part")
    directory: tuple[str, ...] = ("lost+found", "core-dumps", "CVS")
    parent_directory: tuple[str, ...] = (".trackerignore", ".git", ".nomedia")
    text_allowed: tuple[str, ...] = field(default=("*.txt", "*.md", "*.mdwn"))

    def __post_init__(self) -> None:
        for g in (*self.file, *self.directory, *self.parent_directory):
            if g.startswith("/"):
                raise ValueError(f"absolute paths are no filters: {g}")
        if any("*" in g for g in self.parent_directory):
            raise ValueError("a parent directory filter names one file")


def glob_regex(glob: str) -> str:
    """An anchored regular expression for a glob."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def matches_any(name: Column, globs: tuple[str, ...]) -> Column:
    """True where the name matches one of the globs: one alternation, one pass."""
    return name.rlike("|".join(glob_regex(g) for g in globs)) if globs else F.lit(False)


def base_name(url: Column) -> Column:
    return F.regexp_extract(url, r"[^/]*$", 0)


def usable_roots(roots: DataFrame, url: str = "url") -> DataFrame:
    path = F.regexp_replace(url, r"^file://", "")
    bad = F.lit(False)
    for x in NEVER_ROOTS:
        bad = bad | (path == x) | F.startswith(path, F.lit(f"{x}/"))
    return roots.where(~bad)


def eligible(objects: DataFrame, roots: DataFrame, filters: Filters = Filters()) -> DataFrame:  # noqa: B008
    """objects(url, is_dir, is_hidden) with root, reason and indexable.

    The deepest root above counts. A root itself is always eligible; others must match no filter of their kind, be direct
    children where the root isn't recursive, and not be hidden. A folder that holds a named file is out as a whole.
    """
    found = deepest_prefix(objects, "url", usable_roots(roots).select(F.col("url").alias("root"), "recurse"), "root", ["root", "recurse"])
    name, parent = base_name(F.col("url")), F.regexp_replace("url", r"/[^/]*$", "")
    marked = objects.where(base_name(F.col("url")).isin(*filters.parent_directory)).select(F.regexp_replace("url", r"/[^/]*$", "").alias("_folder"), F.lit(True).alias("_marked")).distinct()
    joined = found.withColumn("_folder", F.when(F.col("is_dir"), F.col("url")).otherwise(parent)).join(marked, "_folder", "left")
    reason = (
        F.when(F.col("root").isNull(), "no root")
        .when(F.col("url") == F.col("root"), F.lit(None))
        .when(~F.col("is_dir") & matches_any(name, filters.file), "filter")
        .when(F.col("is_dir") & matches_any(name, filters.directory), "filter")
        .when(F.col("_marked"), "content")
        .when(~F.col("recurse") & (parent != F.col("root")), "not recursive")
        .when(F.coalesce(F.col("is_hidden"), F.lit(False)), "hidden")
    )
    return joined.select(*objects.columns, "root", reason.alias("reason")).withColumn("indexable", F.col("reason").isNull())


def eligible_paths(objects: DataFrame, roots: DataFrame, filters: Filters = Filters()) -> DataFrame:  # noqa: B008
    """Eligibility of the whole path: the first reason from the root down wins."""
    own = eligible(objects, roots, filters).select("url", "root", "reason")
    bad = own.where("reason is not null and reason <> 'no root'").select(F.col("url").alias("_a"), F.col("reason").alias("_r"))
    up = climb(own.select("url"), "url", bad, "_a")
    worst = up.join(bad, "_a").groupBy("url").agg(F.min_by("_r", "_d").alias("first_reason"))
    out = own.join(worst, "url", "left").select("url", "root", F.coalesce("first_reason", "reason").alias("reason"))
    return out.withColumn("indexable", F.col("reason").isNull())


def shallow_text(name: Column, mime: Column, filters: Filters = Filters()) -> Column:  # noqa: B008
    """True for text files outside the allow list: catalogued but never extracted."""
    return (F.startswith(mime, F.lit("text/"))) & ~matches_any(name, filters.text_allowed)


def without_nested(paths: DataFrame, column: str = "path") -> DataFrame:
    """Paths that lie below no other path of the table; ends without a slash."""
    p = paths.select(F.regexp_replace(column, r"(?<=.)/+$", "").alias("path")).distinct()
    up = climb(p, "path", p, "path", False)
    nested = up.join(p.select(F.col("path").alias("_a")), "_a", "left_semi").select("path").distinct()
    return p.join(nested, "path", "left_anti")
