"""Joins on path prefixes, as equi joins on exploded ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_below(path: Column, base: Column) -> Column:
    """True where path lies strictly below base; slash-safe, so a/bc is not below a/b."""
    return F.startswith(path, F.concat(F.rtrim(F.lit("/"), base), F.lit("/")))


def ancestors(url: Column, itself: bool = True) -> Column:
    """All ancestors of a url from the top down, the url itself last. The scheme and authority count as one step."""
    head = F.regexp_extract(url, r"^([a-zA-Z][\w+.-]*://[^/]*)?", 0)
    rest = F.substring(url, F.length(head) + 1, F.length(url))
    steps = F.filter(F.split(rest, "/"), lambda x: x != "")
    n = F.size(steps) - (0 if itself else 1)
    path = lambda i: F.concat(head, F.lit("/"), F.array_join(F.slice(steps, 1, i), "/"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), path)).otherwise(F.array().cast("array<string>"))


def climb(df: DataFrame, url: str, bases: DataFrame, base_url: str, itself: bool = True) -> DataFrame:
    """df with a row for each ancestor of a url (_a, at depth _d) that is as deep as some base.

    The depths of the bases are found by one small aggregation. Steps above and below them are never made, so the top
    directories that all urls share don't become hot keys of the join that follows.
    """
    depth = F.size(ancestors(F.col(base_url)))
    range_ = bases.where(F.col(base_url).isNotNull()).agg(F.struct(F.min(depth).alias("lo"), F.max(depth).alias("hi")))
    d = df.withColumn("_r", range_.scalar())
    lo = F.greatest(F.col("_r.lo"), F.lit(1))
    some = F.when(F.col("_r.lo").isNotNull(), F.slice(ancestors(F.col(url), itself), lo, F.greatest(F.col("_r.hi") - lo + 1, F.lit(0))))
    return d.select(*df.columns, lo.alias("_lo"), F.posexplode(some).alias("_d", "_a")).select(*df.columns, (F.col("_d") + F.col("_lo")).alias("_d"), "_a")


def deepest_prefix(df: DataFrame, url: str, bases: DataFrame, base_url: str, carry: list[str], itself: bool = True) -> DataFrame:
    """df with the columns ``carry`` of the longest base that is the url or an ancestor of it; NULL where there is none.

    Only distinct urls are exploded into their ancestors and joined; the longest match is found by one aggregation, and
    the result is joined back by url.
    """
    urls = df.select(F.col(url).alias("_u")).where("_u is not null").distinct()
    steps = climb(urls, "_u", bases, base_url, itself).select("_u", "_a")
    hit = steps.join(bases.select(F.col(base_url).alias("_a"), *[F.col(c).alias(f"_c_{c}") for c in carry]).distinct(), "_a")
    best = hit.groupBy("_u").agg(F.max_by(F.struct(*[f"_c_{c}" for c in carry]), F.length("_a")).alias("_b"))
    names = [c for c in df.columns if c not in carry]
    return df.select(*names).join(best, F.col(url) == F.col("_u"), "left").select(*names, *[F.col("_b")[f"_c_{c}"].alias(c) for c in carry])


def without_descendants(df: DataFrame, url: str, bases: DataFrame, base_url: str) -> DataFrame:
    """Rows that lie below none of the bases."""
    b = bases.select(F.col(base_url).alias("_a")).where("_a is not null").distinct()
    bad = climb(df.select(F.col(url).alias("_u")).distinct(), "_u", b, "_a", False).join(b, "_a", "left_semi").select("_u").distinct()
    return df.join(bad, F.col(url) == F.col("_u"), "left_anti")
