"""Error reports: one a file, keyed by the MD5 of its uri."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "uri_md5 string, uri string, message string, sparql string"


def save(reports: DataFrame, new: DataFrame) -> DataFrame:
    """The new report of a file replaces its old one. new(uri, message, sparql)."""
    fresh = new.select(F.md5("uri").alias("uri_md5"), "uri", "message", "sparql").dropDuplicates(["uri_md5"])
    return reports.join(fresh.select("uri_md5"), "uri_md5", "left_anti").select("uri_md5", "uri", "message", "sparql").unionByName(fresh)


def forget(reports: DataFrame, reindexed: DataFrame) -> DataFrame:
    """Reports of files that are indexed again are dropped. reindexed(uri)."""
    return reports.join(reindexed.select(F.md5("uri").alias("uri_md5")).distinct(), "uri_md5", "left_anti")


def current(reports: DataFrame, files: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Reports of files that still exist; with terms, those whose uri or path holds one. files(url)."""
    seen = reports.join(files.select(F.col("url").alias("uri")).distinct(), "uri", "left_semi")
    if not terms:
        return seen
    path = F.url_decode(F.regexp_replace("uri", "^file://", ""))
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.contains("uri", F.lit(t)) | F.contains(path, F.lit(t))
    return seen.where(hit)
