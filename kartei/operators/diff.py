"""Disk against catalogue: one full outer equi join and a case expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.operators.prefix import climb


def classify(disk: DataFrame, store: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, state) of every url on disk or in the catalogue.

    disk(url, mtime): what exists and may be indexed. store(url, mtime, mime_type, extractor_hash). rules(mime_type, hash):
    the extractor that holds now. States: CREATE, UPDATE, DELETE, EXTRACTOR_UPDATE, NONE.
    """
    d = disk.select("url", F.col("mtime").alias("d_mtime"), F.lit(True).alias("on_disk")).dropDuplicates(["url"])
    s = store.select("url", F.col("mtime").alias("s_mtime"), "mime_type", "extractor_hash", F.lit(True).alias("stored")).dropDuplicates(["url"])
    both = d.join(s, "url", "full_outer").join(rules.select("mime_type", F.col("hash").alias("now")).dropDuplicates(["mime_type"]), "mime_type", "left")
    state = (
        F.when(F.col("stored").isNull(), "CREATE")
        .when(F.col("on_disk").isNull(), "DELETE")
        .when(~F.equal_null("d_mtime", "s_mtime"), "UPDATE")
        .when(~F.equal_null("extractor_hash", "now"), "EXTRACTOR_UPDATE")
        .otherwise("NONE")
    )
    return both.select("url", state.alias("state"))


def suppress_below_deleted(states: DataFrame, directories: DataFrame) -> DataFrame:
    """States without those below a deleted directory: the deletion of the directory speaks for them.

    Ancestors are exploded for deleted urls only and met with deleted directories in an equi join.
    """
    gone = states.where("state = 'DELETE'").select("url")
    tops = gone.join(directories.select("url").distinct(), "url", "left_semi").select(F.col("url").alias("_a"))
    below = climb(gone, "url", tops, "_a", False).join(tops, "_a", "left_semi").select("url").distinct()
    return states.join(below, "url", "left_anti")


def finish_directories(states: DataFrame) -> DataFrame:
    """(folder, depth, changes): one finish event for every folder with changes, children before parents by depth."""
    changed = states.where("state <> 'NONE'")
    folder = F.regexp_replace("url", r"/[^/]*$", "")
    return changed.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("changes")).withColumn("depth", F.size(F.split("folder", "/")) - 3)
