"""Mutations as pure functions from a catalogue to a catalogue.

Plain Parquet has no row-level delete, so each statement is an anti join or a column rewrite; the result is written as a
new snapshot (kartei.operators.snapshot). Conditions on one url or prefix reach the scan as filters.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kartei.catalog import FILE_SYSTEM, Catalog


def below(url: Column, base: str) -> Column:
    """True for what lies below the base, not for the base; a/bc is not below a/b."""
    return F.startswith(url, F.lit(base.rstrip("/") + "/"))


def _stored_in(test) -> Column:
    return F.coalesce(F.exists("stored_as", test), F.lit(False))


def delete_file(c: Catalog, uri: str) -> Catalog:
    """The file in all graphs, and what is stored in it."""
    return replace(c, files=c.files.where(F.col("url") != uri), ies=c.ies.where(~_stored_in(lambda u: u == uri)))


def delete_folder_contents(c: Catalog, uri: str) -> Catalog:
    """All files below the folder, not the folder."""
    return replace(c, files=c.files.where(~below(F.col("url"), uri)), ies=c.ies.where(~_stored_in(lambda u: below(u, uri))))


def delete_file_content(c: Catalog, uri: str) -> Catalog:
    """The interpretations of a file; its hash is cleared so that it is extracted again."""
    of_file = (F.col("url") == uri) & (F.col("graph") == FILE_SYSTEM)
    files = c.files.withColumn("extractor_hash", F.when(~F.coalesce(of_file, F.lit(False)), F.col("extractor_hash")))
    return replace(c, files=files, ies=c.ies.where(~_stored_in(lambda u: u == uri)))


def delete_index_root(c: Catalog, root_url: str) -> Catalog:
    """The files of a data source, what is stored in them, and the source."""
    gone = c.roots.where(F.col("url") == root_url).select("urn").distinct()
    files = c.files.join(gone, F.col("data_source") == gone["urn"], "left_anti")
    urls = c.files.where(F.col("graph") == FILE_SYSTEM).join(gone, F.col("data_source") == gone["urn"], "left_semi").select("url").distinct()
    hit = c.ies.select("graph", "urn", F.explode("stored_as").alias("url")).join(urls, "url", "left_semi").select("graph", "urn").distinct()
    return replace(c, files=files, ies=c.ies.join(hit, ["graph", "urn"], "left_anti"), roots=c.roots.where(F.col("url") != root_url))


def move_file(c: Catalog, source: str, dest: str, data_source: str | None = None) -> Catalog:
    """A file under another url: name, url, container and source change, the rest is kept; content copies have no container."""
    name, parent = dest.rsplit("/", 1)[1], dest.rsplit("/", 1)[0]
    hit, fs = F.col("url") == source, F.col("graph") == FILE_SYSTEM
    container = c.folders.where(F.col("url") == parent).agg(F.max("urn"))
    files = c.files.withColumn("_container", container.scalar())
    files = files.withColumn("file_name", F.when(hit, F.lit(name)).otherwise(F.col("file_name"))).withColumn("container_urn", F.when(hit, F.when(fs, F.col("_container"))).otherwise(F.col("container_urn")))
    if data_source is not None:
        files = files.withColumn("data_source", F.when(hit, F.lit(data_source)).otherwise(F.col("data_source")))
    files = files.withColumn("extractor_hash", F.when(~(hit & ~fs), F.col("extractor_hash"))).withColumn("url", F.when(hit, F.lit(dest)).otherwise(F.col("url"))).drop("_container")
    ies = c.ies.withColumn("stored_as", F.transform("stored_as", lambda u: F.when(u == source, F.lit(dest)).otherwise(u)))
    return replace(c, files=files, ies=ies)


def move_folder_contents(c: Catalog, source: str, dest: str) -> Catalog:
    """New urls for all below a folder; containers are kept."""
    moved = lambda u: F.when(below(u, source), F.concat(F.lit(dest.rstrip("/") + "/"), F.substring(u, len(source.rstrip("/")) + 2, 1 << 30))).otherwise(u)
    return replace(c, files=c.files.withColumn("url", moved(F.col("url"))), ies=c.ies.withColumn("stored_as", F.transform("stored_as", moved)))


def orphan_discs(c: Catalog, discs: DataFrame) -> DataFrame:
    """discs(disc, album) that still have a song."""
    used = c.ies.select(F.col("album_disc").alias("disc")).where("disc is not null").distinct()
    return discs.join(used, "disc", "left_semi")


def orphan_albums(c: Catalog, albums: DataFrame, discs: DataFrame) -> DataFrame:
    """albums(album) that still have a disc or a song; runs after orphan_discs."""
    used = c.ies.select("album").union(discs.select("album")).where("album is not null").distinct()
    return albums.join(used, "album", "left_semi")


def orphan_artists(c: Catalog, more_roles: list[DataFrame] | None = None) -> Catalog:
    """Artists that still have a role: all roles in one union and one semi join. more_roles: one-column tables."""
    roles = F.concat(F.array("artist", "composer", "lyricist"), F.coalesce("performers", F.array().cast("array<string>")))
    used = c.ies.select(F.explode(roles).alias("urn"))
    for df in more_roles or []:
        used = used.union(df)
    return replace(c, artists=c.artists.join(used.where("urn is not null").distinct(), "urn", "left_semi"))


def set_available(c: Catalog, mount_point: str, mounted: bool) -> Catalog:
    return replace(c, roots=c.roots.withColumn("available", F.when(F.col("url") == mount_point, F.lit(mounted)).otherwise(F.col("available"))))


def mount(c: Catalog, volumes: DataFrame) -> Catalog:
    """volumes(urn, url) that have appeared: known roots become available, others are added as removable ones."""
    v = volumes.groupBy("url").agg(F.min("urn").alias("_urn"))
    known = c.roots.join(v.select("url", F.lit(True).alias("_up")), "url", "left").withColumn("available", F.coalesce("_up", "available")).select(*c.roots.columns)
    new = v.join(c.roots.select("url").distinct(), "url", "left_anti").select(F.col("_urn").alias("urn"), "url", F.lit(True).alias("available"), F.lit(True).alias("is_removable"), F.lit(True).alias("recurse"), F.lit(False).alias("preserve"))
    return replace(c, roots=known.unionByName(new))


def unmount(c: Catalog, volumes: DataFrame, keep: bool = True) -> Catalog:
    """volumes(url) that have gone: their removable roots are no longer available, or are forgotten with all their files."""
    gone = c.roots.where(F.col("is_removable")).join(volumes.select("url").distinct(), "url", "left_semi").select(F.col("urn").alias("_urn")).distinct()
    if keep:
        roots = c.roots.join(gone.withColumn("_down", F.lit(True)), F.col("urn") == F.col("_urn"), "left")
        return replace(c, roots=roots.withColumn("available", F.when(F.col("_down"), F.lit(False)).otherwise(F.col("available"))).select(*c.roots.columns))
    files = c.files.join(gone, F.col("data_source") == F.col("_urn"), "left_anti")
    return replace(c, roots=c.roots.join(gone, F.col("urn") == F.col("_urn"), "left_anti"), files=files)


def update_hashes(c: Catalog, hashes: DataFrame) -> Catalog:
    """hashes(url, hash): mark files as extracted."""
    new = hashes.select("url", F.col("hash").alias("_hash")).dropDuplicates(["url"]).withColumn("graph", F.lit(FILE_SYSTEM))
    files = c.files.join(new, ["graph", "url"], "left").withColumn("extractor_hash", F.coalesce("_hash", "extractor_hash")).select(*c.files.columns)
    return replace(c, files=files)


def drop_content_copies(c: Catalog, uri: str) -> Catalog:
    """A file in content graphs only, with what it is interpreted as there."""
    gone = c.files.where((F.col("url") == uri) & (F.col("graph") != FILE_SYSTEM)).select("graph", F.explode("interpreted_as").alias("urn")).distinct()
    return replace(c, files=c.files.where((F.col("url") != uri) | (F.col("graph") == FILE_SYSTEM)), ies=c.ies.join(gone, ["graph", "urn"], "left_anti"))


def insert_tags(c: Catalog, wanted: DataFrame) -> Catalog:
    """wanted(pref_label, description): tags whose label no resource has yet, with an identifier made of the label."""
    new = wanted.select("pref_label", "description").where("pref_label is not null").dropDuplicates(["pref_label"]).join(c.tags.select("pref_label"), "pref_label", "left_anti")
    urn = F.concat(F.lit("urn:tag:"), F.replace(F.url_encode("pref_label"), F.lit("+"), F.lit("%20")))
    return replace(c, tags=c.tags.unionByName(new.select(urn.alias("urn"), "pref_label", "description")))


def tag_files(c: Catalog, links: DataFrame) -> Catalog:
    """links(url, pref_label): the tags of that label on what is stored at that url."""
    named = links.join(c.tags.select(F.col("urn").alias("tag"), "pref_label"), "pref_label").select("url", "tag").distinct()
    per = c.ies.select("graph", "urn", F.explode("stored_as").alias("url")).join(named, "url").groupBy("graph", "urn").agg(F.collect_set("tag").alias("_new"))
    tags = F.when(F.col("_new").isNull(), F.col("tags")).otherwise(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), "_new"))
    return replace(c, ies=c.ies.join(per, ["graph", "urn"], "left").withColumn("tags", tags).select(*c.ies.columns))


def untag(c: Catalog, label: str, url: str | None = None, drop_tag: bool = False) -> Catalog:
    """Remove the tag of a label from what is stored at a url, or from everything; drop_tag removes the tag as well."""
    tag = c.tags.where(F.col("pref_label") == label).agg(F.coalesce(F.collect_set("urn"), F.array().cast("array<string>")))
    there = F.lit(True) if url is None else F.array_contains("stored_as", url)
    ies = c.ies.withColumn("_gone", tag.scalar()).withColumn("tags", F.when(there, F.array_except("tags", "_gone")).otherwise(F.col("tags"))).drop("_gone")
    return replace(c, ies=ies, tags=c.tags.where(F.col("pref_label") != label) if drop_tag else c.tags)


def reset_folder(c: Catalog, uri: str) -> Catalog:
    """The folder and all below it that has an interpretation, with the interpretations; files without one stay."""
    inside = lambda u: (u == uri) | below(u, uri)
    hit = c.ies.select(F.explode("stored_as").alias("url")).where(inside(F.col("url"))).distinct()
    return replace(c, files=c.files.join(hit, "url", "left_anti"), ies=c.ies.where(~_stored_in(inside)))


def upsert_files(c: Catalog, rows: DataFrame, attributes_only: bool = False) -> Catalog:
    """rows with the columns of files and a seq: the latest row of a key replaces the old one.

    For attribute updates only the times change.
    """
    key = ["graph", "url"]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*[x for x in c.files.columns if x not in key]), "seq").alias("n"))
    if attributes_only:
        j = c.files.join(last, key, "left")
        times = {x: F.coalesce(F.col(f"n.{x}"), F.col(x)) for x in ("mtime", "atime", "ctime")}
        return replace(c, files=j.withColumns(times).select(*c.files.columns))
    new = last.select(*key, "n.*").select(*c.files.columns)
    return replace(c, files=c.files.join(last.select(*key), key, "left_anti").unionByName(new))


def reconcile_roots(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """(url, action) when roots are set up: stored(url, is_removable), configured(url, is_volume)."""
    s = stored.select("url", F.coalesce("is_removable", F.lit(False)).alias("removable"), F.lit(True).alias("known")).dropDuplicates(["url"])
    k = configured.select("url", F.coalesce("is_volume", F.lit(False)).alias("volume"), F.lit(True).alias("asked")).dropDuplicates(["url"])
    action = (
        F.when(F.col("known") & F.col("asked") & F.col("removable"), "available")
        .when(F.col("known") & F.col("asked"), "keep")
        .when(F.col("known") & F.col("removable"), "unavailable")
        .when(F.col("known"), "delete")
        .when(F.col("volume"), "add available")
        .otherwise("add")
    )
    return s.join(k, "url", "full_outer").select("url", action.alias("action"))
