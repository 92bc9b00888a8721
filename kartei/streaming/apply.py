"""Events applied to a catalogue, and the loop that extracts what is pending."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kartei.catalog import FILE_SYSTEM, Catalog
from kartei.extract.pipeline import run
from kartei.operators import mutations, snapshot
from kartei.operators.prefix import climb


#: Neighbouring sequence numbers worked on in one task.
CHUNK = 10_000


def delete_urls(c: Catalog, gone: DataFrame) -> Catalog:
    """gone(url): these files and folders, all below them, and what is stored there; one anti join a table."""
    roots = gone.select(F.col("url").alias("_a")).distinct()
    below = lambda df: climb(df.select("url").distinct(), "url", roots, "_a").join(roots, "_a", "left_semi").select("url").distinct()
    urls = below(c.files)
    stored = c.ies.select("graph", "urn", F.explode("stored_as").alias("url"))
    hit = stored.join(below(stored), "url", "left_semi").select("graph", "urn").distinct()
    folders = c.folders.join(below(c.folders), "url", "left_anti")
    return replace(c, files=c.files.join(urls, "url", "left_anti"), ies=c.ies.join(hit, ["graph", "urn"], "left_anti"), folders=folders)


def move_urls(c: Catalog, moves: DataFrame) -> Catalog:
    """moves(src, dest): files, and folders with all below them; the deepest move of a url counts."""
    m = moves.select(F.col("src").alias("_a"), "dest").groupBy("_a").agg(F.max("dest").alias("dest"))

    def renamed(urls: DataFrame) -> DataFrame:
        up = climb(urls, "url", m, "_a").join(m, "_a")
        best = up.groupBy("url").agg(F.max_by(F.struct("_a", "dest"), "_d").alias("b"))
        return best.select("url", F.concat(F.col("b.dest"), F.substring("url", F.length("b._a") + 1, F.length("url"))).alias("new"))

    f = renamed(c.files.select("url").distinct())
    files = c.files.join(f, "url", "left").withColumn("file_name", F.when(F.col("new").isNotNull(), F.regexp_extract("new", r"[^/]*$", 0)).otherwise(F.col("file_name"))).withColumn("url", F.coalesce("new", "url")).select(*c.files.columns)
    links = c.ies.select("graph", "urn", F.posexplode("stored_as").alias("_p", "url"))
    n = renamed(links.select("url").distinct())
    changed = links.join(n, "url").select("graph", "urn").distinct()
    again = links.join(changed, ["graph", "urn"], "left_semi").join(n, "url", "left").groupBy("graph", "urn").agg(F.transform(F.array_sort(F.collect_set(F.struct("_p", F.coalesce("new", "url").alias("u")))), lambda x: x.u).alias("_new"))
    ies = c.ies.join(again, ["graph", "urn"], "left").withColumn("stored_as", F.coalesce("_new", "stored_as")).select(*c.ies.columns)
    g = renamed(c.folders.select("url").distinct())
    folders = c.folders.join(g, "url", "left").withColumn("url", F.coalesce("new", "url")).select(*c.folders.columns)
    return replace(c, files=files, ies=ies, folders=folders)


def apply_events(c: Catalog, events: DataFrame, listing: DataFrame) -> Catalog:
    """A coalesced batch: deletions, then moves, then created and updated files as the listing has them.

    listing has the columns of files for what is on disk. An update clears the old content first, so the file is
    extracted again; attribute updates change times only. Entities without a song are dropped once for the batch.
    """
    last = events.groupBy("file_url").agg(F.max_by(F.struct("op", "attributes_only", "dest_url"), "seq").alias("e")).select(F.col("file_url").alias("url"), "e.*")
    c = delete_urls(c, last.where("op = 'DELETED'").select("url"))
    c = move_urls(c, last.where("op = 'MOVED' and dest_url is not null").select(F.col("url").alias("src"), F.col("dest_url").alias("dest")))
    full = last.where("op in ('CREATED', 'UPDATED') and not coalesce(attributes_only, false)").select("url")
    stale = c.ies.select("graph", "urn", F.explode("stored_as").alias("url")).join(full, "url", "left_semi").select("graph", "urn").distinct()
    c = replace(c, ies=c.ies.join(stale, ["graph", "urn"], "left_anti"))
    fresh = listing.join(full, "url", "left_semi").withColumn("extractor_hash", F.lit(None).cast("string")).withColumn("seq", F.lit(1))
    c = mutations.upsert_files(c, fresh)
    times = listing.join(last.where("op = 'UPDATED' and coalesce(attributes_only, false)").select("url"), "url", "left_semi").withColumn("seq", F.lit(1))
    return mutations.orphan_artists(mutations.upsert_files(c, times, attributes_only=True))


def touched_graphs(c: Catalog, events: DataFrame, listing: DataFrame) -> set[str]:
    """The graphs with a row at, below, or stored at or below what the events name, and those of the listing."""
    named = events.select(F.explode(F.array("file_url", "dest_url")).alias("_a")).where("_a is not null").distinct()
    stored = c.ies.select("graph", F.explode("stored_as").alias("url"))
    rows = c.files.select("graph", "url").union(stored).distinct()
    hit = climb(rows.select("url").distinct(), "url", named, "_a").join(named, "_a", "left_semi").select("url").distinct()
    graphs = rows.join(hit, "url", "left_semi").select("graph").union(listing.select("graph")).distinct()
    return {FILE_SYSTEM, *(r.graph for r in graphs.collect() if r.graph is not None)}


def collect_garbage(c: Catalog, discs: DataFrame, albums: DataFrame) -> tuple[Catalog, DataFrame, DataFrame]:
    """discs(disc, album), albums(album) and the artists that still have a song, once for a batch: discs, albums, artists.

    Songs name their disc, album and artists in the rows of ies, so a catalogue has no rows of the first two to drop; who
    keeps tables of them passes them here.
    """
    discs = mutations.orphan_discs(c, discs)
    return mutations.orphan_artists(c), discs, mutations.orphan_albums(c, albums, discs)


def apply_and_save(folder: str, listing):
    """A function for streaming.queue.apply_batches that applies each batch and writes a snapshot.

    listing(batch) gives the rows on disk of the batch's urls. A batch is applied once: the marker that makes its snapshot
    visible holds its number, and batches up to the last such number are skipped.
    """

    def each(events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        if batch_id <= snapshot.last_batch(spark, folder):
            return
        c, rows = snapshot.read(spark, folder), listing(events)
        changed = touched_graphs(c, events, rows)
        snapshot.write(apply_events(c, events, rows), folder, batch_id, changed)

    return each


def extract_pending(c: Catalog, contents: DataFrame, rules: DataFrame, at_once: int = 200) -> tuple[Catalog, DataFrame]:
    """One round of extraction: (catalogue, error rows). contents(url, mime_type, content) of files.

    Files without a hash are extracted; each gets the hash of its rule whether or not it could be read, so a bad file is
    not tried again until it changes. at_once is the number of files handed to a worker at a time.
    """
    todo = c.in_graph("files", FILE_SYSTEM).where("extractor_hash is null").select("url").distinct()
    ies, hashes = run(contents.join(todo, "url", "left_semi"), rules, at_once=at_once)
    good = ies.where("error is null")
    known = {f.name: F.lit(None).cast(f.dataType) for f in c.ies.schema.fields}
    new = good.select(*[F.col(n) if n in ("graph", "urn", "mime_type", "rdf_types", "stored_as", "title", "plain_text") else e.alias(n) for n, e in known.items()])
    after = replace(mutations.update_hashes(c, hashes), ies=c.ies.unionByName(new))
    return after, ies.where("error is not null").select(F.col("stored_as")[0].alias("uri"), F.col("error").alias("message"))


def cached_monitor_events(events: DataFrame) -> DataFrame:
    """Raw notifications of a watcher to events, in batch: CREATED and CHANGED wait for CHANGES_DONE, the first counts.

    A creation that is deleted before it is done gives nothing; a deletion drops what waits and is emitted; attribute
    changes pass at once. events(seq, op, file_url). The bursts of a path are numbered by a running count of their ends,
    first over chunks of sequence numbers and then within each chunk, so that a busy path is spread over tasks.
    """
    ends = F.col("op").isin("CHANGES_DONE", "DELETED").cast("int")
    waiting = events.where("op in ('CREATED', 'CHANGED', 'CHANGES_DONE', 'DELETED')").withColumn("chunk", F.floor(F.col("seq") / CHUNK))
    chunks = waiting.groupBy("file_url", "chunk").agg(F.sum(ends).alias("k"))
    before = Window.partitionBy("file_url").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("file_url", "chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file_url", "chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    waiting = waiting.join(chunks, ["file_url", "chunk"]).withColumn("burst", F.col("base") + F.coalesce(F.sum(ends).over(inside), F.lit(0)))
    per = waiting.groupBy("file_url", "burst").agg(F.min_by("op", F.when(F.col("op").isin("CREATED", "CHANGED"), F.col("seq"))).alias("first"), F.max("seq").alias("seq"), F.max_by("op", "seq").alias("last"))
    op = F.when(F.col("last") == "DELETED", F.when(F.col("first") == "CREATED", F.lit(None)).otherwise("DELETED")).when(F.col("last") == "CHANGES_DONE", F.when(F.col("first") == "CREATED", "CREATED").when(F.col("first") == "CHANGED", "UPDATED"))
    out = per.select("seq", op.alias("op"), "file_url", F.lit(False).alias("attributes_only")).where("op is not null")
    return out.unionByName(events.where("op = 'ATTRIBUTE_CHANGED'").select("seq", F.lit("UPDATED").alias("op"), "file_url", F.lit(True).alias("attributes_only")))
