"""Counts, statistics, tags and look-ups."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.catalog import CONTENT_GRAPHS, FILE_SYSTEM, SUB_CLASS, Catalog, explode_links, super_classes, with_availability
from kartei.plans.listing import folders_with_source
from kartei.plans.registry import query

_AVAILABLE = "(select distinct urn from roots where available)"


def count_files(c: Catalog) -> DataFrame:
    """Available data objects that are not folders."""
    files = with_availability(c.data_objects("url", "data_source"), c.roots, False)
    return files.join(c.folders.select("url").distinct(), "url", "left_anti").agg(F.count(F.lit(1)).alias("n"))


def count_folders(c: Catalog) -> DataFrame:
    return with_availability(folders_with_source(c), c.roots, False).agg(F.count(F.lit(1)).alias("n"))


def class_stats(c: Catalog) -> DataFrame:
    """(graph, class, n) with super-classes, of interpretations and data objects, by graph.

    Super-classes are looked up in a literal map, so the only shuffle of rows is the one that drops duplicates.
    """
    known = F.create_map(*[x for k in sorted({*SUB_CLASS, *SUB_CLASS.values()}) for x in (F.lit(k), F.array(*[F.lit(s) for s in super_classes(k)]))])
    rows = c.ies.select("graph", "urn", F.array_sort("rdf_types").alias("t")).distinct()
    ies = rows.select("graph", F.explode(F.array_distinct(F.flatten(F.transform("t", lambda t: F.coalesce(F.try_element_at(known, t), F.array(t)))))).alias("class"))
    objects = c.files.select("graph", "url").distinct().select("graph", F.explode(F.array(*[F.lit(x) for x in super_classes("nfo:FileDataObject")])).alias("class"))
    return ies.unionByName(objects).groupBy("graph", "class").agg(F.count(F.lit(1)).alias("n")).orderBy("graph", F.desc("n"), "class")


def tag_counts(c: Catalog) -> DataFrame:
    """(tag, label, description, n): tags without a resource are kept with 0."""
    links = explode_links(c.ies.select("urn", "tags"), "tags", "tag").distinct()
    n = links.groupBy("tag").agg(F.count("urn").alias("n"))
    tags = c.tags.select(F.col("urn").alias("tag"), F.col("pref_label").alias("label"), "description").distinct()
    return tags.join(n, "tag", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def tags_for_files(c: Catalog) -> DataFrame:
    """(url, tag, label) of every file whose interpretation has a tag."""
    links = c.ies.select(F.explode("stored_as").alias("url"), "tags").select("url", F.explode("tags").alias("tag")).distinct()
    return links.join(c.tags.select(F.col("urn").alias("tag"), F.col("pref_label").alias("label")).distinct(), "tag").select("url", "tag", "label")


def files_with_tag(c: Catalog) -> DataFrame:
    """(tag, uri): where the tagged resource is stored, or the resource itself."""
    links = c.ies.select("urn", F.explode("tags").alias("tag"), "stored_as")
    return links.select("tag", "urn", F.explode_outer("stored_as").alias("sa")).select("tag", F.coalesce("sa", "urn").alias("uri")).distinct()


def _named(p: str):
    return lambda x: F.struct(F.lit(p).alias("p"), x.alias("o"))


def quads(c: Catalog) -> DataFrame:
    """The derived (graph, s, p, o) view over the typed tables."""
    def stack(df: DataFrame, s: str, single: dict[str, str], multi: dict[str, str]) -> DataFrame:
        # all properties of a row in one pass instead of a scan for each
        pairs = [F.array(F.struct(F.lit(p).alias("p"), F.col(o).cast("string").alias("o"))) for p, o in single.items()]
        pairs += [F.transform(F.coalesce(F.col(o), F.array().cast("array<string>")), _named(p)) for p, o in multi.items()]
        return df.select("graph", F.col(s).alias("s"), F.explode(F.concat(*pairs)).alias("x")).select("graph", "s", "x.p", "x.o").where("o is not null").distinct()

    ies = stack(c.ies, "urn", {"nie:mimeType": "mime_type", "nie:title": "title", "nie:comment": "ie_comment", "nie:language": "ie_language", "nfo:genre": "genre", "nmm:artist": "artist", "nmm:composer": "composer", "nmm:lyricist": "lyricist", "nmm:musicAlbum": "album", "nmm:musicAlbumDisc": "album_disc"}, {"rdf:type": "rdf_types", "nie:isStoredAs": "stored_as", "nao:hasTag": "tags", "nmm:performer": "performers"})
    files = stack(c.files, "url", {"nie:url": "url", "nfo:fileName": "file_name", "nfo:fileSize": "file_size", "nfo:belongsToContainer": "container_urn", "nie:dataSource": "data_source", "tracker:extractorHash": "extractor_hash"}, {"nie:interpretedAs": "interpreted_as"})
    return ies.unionByName(files)


def describe(c: Catalog, uri: str) -> DataFrame:
    """(graph, s, p, o) of a resource and of what it is interpreted as."""
    asked = c.files.where(F.col("url") == uri).select(F.explode("interpreted_as").alias("s")).union(c.files.where(F.col("url") == uri).select("url")).union(c.ies.where(F.col("urn") == uri).select("urn")).distinct()
    return quads(c).join(asked, "s", "left_semi")


def root_content(c: Catalog) -> DataFrame:
    """(root, url, folder_urn, mtime, hash, mime_type) of every file below an index root."""
    files = c.in_graph("files", FILE_SYSTEM).select("data_source", "url", "mtime", "extractor_hash", "interpreted_as").distinct()
    each = files.select(F.col("data_source").alias("root"), "url", "mtime", F.col("extractor_hash").alias("hash"), F.explode_outer("interpreted_as").alias("ie"))
    ies = c.ies.select(F.col("urn").alias("ie"), "mime_type").distinct()
    folders = c.folders.select(F.col("urn").alias("ie"), F.col("urn").alias("folder_urn")).distinct()
    known = c.roots.select(F.col("urn").alias("root")).distinct()
    return each.join(known, "root", "left_semi").join(ies, "ie", "left").join(folders, "ie", "left").select("root", "url", "folder_urn", "mtime", "hash", "mime_type").distinct().orderBy("url")


def pending(c: Catalog) -> DataFrame:
    """(graph, url) of data objects in content graphs whose file has no extractor hash."""
    done = c.in_graph("files", FILE_SYSTEM).where("extractor_hash is not null").select("url")
    return c.in_graph("files", None).select("graph", "url").join(done, "url", "left_anti").distinct()


def pending_items(c: Catalog, high: tuple[str, ...] = ("tracker:Audio",)) -> DataFrame:
    """(priority, url, ie, mime_type) of the pending files: graphs of high priority first."""
    files = c.in_graph("files", None).select("graph", "url", "interpreted_as").distinct()
    each = files.select("graph", "url", F.explode("interpreted_as").alias("ie")).join(pending(c), ["graph", "url"], "left_semi")
    mime = c.ies.select(F.col("urn").alias("ie"), "mime_type").distinct()
    return each.join(mime, "ie", "left").select(F.when(F.col("graph").isin(*high), 0).otherwise(1).alias("priority"), "url", "ie", "mime_type").distinct()


def cue_sheets(c: Catalog, suffix: str = ".cue") -> DataFrame:
    """(folder, url) of the files with that ending in each folder."""
    files = c.data_objects("url", "file_name", "container_urn").where(F.endswith("file_name", F.lit(suffix)))
    return files.join(c.folders.select(F.col("urn").alias("container_urn"), F.col("url").alias("folder")).distinct(), "container_urn").select("folder", "url")


@query("r16_count_files", f"select count(*) as n from (select distinct url from files where graph = '{FILE_SYSTEM}' and data_source in {_AVAILABLE}) where url not in (select url from folders)")
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_files(Catalog.load(spark, sf_dir))


@query("r17_count_folders", """
with s as (select f.urn, arg_max(r.urn, length(r.url)) as ds from (select distinct urn, url from folders) f
join roots r on f.url = r.url or starts_with(f.url, r.url || '/') group by 1)
select count(*) as n from s where ds in (select urn from roots where available)""")
def r17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_folders(Catalog.load(spark, sf_dir))


def _closure_values() -> str:
    from kartei.catalog import SUB_CLASS

    return ", ".join(f"('{c}', '{s}')" for c in sorted({*SUB_CLASS, *SUB_CLASS.values()}) for s in super_classes(c))


@query("r18_class_stats", f"""
with k(sub, super) as (values {_closure_values()}),
e as (select distinct graph, urn, unnest(rdf_types) as sub from ies),
x as (select distinct graph, urn, coalesce(super, sub) as class from e left join k using (sub)
union all select distinct graph, url, unnest(['nfo:FileDataObject', 'nie:DataObject', 'rdfs:Resource']) from files)
select graph, class, count(*) as n from x group by 1, 2""")
def r18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_stats(Catalog.load(spark, sf_dir))


@query("r19_tag_counts", """
with l as (select tag, count(distinct urn) as n from (select urn, unnest(tags) as tag from ies) group by 1)
select distinct t.urn as tag, t.pref_label as label, t.description, coalesce(l.n, 0) as n from tags t left join l on l.tag = t.urn""")
def r19a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tag_counts(Catalog.load(spark, sf_dir))


@query("r19_tags_for_files", """
with i as (select unnest(stored_as) as url, tags from ies), l as (select url, unnest(tags) as tag from i)
select distinct l.url, l.tag, t.pref_label as label from l join tags t on t.urn = l.tag""")
def r19b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags_for_files(Catalog.load(spark, sf_dir))


@query("r19_files_with_tag", """
with l as (select urn, stored_as, unnest(tags) as tag from ies)
select distinct tag, unnest(case when len(stored_as) > 0 then stored_as else [urn] end) as uri from l""")
def r19c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_with_tag(Catalog.load(spark, sf_dir))


@query("r20_describe", """
with u as (select min(url) as url from files),
s as (select url as s from u union select unnest(interpreted_as) from files where url = (select url from u)),
f as (select distinct graph, url, unnest([{'p': 'nie:url', 'o': url}, {'p': 'nfo:fileName', 'o': file_name}, {'p': 'nfo:fileSize', 'o': file_size::varchar}, {'p': 'nfo:belongsToContainer', 'o': container_urn}, {'p': 'nie:dataSource', 'o': data_source}, {'p': 'tracker:extractorHash', 'o': extractor_hash}]) as x from files where url in (select s from s)),
fm as (select distinct graph, url, unnest(interpreted_as) as o from files where url in (select s from s)),
i as (select distinct graph, urn, unnest([{'p': 'nie:mimeType', 'o': mime_type}, {'p': 'nie:title', 'o': title}, {'p': 'nie:comment', 'o': ie_comment}, {'p': 'nie:language', 'o': ie_language}, {'p': 'nfo:genre', 'o': genre}, {'p': 'nmm:artist', 'o': artist}, {'p': 'nmm:composer', 'o': composer}, {'p': 'nmm:lyricist', 'o': lyricist}, {'p': 'nmm:musicAlbum', 'o': album}, {'p': 'nmm:musicAlbumDisc', 'o': album_disc}]) as x from ies where urn in (select s from s)),
m as (select graph, urn, 'rdf:type' as p, unnest(rdf_types) as o from ies union select graph, urn, 'nie:isStoredAs', unnest(stored_as) from ies union select graph, urn, 'nao:hasTag', unnest(tags) from ies union select graph, urn, 'nmm:performer', unnest(performers) from ies)
select graph, url as s, x.p as p, x.o as o from f where x.o is not null union select graph, url, 'nie:interpretedAs', o from fm
union select graph, urn, x.p, x.o from i where x.o is not null union select graph, urn, p, o from m where urn in (select s from s)""")
def r20(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return describe(c, c.files.agg(F.min("url")).first()[0]).select("graph", "s", "p", "o")


@query("r21_ask", f"""
select exists(select 1 from files where graph = '{FILE_SYSTEM}' and url = (select min(url) from files)) as known,
exists(select 1 from files where graph = '{FILE_SYSTEM}' and url = 'file:///nowhere') as unknown,
exists(select 1 from files f where graph <> '{FILE_SYSTEM}' and url not in (select url from files where graph = '{FILE_SYSTEM}' and extractor_hash is not null)) as unextracted""")
def r21(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    first = c.files.agg(F.min("url")).first()[0]
    fs = c.in_graph("files", FILE_SYSTEM)
    left = pending(c).agg((F.count(F.lit(1)) > 0).alias("unextracted"))
    return fs.agg(F.coalesce(F.bool_or(F.col("url") == first), F.lit(False)).alias("known"), F.coalesce(F.bool_or(F.col("url") == "file:///nowhere"), F.lit(False)).alias("unknown")).withColumn("unextracted", left.scalar())


@query("r22_index_roots", "select distinct url, is_removable from roots")
def r22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Catalog.load(spark, sf_dir).roots.select("url", "is_removable").distinct()


@query("r23_root_content", f"""
with f as (select distinct data_source, url, mtime, extractor_hash, unnest(case when len(interpreted_as) > 0 then interpreted_as else [null] end) as ie from files where graph = '{FILE_SYSTEM}')
select distinct f.data_source as root, f.url, d.urn as folder_urn, epoch_us(f.mtime) as mtime, f.extractor_hash as hash, i.mime_type from f
join roots r on r.urn = f.data_source left join folders d on d.urn = f.ie left join (select distinct urn, mime_type from ies) i on i.urn = f.ie""")
def r23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return root_content(Catalog.load(spark, sf_dir)).withColumn("mtime", F.unix_micros("mtime"))


@query("r24_mime_types", "select distinct url, mime_type from (select unnest(stored_as) as url, mime_type from ies where mime_type is not null)")
def r24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MIME types of every stored interpretation."""
    return Catalog.load(spark, sf_dir).ies.where("mime_type is not null").select(F.explode("stored_as").alias("url"), "mime_type").distinct()


_PENDING = f"select distinct graph, url from files where graph <> '{FILE_SYSTEM}' and url not in (select url from files where graph = '{FILE_SYSTEM}' and extractor_hash is not null and length(url) % 10 > 0)"


def _some_unextracted(c: Catalog) -> Catalog:
    """The catalogue with the hashes of about a tenth of the files cleared, as after a change of their rule."""
    return replace(c, files=c.files.withColumn("extractor_hash", F.when(F.length("url") % 10 > 0, F.col("extractor_hash"))))


@query("r25_pending_count", f"select graph, count(*) as n from ({_PENDING}) group by 1")
def r25a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(_some_unextracted(Catalog.load(spark, sf_dir))).groupBy("graph").agg(F.count(F.lit(1)).alias("n"))


@query("r25_pending_items", f"""
with p as ({_PENDING}), f as (select distinct graph, url, unnest(interpreted_as) as ie from files where graph <> '{FILE_SYSTEM}')
select distinct case when f.graph = 'tracker:Audio' then 0 else 1 end as priority, f.url, f.ie, i.mime_type from f join p using (graph, url) left join (select distinct urn, mime_type from ies) i on i.urn = f.ie""")
def r25b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending_items(_some_unextracted(Catalog.load(spark, sf_dir)))


@query("r26_files_by_ending", f"select distinct d.url as folder, f.url from files f join folders d on d.urn = f.container_urn where f.graph = '{FILE_SYSTEM}' and ends_with(f.file_name, '.mp3')")
def r26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_sheets(Catalog.load(spark, sf_dir), ".mp3")


@query("r27_sql_endpoint", f"select data_source, count(distinct url) as files, sum(file_size)::bigint as bytes from (select distinct url, data_source, file_size from files where graph = '{FILE_SYSTEM}') group by 1")
def r27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad-hoc SQL over the registered views."""
    Catalog.load(spark, sf_dir).register("kartei_")
    return spark.sql("select data_source, count(distinct url) as files, sum(file_size) as bytes from (select distinct url, data_source, file_size from kartei_files where graph = {g}) group by 1", g=FILE_SYSTEM)


@query("a05_share_of_total", f"""
with f as (select distinct url, data_source, extractor_hash from files where graph = '{FILE_SYSTEM}'), g as (select data_source, count(*) as files, count(extractor_hash) as extracted from f group by 1)
select data_source, files, extracted, files - extracted as waiting, round(100.0 * files / sum(files) over (), 6) as share from g""")
def a05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per source with the share of the total."""
    from pyspark.sql import Window

    f = Catalog.load(spark, sf_dir).data_objects("url", "data_source", "extractor_hash")
    g = f.groupBy("data_source").agg(F.count(F.lit(1)).alias("files"), F.count("extractor_hash").alias("extracted"))
    total = F.sum("files").over(Window.partitionBy())  # one row a source
    return g.select("data_source", "files", "extracted", (F.col("files") - F.col("extracted")).alias("waiting"), F.round(100.0 * F.col("files") / total, 6).alias("share"))


@query("a09_graphs_by_source", f"select data_source, string_agg(distinct graph, ',' order by graph) as graphs from files where graph <> '{FILE_SYSTEM}' group by 1")
def a09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct union of the content graphs of each source."""
    f = Catalog.load(spark, sf_dir).in_graph("files", None)
    return f.groupBy("data_source").agg(F.array_join(F.array_sort(F.collect_set("graph")), ",").alias("graphs"))


@query("u01_resources", "select urn as uri from ies union select url from files union select urn from folders union select urn from roots union select urn from tags union select urn from artists")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every resource of the catalogue: a bag union made distinct."""
    c = Catalog.load(spark, sf_dir)
    u = lambda df, k: df.select(F.col(k).alias("uri"))
    return u(c.ies, "urn").union(u(c.files, "url")).union(u(c.folders, "urn")).union(u(c.roots, "urn")).union(u(c.tags, "urn")).union(u(c.artists, "urn")).distinct()


@query("u02_priority_union", f"""
select 0 as rank, url from (select distinct url from files where graph = 'tracker:Audio' order by url limit 20) union all
select 1, url from (select distinct url from files where graph = 'tracker:Documents' order by url limit 20)""")
def u02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limited branches of a priority queue; branches switched off are left out of the plan."""
    c = Catalog.load(spark, sf_dir)
    limits = dict.fromkeys(CONTENT_GRAPHS, 0) | {"tracker:Audio": 20, "tracker:Documents": 20}
    order = ["tracker:Audio", "tracker:Documents", "tracker:Pictures", "tracker:Video", "tracker:Software"]
    parts = [c.data_objects("url", graph=g).orderBy("url").limit(limits[g]).select(F.lit(k).alias("rank"), "url") for k, g in enumerate(order) if limits[g]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("u04_only_in_content", f"select distinct url from files where graph <> '{FILE_SYSTEM}' except select url from files where graph = '{FILE_SYSTEM}' and length(url) % 7 > 0")
def u04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content copies without a file, after about a seventh of the files is gone."""
    c = Catalog.load(spark, sf_dir)
    return c.in_graph("files", None).select("url").distinct().exceptAll(c.data_objects("url").where(F.length("url") % 7 > 0))
