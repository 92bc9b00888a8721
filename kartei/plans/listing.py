"""List queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.catalog import FILE_SYSTEM, Catalog, explode_links, is_a, page, with_availability
from kartei.operators.prefix import deepest_prefix
from kartei.plans.registry import query

#: kind -> (graph, class) of the lists of one content graph.
CONTENT = {"documents": ("tracker:Documents", "nfo:Document"), "images": ("tracker:Pictures", "nfo:Image"), "music": ("tracker:Audio", "nmm:MusicPiece"), "videos": ("tracker:Video", "nmm:Video"), "software": ("tracker:Software", "nfo:Software")}


def list_all(c: Catalog, show_all: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """(urn, url) of every interpretation of a file."""
    files = with_availability(c.located("url", "data_source"), c.roots, show_all).select("url")
    ies = explode_links(c.ies.select("urn", "stored_as"), "stored_as", "url")
    return page(ies.join(files, "url", "left_semi").select("urn", "url").distinct(), ["url", "urn"], offset, limit)


def list_files(c: Catalog, show_all: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """(url, file_name) of every file."""
    return page(with_availability(c.data_objects("url", "file_name", "data_source"), c.roots, show_all).select("url", "file_name"), ["url"], offset, limit)


def folders_with_source(c: Catalog) -> DataFrame:
    """(urn, url, data_source) of the folders; the source is the deepest root above."""
    return deepest_prefix(c.folders.select("urn", "url").distinct(), "url", c.roots.select(F.col("urn").alias("data_source"), F.col("url").alias("root_url")), "root_url", ["data_source"])


def list_folders(c: Catalog, show_all: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """(urn, url) of every folder."""
    return page(with_availability(folders_with_source(c).where("data_source is not null"), c.roots, show_all).select("urn", "url").distinct(), ["url", "urn"], offset, limit)


def list_content(c: Catalog, kind: str, show_all: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """(urn, url) of the interpretations of one content graph."""
    graph, cls = CONTENT[kind]
    files = with_availability(c.located("url", "data_source", graph=graph), c.roots, show_all).select("url")
    ies = explode_links(c.in_graph("ies", graph).where(is_a(F.col("rdf_types"), cls)).select("urn", "stored_as"), "stored_as", "url")
    return page(ies.join(files, "url", "left_semi").select("urn", "url").distinct(), ["url", "urn"], offset, limit)


def albums(c: Catalog) -> DataFrame:
    """(album, title) of the albums songs belong to; the title is the first part of the identifier."""
    return c.in_graph("ies", "tracker:Audio").select("album").where("album is not null").distinct().withColumn("title", F.url_decode(F.regexp_extract("album", r"^urn:album:([^:]*)", 1)))


def list_albums(c: Catalog, offset: int = 0, limit: int = -1) -> DataFrame:
    return page(albums(c), ["title", "album"], offset, limit)


def list_artists(c: Catalog, show_all: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """(urn, artist_name) of the artists with a song on a file."""
    files = with_availability(c.located("url", "data_source", graph="tracker:Audio"), c.roots, show_all).select("url")
    songs = explode_links(c.in_graph("ies", "tracker:Audio").select("artist", "stored_as").where("artist is not null"), "stored_as", "url")
    found = songs.join(files, "url", "left_semi").select(F.col("artist").alias("urn")).distinct()
    return page(c.artists.select("urn", "artist_name").distinct().join(found, "urn", "left_semi"), ["artist_name", "urn"], offset, limit)


_AVAILABLE = "(select distinct urn from roots where available)"


def _content_sql(kind: str) -> str:
    graph, typed = sql_content(kind)
    return f"""
select distinct i.urn, i.url from (select urn, unnest(stored_as) as url from ies where graph = '{graph}' and {typed}) i
where i.url in (select url from files where graph = '{graph}' and data_source in {_AVAILABLE})"""


@query("r01_list_all", f"""
select distinct i.urn, i.url from (select urn, unnest(stored_as) as url from ies) i
join (select distinct url, data_source from files where graph = '{FILE_SYSTEM}') f using (url) where f.data_source in {_AVAILABLE}""")
def r01_list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_all(Catalog.load(spark, sf_dir))


@query("r01_list_all_shown", f"""
select distinct i.urn, i.url from (select urn, unnest(stored_as) as url from ies) i
join (select distinct url from files where graph = '{FILE_SYSTEM}') f using (url)""")
def r01_list_all_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_all(Catalog.load(spark, sf_dir), show_all=True)


@query("l01_page", f"""
select url, file_name from (select distinct url, file_name, data_source from files where graph = '{FILE_SYSTEM}')
where data_source in {_AVAILABLE} order by url offset 100 limit 50""")
def l01_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the list; the limit is the feature."""
    return list_files(Catalog.load(spark, sf_dir), offset=100, limit=50)


@query("r02_list_files", f"select distinct url, file_name from files where graph = '{FILE_SYSTEM}' and data_source in {_AVAILABLE}")
def r02_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_files(Catalog.load(spark, sf_dir))


@query("r03_list_folders", """
with s as (select f.urn, f.url, arg_max(r.urn, length(r.url)) as ds from (select distinct urn, url from folders) f
join roots r on f.url = r.url or starts_with(f.url, r.url || '/') group by 1, 2)
select s.urn, s.url from s where ds in (select urn from roots where available)""")
def r03_list_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_folders(Catalog.load(spark, sf_dir))


def with_software(c: Catalog) -> Catalog:
    """The catalogue with its videos taken for software, which the test tables lack."""
    graph = F.when(F.col("graph") == "tracker:Video", "tracker:Software").otherwise(F.col("graph"))
    types = F.when(F.col("graph") == "tracker:Video", F.array(F.lit("nfo:SoftwareApplication"))).otherwise(F.col("rdf_types"))
    return replace(c, ies=c.ies.withColumn("rdf_types", types).withColumn("graph", graph), files=c.files.withColumn("graph", graph))


def loaded(spark: SparkSession, sf_dir: str, kind: str) -> Catalog:
    c = Catalog.load(spark, sf_dir)
    return with_software(c) if kind == "software" else c


def sql_content(kind: str) -> tuple[str, str]:
    """(graph, condition on the types) of a kind in the test tables."""
    from kartei.catalog import sub_classes

    graph, cls = CONTENT[kind]
    classes = ", ".join(f"'{x}'" for x in sub_classes(cls))
    return ("tracker:Video", "true") if kind == "software" else (graph, f"list_has_any(rdf_types, [{classes}])")


def _register_content() -> None:
    for n, kind in enumerate(CONTENT, start=4):

        def run(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
            return list_content(loaded(spark, sf_dir, kind), kind)

        query(f"r{n:02d}_list_{kind}", _content_sql(kind))(run)


_register_content()


@query("r09_list_albums", "select distinct album, url_decode(regexp_extract(album, '^urn:album:([^:]*)', 1)) as title from ies where graph = 'tracker:Audio' and album is not null")
def r09_list_albums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_albums(Catalog.load(spark, sf_dir))


@query("r10_list_artists", f"""
select distinct a.urn, a.artist_name from artists a join (select artist, unnest(stored_as) as url from ies where graph = 'tracker:Audio') i on i.artist = a.urn
where i.url in (select url from files where graph = 'tracker:Audio' and data_source in {_AVAILABLE})""")
def r10_list_artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return list_artists(Catalog.load(spark, sf_dir))


@query("j07_folder_source", """
select f.urn, f.url, arg_max(r.urn, length(r.url)) as data_source from (select distinct urn, url from folders) f
left join roots r on f.url = r.url or starts_with(f.url, r.url || '/') group by 1, 2""")
def j07_folder_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest root above every folder."""
    return folders_with_source(Catalog.load(spark, sf_dir))


@query("j07_file_folder", f"""
select f.url, arg_max(d.urn, length(d.url)) as folder from (select distinct url from files where graph = '{FILE_SYSTEM}') f
left join folders d on starts_with(f.url, d.url || '/') group by 1""")
def j07_file_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest folder above every file."""
    c = Catalog.load(spark, sf_dir)
    return deepest_prefix(c.data_objects("url"), "url", c.folders.select(F.col("urn").alias("folder"), F.col("url").alias("folder_url")), "folder_url", ["folder"])
