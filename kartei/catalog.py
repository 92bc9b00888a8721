"""The catalogue: typed tables, their schemas, and the class hierarchy.

Rows are records; exact duplicate rows stand for one record, so every reader projects first and drops duplicates of the
narrow projection, never of the full texts.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_SYSTEM = "tracker:FileSystem"
CONTENT_GRAPHS = ("tracker:Documents", "tracker:Pictures", "tracker:Audio", "tracker:Video", "tracker:Software")

FILES = "graph string, url string, file_name string, file_size bigint, mtime timestamp, atime timestamp, ctime timestamp, container_urn string, data_source string, interpreted_as array<string>, extractor_hash string"
IES = "graph string, urn string, mime_type string, rdf_types array<string>, stored_as array<string>, title string, ie_comment string, ie_language string, plain_text string, tags array<string>, genre string, artist string, performers array<string>, composer string, lyricist string, album string, album_disc string, content_created timestamp"
ROOTS = "urn string, url string, available boolean, is_removable boolean, recurse boolean, preserve boolean"
FOLDERS = "urn string, url string, mime_type string"
ARTISTS = "urn string, artist_name string"
TAGS = "urn string, pref_label string, description string"
EVENTS = "seq bigint, ts timestamp, received timestamp, op string, file_url string, dest_url string, is_dir boolean, attributes_only boolean"

# Sub-class edges of the public Nepomuk ontologies that the catalogue uses.
SUB_CLASS = {
    "nfo:PlainTextDocument": "nfo:TextDocument",
    "nfo:PaginatedTextDocument": "nfo:TextDocument",
    "nfo:HtmlDocument": "nfo:PlainTextDocument",
    "nfo:EBook": "nfo:TextDocument",
    "nfo:TextDocument": "nfo:Document",
    "nfo:Document": "nie:InformationElement",
    "nfo:Image": "nfo:Visual",
    "nfo:Icon": "nfo:Image",
    "nfo:VectorImage": "nfo:Image",
    "nmm:Photo": "nfo:Image",
    "nfo:Visual": "nfo:Media",
    "nfo:Audio": "nfo:Media",
    "nmm:MusicPiece": "nfo:Audio",
    "nfo:Video": "nfo:Visual",
    "nmm:Video": "nfo:Video",
    "nfo:Media": "nie:InformationElement",
    "nfo:MediaList": "nie:InformationElement",
    "nmm:Playlist": "nfo:MediaList",
    "nfo:Software": "nie:InformationElement",
    "nfo:SoftwareApplication": "nfo:Software",
    "nfo:Executable": "nfo:Software",
    "nfo:GameImage": "nfo:Software",
    "nfo:FilesystemImage": "nie:InformationElement",
    "nfo:Folder": "nie:InformationElement",
    "nie:InformationElement": "rdfs:Resource",
    "nfo:FileDataObject": "nie:DataObject",
    "nie:DataObject": "rdfs:Resource",
    "nmm:Artist": "rdfs:Resource",
    "nmm:MusicAlbum": "rdfs:Resource",
    "nmm:MusicAlbumDisc": "rdfs:Resource",
    "nao:Tag": "rdfs:Resource",
    "tracker:IndexedFolder": "nfo:Folder",
}


@functools.cache
def super_classes(name: str) -> tuple[str, ...]:
    """A class and all its super-classes."""
    out = [name]
    while out[-1] in SUB_CLASS:
        out.append(SUB_CLASS[out[-1]])
    return tuple(out)


@functools.cache
def sub_classes(name: str) -> tuple[str, ...]:
    """A class and all its sub-classes."""
    return tuple(sorted({c for c in {*SUB_CLASS, name} if name in super_classes(c)}))


def is_a(types: Column, name: str) -> Column:
    """True where an array of types holds the class or one of its sub-classes."""
    return F.arrays_overlap(types, F.array(*[F.lit(c) for c in sub_classes(name)]))


def class_closure(spark: SparkSession) -> DataFrame:
    """(sub, super) of all pairs, with each class its own super-class."""
    rows = sorted((c, s) for c in {*SUB_CLASS, *SUB_CLASS.values()} for s in super_classes(c))
    return spark.createDataFrame(rows, "sub string, super string")


@dataclass(frozen=True)
class Catalog:
    """The tables of one snapshot."""

    files: DataFrame
    ies: DataFrame
    roots: DataFrame
    folders: DataFrame
    artists: DataFrame
    tags: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Catalog:
        """Read the tables with their declared schemas; no inference."""
        # a table laid out by graph has that column last
        read = lambda name, schema: (df := spark.read.schema(schema).parquet(f"{folder}/{name}.parquet")).select(*sorted(df.columns, key=lambda c: c != "graph"))
        return cls(read("files", FILES), read("ies", IES), read("roots", ROOTS), read("folders", FOLDERS), read("artists", ARTISTS), read("tags", TAGS))

    def in_graph(self, table: str, graph: str | None) -> DataFrame:
        """The rows of one graph, or of all content graphs for None; a partition filter where data is laid out by graph."""
        df = getattr(self, table)
        return df.where(F.col("graph") == graph) if graph else df.where(F.col("graph") != FILE_SYSTEM)

    def data_objects(self, *columns: str, graph: str = FILE_SYSTEM) -> DataFrame:
        """Distinct narrow rows of the files of a graph."""
        return self.in_graph("files", graph).select(*columns).distinct()

    def located(self, *columns: str, graph: str = FILE_SYSTEM) -> DataFrame:
        """The same rows with duplicates: for joins whose result is made distinct anyway."""
        return self.in_graph("files", graph).select(*columns)

    def register(self, prefix: str = "") -> None:
        """Temporary views for ad-hoc SQL."""
        for name in ("files", "ies", "roots", "folders", "artists", "tags"):
            getattr(self, name).createOrReplaceTempView(f"{prefix}{name}")


def explode_links(df: DataFrame, array: str, into: str) -> DataFrame:
    """One row for each element of a multi-valued property; rows without elements are dropped."""
    return df.withColumn(into, F.explode(array)).drop(array)


def with_availability(df: DataFrame, roots: DataFrame, show_all: bool) -> DataFrame:
    """Rows whose data source is available; all rows for show_all, without a join.

    An unknown availability counts as not available. roots has one row a root, whatever the data; the planner broadcasts
    it while it is below its threshold.
    """
    if show_all:
        return df
    available = roots.where(F.col("available")).select(F.col("urn").alias("data_source")).distinct()
    return df.join(available, "data_source", "left_semi")


def page(df: DataFrame, order: list[str | Column], offset: int = 0, limit: int = -1) -> DataFrame:
    """ORDER BY with OFFSET and LIMIT; a negative limit is none. An unlimited list is sorted by ranges, over all tasks."""
    df = df.orderBy(*order)
    if offset > 0:
        df = df.offset(offset)
    return df.limit(limit) if limit >= 0 else df
