"""From files to interpretations: rules, extraction, completion, CUE sheets and hashes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.extract.base import MAX_TEXT, extract
from kartei.extract.playlists import cue_tracks
from kartei.operators.rules import match_rules
from kartei.session import materialize


#: MIME types that are broadcast with what the rules say of them.
MOST_KINDS = 100_000


def run(files: DataFrame, rules: DataFrame, max_text: int = MAX_TEXT, at_once: int = 0) -> tuple[DataFrame, DataFrame]:
    """files(url, mime_type, content) to (interpretations, hashes).

    Every file gets the module, graph, types and hash of its rules. A file whose rules have no graph is not extracted.
    Neither contents nor extracted texts are shuffled: what the rules say is one row a MIME type, counted and broadcast,
    and goes through the extraction with the file.
    """
    known = materialize(match_rules(files.select("mime_type"), rules).where("graph is not null"))
    if known.count() <= MOST_KINDS:
        known = F.broadcast(known)
    todo = files.join(known, "mime_type")
    return complete(extract(todo, max_text, keep=("graph",), at_once=at_once)), files.select("url", "mime_type").join(known, "mime_type").select("url", "hash")


def complete(extracted: DataFrame) -> DataFrame:
    """Interpretations with what every one has: its type, where it is stored, and fallback types."""
    types = F.array_distinct(F.concat(F.array(F.lit("nie:InformationElement")), F.coalesce("rdf_types", F.array().cast("array<string>"))))
    return extracted.select("graph", F.concat(F.lit("urn:ie:"), F.sha2("url", 256)).alias("urn"), "mime_type", types.alias("rdf_types"), F.array("url").alias("stored_as"), "title", "plain_text", "props", "children", "error")


def merge_entities(entities: DataFrame) -> DataFrame:
    """entities(urn, ord, props map<string,string>) that several files tell of, one row a urn: (urn, props).

    The first value of a property, in order, wins. Values are told apart before they are grouped, so an entity that most
    files tell of is aggregated within tasks first.
    """
    each = entities.where("urn is not null").select("urn", "ord", F.explode("props").alias("p", "v")).where("v is not null")
    first = each.groupBy("urn", "p").agg(F.min_by("v", F.struct("ord", "v")).alias("v"))
    return first.groupBy("urn").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "v")))).alias("props"))


def sheets_of(audio: DataFrame, sheets: DataFrame) -> DataFrame:
    """(url, cue_url): the sheet of the same name in the folder, else the sheets of the folder that name the file.

    audio(url, folder, file_name), sheets(cue_url, folder, cue_name, entries): names are compared without endings and in
    any letter case. Both ways are equi joins on folder and bare name, so a full folder gives no pairs but these.
    """
    bare = lambda x: F.lower(F.regexp_replace(x, r"\.[^.]*$", ""))
    a = audio.select("url", "folder", bare(F.col("file_name")).alias("bare")).distinct()
    named = a.join(sheets.select("cue_url", "folder", bare(F.col("cue_name")).alias("bare")).distinct(), ["folder", "bare"]).select("url", "cue_url")
    told = sheets.select("cue_url", "folder", F.explode("entries").alias("e")).select("cue_url", "folder", bare(F.regexp_extract("e", r"[^/\\\\]*$", 0)).alias("bare")).distinct()
    rest = a.join(named.select("url").distinct(), "url", "left_anti").join(told, ["folder", "bare"]).select("url", "cue_url")
    return named.unionByName(rest)


def tracks(audio: DataFrame) -> DataFrame:
    """(url, track, title, artist, album, start, duration) of the sheets: audio(url, file_name, seconds, cue)."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                for _, n, p in cue_tracks(r.cue, r.file_name, None if pd.isna(r.seconds) else float(r.seconds)).children:
                    rows.append((r.url, n, p.get("nie:title"), p.get("nmm:artist"), p.get("nmm:musicAlbum"), float(p["nfo:audioOffset"]) if "nfo:audioOffset" in p else None, int(p["nfo:duration"]) if "nfo:duration" in p else None))
            yield pd.DataFrame(rows, columns=["url", "track", "title", "artist", "album", "start", "duration"]).astype({"duration": "Int64"})

    return audio.select("url", "file_name", "seconds", "cue").mapInPandas(run, "url string, track int, title string, artist string, album string, start double, duration int")


def as_jsonld(quads: DataFrame) -> DataFrame:
    """quads(graph, s, p, o) as (s, json): each subject as a JSON-LD object with all its properties, by a built-in."""
    each = quads.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("os"))
    all_ = each.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("p", "os"))).alias("ps"))
    types = F.try_element_at(F.filter("ps", lambda x: x.p == "rdf:type"), F.lit(1)).os
    props = F.map_from_entries(F.filter("ps", lambda x: x.p != "rdf:type"))
    return all_.select("s", F.to_json(F.struct(F.col("s").alias("@id"), types.alias("@type"), props.alias("properties"))).alias("json"))


def _iri(x):
    return F.when(x.rlike(r"^[\w.-]+:[\w-]+$") & ~x.rlike("^urn:"), x).otherwise(F.concat(F.lit("<"), x, F.lit(">")))


def as_turtle(quads: DataFrame, named_graphs: bool = False) -> DataFrame:
    """quads(graph, s, p, o) as text, one row a subject: Turtle, or TriG with the graph around it."""
    escaped = F.regexp_replace(F.regexp_replace(F.col("o"), r'([\\"])', r"\\$1"), "\n", r"\\n")
    is_iri = F.col("p").isin("rdf:type", "nie:isStoredAs", "nie:interpretedAs", "nao:hasTag", "nie:dataSource", "nfo:belongsToContainer", "nie:url") | F.col("o").rlike(r"^(urn|file):\S+$")
    obj = F.when(is_iri, _iri(F.col("o"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))
    line = F.concat(F.when(F.col("p") == "rdf:type", "a").otherwise(F.col("p")), F.lit(" "), obj)
    keys = ["graph", "s"] if named_graphs else ["s"]
    out = quads.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(line)), " ;\n  ").alias("lines"))
    text = F.concat(_iri(F.col("s")), F.lit(" "), F.col("lines"), F.lit(" ."))
    return out.select(*keys, (F.concat(F.lit("GRAPH "), F.col("graph"), F.lit(" { "), text, F.lit(" }")) if named_graphs else text).alias("text"))


def playlists_as_m3u(entries: DataFrame) -> DataFrame:
    """entries(playlist, position, url) as (playlist, text): entries by position, gaps skipped."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "url")))
    return entries.where("url is not null").groupBy("playlist").agg(F.concat(F.lit("#EXTM3U\n"), F.array_join(F.transform(ordered, lambda e: e.url), "\n"), F.lit("\n")).alias("text"))


def xmp_sidecar(props: dict[str, list[str]]) -> str:
    """An XMP packet of properties, as a sidecar is written."""
    from xml.sax.saxutils import escape

    from kartei.extract.photo import XMP, XMP_MANY

    one = {v: k for k, v in reversed(XMP.items())}
    many = {v: k for k, v in reversed(XMP_MANY.items())}
    dc = {"title", "description", "rights", "date", "language", "identifier", "creator", "contributor", "publisher", "subject"}
    out = []
    for name, values in sorted(props.items()):
        key = one.get(name) or many.get(name)
        if key:
            tag = f"{'dc' if key in dc else 'xmp'}:{key}"
            items = "".join(f"<rdf:li>{escape(v)}</rdf:li>" for v in values)
            out.append(f"<{tag}><rdf:Bag>{items}</rdf:Bag></{tag}>" if name in many else f"<{tag}>{escape(values[0])}</{tag}>")
    ns = 'xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:xmp="http://ns.adobe.com/xap/1.0/"'
    return f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" {ns}>{"".join(out)}</rdf:Description></rdf:RDF></x:xmpmeta>'


def write_sidecars(ies: DataFrame) -> DataFrame:
    """ies(path, props) written beside their files as path.xmp by a temporary file and an atomic rename: (path, error)."""

    def run(batches):
        import os

        for b in batches:
            rows = []
            for r in b.itertuples():
                error = None
                try:
                    data = xmp_sidecar({k: list(v) for k, v in dict(r.props or {}).items()}).encode()
                    with open(f"{r.path}.xmp.part", "wb") as f:
                        f.write(data)
                    os.replace(f"{r.path}.xmp.part", f"{r.path}.xmp")
                except OSError as e:
                    error = str(e)
                rows.append((r.path, error))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return ies.select("path", "props").mapInPandas(run, "path string, error string")
