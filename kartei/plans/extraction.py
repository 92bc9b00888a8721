"""Queries of extractors, serialisers, reports and streams over the test tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.catalog import FILE_SYSTEM, Catalog
from kartei.extract import pipeline
from kartei.extract.base import extract, statistics
from kartei.functions import binary
from kartei.operators.rules import shipped_rules
from kartei.plans import stats
from kartei.plans.registry import query
from kartei.sources import reports
from kartei.sources.settings import Settings
from kartei.streaming import apply, queue


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_files(df: DataFrame, url: str, content, module: str, mime: str, *types: str) -> DataFrame:
    return df.select(F.col(url).cast("string").alias("url"), F.lit(mime).alias("mime_type"), F.lit(module).alias("module"), F.array(*[F.lit(t) for t in types]).cast("array<string>").alias("rdf_types"), content.alias("content"))


@query("x01_text", "select doc_id::varchar as url, trim(text, ' ' || chr(10) || chr(13) || chr(9)) as plain_text from documents")
def x01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts stored in UTF-8 and, every third one, in UTF-16 with a mark."""
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).otherwise(F.encode("text", "UTF-8"))
    return extract(_as_files(_read(spark, sf_dir, "documents"), "doc_id", raw, "text", "text/plain", "nfo:PlainTextDocument")).select("url", "plain_text")


@query("x02_html", r"""
select doc_id::varchar as url, 'Page ' || doc_id as title, trim(regexp_replace(text, '\s+', ' ', 'g')) || ' end' as plain_text, source as author from documents""")
def x02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts wrapped in pages with a title, an author, a script and escapes."""
    body = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><head><title>Page "), F.col("doc_id").cast("string"), F.lit('</title><meta charset=utf-8><meta name="author" content="'), "source", F.lit('"></head><body><script>var x = "<p>";</script><p>'), body, F.lit("</p><b>end</b></body></html>"))
    out = extract(_as_files(_read(spark, sf_dir, "documents"), "doc_id", F.encode(page, "UTF-8"), "html", "text/html", "nfo:HtmlDocument"))
    return out.select("url", "title", "plain_text", F.col("props")["nco:creator"][0].alias("author"))


@query("x09_ps", "select p_partkey::varchar as url, p_name as title, p_size as pages, '2024-04-28T18:00:00Z' as created from part")
def x09(spark: SparkSession, sf_dir: str) -> DataFrame:
    ps = F.concat(F.lit("%!PS-Adobe-3.0\n%%Title: ("), "p_name", F.lit(")\n%%CreationDate: D:20240428180000Z\n%%Pages: (atend)\n%%EndComments\n%%Trailer\n%%Pages: "), F.col("p_size").cast("string"), F.lit("\n%%EOF\n"))
    out = extract(_as_files(_read(spark, sf_dir, "part"), "p_partkey", F.encode(ps, "UTF-8"), "ps", "application/postscript"))
    return out.select("url", "title", F.col("props")["nfo:pageCount"][0].cast("int").alias("pages"), F.col("props")["nie:contentCreated"][0].alias("created"))


@query("x12_playlist", "select l_orderkey::varchar as url, (row_number() over (partition by l_orderkey order by l_linenumber, '#EXTINF:' || l_suppkey || ',Part' || chr(10) || 'song-' || l_partkey))::int as position, 'song-' || l_partkey || '.mp3' as entry, nullif(sum(l_suppkey) over (partition by l_orderkey), 0)::bigint as seconds from lineitem")
def x12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as playlists of their lines."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    item = F.concat(F.lit("#EXTINF:"), F.col("l_suppkey").cast("string"), F.lit(",Part\nsong-"), F.col("l_partkey").cast("string"), F.lit(".mp3\n"))
    lists = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("t")))), lambda x: x.t), "").alias("body"))
    out = extract(_as_files(lists, "l_orderkey", F.encode(F.concat(F.lit("#EXTM3U\n"), "body"), "UTF-8"), "playlist", "audio/x-mpegurl"))
    total = F.col("props")["nfo:listDuration"][0].cast("bigint")
    return out.select("url", total.alias("seconds"), F.explode("children").alias("c")).select("url", "c.position", F.col("c.props")["nfo:entryUrl"].alias("entry"), "seconds")


@query("x16_cue", """
with t as (select l_orderkey, l_linenumber as n, max(l_linenumber) over (partition by l_orderkey) as last, l_partkey from lineitem)
select l_orderkey::varchar as url, n as track, 'Part ' || l_partkey as title, (n - 1) * 200.0::double as start, case when n < last then 200 else 100 end as duration from t where l_orderkey in (select l_orderkey from lineitem group by 1 having max(l_linenumber) = count(*) and count(distinct l_linenumber) = count(*))""")
def x16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sheets of one audio file: every line is a track of 200 seconds, the last of 100."""
    line = _read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), "l_partkey")
    at = (F.col("n") - 1) * 200
    item = F.concat(F.lit("  TRACK "), F.lpad(F.col("n").cast("string"), 2, "0"), F.lit(' AUDIO\n    TITLE "Part '), F.col("l_partkey").cast("string"), F.lit('"\n    INDEX 01 '), F.lpad((at / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((at % 60).cast("string"), 2, "0"), F.lit(":00\n"))
    sheets = line.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("t")))), lambda x: x.t), "").alias("body"), F.max("n").alias("last"), F.count(F.lit(1)).alias("k"), F.count_distinct("n").alias("kinds")).where("k = last and kinds = k")
    cue = F.concat(F.lit('TITLE "Order"\nFILE "Order.FLAC" WAVE\n'), "body")
    audio = sheets.select(F.col("l_orderkey").cast("string").alias("url"), F.lit("order.flac").alias("file_name"), ((F.col("last") - 1) * 200.0 + 100.0).alias("seconds"), F.encode(cue, "UTF-8").alias("cue"))
    return pipeline.tracks(audio).select("url", "track", "title", "start", "duration")


@query("j11_sheets", f"""
with f as (select distinct url, container_urn as folder, file_name, regexp_extract(file_name, '-(\\d+)\\.', 1)::bigint as n from files where graph = '{FILE_SYSTEM}' and regexp_matches(file_name, '-\\d+\\.')),
a as (select url, folder, 'track ' || n % 5 as bare from f where ends_with(file_name, '.mp3')), s as (select url as cue_url, folder, 'track ' || n % 9 as bare, 'track ' || n % 4 as entry from f where ends_with(file_name, '.pdf')),
n as (select a.url, s.cue_url from a join s using (folder, bare))
select url, cue_url from n union all select distinct a.url, s.cue_url from a join s on s.folder = a.folder and s.entry = a.bare where a.url not in (select url from n)""".replace("\\\\", "\\"))
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets for audio files: .mp3 and .pdf files stand for them, with names made of their numbers."""
    n = F.nullif(F.regexp_extract("file_name", r"-(\d+)\.", 1), F.lit("")).cast("long")
    f = Catalog.load(spark, sf_dir).data_objects("url", "container_urn", "file_name").withColumnRenamed("container_urn", "folder").withColumn("n", n).where("n is not null")
    name = lambda k, end: F.concat(F.lit("Track "), (F.col("n") % k).cast("string"), F.lit(end))
    audio = f.where(F.endswith("file_name", F.lit(".mp3"))).select("url", "folder", name(5, ".mp3").alias("file_name"))
    sheets = f.where(F.endswith("file_name", F.lit(".pdf"))).select(F.col("url").alias("cue_url"), "folder", name(9, ".cue").alias("cue_name"), F.array(F.upper(name(4, ".wav"))).alias("entries"))
    return pipeline.sheets_of(audio, sheets)


@query("j10_merged_entities", """
with s as (select distinct artist as urn, urn as song, genre, composer, album from ies where artist is not null)
select urn, arg_min(genre, (song, genre)) filter (genre is not null) as genre, arg_min(composer, (song, composer)) filter (composer is not null) as composer, arg_min(album, (song, album)) filter (album is not null) as album from s
group by urn having count(genre) + count(composer) + count(album) > 0""")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all songs tell of their artists: the first value, by song, of each property."""
    i = _read(spark, sf_dir, "ies").where("artist is not null").select("artist", "urn", "genre", "composer", "album").distinct()
    props = F.create_map(*[x for c in ("genre", "composer", "album") for x in (F.lit(c), F.col(c))])
    out = pipeline.merge_entities(i.select(F.col("artist").alias("urn"), F.col("urn").alias("ord"), props.alias("props")))
    return out.select("urn", *[F.col("props")[c].alias(c) for c in ("genre", "composer", "album")])


@query("x31_complete", """
select doc_id::varchar as url, 'tracker:Documents' as graph, 'nie:InformationElement,nfo:Document,nfo:PlainTextDocument' as types, length(trim(text, ' ' || chr(10) || chr(13) || chr(9)))::int as n from documents""")
def x31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, extraction and completion in one pass."""
    files = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.when(F.col("doc_id").isNotNull(), "text/plain").alias("mime_type"), F.encode("text", "UTF-8").alias("content"))
    ies, _ = pipeline.run(files, shipped_rules(spark))
    return ies.select(F.col("stored_as")[0].alias("url"), "graph", F.array_join("rdf_types", ",").alias("types"), F.length("plain_text").alias("n"))


@query("str13_quarantine", "select doc_id::varchar as url, doc_id % 10 = 0 as failed, md5(doc_id::varchar) as uri_md5 from documents")
def str13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth file is broken: it becomes an error row, the others are extracted."""
    raw = F.when(F.col("doc_id") % 10 == 0, F.lit("no header").cast("binary")).otherwise(F.encode(F.concat(F.lit("%!PS\n%%Title: "), F.col("doc_id").cast("string"), F.lit("\n")), "UTF-8"))
    out = extract(_as_files(_read(spark, sf_dir, "documents"), "doc_id", raw, "ps", "application/postscript"))
    return out.select("url", F.col("error").isNotNull().alias("failed"), F.md5("url").alias("uri_md5"))


@query("a05_modules", """
with m as (select case doc_id % 4 when 0 then 'ps' when 1 then 'html' else 'text' end as module, doc_id % 8 = 0 as failed from documents)
select module, count(*) as files, count(*) filter (failed) as failed, round(100.0 * count(*) / (select count(*) from m), 6) as share from m group by 1""")
def a05_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each module read and failed on: every other PostScript file is broken."""
    k = F.col("doc_id") % 4
    content = F.when(F.col("doc_id") % 8 == 0, "broken").when(k == 0, "%!PS-Adobe-3.0\n%%Pages: 1\n").otherwise(F.col("text"))
    files = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.lit("x/y").alias("mime_type"), F.when(k == 0, "ps").when(k == 1, "html").otherwise("text").alias("module"), F.array().cast("array<string>").alias("rdf_types"), F.encode(content, "UTF-8").alias("content"))
    return statistics(extract(files))


@query("src09_text_budget", """
with k as (select doc_id, text, len(list_filter(range(1, least(length(text), 200) + 1), lambda i: strlen(left(text, i)) <= 200)) as n from documents)
select doc_id::varchar as url, trim(left(text, n), ' ' || chr(10) || chr(13) || chr(9)) as plain_text from k""")
def src09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings that allow 200 bytes a text: cut between characters."""
    settings = Settings.load(Settings(max_bytes=200).dump())
    files = _as_files(_read(spark, sf_dir, "documents"), "doc_id", F.encode("text", "UTF-8"), "text", "text/plain")
    return extract(files, settings.max_bytes).select("url", "plain_text")


@query("str12_extract_pending", f"""
with f as (select distinct url from files where graph = '{FILE_SYSTEM}' and (extractor_hash is null or length(url) % 10 = 0))
select url, url as plain_text, false as failed from f where length(url) % 20 > 0 union all select url, null, true from f where length(url) % 20 = 0""")
def str12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round of extraction of what has no hash; some files are broken, are reported and keep nothing else from being read."""
    c = Catalog.load(spark, sf_dir)
    c = replace(c, files=c.files.withColumn("extractor_hash", F.when(F.length("url") % 10 > 0, F.col("extractor_hash"))))
    broken = F.length("url") % 20 == 0
    contents = c.data_objects("url").select("url", F.when(broken, "application/postscript").otherwise("text/plain").alias("mime_type"), F.encode("url", "UTF-8").alias("content"))
    after, errors = apply.extract_pending(c, contents, shipped_rules(spark))
    new = after.ies.join(c.ies.select("urn"), "urn", "left_anti").select(F.col("stored_as")[0].alias("url"), "plain_text", F.lit(False).alias("failed"))
    return new.union(errors.select("uri", F.lit(None).cast("string"), F.lit(True)))


@query("sc05_valid_prefix", "select doc_id, text as prefix from documents")
def sc05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid part of texts with a broken end."""
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", binary.valid_utf8_prefix(F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))).alias("prefix"))


@query("sc30_encodings", "select doc_id, case when doc_id % 3 = 0 then 'utf-16' when doc_id % 3 = 1 and not regexp_matches(text, '^[\\x00-\\x7f]*$') and not regexp_matches(text, '[^\\x00-\\xff]') then 'windows-1252' else 'utf-8' end as encoding from documents".replace("\\\\", "\\"))
def sc30(spark: SparkSession, sf_dir: str) -> DataFrame:
    latin = (F.col("doc_id") % 3 == 1) & ~F.col("text").rlike(r"[^\x00-\xff]")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return _read(spark, sf_dir, "documents").select("doc_id", binary.guess_encoding(raw).alias("encoding"))


@query("q17_reports", """
select distinct url as uri, md5(url) as uri_md5, case when length(url) % 3 = 0 then 'second' else 'first' end as message from files where length(url) % 5 > 0""")
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports are saved twice for some files and forgotten for others."""
    f = _read(spark, sf_dir, "files").select(F.col("url").alias("uri")).distinct()
    empty = spark.createDataFrame([], reports.SCHEMA)
    one = reports.save(empty, f.select("uri", F.lit("first").alias("message"), F.lit(None).cast("string").alias("sparql")))
    two = reports.save(one, f.where(F.length("uri") % 3 == 0).select("uri", F.lit("second").alias("message"), F.lit(None).cast("string").alias("sparql")))
    return reports.forget(two, f.where(F.length("uri") % 5 == 0)).select("uri", "uri_md5", "message")


@query("src10_current_reports", f"select distinct url as uri from files where graph = '{FILE_SYSTEM}' and contains(url, '0')")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Catalog.load(spark, sf_dir).data_objects("url").withColumnRenamed("url", "uri")
    gone = spark.createDataFrame([("file:///gone/0",)], "uri string")
    saved = reports.save(spark.createDataFrame([], reports.SCHEMA), f.union(gone).select("uri", F.lit("x").alias("message"), F.lit(None).cast("string").alias("sparql")))
    return reports.current(saved, f.withColumnRenamed("uri", "url"), ["0"]).select("uri")


_TRIPLES = r"""
f as (select graph, url as s, unnest([{'p': 'nie:url', 'o': url}, {'p': 'nfo:fileName', 'o': file_name}, {'p': 'nfo:fileSize', 'o': file_size::varchar}, {'p': 'nfo:belongsToContainer', 'o': container_urn}, {'p': 'nie:dataSource', 'o': data_source}, {'p': 'tracker:extractorHash', 'o': extractor_hash}]) as x from files),
i as (select graph, urn as s, unnest([{'p': 'nie:mimeType', 'o': mime_type}, {'p': 'nie:title', 'o': title}, {'p': 'nie:comment', 'o': ie_comment}, {'p': 'nie:language', 'o': ie_language}, {'p': 'nfo:genre', 'o': genre}, {'p': 'nmm:artist', 'o': artist}, {'p': 'nmm:composer', 'o': composer}, {'p': 'nmm:lyricist', 'o': lyricist}, {'p': 'nmm:musicAlbum', 'o': album}, {'p': 'nmm:musicAlbumDisc', 'o': album_disc}]) as x from ies),
q as (select graph, s, x.p as p, x.o as o from f where x.o is not null union select graph, s, x.p, x.o from i where x.o is not null
union select graph, url, 'nie:interpretedAs', unnest(interpreted_as) from files union select graph, urn, 'rdf:type', unnest(rdf_types) from ies union select graph, urn, 'nie:isStoredAs', unnest(stored_as) from ies
union select graph, urn, 'nao:hasTag', unnest(tags) from ies union select graph, urn, 'nmm:performer', unnest(performers) from ies),
l as (select graph, s, case when p = 'rdf:type' then 'a' else p end || ' ' || case when p in ('rdf:type', 'nie:isStoredAs', 'nie:interpretedAs', 'nao:hasTag', 'nie:dataSource', 'nfo:belongsToContainer', 'nie:url') or regexp_full_match(o, '(urn|file):\S+')
then case when regexp_full_match(o, '[\w.-]+:[\w-]+') and not starts_with(o, 'urn:') then o else '<' || o || '>' end else '"' || replace(replace(replace(o, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"' end as l from q)"""


@query("q18_turtle", f"with {_TRIPLES} select s, '<' || s || '> ' || string_agg(l, ' ;' || chr(10) || '  ' order by l) || ' .' as text from (select distinct s, l from l) group by s")
def q18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every resource with all its properties."""
    return pipeline.as_turtle(stats.quads(Catalog.load(spark, sf_dir)))


@query("q18_trig", f"with {_TRIPLES} select graph, s, 'GRAPH ' || graph || ' {{ <' || s || '> ' || string_agg(l, ' ;' || chr(10) || '  ' order by l) || ' . }}' as text from (select distinct graph, s, l from l) group by graph, s")
def q18b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.as_turtle(stats.quads(Catalog.load(spark, sf_dir)), named_graphs=True)


@query("q18_jsonld", f"""
with {_TRIPLES}, v as (select s, p, '[' || string_agg(to_json(o)::varchar, ',' order by o) || ']' as vs from (select distinct s, p, o from q) group by s, p)
select s, '{{"@id":' || to_json(s)::varchar || coalesce(',"@type":' || max(vs) filter (p = 'rdf:type'), '') || ',"properties":{{' || coalesce(string_agg(to_json(p)::varchar || ':' || vs, ',' order by p) filter (p <> 'rdf:type'), '') || '}}}}' as json from v group by s""")
def q18c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every resource of every graph with all its properties."""
    return pipeline.as_jsonld(stats.quads(Catalog.load(spark, sf_dir)))


@query("q21_playlist_text", """
select l_orderkey as playlist, '#EXTM3U' || chr(10) || string_agg('song-' || l_partkey, chr(10) order by l_linenumber, 'song-' || l_partkey) || chr(10) as text from lineitem group by 1""")
def q21(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _read(spark, sf_dir, "lineitem")
    return pipeline.playlists_as_m3u(line.select(F.col("l_orderkey").alias("playlist"), F.col("l_linenumber").alias("position"), F.concat(F.lit("song-"), F.col("l_partkey").cast("string")).alias("url")))


@query("str15_changes", "select distinct graph, urn, case when length(urn) % 2 = 0 and mime_type is not null then 'update' else 'delete' end as change from ies where (length(urn) % 2 = 0 and mime_type is not null) or length(urn) % 3 = 0")
def str15(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _read(spark, sf_dir, "ies").select("graph", "urn", "mime_type")
    even = (F.length("urn") % 2 == 0) & F.col("mime_type").isNotNull()
    after = i.where(even | (F.length("urn") % 3 != 0)).withColumn("mime_type", F.when(even, F.concat("mime_type", F.lit("+new"))).otherwise(F.col("mime_type")))
    return queue.changed_graphs(i, after)


@query("w01_windows", """
select epoch_us(ts) // 3600000000 * 3600 as start, (epoch_us(ts) // 3600000000 + 1) * 3600 as "end", op, count(*) as n from change_events where ts is not null and op is not null group by 1, 2, 3""")
def w01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and kind."""
    return queue.windows(_read(spark, sf_dir, "change_events")).withColumns({c: F.unix_seconds(c) for c in ("start", "end")})


def _be(x, digits: int):
    """A number as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), digits, "0"))


def _le(x, digits: int):
    """A number as little-endian bytes."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * k).bitwiseAND(255)), 2, "0")) for k in range(digits // 2)])


def _sizes(df: DataFrame) -> DataFrame:
    p = lambda k: F.col("props")[k][0].cast("int")
    return extract(df).select("url", p("nfo:width").alias("width"), p("nfo:height").alias("height"))


@query("x08_abiword", "select s_suppkey::varchar as url, s_name as title, 'Supplier ' || s_nationkey || ' of ' || s_suppkey as plain_text from supplier")
def x08(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit('<abiword><metadata><m key="dc.title">'), "s_name", F.lit("</m></metadata><section><p>Supplier <c>"), F.col("s_nationkey").cast("string"), F.lit("</c></p><p>of "), F.col("s_suppkey").cast("string"), F.lit("</p></section></abiword>"))
    return extract(_as_files(_read(spark, sf_dir, "supplier"), "s_suppkey", F.encode(t, "UTF-8"), "abw", "application/x-abiword")).select("url", "title", "plain_text")


@query("x11_desktop", "select s_suppkey::varchar as url, case when s_nationkey % 3 > 0 then s_name end as title, case when s_nationkey % 3 > 0 then 'run ' || s_nationkey end as command, s_nationkey % 3 = 0 as failed from supplier")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries without a command are rejected."""
    t = F.concat(F.lit("[Desktop Entry]\nType=Application\nName="), "s_name", F.when(F.col("s_nationkey") % 3 > 0, F.concat(F.lit("\nExec=run "), F.col("s_nationkey").cast("string"))).otherwise(""), F.lit("\n"))
    out = extract(_as_files(_read(spark, sf_dir, "supplier"), "s_suppkey", F.encode(t, "UTF-8"), "desktop", "application/x-desktop"))
    return out.select("url", "title", F.col("props")["nfo:softwareCmdLine"][0].alias("command"), F.col("error").isNotNull().alias("failed"))


@query("x13_id3", "select c_custkey::varchar as url, c_name as title, c_mktsegment as artist, (c_nationkey + 1)::int as track from customer")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID3v2.4 frames for the title and the artist, an old tag at the end with a title that must not win."""
    frame = lambda name, v: F.concat(F.encode(F.lit(name), "US-ASCII"), _be(F.length(v) + 1, 8), F.unhex(F.lit("000003")), F.encode(v, "UTF-8"))
    track = (F.col("c_nationkey") + 1).cast("string")
    frames = F.concat(frame("TIT2", F.col("c_name")), frame("TPE1", F.col("c_mktsegment")), frame("TRCK", F.concat(track, F.lit("/99"))))
    old = F.encode(F.rpad(F.lit("TAGold title"), 128, " "), "US-ASCII")
    tag = F.concat(F.encode(F.lit("ID3"), "US-ASCII"), F.unhex(F.lit("040000")), _be(F.octet_length(frames) + F.shiftright(F.octet_length(frames), 7) * 128, 8), frames, old)
    out = extract(_as_files(_read(spark, sf_dir, "customer"), "c_custkey", tag, "mp3", "audio/mpeg"))
    return out.select("url", "title", F.col("props")["nmm:artist"][0].alias("artist"), F.col("props")["nmm:trackNumber"][0].cast("int").alias("track"))


_SIZES = "select p_partkey::varchar as url, p_size as width, (p_partkey % 5000 + 1)::int as height from part"


@query("x18_png", _SIZES)
def x18(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), _be(F.col("p_size"), 8), _be(F.col("p_partkey") % 5000 + 1, 8), F.unhex(F.lit("0806000000000000000000000049454E4400000000")))
    return _sizes(_as_files(_read(spark, sf_dir, "part"), "p_partkey", head, "png", "image/png"))


@query("x20_gif", _SIZES)
def x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.encode(F.lit("GIF89a"), "US-ASCII"), _le(F.col("p_size"), 4), _le(F.col("p_partkey") % 5000 + 1, 4), F.unhex(F.lit("0000003B")))
    return _sizes(_as_files(_read(spark, sf_dir, "part"), "p_partkey", head, "gif", "image/gif"))


@query("x22_bmp", _SIZES)
def x22(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.encode(F.lit("BM"), "US-ASCII"), F.unhex(F.lit("00" * 12)), _le(F.lit(40), 8), _le(F.col("p_size"), 8), _le(F.col("p_partkey") % 5000 + 1, 8))
    return _sizes(_as_files(_read(spark, sf_dir, "part"), "p_partkey", head, "bmp", "image/bmp"))


@query("x17_jpeg", _SIZES)
def x17(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.unhex(F.lit("FFD8FFC0000B08")), _be(F.col("p_partkey") % 5000 + 1, 4), _be(F.col("p_size"), 4), F.unhex(F.lit("01011100FFD9")))
    return _sizes(_as_files(_read(spark, sf_dir, "part"), "p_partkey", head, "jpeg", "image/jpeg"))


@query("sc31_octal", "select p_partkey, 'é ' || p_name as plain from part")
def sc31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", binary.octal_unescape(F.concat(F.lit("\\303\\251\\040"), "p_name")).alias("plain"))


@query("f12_usable_roots", "select url from (select distinct url from roots union select * from (values ('file:///proc/x'), ('file:///device'), ('file:///tmp'))) where not regexp_matches(url, '^file:///(dev|lib|proc|sys|tmp)(/|$)')")
def f12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kartei.operators.eligibility import usable_roots

    more = spark.createDataFrame([("file:///proc/x",), ("file:///device",), ("file:///tmp",)], "url string")
    return usable_roots(_read(spark, sf_dir, "roots").select("url").distinct().union(more))
