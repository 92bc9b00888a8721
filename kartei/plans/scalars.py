"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.catalog import FILE_SYSTEM, Catalog
from kartei.functions import dates, media, paths, text, urns
from kartei.plans.registry import query


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BLANK = "regexp_matches({0}, '^\\s*$')"


@query("sc02_coalesce_strip", r"""
select distinct urn, coalesce(nullif(regexp_replace(title, '^\s+|\s+$', '', 'g'), ''), nullif(regexp_replace(ie_comment, '^\s+|\s+$', '', 'g'), ''), mime_type) as shown from ies""")
def sc02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of title, comment and type that isn't blank."""
    return _read(spark, sf_dir, "ies").select("urn", text.coalesce_strip(F.col("title"), F.col("ie_comment"), F.col("mime_type")).alias("shown")).distinct()


@query("sc03_merge", "select distinct urn, case when coalesce(genre, artist, album) is not null then concat_ws('*', genre, artist, album) end as merged from ies")
def sc03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "ies").select("urn", text.merge("*", F.col("genre"), F.col("artist"), F.col("album")).alias("merged")).distinct()


@query("sc04_normalize", r"select doc_id, array_to_string([w for w in regexp_split_to_array(text, '[^\p{L}]+') if w <> ''][1:20], ' ') as words from documents")
def sc04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.normalize_words(F.col("text"), 20).alias("words"))


@query("sc06_iso_dates", """
select distinct url, strftime(mtime, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(mtime) % 1000000 > 0 then '.' || lpad((epoch_us(mtime) % 1000000)::varchar, 6, '0') else '' end || 'Z' as utc,
strftime(mtime + interval 90 minute, '%Y-%m-%dT%H:%M:%S') || case when epoch_us(mtime) % 1000000 > 0 then '.' || lpad((epoch_us(mtime) % 1000000)::varchar, 6, '0') else '' end || '+01:30' as east from files where mtime is not null""")
def sc06(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _read(spark, sf_dir, "files").where("mtime is not null")
    return f.select("url", dates.format_iso8601(F.col("mtime")).alias("utc"), dates.format_iso8601(F.col("mtime"), 90).alias("east")).distinct()


@query("sc08_date_guess", """
select distinct url, strftime(mtime, '%Y-%m-%dT00:00:00+00:00') as day, strftime(mtime, '%Y-%m-%dT%H:%M:%S+00:00') as compact, strftime(mtime, '%Y-%m-%dT%H:%M:%SZ') as zulu,
strftime(mtime, '%Y-%m-%dT%H:%M:%S+00:00') as exif, strftime(mtime, '%Y-01-01T00:00:00Z') as year, cast(null as varchar) as none from files where mtime is not null""")
def sc08(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda p: dates.date_guess(F.date_format("mtime", p))
    f = _read(spark, sf_dir, "files").where("mtime is not null")
    return f.select("url", m("yyyy-MM-dd").alias("day"), m("yyyyMMddHHmmss").alias("compact"), m("yyyyMMddHHmmss'Z'").alias("zulu"), m("yyyy:MM:dd HH:mm:ss").alias("exif"), m("yyyy").alias("year"), m("'A'yyyy").alias("none")).distinct()


@query("sc09_same_name", """
with f as (select distinct container_urn, file_name from files where container_urn is not null and file_name is not null),
k as (select container_urn, lower(regexp_replace(file_name, '\\.[^.]*$', '')) as bare, file_name from f)
select container_urn, bare, count(*) as names from k group by 1, 2""".replace("\\\\", "\\"))
def sc09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder that share a name apart from letter case and ending."""
    f = _read(spark, sf_dir, "files").select("container_urn", "file_name").where("container_urn is not null and file_name is not null").distinct()
    return f.groupBy("container_urn", F.lower(F.regexp_replace("file_name", r"\.[^.]*$", "")).alias("bare")).agg(F.count(F.lit(1)).alias("names"))


@query("sc10_keywords", r"""
select doc_id, array_to_string(list_distinct_ordered, '|') as words from (select doc_id, [x for x, i in k if list_position(k, x) = i] as list_distinct_ordered from (
select doc_id, [regexp_replace(x, '^ | $', '', 'g') for x in string_split_regex(replace(text, '"', ''), '[,;]') if x <> ''] as k from documents))""")
def sc10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(text.keywords(F.replace("text", F.lit('"'), F.lit(""))), "|").alias("words"))


@query("sc11_in_path", "select distinct f.url, (select max(url) from roots where f.url = url or starts_with(f.url, url || '/')) as root from folders f")
def sc11(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = _read(spark, sf_dir, "folders").select("url").distinct(), _read(spark, sf_dir, "roots").select(F.col("url").alias("root")).distinct()
    from kartei.operators.prefix import deepest_prefix

    return deepest_prefix(f, "url", r.withColumn("base", F.col("root")), "base", ["root"])


@query("sc14_relative", """
select distinct f.url, case when starts_with(f.url, r.url || '/') then substr(f.url, length(r.url) + 2) end as below, case when starts_with(f.url, r.url || '/') then r.url || '/' || substr(f.url, length(r.url) + 2) end as again
from files f join roots r on r.urn = f.data_source""")
def sc14(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _read(spark, sf_dir, "files").select("url", "data_source").distinct()
    r = _read(spark, sf_dir, "roots").select(F.col("urn").alias("data_source"), F.col("url").alias("root")).distinct()
    below = paths.relative_to(F.col("url"), F.col("root"))
    return f.join(r, "data_source").select("url", below.alias("below"), paths.resolve_relative(F.concat(F.lit("file:"), below), F.col("root")).alias("again")).distinct()


@query("sc15_object_path", r"select distinct url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '_', '_5f', 'g'), ':', '_3a', 'g'), '/', '_2f', 'g'), '-', '_2d', 'g'), '\.', '_2e', 'g') as path from folders")
def sc15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "folders").select("url", paths.object_path(F.col("url")).alias("path")).distinct()


@query("sc16_durations", """
with s as (select seq, epoch(received)::bigint - epoch(ts)::bigint as s from (select distinct seq, ts, received from change_events) where ts is not null and received is not null),
p as (select seq, s, s // 86400 as d, s // 3600 % 24 as h, s // 60 % 60 as m, s % 60 as x from s where s >= 0)
select seq, s as seconds, case when s = 0 then 'less than one second' else concat_ws(' ', case when d > 0 then d || 'd' end, case when h > 0 then lpad(h::varchar, 2, '0') || 'h' end, case when m > 0 then lpad(m::varchar, 2, '0') || 'm' end, case when x > 0 then lpad(x::varchar, 2, '0') || 's' end) end as shown from p""")
def sc16(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "change_events").select("seq", (F.unix_seconds("received") - F.unix_seconds("ts")).alias("seconds")).where("seconds >= 0").distinct()
    return e.select("seq", "seconds", dates.seconds_to_string(F.col("seconds")).alias("shown"))


@query("sc17_ellipsize", """
select distinct urn, case when length(title) < 12 then title else left(title, 11) || '…' end as at_end, case when length(title) < 12 then title else '…' || right(title, 11) end as at_start from ies where title is not null""")
def sc17(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _read(spark, sf_dir, "ies").where("title is not null")
    return i.select("urn", text.ellipsize(F.col("title"), 12).alias("at_end"), text.ellipsize(F.col("title"), 12, False).alias("at_start")).distinct()


@query("sc18_extension_changed", r"""
select distinct seq, nullif(regexp_extract(file_url, '\.[^./]*$'), '') is distinct from nullif(regexp_extract(dest_url, '\.[^./]*$'), '') as changed from change_events where op = 'MOVED'""")
def sc18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "change_events").where("op = 'MOVED'").select("seq", text.extension_changed(F.col("file_url"), F.col("dest_url")).alias("changed")).distinct()


@query("sc19_title_from_name", r"select distinct url, replace(case when starts_with(file_name, '.') then substr(file_name, 2) else regexp_replace(file_name, '\.[^.]*$', '') end, '_', ' ') as title from files")
def sc19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "files").select("url", text.title_from_name(F.col("file_name")).alias("title")).distinct()


@query("sc20_enums", """
select p_partkey, case p_size % 9 when 2 then 'nfo:orientation-top-mirror' when 3 then 'nfo:orientation-bottom' when 4 then 'nfo:orientation-bottom-mirror' when 5 then 'nfo:orientation-left-mirror' when 6 then 'nfo:orientation-right' when 7 then 'nfo:orientation-right-mirror' when 8 then 'nfo:orientation-left' else 'nfo:orientation-top' end as orientation,
case when p_size % 2 = 1 then 'nmm:flash-on' else 'nmm:flash-off' end as flash,
case p_size % 8 when 1 then 'nmm:metering-mode-average' when 2 then 'nmm:metering-mode-center-weighted-average' when 3 then 'nmm:metering-mode-spot' when 4 then 'nmm:metering-mode-multispot' when 5 then 'nmm:metering-mode-pattern' when 6 then 'nmm:metering-mode-partial' else 'nmm:metering-mode-other' end as metering,
case when p_size % 2 = 1 then 'nmm:white-balance-manual' else 'nmm:white-balance-auto' end as white_balance from part""")
def sc20(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    return _read(spark, sf_dir, "part").select("p_partkey", media.orientation(s % 9).alias("orientation"), media.flash(s).alias("flash"), media.metering(s % 8).alias("metering"), media.white_balance(s % 2).alias("white_balance"))


@query("sc22_ratio_gps", """
select c_custkey, case when c_nationkey = 0 then null else c_custkey / c_nationkey::double end as ratio, round(case when c_nationkey % 2 = 0 then 1 else -1 end * (c_custkey % 90 + c_nationkey / 60.0), 9) as degrees from customer""")
def sc22(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    gps = F.concat((k % 90).cast("string"), F.lit(","), n.cast("string"), F.lit(".0"), F.when(n % 2 == 0, "N").otherwise("S"))
    return _read(spark, sf_dir, "customer").select("c_custkey", media.ratio(F.concat(k.cast("string"), F.lit("/"), n.cast("string"))).alias("ratio"), F.round(media.gps_coordinate(gps), 9).alias("degrees"))


@query("sc25_genre_numbers", r"""
select distinct urn, try_cast(coalesce(nullif(regexp_extract(genre, '^\((\d+)\)', 1), ''), nullif(regexp_extract(genre, '(\d+)$', 1), '')) as integer) as number from ies where genre is not null""")
def sc25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "ies").where("genre is not null").select("urn", media.genre_number(F.col("genre")).alias("number")).distinct()


@query("sc26_profiles", """
with p as (select p_partkey, p_size * 100 as w, (p_partkey % 50) * 100 as h from part)
select p_partkey, case when w <= 640 and h <= 480 then 'JPEG_SM' when w <= 1024 and h <= 768 then 'JPEG_MED' when w <= 4096 and h <= 4096 then 'JPEG_LRG' end as jpeg,
case when w = 120 and h = 120 then 'PNG_LRG_ICO' when w = 48 and h = 48 then 'PNG_SM_ICO' when w <= 160 and h <= 160 then 'PNG_TN' when w <= 4096 and h <= 4096 then 'PNG_LRG' end as png from p""")
def sc26(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), (F.col("p_partkey") % 50 * 100).alias("h"))
    return p.select("p_partkey", media.jpeg_profile(F.col("w"), F.col("h")).alias("jpeg"), media.png_profile(F.col("w"), F.col("h"), F.lit(32)).alias("png"))


@query("sc27_urns", """
select distinct artist_name, 'urn:artist:' || url_encode(artist_name) as artist, 'urn:tag:' || url_encode(artist_name) as tag,
'urn:album:' || url_encode(artist_name) || ':' || url_encode('The ' || artist_name) || ':2001-02-03' as album, 'urn:album-disc:' || url_encode(artist_name) || ':' || url_encode('The ' || artist_name) || ':2001-02-03:Disc1' as disc,
'urn:tv-season:' || url_encode(artist_name || '-S 7') as season from artists""")
def sc27(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("artist_name")
    album = urns.album(n, F.concat(F.lit("The "), n), F.lit("2001-02-03T04:05:06Z"))
    return _read(spark, sf_dir, "artists").select("artist_name", urns.artist(n).alias("artist"), urns.tag(n).alias("tag"), album.alias("album"), urns.album_disc(album, F.lit(0)).alias("disc"), urns.tv_season(n, F.lit(7)).alias("season")).distinct()


@query("sc33_namespaces", """
select distinct t as name, 'http://www.semanticdesktop.org/ontologies/2007/03/22/nfo#' || substr(t, 5) as full_name, t as again from (select unnest(rdf_types) as t from ies) where starts_with(t, 'nfo:')""")
def sc33(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "ies").select(F.explode("rdf_types").alias("name")).where("name like 'nfo:%'").distinct()
    full = paths.expand_uri(F.col("name"), paths.NAMESPACES)
    return t.select("name", full.alias("full_name"), paths.compress_uri(full, paths.NAMESPACES).alias("again"))


@query("sc01_builtins", f"""
select distinct url, contains(url, '/vault/') as has, upper(file_name) as up, split_part(file_name, '.', 1) as before, year(mtime)::int as y, month(mtime)::int as m, md5(url) as md5, sha256(url) as sha, round(file_size / 1024.0, 3) as kib, ceil(file_size / 1000.0)::bigint as c
from files where graph = '{FILE_SYSTEM}' and mtime is not null and file_size is not null""")
def sc01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint built-ins."""
    f = Catalog.load(spark, sf_dir).in_graph("files", FILE_SYSTEM).where("mtime is not null and file_size is not null")
    return f.select("url", F.contains("url", F.lit("/vault/")).alias("has"), F.upper("file_name").alias("up"), F.split_part("file_name", F.lit("."), F.lit(1)).alias("before"), F.year("mtime").alias("y"), F.month("mtime").alias("m"), F.md5("url").alias("md5"), F.sha2("url", 256).alias("sha"), F.round(F.col("file_size") / 1024.0, 3).alias("kib"), F.ceil(F.col("file_size") / 1000.0).alias("c")).distinct()


@query("f15_class_filter", """
select class, count(*) as n from (select urn, unnest(rdf_types) as class from (select distinct urn, rdf_types from ies))
where list_contains([x for x in regexp_split_to_array(lower(class), '[^a-z]+') if x <> ''], 'photo') or list_contains([x for x in regexp_split_to_array(lower(class), '[^a-z]+') if x <> ''], 'audio') group by 1""")
def f15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class statistics of the classes whose words match a term."""
    e = _read(spark, sf_dir, "ies").select("urn", "rdf_types").distinct().select(F.explode("rdf_types").alias("class"))
    words = F.split(F.lower("class"), "[^a-z]+")
    return e.where(F.arrays_overlap(words, F.array(F.lit("photo"), F.lit("audio")))).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("sc07_parse", "select distinct url, strftime(mtime, '%Y-%m-%dT%H:%M:%S+00:00') as shown, cast(null as varchar) as none from files where mtime is not null")
def sc07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in one given pattern; text in another one is NULL."""
    f = _read(spark, sf_dir, "files").where("mtime is not null")
    return f.select("url", dates.parse_with(F.date_format("mtime", "dd/MM/yyyy HH.mm.ss"), "dd/MM/yyyy HH.mm.ss").alias("shown"), dates.parse_with(F.date_format("mtime", "yyyy"), "dd/MM/yyyy HH.mm.ss").alias("none")).distinct()


@query("sc23_sc24_regions", """
select c_custkey, case c_nationkey % 6 when 0 then 'nfo:roi-content-face' when 1 then 'nfo:roi-content-pet' when 2 then 'nfo:roi-content-focus' when 3 then 'nfo:roi-content-barcode' when 4 then 'nfo:roi-content-undefined' else 'nfo:region-content-undefined' end as region,
case when c_nationkey % 2 = 0 then 'nfo:orientation-left' else 'nfo:orientation-top' end as iptc from customer""")
def sc24(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("Face", "PETS", "focus point", "BarCode", "other", None)])
    k = F.col("c_nationkey")
    return _read(spark, sf_dir, "customer").select("c_custkey", media.region_type(F.element_at(names, (k % 6 + 1).cast("int"))).alias("region"), media.iptc_orientation(F.when(k % 2 == 0, "P").otherwise("L")).alias("iptc"))


@query("sc28_content_ids", "select distinct url, url || case when length(url) % 2 = 0 then '/' || length(url) else '' end as part, 'urn:child:' || sha256(url || chr(10) || '3') as child from files")
def sc28(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _read(spark, sf_dir, "files").select("url").distinct()
    suffix = F.when(F.length("url") % 2 == 0, F.length("url").cast("string"))
    return f.select("url", urns.content_id(F.col("url"), suffix).alias("part"), urns.child_id(F.col("url"), F.lit(3)).alias("child"))
