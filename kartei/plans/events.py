"""Queries of applied events, progress and monitors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kartei.catalog import FILE_SYSTEM, Catalog
from kartei.functions import dates
from kartei.operators import coalesce
from kartei.plans import stats
from kartei.plans.registry import query
from kartei.plans.sync import COALESCED
from kartei.streaming import apply


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/change_events.parquet")


@query("str03_monitor_cache", """
with e as (select distinct seq, file_url, case seq % 7 when 0 then 'CREATED' when 1 then 'CHANGED' when 2 then 'CHANGED' when 3 then 'CHANGES_DONE' when 4 then 'DELETED' when 5 then 'ATTRIBUTE_CHANGED' else 'CHANGES_DONE' end as op from change_events),
w as (select *, coalesce(sum(case when op in ('CHANGES_DONE', 'DELETED') then 1 else 0 end) over (partition by file_url order by seq rows between unbounded preceding and 1 preceding), 0) as burst from e where op <> 'ATTRIBUTE_CHANGED'),
p as (select file_url, burst, arg_min(op, seq) filter (op in ('CREATED', 'CHANGED')) as first, max(seq) as seq, arg_max(op, seq) as last from w group by 1, 2),
x as (select seq, case when last = 'DELETED' then case when first = 'CREATED' then null else 'DELETED' end when last = 'CHANGES_DONE' then case first when 'CREATED' then 'CREATED' when 'CHANGED' then 'UPDATED' end end as op, file_url, false as attributes_only from p)
select * from x where op is not null union all select seq, 'UPDATED', file_url, true from e where op = 'ATTRIBUTE_CHANGED'""")
def str03(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["CREATED", "CHANGED", "CHANGED", "CHANGES_DONE", "DELETED", "ATTRIBUTE_CHANGED", "CHANGES_DONE"]
    op = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("seq") % 7 + 1).cast("int"))
    return apply.cached_monitor_events(_events(spark, sf_dir).select("seq", "file_url", op.alias("op")).distinct())


@query("str09_delete_urls", f"""
with g as (select distinct file_url as a from change_events where op = 'DELETED' union select min(url) from folders)
select distinct graph, url from files where not exists (select 1 from g where url = g.a or starts_with(url, g.a || '/'))""")
def str09a(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    gone = _events(spark, sf_dir).where("op = 'DELETED'").select(F.col("file_url").alias("url")).union(c.folders.agg(F.min("url")))
    return apply.delete_urls(c, gone).files.select("graph", "url").distinct()


@query("str09_move_urls", """
with m as (select file_url as a, max(dest_url) as dest from change_events where op = 'MOVED' group by 1 union all select min(url), 'file:///moved/here' from folders),
n as (select f.url, arg_max(m.dest || substr(f.url, length(m.a) + 1), length(m.a)) as new from (select distinct url from files) f join m on f.url = m.a or starts_with(f.url, m.a || '/') group by 1)
select distinct f.graph, coalesce(n.new, f.url) as url, case when n.new is not null then regexp_extract(n.new, '[^/]*$') else f.file_name end as file_name from files f left join n using (url)""")
def str09b(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    moves = _events(spark, sf_dir).where("op = 'MOVED'").select(F.col("file_url").alias("src"), F.col("dest_url").alias("dest"))
    return apply.move_urls(c, moves.union(c.folders.select(F.min("url"), F.lit("file:///moved/here")))).files.select("graph", "url", "file_name").distinct()


@query("str09_apply", f"""
{COALESCED[0]}, q as ({COALESCED[1]}),
l as (select file_url as u, x.op as op, x.att as att, x.dest as dest from (select file_url, arg_max({{'op': op, 'att': coalesce(attributes_only, false), 'dest': dest_url}}, seq) as x from q group by 1)),
f1 as (select distinct graph, url, extractor_hash from files where not exists (select 1 from l where op = 'DELETED' and (url = u or starts_with(url, u || '/')))),
mv as (select f.url, arg_max(l.dest || substr(f.url, length(l.u) + 1), length(l.u)) as new from (select distinct url from f1) f join l on l.op = 'MOVED' and l.dest is not null and (f.url = l.u or starts_with(f.url, l.u || '/')) group by 1),
f2 as (select graph, coalesce(mv.new, f1.url) as url, extractor_hash from f1 left join mv using (url)),
fl as (select distinct url from files where graph = '{FILE_SYSTEM}' and url in (select u from l where op in ('CREATED', 'UPDATED') and not att))
select graph, url, extractor_hash from f2 where graph <> '{FILE_SYSTEM}' or url not in (select url from fl) union select '{FILE_SYSTEM}', url, null from fl""")
def str09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events coalesced and applied; the listing is the catalogue's own with the time of the events."""
    c = Catalog.load(spark, sf_dir)
    e = coalesce.coalesce_events(_events(spark, sf_dir))
    after = apply.apply_events(c, e, c.in_graph("files", FILE_SYSTEM))
    return after.files.select("graph", "url", "extractor_hash").distinct()


@query("str11_garbage", """
with g as (select distinct file_url as a from change_events where op = 'DELETED' union select min(url) from folders),
u as (select distinct u from (select unnest(stored_as) as u from ies) where exists (select 1 from g where u = g.a or starts_with(u, g.a || '/'))),
k as (select * from ies where not list_has_any(stored_as, (select list(u) from u))),
d as (select distinct album_disc as disc, album from ies where album_disc is not null and album_disc in (select album_disc from k)),
r as (select artist as urn from k union select composer from k union select lyricist from k union select unnest(performers) from k)
select 'disc' as kind, disc as id from d union select 'album', album from ies where album is not null and (album in (select album from d) or album in (select album from k))
union select 'artist', urn from artists where urn in (select urn from r where urn is not null)""")
def str11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of discs, albums and artists after a batch of deletions."""
    c = Catalog.load(spark, sf_dir)
    gone = _events(spark, sf_dir).where("op = 'DELETED'").select(F.col("file_url").alias("url")).union(c.folders.agg(F.min("url")))
    discs = c.ies.select(F.col("album_disc").alias("disc"), "album").where("disc is not null").distinct()
    after, discs, albums = apply.collect_garbage(apply.delete_urls(c, gone), discs, c.ies.select("album").where("album is not null").distinct())
    named = lambda df, kind, col: df.select(F.lit(kind).alias("kind"), F.col(col).alias("id"))
    return named(discs, "disc", "disc").union(named(albums, "album", "album")).union(named(after.artists, "artist", "urn")).distinct()


@query("a06_progress", f"""
with f as (select distinct url, data_source, extractor_hash, file_size from files where graph = '{FILE_SYSTEM}'), g as (select data_source, count(extractor_hash) as done, count(*) - count(extractor_hash) as remaining from f group by 1)
select data_source, done, remaining, round(done / (done + remaining)::double, 6) as progress, case when done > 0 and remaining > 0 then floor(60 / done::double * remaining)::bigint else 0 end as seconds_left from g""")
def a06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress per source and the time left, had the work so far taken a minute."""
    f = Catalog.load(spark, sf_dir).data_objects("url", "data_source", "extractor_hash", "file_size")
    g = f.groupBy("data_source").agg(F.count("extractor_hash").alias("done"), (F.count(F.lit(1)) - F.count("extractor_hash")).alias("remaining"))
    return g.select("data_source", "done", "remaining", F.round(F.col("done") / (F.col("done") + F.col("remaining")), 6).alias("progress"), dates.seconds_estimate(F.lit(60), F.col("done"), F.col("remaining")).alias("seconds_left"))


@query("a07_playlist_totals", "with n as (select l_orderkey, l_suppkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos from lineitem) select l_orderkey as playlist, count(*) as entries, sum(case when pos <= 3 then l_suppkey else 0 end)::bigint as seconds from n group by 1")
def a07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter and duration: entries past the kept ones count, their duration doesn't (here three are kept)."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "playlist")
    counter = line.groupBy("playlist").agg(F.count(F.lit(1)).alias("entries"))
    place = F.row_number().over(Window.partitionBy("playlist").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    kept = line.withColumn("place", place).where("place <= 3").groupBy("playlist").agg(F.sum("l_suppkey").alias("seconds"))
    return counter.join(kept, "playlist").select("playlist", "entries", "seconds")


@query("a08_values_by_property", """
with q as (select distinct graph, urn, unnest(['nie:mimeType', 'nie:title', 'nfo:genre']) as p, unnest([mime_type, title, genre]) as o from ies)
select p, count(distinct o) as kinds, count(*) as rows from q where o is not null group by 1""")
def a08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of each property."""
    q = stats.quads(Catalog.load(spark, sf_dir)).where("p in ('nie:mimeType', 'nie:title', 'nfo:genre')")
    per = q.groupBy("p", "o").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("p").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("rows"))
