"""Queries of the synchronisation operators: diff, coalescing, eligibility, rules and mutations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.catalog import FILE_SYSTEM, Catalog
from kartei.operators import coalesce, diff, eligibility, monitor, mutations, rules
from kartei.plans.registry import query

# The folder the mutation queries work on: the first one by url.
_FOLDER_SQL = "(select min(url) from folders)"
_FILE_SQL = "(select min(url) from files)"


def _folder(c: Catalog) -> str:
    return c.folders.agg(F.min("url")).first()[0]


def _file(c: Catalog) -> str:
    return c.files.agg(F.min("url")).first()[0]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/change_events.parquet")


def _keys(c: Catalog) -> DataFrame:
    """What is left: (kind, graph, key)."""
    return c.files.select(F.lit("file").alias("kind"), "graph", F.col("url").alias("key")).union(c.ies.select(F.lit("ie"), "graph", "urn")).distinct()


def _keys_sql(files: str, ies: str) -> str:
    return f"select 'file' as kind, graph, url as key from files where {files} union select 'ie', graph, urn from ies where {ies}"


@query("q01_delete_file", _keys_sql(f"url <> {_FILE_SQL}", f"not list_contains(stored_as, {_FILE_SQL})"))
def q01(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return _keys(mutations.delete_file(c, _file(c)))


_BELOW = f"starts_with({{0}}, {_FOLDER_SQL} || '/')"


@query("q02_delete_subtree", _keys_sql(f"not {_BELOW.format('url')}", f"(graph, urn) not in (select (graph, urn) from (select graph, urn, unnest(stored_as) as u from ies) where {_BELOW.format('u')})"))
def q02(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return _keys(mutations.delete_folder_contents(c, _folder(c)))


@query("q03_delete_content", f"""
select distinct graph, url, case when not (url = {_FILE_SQL} and graph = '{FILE_SYSTEM}') then extractor_hash end as extractor_hash from files""")
def q03(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return mutations.delete_file_content(c, _file(c)).files.select("graph", "url", "extractor_hash").distinct()


_ROOT = "(select min(url) from roots)"
_ROOT_URN = f"(select urn from roots where url = {_ROOT})"


@query("q04_delete_root", _keys_sql(f"data_source not in {_ROOT_URN}", f"urn not in (select urn from (select urn, unnest(stored_as) as u from ies) where u in (select url from files where graph = '{FILE_SYSTEM}' and data_source in {_ROOT_URN}))"))
def q04(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return _keys(mutations.delete_index_root(c, c.roots.agg(F.min("url")).first()[0]))


@query("q05_move_file", f"""
with p as (select {_FILE_SQL} as src, {_FOLDER_SQL} as dir)
select distinct graph, case when url = src then dir || '/moved.bin' else url end as url, case when url = src then 'moved.bin' else file_name end as file_name,
case when url = src then case when graph = '{FILE_SYSTEM}' then (select max(urn) from folders where url = dir) end else container_urn end as container_urn, epoch_us(mtime) as mtime from files, p""")
def q05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return mutations.move_file(c, _file(c), f"{_folder(c)}/moved.bin").files.select("graph", "url", "file_name", "container_urn", F.unix_micros("mtime").alias("mtime")).distinct()


@query("q06_move_subtree", f"""
with p as (select {_FOLDER_SQL} as src)
select distinct 'file' as kind, graph, case when starts_with(url, src || '/') then 'file:///elsewhere/' || substr(url, length(src) + 2) else url end as key from files, p
union select 'ie', graph, case when starts_with(u, src || '/') then 'file:///elsewhere/' || substr(u, length(src) + 2) else u end from (select graph, unnest(stored_as) as u from ies), p""")
def q06(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    m = mutations.move_folder_contents(c, _folder(c), "file:///elsewhere")
    return m.files.select(F.lit("file").alias("kind"), "graph", F.col("url").alias("key")).union(m.ies.select(F.lit("ie"), "graph", F.explode("stored_as"))).distinct()


# Stale discs, albums and artists are made by taking away the songs of every second artist.
_KEPT = "(select * from ies where artist is null or length(artist) % 2 = 0)"


def _kept(c: Catalog) -> Catalog:
    from dataclasses import replace

    return replace(c, ies=c.ies.where(F.col("artist").isNull() | (F.length("artist") % 2 == 0)))


@query("q07_discs", f"select distinct album_disc as disc, album from ies where album_disc is not null and album_disc in (select album_disc from {_KEPT})")
def q07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    discs = c.ies.select(F.col("album_disc").alias("disc"), "album").where("disc is not null").distinct()
    return mutations.orphan_discs(_kept(c), discs)


@query("q08_albums", f"""
with d as (select distinct album_disc, album from ies where album_disc is not null and album_disc in (select album_disc from {_KEPT}))
select distinct album from ies where album is not null and (album in (select album from d) or album in (select album from {_KEPT}))""")
def q08(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    k = _kept(c)
    discs = mutations.orphan_discs(k, c.ies.select(F.col("album_disc").alias("disc"), "album").where("disc is not null").distinct())
    return mutations.orphan_albums(k, c.ies.select("album").where("album is not null").distinct(), discs)


@query("q09_artists", f"""
with r as (select artist as urn from {_KEPT} union select composer from {_KEPT} union select lyricist from {_KEPT} union select unnest(performers) from {_KEPT})
select distinct urn, artist_name from artists where urn in (select urn from r where urn is not null)""")
def q09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.orphan_artists(_kept(Catalog.load(spark, sf_dir))).artists.select("urn", "artist_name").distinct()


@query("q10_mount", f"select urn, url, case when url = {_ROOT} then false else available end as available from roots")
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return mutations.set_available(c, c.roots.agg(F.min("url")).first()[0], False).roots.select("urn", "url", "available")


@query("src07_mounts", """
with r as (select distinct * from roots), up as (select url from r where length(url) % 2 = 0 union select 'file:///media/new'), down as (select url from r where is_removable and length(url) % 3 = 0)
select urn, url, case when url in (select url from down) then false when url in (select url from up) then true else available end as available, is_removable from r
union all select 'urn:root:new', 'file:///media/new', true, true""")
def src07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes appear, one of them for the first time, and some removable ones go again."""
    c = Catalog.load(spark, sf_dir)
    c = replace(c, roots=c.roots.distinct())
    new = spark.createDataFrame([("urn:root:new", "file:///media/new")], "urn string, url string")
    c = mutations.mount(c, c.roots.where(F.length("url") % 2 == 0).select("urn", "url").union(new))
    return mutations.unmount(c, c.roots.where("length(url) % 3 = 0 and url <> 'file:///media/new'").select("url")).roots.select("urn", "url", "available", "is_removable")


@query("src07_forgotten", """
with g as (select distinct urn from roots where is_removable and length(url) % 3 = 0)
select 'file' as kind, url from files where data_source is null or data_source not in (select urn from g) union select 'root', url from roots where urn not in (select urn from g)""")
def src07b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes that are gone for good take their files along."""
    c = Catalog.load(spark, sf_dir)
    d = mutations.unmount(c, c.roots.where("length(url) % 3 = 0").select("url"), keep=False)
    return d.files.select(F.lit("file").alias("kind"), "url").union(d.roots.select(F.lit("root"), "url")).distinct()


@query("q11_update_hash", f"select distinct graph, url, case when graph = '{FILE_SYSTEM}' then coalesce('new-' || length(url), extractor_hash) else extractor_hash end as extractor_hash from files")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    hashes = c.data_objects("url").select("url", F.concat(F.lit("new-"), F.length("url").cast("string")).alias("hash"))
    return mutations.update_hashes(c, hashes).files.select("graph", "url", "extractor_hash").distinct()


@query("q12_drop_copies", f"""
select 'file' as kind, graph, url as key from files where url <> {_FILE_SQL} or graph = '{FILE_SYSTEM}'
union select 'ie', graph, urn from ies where (graph, urn) not in (select (graph, i) from (select graph, unnest(interpreted_as) as i from files where url = {_FILE_SQL} and graph <> '{FILE_SYSTEM}'))""")
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return _keys(mutations.drop_content_copies(c, _file(c)))


@query("q13_insert_tag", """
select distinct pref_label, description from tags union
select distinct genre, cast(null as varchar) from ies where genre is not null and genre not in (select pref_label from tags)""")
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genres as tags."""
    c = Catalog.load(spark, sf_dir)
    wanted = c.ies.select(F.col("genre").alias("pref_label"), F.lit(None).cast("string").alias("description")).where("pref_label is not null").distinct()
    return mutations.insert_tags(c, wanted).tags.select("pref_label", "description").distinct()


@query("q14_tag_files", f"""
with t as (select min(urn) as tag from tags where pref_label = (select min(pref_label) from tags)),
u as (select graph, urn, stored_as, unnest(tags) as tag from ies union select graph, urn, stored_as, t.tag from ies, t where (graph, urn) in (select (graph, urn) from (select graph, urn, unnest(stored_as) as u from ies) where {_BELOW.format('u')}))
select distinct graph, urn, tag from u""")
def q14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    label = c.tags.agg(F.min("pref_label")).first()[0]
    links = c.ies.select(F.explode("stored_as").alias("url")).where(mutations.below(F.col("url"), _folder(c))).distinct().withColumn("pref_label", F.lit(label))
    return mutations.tag_files(c, links).ies.select("graph", "urn", F.explode("tags").alias("tag")).distinct()


@query("q14_delete_tag", "select distinct graph, urn, tag from (select graph, urn, unnest(tags) as tag from ies) where tag not in (select urn from tags where pref_label = (select min(pref_label) from tags))")
def q14b(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return mutations.untag(c, c.tags.agg(F.min("pref_label")).first()[0], drop_tag=True).ies.select("graph", "urn", F.explode("tags").alias("tag")).distinct()


_IN = f"(u = {_FOLDER_SQL} or {_BELOW.format('u')})"


@query("q15_reset", f"""
with h as (select distinct u from (select unnest(stored_as) as u from ies) where {_IN})
select 'file' as kind, graph, url as key from files where url not in (select u from h) union select 'ie', graph, urn from ies where (graph, urn) not in (select (graph, urn) from (select graph, urn, unnest(stored_as) as u from ies) where {_IN})""")
def q15(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return _keys(mutations.reset_folder(c, _folder(c)))


@query("q16_upsert", f"""
with e as (select file_url as url, max(seq) as seq from change_events where op in ('CREATED', 'UPDATED') and not is_dir group by 1),
x as (select e.url, arg_max(v.ts, v.seq) as ts from e join change_events v on v.file_url = e.url and v.op in ('CREATED', 'UPDATED') and not v.is_dir group by 1)
select f.url, epoch_us(coalesce(x.ts, f.mtime)) as mtime from (select distinct url, mtime from files where graph = '{FILE_SYSTEM}') f left join x using (url)""")
def q16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute updates: the time of the last event of every file."""
    c = Catalog.load(spark, sf_dir)
    e = _events(spark, sf_dir).where("op in ('CREATED', 'UPDATED') and not is_dir").select("seq", "ts", "file_url").distinct()
    known = {"graph": F.lit(FILE_SYSTEM), "url": F.col("file_url"), "mtime": F.col("ts")}
    rows = e.select("seq", *[known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in c.files.schema.fields])
    return mutations.upsert_files(c, rows, attributes_only=True).in_graph("files", FILE_SYSTEM).select("url", F.unix_micros("mtime").alias("mtime")).distinct()


@query("r29_init_roots", """
with c as (select url, is_removable as volume from roots where length(url) % 3 > 0 union select 'file:///new/volume', true union select 'file:///new/folder', false)
select coalesce(r.url, c.url) as url, case when r.url is not null and c.url is not null and coalesce(r.is_removable, false) then 'available' when r.url is not null and c.url is not null then 'keep'
when r.url is not null and coalesce(r.is_removable, false) then 'unavailable' when r.url is not null then 'delete' when coalesce(c.volume, false) then 'add available' else 'add' end as action
from (select distinct url, is_removable from roots) r full join c using (url)""")
def r29(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    new = spark.createDataFrame([("file:///new/volume", True), ("file:///new/folder", False)], "url string, is_volume boolean")
    asked = c.roots.where(F.length("url") % 3 > 0).select("url", F.col("is_removable").alias("is_volume")).union(new)
    return mutations.reconcile_roots(c.roots, asked)


# A listing of the disk made from the catalogue: some files gone, some touched, some new.
_DISK = f"""
s as (select url, any_value(mtime) as mtime, any_value(file_size) as size, any_value(extractor_hash) as hash, any_value(ie) as ie from (select *, interpreted_as[1] as ie from files where graph = '{FILE_SYSTEM}') group by 1),
st as (select s.url, s.mtime, s.size, s.hash, i.mime from s left join (select urn, max(mime_type) as mime from ies group by 1) i on i.urn = s.ie),
d as (select url, case when coalesce(size, 0) % 7 = 0 then mtime + interval 1 second else mtime end as mtime from s where coalesce(size, 1) % 11 > 0
union all select url || '.new', mtime from s where coalesce(size, 0) % 13 = 0),
k as (select mime, max(hash) as now from st where mime is not null group by 1),
x as (select coalesce(d.url, st.url) as url, case when st.url is null then 'CREATE' when d.url is null then 'DELETE' when d.mtime is distinct from st.mtime then 'UPDATE'
when st.hash is distinct from k.now then 'EXTRACTOR_UPDATE' else 'NONE' end as state from d full join st on d.url = st.url left join k on k.mime = st.mime)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    s = c.data_objects("url", "mtime", "file_size", "extractor_hash", "interpreted_as").select("url", "mtime", "file_size", "extractor_hash", F.try_element_at("interpreted_as", F.lit(1)).alias("ie"))
    mimes = c.ies.groupBy(F.col("urn").alias("ie")).agg(F.max("mime_type").alias("mime_type"))
    store = s.join(mimes, "ie", "left")
    touched = F.when(F.coalesce("file_size", F.lit(0)) % 7 == 0, F.col("mtime") + F.expr("interval 1 second")).otherwise(F.col("mtime"))
    disk = s.where(F.coalesce("file_size", F.lit(1)) % 11 > 0).select("url", touched.alias("mtime")).unionByName(s.where(F.coalesce("file_size", F.lit(0)) % 13 == 0).select(F.concat("url", F.lit(".new")).alias("url"), "mtime"))
    now = store.where("mime_type is not null").groupBy("mime_type").agg(F.max("extractor_hash").alias("hash"))
    return diff.classify(disk, store, now)


@query("str06_state", f"with {_DISK} select url, state from x")
def str06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


@query("a04_state_counts", f"with {_DISK} select state, count(*) as n from x group by 1")
def a04(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("str07_suppress", f"""
with {_DISK}, t as (select url, 'DELETE' as state, true as dir from folders where length(url) % 2 = 0),
y as (select url, state, false as dir from x union all select * from t)
select url, state from y where not (state = 'DELETE' and exists (select 1 from t where starts_with(y.url, t.url || '/')))""")
def str07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    gone = c.folders.where(F.length("url") % 2 == 0).select("url", F.lit("DELETE").alias("state")).distinct()
    return diff.suppress_below_deleted(_states(spark, sf_dir).unionByName(gone), gone)


@query("str08_finish", f"with {_DISK} select regexp_replace(url, '/[^/]*$', '') as folder, count(*) as changes, len(string_split(regexp_replace(url, '/[^/]*$', ''), '/'))::int - 3 as depth from x where state <> 'NONE' group by 1, 3")
def str08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.finish_directories(_states(spark, sf_dir))


#: The queue one event after the other: common tables and the select of what is left.
COALESCED = (
    """with recursive e0 as (select distinct seq, op, file_url, dest_url, is_dir, attributes_only from change_events where op is not null and file_url is not null and seq is not null),
g as (select file_url as a, max(seq) as last from e0 where op = 'DELETED' and is_dir group by 1),
e as (select * from e0 where not exists (select 1 from g where starts_with(e0.file_url, g.a || '/') and g.last > e0.seq)),
b as (select file_url as key, seq, 0 as second, case op when 'CREATED' then 1 when 'DELETED' then 4 when 'MOVED' then 5 else case when coalesce(attributes_only, false) then 3 else 2 end end as kind, op, dest_url, is_dir, attributes_only from e
union all select dest_url, seq, 1, 6, op, null, is_dir, attributes_only from e where op = 'MOVED' and dest_url is not null),
n as (select *, row_number() over (partition by key order by seq, second) as rn from b),
r as (select key, rn, seq, kind, case when kind in (5, 6) then 0 else kind end as state, 0 as effect from n where rn = 1
union all select n.key, n.rn, n.seq, n.kind,
case when (r.state = 2 and n.kind in (2, 3)) or (r.state = 3 and n.kind = 3) or (r.state = 4 and n.kind = 4) then r.state when n.kind in (5, 6) then 0 else n.kind end,
case when (r.state = 2 and n.kind in (2, 3)) or (r.state = 3 and n.kind = 3) or (r.state = 4 and n.kind = 4) then 2
when (r.state = 1 and n.kind in (1, 2, 4, 5)) or (r.state = 2 and n.kind = 4) or (r.state = 3 and n.kind in (2, 4)) then 1 else 0 end
from r join n on n.key = r.key and n.rn = r.rn + 1),
c as (select r.*, lead(effect) over (partition by key order by rn) as after from r where effect <> 2)""",
    """select n.seq, case when n.kind = 5 and c.effect = 1 then 'CREATED' else n.op end as op, case when n.kind = 5 and c.effect = 1 then n.dest_url else n.key end as file_url,
case when not (n.kind = 5 and c.effect = 1) then n.dest_url end as dest_url, n.is_dir, n.attributes_only
from c join n on n.key = c.key and n.rn = c.rn where coalesce(c.after, 0) <> 1 and n.kind <> 6""",
)


@query("str01_coalesce", "\n".join(COALESCED))
def str01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coalesce.coalesce_events(_events(spark, sf_dir))


@query("str02_purge", """
with e as (select distinct seq, file_url, case when seq % 5 = 0 then 'DELETED' else op end as op, is_dir from change_events),
g as (select file_url as a, max(seq) as last from e where op = 'DELETED' and is_dir group by 1)
select seq, file_url, op, is_dir from e where not exists (select 1 from g where starts_with(e.file_url, g.a || '/') and g.last > e.seq)""")
def str02(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("seq", "file_url", F.when(F.col("seq") % 5 == 0, "DELETED").otherwise(F.col("op")).alias("op"), "is_dir").distinct()
    return coalesce.purge_below_deleted(e)


@query("str04_pair_moves", """
with e as (select distinct seq, case when seq % 3 = 0 then 'MOVED_FROM' when seq % 3 = 1 and seq % 2 = 0 then 'MOVED_TO' else op end as op, file_url, is_dir from change_events),
m as (select t.seq, f.seq as from_seq, f.file_url as src, t.file_url as dst, t.is_dir from e t join e f on f.seq = t.seq - 1 and f.op = 'MOVED_FROM' where t.op = 'MOVED_TO')
select seq, 'MOVED' as op, src as file_url, dst as dest_url, is_dir from m
union all select seq, case op when 'MOVED_FROM' then 'DELETED' when 'MOVED_TO' then 'CREATED' else op end, file_url, null, is_dir from e where seq not in (select seq from m) and seq not in (select from_seq from m)""")
def str04(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("seq")
    op = F.when(q % 3 == 0, "MOVED_FROM").when((q % 3 == 1) & (q % 2 == 0), "MOVED_TO").otherwise(F.col("op"))
    return monitor.pair_moves(_events(spark, sf_dir).select("seq", op.alias("op"), "file_url", "is_dir").distinct())


@query("str05_translate", r"""
with e as (select distinct seq, op, file_url, dest_url, is_dir, coalesce(attributes_only, false) as attrs, length(file_url) % 5 > 0 as ok, length(dest_url) % 4 > 0 as dok, length(file_url) % 7 > 0 as pok, seq % 6 > 0 as mon from change_events where op is not null),
x as (select seq, 0 as part, 'DELETED' as op, regexp_replace(file_url, '/[^/]*$', '') as file_url, cast(null as varchar) as dest_url, true as is_dir, false as attributes_only from e where op = 'CREATED' and not is_dir and not pok
union all select seq, 0, 'CREATED', file_url, null, is_dir, false from e where op = 'CREATED' and (is_dir or pok) and ok
union all select seq, 0, op, file_url, null, is_dir, attrs from e where op in ('UPDATED', 'DELETED') and ok
union all select seq, 0, 'UPDATED', dest_url, null, is_dir, false from e where op = 'MOVED' and mon and not ok and dok
union all select seq, 0, 'DELETED', file_url, null, is_dir, false from e where op = 'MOVED' and mon and ok and not dok
union all select seq, 0, 'DELETED', dest_url, null, is_dir, false from e where op = 'MOVED' and mon and ok and dok and not is_dir
union all select seq, case when is_dir then 0 else 1 end, 'MOVED', file_url, dest_url, is_dir, false from e where op = 'MOVED' and mon and ok and dok
union all select seq, case when is_dir then 1 else 2 end, 'UPDATED', dest_url, null, is_dir, false from e where op = 'MOVED' and mon and ok and dok and nullif(regexp_extract(file_url, '\.[^./]*$'), '') is distinct from nullif(regexp_extract(dest_url, '\.[^./]*$'), ''))
select * from x""")
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = {"indexable": F.length("file_url") % 5 > 0, "dest_indexable": F.length("dest_url") % 4 > 0, "parent_indexable": F.length("file_url") % 7 > 0, "source_monitored": F.col("seq") % 6 > 0}
    e = _events(spark, sf_dir).where("op is not null").select("seq", "op", "file_url", "dest_url", "is_dir", "attributes_only").distinct()
    return monitor.translate(e.withColumns(flags))


def _objects(c: Catalog) -> DataFrame:
    files = c.data_objects("url").select("url", F.lit(False).alias("is_dir"), F.startswith(eligibility.base_name(F.col("url")), F.lit(".")).alias("is_hidden"))
    return files.union(c.folders.select("url", F.lit(True), F.lit(False)).distinct())


_OBJECTS = f"""o as (select distinct url, false as is_dir, starts_with(regexp_extract(url, '[^/]*$'), '.') as is_hidden from files where graph = '{FILE_SYSTEM}' union all select distinct url, true, false from folders),
rt as (select o.url, arg_max(r.url, length(r.url)) as root, arg_max(r.recurse, length(r.url)) as recurse from o join roots r on o.url = r.url or starts_with(o.url, r.url || '/') group by 1),
w as (select o.*, rt.root, rt.recurse, regexp_extract(o.url, '[^/]*$') as name, regexp_replace(o.url, '/[^/]*$', '') as parent from o left join rt using (url)),
z as (select url, is_dir, is_hidden, root, case when root is null then 'no root' when url = root then null
when not is_dir and (ends_with(name, '~') or regexp_matches(name, '\\.(o|la|lo|tmp|part)$')) then 'filter' when is_dir and name in ('lost+found', 'core-dumps', 'CVS') then 'filter'
when (case when is_dir then url else parent end) in (select parent from w where name in ('.trackerignore', '.git', '.nomedia')) then 'content'
when not recurse and parent <> root then 'not recursive' when is_hidden then 'hidden' end as reason from w)""".replace("\\\\", "\\")


@query("f10_eligible", f"with {_OBJECTS} select url, is_dir, is_hidden, root, reason, reason is null as indexable from z")
def f10(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return eligibility.eligible(_objects(c), c.roots)


@query("f11_path_report", f"""
with {_OBJECTS}, b as (select url as a, reason as r from z where reason is not null and reason <> 'no root'),
m as (select z.url, arg_min(b.r, length(b.a)) as r from z join b on z.url = b.a or starts_with(z.url, b.a || '/') group by 1)
select z.url, z.root, coalesce(m.r, z.reason) as reason, coalesce(m.r, z.reason) is null as indexable from z left join m using (url)""")
def f11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return eligibility.eligible_paths(_objects(c), c.roots)


@query("f13_shallow_text", f"""
select distinct f.url, starts_with(i.mime_type, 'text/') and not regexp_matches(f.file_name, '\\.(txt|md|mdwn)$') as shallow from (select distinct url, file_name from files where graph = '{FILE_SYSTEM}') f
join (select distinct unnest(stored_as) as url, mime_type from ies) i using (url)""")
def f13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    i = c.ies.select(F.explode("stored_as").alias("url"), "mime_type").distinct()
    return c.data_objects("url", "file_name").join(i, "url").select("url", eligibility.shallow_text(F.col("file_name"), F.col("mime_type")).alias("shallow")).distinct()


#: What the rules give, stated by hand: the types of the catalogue, and made-up rows for rules that no type of it meets.
_EXPECTED = """
application/pdf pdf tracker:Documents nfo:PaginatedTextDocument 1
audio/mpeg mp3 tracker:Audio nmm:MusicPiece 2
text/plain text tracker:Documents nfo:Document 1
image/jpeg jpeg tracker:Pictures nfo:Image 1
audio/flac libav tracker:Audio nmm:MusicPiece 1
application/vnd.oasis.opendocument.text oasis tracker:Documents nfo:PaginatedTextDocument 1
text/html html tracker:Documents nfo:HtmlDocument 1
audio/x-vorbis+ogg libav tracker:Audio nmm:MusicPiece 1
application/epub+zip epub tracker:Documents nfo:EBook 1
video/x-matroska libav tracker:Video nmm:Video 1
video/mp4 libav tracker:Video nfo:Media 2
image/png png tracker:Pictures nfo:Image 1
application/msword msoffice tracker:Documents nfo:Document 1
audio/mp4 libav tracker:Audio nmm:MusicPiece 1
image/tiff tiff tracker:Pictures nfo:Image 1
image/x-sony-sr2 raw tracker:Pictures nfo:Image 1
image/x-adobe-dng raw tracker:Pictures nfo:Image 1
application/x-nes-rom - tracker:Software nfo:GameImage 1
application/x-playstation-rom - tracker:Software nfo:GameImage 1
application/x-cbz - tracker:Documents nfo:EBook 1
application/x-cue disc-generic tracker:Software nfo:Software 1
application/x-scpls - - - 0
audio/x-scpls playlist tracker:Audio nmm:Playlist 2
application/vnd.ms-word.document.macroenabled.12 msoffice tracker:Documents nfo:Document 1
inode/directory - - nfo:Folder 1
image/svg+xml - tracker:Pictures nfo:Image 1
application/x-cd-image iso tracker:Software nfo:FilesystemImage 1
application/octet-stream - - - 0
"""


def _expected_sql() -> str:
    value = lambda x: "null" if x == "-" else f"'{x}'"
    rows = [line.split() for line in _EXPECTED.strip().splitlines()]
    return ", ".join(f"({', '.join(map(value, r[:4]))}, {r[4]})" for r in rows)


@query("f14_rules", f"""
with e(mime_type, module, graph, first_type, rules) as (values {_expected_sql()})
select * from e where starts_with(mime_type, 'image/x-') or mime_type in (select mime_type from ies) or mime_type not in ('application/pdf', 'audio/mpeg', 'text/plain', 'image/jpeg', 'audio/flac', 'application/vnd.oasis.opendocument.text', 'text/html', 'audio/x-vorbis+ogg', 'application/epub+zip', 'video/x-matroska', 'video/mp4', 'image/png', 'application/msword', 'audio/mp4', 'image/tiff')
union all select distinct mime_type, null, null, null, 0 from ies where mime_type is not null and mime_type not in (select mime_type from e)""")
def f14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The types of the catalogue and some that its rows lack."""
    more = spark.createDataFrame([(line.split()[0],) for line in _EXPECTED.strip().splitlines()[15:]], "mime_type string")
    out = rules.match_rules(Catalog.load(spark, sf_dir).ies.select("mime_type").union(more), rules.shipped_rules(spark))
    return out.select("mime_type", "module", "graph", F.try_element_at("rdf_types", F.lit(1)).alias("first_type"), "rules")


@query("src06_rule_files", """
select mime_type, case when starts_with(mime_type, 'audio/') and mime_type <> 'audio/flac' then 'sound' when mime_type in ('image/png', 'image/tiff') then 'first' when starts_with(mime_type, 'image/') then 'second' end as module,
case when starts_with(mime_type, 'audio/') and mime_type <> 'audio/flac' then 'tracker:Audio' when starts_with(mime_type, 'image/') then 'tracker:Pictures' end as graph,
(starts_with(mime_type, 'audio/') and mime_type <> 'audio/flac')::int + starts_with(mime_type, 'image/')::int + (mime_type in ('image/png', 'image/tiff'))::int as rules from (select distinct mime_type from ies where mime_type is not null)""")
def src06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key files with wildcards, a block list, and attributes left to a later rule."""
    head = "[ExtractorRule]\n"
    files = {
        "20-late.rule": f"{head}ModulePath=second\nMimeTypes=image/*;\nGraph=tracker:Pictures\nHash=b\n",
        "10-early.rule": f"{head}# no graph of its own\nModulePath=first\nMimeTypes=image/png;image/tif?;\n",
        "15-sound.rule": f"{head}ModulePath=sound\nMimeTypes=audio/*;\nBlockMimeTypes=audio/fl*;\nGraph=tracker:Audio\nHash=a\n",
    }
    return rules.match_rules(Catalog.load(spark, sf_dir).ies, rules.parse_texts(spark, files)).select("mime_type", "module", "graph", "rules")


@query("sc12_nested_paths", """
with p as (select url as path from folders union select url from roots)
select path from p where not exists (select 1 from p q where starts_with(p.path, q.path || '/'))""")
def sc12(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return eligibility.without_nested(c.folders.select(F.col("url").alias("path")).union(c.roots.select("url")))
