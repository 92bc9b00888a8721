"""Batches of events applied to a catalogue, extraction of what is pending, monitor bursts."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kartei.catalog import FILE_SYSTEM, Catalog
from kartei.operators import mutations, rules, snapshot
from kartei.streaming import apply, queue

T0, T1 = datetime(2024, 1, 1), datetime(2025, 1, 1)


@pytest.fixture
def small(spark) -> Catalog:
    """A root with a/b.txt, a/sub/c.mp3 and the sibling ab/d.txt."""
    c = Catalog.load(spark, "/root/testdata/sf0.001")
    make = lambda rows, df: spark.createDataFrame(rows, df.schema)
    row = lambda url, ie, h="h": (FILE_SYSTEM, url, url.rsplit("/", 1)[1], 1, T0, T0, T0, None, "urn:r", [ie] if ie else [], h)
    ie = lambda urn, url, artist=None: ("tracker:Audio" if artist else "tracker:Documents", urn, "text/plain", ["nfo:Document"], [url], "T", None, None, "text", [], None, artist, [], None, None, None, None, None)
    return Catalog(
        files=make([row("file:///r/a/b.txt", "i1"), row("file:///r/a/sub/c.mp3", "i2"), row("file:///r/ab/d.txt", "i3"), row("file:///r/e.bin", None, None)], c.files),
        ies=make([ie("i1", "file:///r/a/b.txt"), ie("i2", "file:///r/a/sub/c.mp3", "urn:artist:X"), ie("i3", "file:///r/ab/d.txt")], c.ies),
        roots=make([("urn:r", "file:///r", True, False, True, False)], c.roots),
        folders=make([("f1", "file:///r/a", "inode/directory"), ("f2", "file:///r/a/sub", "inode/directory"), ("f3", "file:///r/ab", "inode/directory")], c.folders),
        artists=make([("urn:artist:X", "X"), ("urn:artist:Y", "Y")], c.artists),
        tags=make([], c.tags),
    )


def urls(c):
    return {r.url for r in c.files.select("url").collect()}


EVENT = "seq long, op string, file_url string, dest_url string, is_dir boolean, attributes_only boolean"


def test_deleting_a_folder_takes_what_is_below(spark, small):
    d = apply.delete_urls(small, spark.createDataFrame([("file:///r/a",)], "url string"))
    assert urls(d) == {"file:///r/ab/d.txt", "file:///r/e.bin"}
    assert {r.urn for r in d.ies.collect()} == {"i3"} and {r.urn for r in d.folders.collect()} == {"f3"}


def test_moving_a_folder_moves_what_is_below(spark, small):
    m = spark.createDataFrame([("file:///r/a", "file:///r/z"), ("file:///r/a/sub", "file:///r/y")], "src string, dest string")
    d = apply.move_urls(small, m)
    assert urls(d) == {"file:///r/z/b.txt", "file:///r/y/c.mp3", "file:///r/ab/d.txt", "file:///r/e.bin"}
    assert {u for r in d.ies.collect() for u in r.stored_as} == {"file:///r/z/b.txt", "file:///r/y/c.mp3", "file:///r/ab/d.txt"}
    assert {r.url for r in d.folders.collect()} == {"file:///r/z", "file:///r/y", "file:///r/ab"}


def test_apply_events(spark, small):
    events = [(1, "DELETED", "file:///r/a/sub", None, True, False), (2, "UPDATED", "file:///r/a/b.txt", None, False, False), (3, "UPDATED", "file:///r/ab/d.txt", None, False, True), (4, "CREATED", "file:///r/n.txt", None, False, False), (5, "MOVED", "file:///r/e.bin", "file:///r/e2.bin", False, False)]
    rows = [(FILE_SYSTEM, f"file:///r/{n}", n, 9, T1, T1, T1, None, "urn:r", [], "from disk") for n in ("a/b.txt", "ab/d.txt", "n.txt", "e.bin")]
    d = apply.apply_events(small, spark.createDataFrame(events, EVENT), spark.createDataFrame(rows, small.files.schema))
    got = {r.url: r for r in d.files.collect()}
    assert set(got) == {"file:///r/a/b.txt", "file:///r/ab/d.txt", "file:///r/n.txt", "file:///r/e2.bin"}
    assert got["file:///r/a/b.txt"].extractor_hash is None and got["file:///r/a/b.txt"].file_size == 9
    assert got["file:///r/ab/d.txt"].extractor_hash == "h" and got["file:///r/ab/d.txt"].mtime == T1 and got["file:///r/ab/d.txt"].file_size == 1
    assert {r.urn for r in d.ies.collect()} == {"i3"} and d.artists.count() == 0


def test_batches_are_applied_once(spark, small, tmp_path):
    store, src = str(tmp_path / "store"), str(tmp_path / "events")
    snapshot.write(small, store)
    spark.createDataFrame([(1, "DELETED", "file:///r/a", None, True, False)], EVENT).coalesce(1).write.parquet(src)
    each = apply.apply_and_save(store, lambda e: small.files.limit(0))
    queue.apply_batches(spark.readStream.schema(EVENT).parquet(src), each, str(tmp_path / "cp")).awaitTermination()
    assert snapshot.current(spark, store) == 2 and len(urls(snapshot.read(spark, store))) == 2
    each(spark.createDataFrame([], EVENT), 0)
    assert snapshot.current(spark, store) == 2


def rows_of(c):
    return {n: sorted(str(r) for r in getattr(c, n).collect()) for n in snapshot.TABLES}


def test_a_snapshot_rewrites_only_the_graphs_that_change(spark, small, tmp_path):
    store = str(tmp_path / "store")
    assert snapshot.read(spark, store) is None and snapshot.last_batch(spark, store) == -1
    snapshot.write(small, store)
    assert rows_of(snapshot.read(spark, store)) == rows_of(small)
    each = apply.apply_and_save(store, lambda e: small.files.limit(0))
    event = lambda url: spark.createDataFrame([(1, "DELETED", url, None, False, False)], EVENT)
    each(event("file:///r/a/b.txt"), 0)
    held = snapshot.manifest(spark, store, 2)
    assert held["files"] == {"graph=tracker%3AFileSystem": 2} and held["ies"] == {"graph=tracker%3AAudio": 1, "graph=tracker%3ADocuments": 2} and held["roots"] == 1
    c = snapshot.read(spark, store)
    assert {r.urn for r in c.ies.collect()} == {"i2", "i3"} and c.ies.columns == small.ies.columns
    each(event("file:///r/a/sub/c.mp3"), 1)
    assert snapshot.manifest(spark, store, 3)["ies"] == {"graph=tracker%3ADocuments": 2}  # the last song is gone
    want = rows_of(snapshot.read(spark, store))
    snapshot.drop_old(spark, store, 1)
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.is_dir()) == ["snap-1", "snap-2", "snap-3"]
    assert rows_of(snapshot.read(spark, store)) == want and snapshot.last_batch(spark, store) == 1
    snapshot.write(snapshot.read(spark, store), store)
    snapshot.drop_old(spark, store, 1)
    assert sorted(p.name for p in (tmp_path / "store").iterdir() if p.is_dir()) == ["snap-4"]
    assert rows_of(snapshot.read(spark, store)) == want


def test_pending_files_are_extracted_and_bad_ones_reported(spark, small):
    content = [("file:///r/e.bin", "text/plain", bytearray(b"found text")), ("file:///r/a/b.txt", "text/plain", bytearray(b"done before"))]
    bad = small.files.where("url = 'file:///r/e.bin'").withColumn("url", F.lit("file:///r/bad.ps"))
    c = mutations.upsert_files(small, bad.withColumn("seq", F.lit(1)))
    content.append(("file:///r/bad.ps", "application/postscript", bytearray(b"not one")))
    after, errors = apply.extract_pending(c, spark.createDataFrame(content, "url string, mime_type string, content binary"), rules.shipped_rules(spark))
    new = {r.stored_as[0]: r.plain_text for r in after.ies.where("urn like 'urn:ie:%'").collect()}
    assert new == {"file:///r/e.bin": "found text"}
    assert [r.uri for r in errors.collect()] == ["file:///r/bad.ps"]
    assert after.files.where("extractor_hash is null").count() == 0


@pytest.mark.parametrize(
    ("ops", "want"),
    [
        (["CREATED", "CHANGED", "CHANGES_DONE"], ["CREATED"]),
        (["CHANGED", "CHANGED", "CHANGES_DONE"], ["UPDATED"]),
        (["CREATED", "DELETED"], []),
        (["CHANGED", "DELETED"], ["DELETED"]),
        (["DELETED"], ["DELETED"]),
        (["CHANGES_DONE"], []),
        (["CREATED"], []),
        (["CREATED", "ATTRIBUTE_CHANGED", "CHANGES_DONE", "CHANGED", "CHANGES_DONE"], ["UPDATED", "CREATED", "UPDATED"]),
    ],
)
def test_monitor_bursts(spark, monkeypatch, ops, want):
    for chunk in (2, 10_000):
        monkeypatch.setattr(apply, "CHUNK", chunk)
        df = spark.createDataFrame([(k, op, "file:///x") for k, op in enumerate(ops)], "seq long, op string, file_url string")
        assert [r.op for r in apply.cached_monitor_events(df).orderBy("seq").collect()] == want


def test_tag_text_and_counts_of_empty_tables(spark, small):
    from kartei.plans import stats

    empty = Catalog(**{n: getattr(small, n).limit(0) for n in ("files", "ies", "roots", "folders", "artists", "tags")})
    assert stats.count_files(empty).first().n == 0 and stats.class_stats(empty).count() == 0 and stats.quads(empty).count() == 0


def test_events_of_the_test_tables_as_applied_one_by_one(spark, tiny):
    """The files after a batch, against a plain loop over the same rows."""
    from kartei.operators.coalesce import coalesce_events
    from test_operators import in_order

    c = Catalog.load(spark, tiny)
    events = spark.read.parquet(f"{tiny}/change_events.parquet")
    names = ["seq", "op", "file_url", "dest_url", "is_dir", "attributes_only"]
    folder = c.folders.agg(F.min("url")).first()[0]
    top = events.agg(F.max("seq")).first()[0]
    more = spark.createDataFrame([(top + 1, "DELETED", folder, None, True, False)], EVENT)
    rows = sorted({tuple(r) for r in events.select(*names).union(more).collect() if r.op and r.file_url})
    last: dict[str, tuple] = {}
    for r in in_order(rows):
        last[r[2]] = max(r, last.get(r[2], r), key=lambda x: x[0])
    disk = {r.url: r.extractor_hash for r in c.in_graph("files", FILE_SYSTEM).collect()}
    files = {(r.graph, r.url): r.extractor_hash for r in c.files.collect()}
    gone = [u for u, r in last.items() if r[1] == "DELETED"]
    moved = {u: r[3] for u, r in last.items() if r[1] == "MOVED" and r[3]}
    at = lambda url, base: url == base or url.startswith(base + "/")
    want = {}
    for (graph, url), h in files.items():
        if any(at(url, g) for g in gone):
            continue
        base = max((m for m in moved if at(url, m)), key=len, default=None)
        want[graph, moved[base] + url[len(base) :] if base else url] = h
    for u, r in last.items():
        if r[1] in ("CREATED", "UPDATED") and u in disk and not r[5]:
            want[FILE_SYSTEM, u] = None
    after = apply.apply_events(c, coalesce_events(events.select(*names).union(more)), c.in_graph("files", FILE_SYSTEM))
    got = {(r.graph, r.url, r.extractor_hash) for r in after.files.collect()}
    assert got == {(*k, h) for k, h in want.items()} and len(want) < len(files)
