"""Operators on small tables made by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from kartei.catalog import Catalog, is_a, sub_classes
from kartei.operators import coalesce, diff, eligibility, mutations, rules, snapshot
from kartei.operators.coalesce import APPEND, DROP, EFFECT, MOVED, REPLACE, coalesce_events
from kartei.plans import search
from kartei.streaming import queue

EVENT = "seq long, op string, file_url string, dest_url string, is_dir boolean, attributes_only boolean"


def in_order(rows):
    """The queue, one event after the other."""
    gone = [(r[0], r[2]) for r in rows if r[1] == "DELETED" and r[4]]
    out, last = [], {}
    for r in sorted(rows):
        if any(seq > r[0] and r[2].startswith(url + "/") for seq, url in gone):
            continue
        kind = {"CREATED": 1, "DELETED": 4, "MOVED": 5}.get(r[1]) or (3 if r[5] else 2)
        old = last.get(r[2])
        effect = EFFECT.get((old[0], kind), APPEND) if old else APPEND
        if effect == DROP:
            continue
        if effect == REPLACE:
            old[1][1] = False
        row = (r[0], "CREATED", r[3], None, r[4], r[5]) if kind == MOVED and effect == REPLACE else r
        out.append([row, True])
        if kind == MOVED:
            last.pop(r[2], None), last.pop(r[3], None)
        else:
            last[r[2]] = (kind, out[-1])
    return sorted(r for r, kept in out if kept)


def random_events(n, seed):
    rnd = random.Random(seed)
    files = [f"file:///a/d{i % 2}/f{i}" for i in range(5)]
    out = []
    for q in range(1, n + 1):
        is_dir = rnd.random() < 0.1
        url = rnd.choice(["file:///a/d0", "file:///a/d1"]) if is_dir else rnd.choice(files)
        op = rnd.choice(["UPDATED"] * 8 + ["DELETED"]) if is_dir else rnd.choice(["CREATED", "UPDATED", "UPDATED", "UPDATED", "DELETED", "MOVED"])
        out.append((q, op, url, rnd.choice(files) if op == "MOVED" else None, is_dir, op == "UPDATED" and rnd.random() < 0.6))
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, 1), (2, 3), (3, 20), (4, 512)])
def test_coalesce_in_chunks_is_the_queue(spark, seed, chunk):
    rows = random_events(400, seed)
    got = sorted(map(tuple, coalesce_events(spark.createDataFrame(rows, EVENT), chunk).collect()))
    assert got == in_order(rows)


def test_coalesce_twice_changes_nothing_for_repeated_rows(spark):
    rows = random_events(60, 9)
    a = sorted(map(tuple, coalesce_events(spark.createDataFrame(rows + rows, EVENT)).collect()))
    assert a == in_order(rows)


def test_coalesce_drops_nulls_and_takes_an_empty_table(spark):
    df = spark.createDataFrame([(1, None, "file:///a", None, False, False), (2, "CREATED", None, None, False, False)], EVENT)
    assert coalesce_events(df).count() == 0
    assert coalesce_events(spark.createDataFrame([], EVENT)).count() == 0


@pytest.mark.parametrize(("queued", "new"), [(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4, 5)])
def test_every_cell_of_the_matrix(spark, queued, new):
    names = {1: ("CREATED", False), 2: ("UPDATED", False), 3: ("UPDATED", True), 4: ("DELETED", False), 5: ("MOVED", False)}
    rows = [(1, names[queued][0], "file:///x", None, False, names[queued][1]), (2, names[new][0], "file:///x", "file:///y" if new == 5 else None, False, names[new][1])]
    got = sorted(map(tuple, coalesce_events(spark.createDataFrame(rows, EVENT)).collect()))
    effect = EFFECT.get((queued, new), APPEND)
    want = {APPEND: rows, REPLACE: [rows[1]], DROP: [rows[0]]}[effect]
    if new == 5 and effect == REPLACE:
        want = [(2, "CREATED", "file:///y", None, False, False)]
    assert got == want


def test_stream_and_batch_agree(spark, tmp_path):
    """All kinds of events, of files and directories, in several micro-batches."""
    rows = random_events(300, 5) + [(401, "UPDATED", "file:///y", None, False, False), (402, "MOVED", "file:///x", "file:///y", False, False), (403, "UPDATED", "file:///y", None, False, False)]
    assert {"MOVED", "DELETED"} <= {r[1] for r in rows} and any(r[4] for r in rows)
    src = str(tmp_path / "events")
    for k in range(0, len(rows), 50):
        spark.createDataFrame(rows[k : k + 50], EVENT).coalesce(1).write.mode("append").parquet(src)
    stream = queue.queued(spark, src, EVENT, 1)
    q = queue.coalesce_stream(stream).writeStream.format("memory").queryName("coalesced").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    told = [tuple(r) for r in spark.sql("select * from coalesced").collect()]
    left, queued, replaced = ({t[:6] for t in told if t[6] == s} for s in ("left", "queued", "replaced"))
    want = {tuple(r) for r in coalesce_events(spark.createDataFrame(rows, EVENT), purge=False).collect()}
    assert left | queued - replaced == want
    assert {(401, "UPDATED", "file:///y"), (403, "UPDATED", "file:///y")} <= {t[:3] for t in want}


def test_a_micro_batch_takes_a_bounded_number_of_files(spark, tmp_path):
    src = str(tmp_path / "q")
    queue.enqueue(spark.createDataFrame(random_events(100, 3), EVENT).coalesce(1), src, 20)
    sizes = []
    queue.queued(spark, src, EVENT, 2).writeStream.foreachBatch(lambda df, i: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 100 and len(sizes) >= 3 and max(sizes) <= 40


def test_apply_batches(spark, tmp_path):
    rows = random_events(40, 6)
    src = str(tmp_path / "e")
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(src)
    seen = []
    queue.apply_batches(spark.readStream.schema(EVENT).parquet(src), lambda df, i: seen.append((i, df.count())), str(tmp_path / "cp")).awaitTermination()
    assert seen == [(0, len(in_order(rows)))]


@pytest.mark.parametrize(
    ("recurse", "want"),
    [(False, {"/A", "/A/A", "/A/B"}), (True, {"/A", "/A/A", "/A/B", "/A/A/A", "/A/A/B", "/A/B/A", "/A/B/B", "/A/A/A/A", "/A/A/A/B"})],
)
def test_eligibility_tree(spark, recurse, want):
    names = ["/A", "/A/A", "/A/A/A", "/A/A/A/A", "/A/A/A/B", "/A/A/B", "/A/B", "/A/B/A", "/A/B/B"]
    objects = spark.createDataFrame([(n, True, False) for n in names], "url string, is_dir boolean, is_hidden boolean")
    roots = spark.createDataFrame([("/A", recurse)], "url string, recurse boolean")
    assert {r.url for r in eligibility.eligible(objects, roots).where("indexable").collect()} == want


def test_eligibility_reasons(spark):
    rows = [("/A", True, True), ("/A/x.tmp", False, False), ("/A/.h", False, True), ("/A/g", True, False), ("/A/g/.git", False, True), ("/A/g/f.txt", False, False), ("/AB/f", False, False), ("/A/CVS", True, False), ("/A/CVS/f", False, False)]
    objects = spark.createDataFrame(rows, "url string, is_dir boolean, is_hidden boolean")
    roots = spark.createDataFrame([("/A", True)], "url string, recurse boolean")
    own = {r.url: r.reason for r in eligibility.eligible(objects, roots).collect()}
    assert own == {"/A": None, "/A/x.tmp": "filter", "/A/.h": "hidden", "/A/g": "content", "/A/g/.git": "content", "/A/g/f.txt": "content", "/AB/f": "no root", "/A/CVS": "filter", "/A/CVS/f": None}
    path = {r.url: r.reason for r in eligibility.eligible_paths(objects, roots).collect()}
    assert path["/A/CVS/f"] == "filter"


def test_filters_reject_paths():
    with pytest.raises(ValueError):
        eligibility.Filters(file=("/tmp/x",))
    with pytest.raises(ValueError):
        eligibility.Filters(parent_directory=("*",))


def test_nested_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("/home/ivan", "/home", "/tmp", "/usr/", "/usr/share/local")], "path string")
    assert {r.path for r in eligibility.without_nested(df).collect()} == {"/home", "/tmp", "/usr"}


def test_rules(spark):
    r = spark.createDataFrame(
        [(0, "a", ["image/png"], [], ["nfo:Image", "nmm:Photo"], None, None, "png"), (1, "b", ["image/*"], ["image/x-blocked"], ["nfo:Image"], "tracker:Pictures", "h", None), (2, "c", ["audio/mpeg"], [], ["nfo:Audio"], "tracker:Audio", "k", "mp3")],
        rules.SCHEMA,
    )
    m = spark.createDataFrame([(x,) for x in ("audio/mpeg", "image/png", "text/generic", "image/x-blocked", "image/gif")] + [(None,)], "mime_type string")
    got = {x.mime_type: (x.module, x.graph, x.hash, x.rdf_types, x.rules) for x in rules.match_rules(m, r).collect()}
    assert got["audio/mpeg"] == ("mp3", "tracker:Audio", "k", ["nfo:Audio"], 1)
    assert got["image/png"] == ("png", "tracker:Pictures", "h", ["nfo:Image", "nmm:Photo"], 2)
    assert got["text/generic"][4] == 0 and got["image/x-blocked"][4] == 0
    assert None not in got


def test_rule_files(spark, tmp_path):
    (tmp_path / "90-image.rule").write_text("[ExtractorRule]\nModulePath=libx.so\nMimeTypes=image/*;\nBlockMimeTypes=image/x-blocked;\nFallbackRdfTypes=nfo:Image;\n")
    got = rules.parse_rules(spark, str(tmp_path)).first()
    assert (got.allow, got.block, got.rdf_types, got.module) == (["image/*"], ["image/x-blocked"], ["nfo:Image"], "libx.so")


def test_diff_states(spark):
    disk = spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 1)], "url string, m long").select("url", F.timestamp_seconds("m").alias("mtime"))
    store = spark.createDataFrame([("a", 1, "t", "h"), ("b", 1, "t", "h"), ("d", 1, "t", "old"), ("e", 1, None, None)], "url string, m long, mime_type string, extractor_hash string").withColumn("mtime", F.timestamp_seconds("m"))
    now = spark.createDataFrame([("t", "h")], "mime_type string, hash string")
    got = {r.url: r.state for r in diff.classify(disk, store, now).collect()}
    assert got == {"a": "NONE", "b": "UPDATE", "c": "CREATE", "d": "EXTRACTOR_UPDATE", "e": "DELETE"}


def test_diff_of_equal_sides_is_none(spark):
    store = spark.createDataFrame([("a", 1, None, None)], "url string, m long, mime_type string, extractor_hash string").withColumn("mtime", F.timestamp_seconds("m"))
    assert [r.state for r in diff.classify(store.select("url", "mtime"), store, spark.createDataFrame([], "mime_type string, hash string")).collect()] == ["NONE"]


def test_prefix_safety(spark):
    s = spark.createDataFrame([("file:///a/b", "DELETE"), ("file:///a/b/x", "DELETE"), ("file:///a/bc", "DELETE"), ("file:///a/b/new", "CREATE")], "url string, state string")
    got = {r.url for r in diff.suppress_below_deleted(s, s.where("url = 'file:///a/b'").select("url")).collect()}
    assert got == {"file:///a/b", "file:///a/bc"} or got == {"file:///a/b", "file:///a/bc", "file:///a/b/new"}


def test_snapshots(spark, tiny, tmp_path):
    folder = str(tmp_path / "store")
    assert snapshot.read(spark, folder) is None
    c = Catalog.load(spark, tiny)
    assert snapshot.write(c, folder) == 1
    uri = c.files.agg(F.min("url")).first()[0]
    assert snapshot.write(mutations.delete_file(snapshot.read(spark, folder), uri), folder) == 2
    again = snapshot.read(spark, folder)
    assert again.files.where(F.col("url") == uri).count() == 0
    assert again.files.count() == c.files.where(F.col("url") != uri).count()
    snapshot.write(again, folder)
    snapshot.drop_old(spark, folder, 1)
    assert snapshot.current(spark, folder) == 3


def test_classes(spark):
    assert "nfo:PlainTextDocument" in sub_classes("nfo:TextDocument")
    df = spark.createDataFrame([(["nfo:PlainTextDocument"],), (["nfo:Image"],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(is_a(F.col("t"), "nfo:Document")).collect()] == [True, False, None]


@pytest.mark.parametrize(
    ("text", "terms", "hit"),
    [("one two three", ["two"], True), ("one two three", ["three one"], True), ("x" * 400, ["x" * 400], False), ("abc", ["unknown"], False), ("abc123", ["abc123"], True), ("你好", ["你好"], True), ("Cañamón", ["canamon"], True), ("the of in", ["the of"], True), ("Automobile", ["AUTOMOBILE"], True), ("x", [], False), (None, ["x"], False)],
)
def test_matching(spark, text, terms, hit):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.where(search.matches(terms, F.col("t"))).count() == int(hit)


def test_insert_and_remove_tags(spark, tiny):
    c = Catalog.load(spark, tiny)
    n = c.tags.count()
    wanted = spark.createDataFrame([("brand new", None), ("brand new", "twice"), (None, None)], "pref_label string, description string")
    d = mutations.insert_tags(mutations.insert_tags(c, wanted), wanted)
    assert d.tags.count() == n + 1
    url = c.ies.select(F.min(F.col("stored_as")[0])).first()[0]
    e = mutations.tag_files(d, spark.createDataFrame([(url, "brand new")], "url string, pref_label string"))
    tagged = e.ies.where(F.array_contains("tags", "urn:tag:brand%20new"))
    assert tagged.count() >= 1
    assert mutations.untag(e, "brand new", url).ies.where(F.array_contains("tags", "urn:tag:brand%20new")).count() == 0


def test_kind_of_is_null_for_unknown(spark):
    df = spark.createDataFrame([("ODD", None)], "op string, a boolean")
    assert df.select(coalesce.kind_of(F.col("op"), F.col("a"))).first()[0] is None


def test_a_stored_index_reads_only_the_folders_of_its_words(spark, tiny, tmp_path):
    from kartei.catalog import Catalog
    from kartei.plans import search

    index = search.postings(Catalog.load(spark, tiny))
    folder = str(tmp_path / "index")
    search.write_postings(index, folder)
    terms = ["missing", "Invoices"]
    stored = search.read_postings(spark, folder, terms)
    rows = lambda df: sorted(map(tuple, search.lookup(df, terms).collect()))
    assert rows(stored) == rows(index) and rows(stored)
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "xxhash64" not in plan
    assert len(stored.inputFiles()) <= 8 * 60 and search.read_postings(spark, folder, [" "]).count() == 0


def test_the_module_for_sound_is_a_choice(spark):
    mimes = spark.createDataFrame([("audio/flac",), ("video/mp4",), ("image/x-nikon-nef",), ("application/x-gba-rom",)], "mime_type string")
    for sound in ("libav", "mediainfo"):
        got = {r.mime_type: (r.module, r.graph) for r in rules.match_rules(mimes, rules.shipped_rules(spark, sound)).collect()}
        assert got == {"audio/flac": (sound, "tracker:Audio"), "video/mp4": (sound, "tracker:Video"), "image/x-nikon-nef": ("raw", "tracker:Pictures"), "application/x-gba-rom": (None, "tracker:Software")}
    with pytest.raises(ValueError):
        rules.shipped_rules(spark, "other")
