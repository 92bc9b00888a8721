"""Scalar functions against fixed expected values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kartei.functions import binary, dates, media, paths, text, urns

C = F.col


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(C("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("", None),
        ("2008-06-14", "2008-06-14T00:00:00+02:00"),
        ("20080614000000", "2008-06-14T00:00:00+02:00"),
        ("20080614000000Z", "2008-06-14T00:00:00Z"),
        ("Mon Jun 14 04:20:20 2008", "2008-06-14T04:20:20+02:00"),
        ("2008:06:14 04:20:20", "2008-06-14T04:20:20+02:00"),
        ("2010", "2010-01-01T00:00:00Z"),
        ("201a", None),
        ("A2010", None),
        ("20100318010203-00:03Z", "2010-03-18T01:02:03-00:03"),
        ("2010-03-18T01:02:03.10-00:03", "2010-03-18T01:02:03.100000-00:03"),
        ("2010-03-18T01:02:03.100", "2010-03-18T01:02:03.100000+01:00"),
        ("2010-13-18", None),
        (None, None),
    ],
)
def test_date_guess(spark, value, want):
    assert one(spark, value, lambda x: dates.date_guess(x, "Europe/Amsterdam")) == want


def test_parse_with(spark):
    assert one(spark, "x", lambda x: dates.parse_with(x, "yyyy-MM-dd")) is None
    assert one(spark, "2008-06-14", lambda x: dates.parse_with(x, "yyyy-MM-dd", "Europe/Amsterdam")) == "2008-06-14T00:00:00+02:00"


@pytest.mark.parametrize(("value", "want"), [(0.0, "less than one second"), (59.9, "59s"), (60.0, "01m"), (100.12, "01m 40s"), (1000000.0, "11d 13h 46m 40s")])
def test_seconds_short(spark, value, want):
    assert one(spark, value, dates.seconds_to_string, "double") == want


def test_seconds_long(spark):
    assert one(spark, 100.0, lambda x: dates.seconds_to_string(x, False), "double") == "01 minute 40 seconds"


@pytest.mark.parametrize(("args", "want"), [((10, 10, 20), 20), ((10, 9, 20), 22), ((0, 9, 20), 0), ((10, -1, 20), 0)])
def test_seconds_estimate(spark, args, want):
    df = spark.createDataFrame([args], "a int, b int, c int")
    assert df.select(dates.seconds_estimate(C("a"), C("b"), C("c"))).first()[0] == want


@pytest.mark.parametrize(("value", "want"), [(None, True), ("", True), ("   ", True), ("   -    ", False), (" 　", True)])
def test_is_blank(spark, value, want):
    assert one(spark, value, text.is_blank) is want


def test_coalesce_and_merge(spark):
    df = spark.createDataFrame([("", "a", None)], "a string, b string, c string")
    assert df.select(text.coalesce_strip(C("a"), C("b"))).first()[0] == "a"
    assert df.select(text.merge("*", C("b"), C("c"), F.lit("b"))).first()[0] == "a*b"
    assert df.select(text.merge("*", C("c"))).first()[0] is None


def test_words_and_names(spark):
    assert one(spark, "ab12 cd, ef", lambda x: text.normalize_words(x, 2)) == "ab cd"
    assert one(spark, 'x "a, b;c,a"', lambda x: F.array_join(text.keywords(x), "|")) == "a|b|c"
    assert one(spark, "my_song.old.mp3", text.title_from_name) == "my song.old"
    assert one(spark, ".hidden_file", text.title_from_name) == "hidden file"
    assert one(spark, "abcd", lambda x: text.ellipsize(x, 4)) == "abc…"
    assert one(spark, "abc", lambda x: text.ellipsize(x, 4)) == "abc"
    assert one(spark, "Cañamón", text.fold) == "canamon"


def test_paths(spark):
    assert one(spark, "/a/bc", lambda x: paths.is_in_path(x, F.lit("/a/b"))) is False
    assert one(spark, "/a/b/c", lambda x: paths.is_in_path(x, F.lit("/a/b/"))) is True
    assert one(spark, "aé/", paths.object_path) == "a_c3_a9_2f"
    assert paths.evaluate_name("name") is None
    assert paths.evaluate_name("/a/b/") == "/a/b"
    assert paths.evaluate_name("$NO_SUCH_NAME/x") is None


def test_paths_with_environment(monkeypatch):
    monkeypatch.setenv("PLACE", "/here")
    assert paths.evaluate_name("$PLACE/x") == "/here/x"
    assert paths.evaluate_name("${PLACE}/x") == "/here/x"
    assert paths.evaluate_name("&DOCS", {"&DOCS": "/docs"}) == "/docs"


@pytest.mark.parametrize(("data", "want"), [(b"", ""), (b"abc", "abc"), (b"\xffabc", ""), (b"abcdefghijk\xffxyz", "abcdefghijk"), (b"ab\xc3", "ab")])
def test_valid_prefix(spark, data, want):
    assert one(spark, bytearray(data), binary.valid_utf8_prefix, "binary") == want


def test_text_of():
    assert binary.decode_text(b"\xff\xfe`O}Y", 100) == "你好"
    assert binary.decode_text("Cañamón".encode("cp1252"), 100) == "Cañamón"
    assert binary.decode_text("aé".encode() + b"b", 2) == "a"


def test_ends_hash(spark):
    assert one(spark, bytearray(b"x"), binary.ends_hash, "binary") is None
    assert one(spark, bytearray(64 * 1024), binary.ends_hash, "binary") == f"{65536:016x}"


def test_urns(spark):
    assert one(spark, "A b/ü", urns.artist) == "urn:artist:A%20b%2F%C3%BC"
    assert one(spark, "Show", lambda x: urns.tv_season(x, F.lit(2))) == "urn:tv-season:Show-S%202"


def test_media(spark):
    assert one(spark, "1/0", media.ratio) is None
    assert one(spark, "1/4", media.ratio) == 0.25
    assert one(spark, "52,22.5S", media.gps_coordinate) == -52.375
    assert one(spark, "Pets", media.region_type) == "nfo:roi-content-pet"
    assert one(spark, "(17)Rock", media.genre_number) == 17
    assert one(spark, 9, media.orientation, "int") == "nfo:orientation-top"


@pytest.mark.parametrize(
    ("word", "want"),
    [line.split() for line in "consign consign|consigned consign|consistency consist|consolation consol|knightly knight|kneeling kneel|knots knot|generously generous|generate generat|ties tie|cries cri|gas gas|gaps gap|kiwis kiwi|agreed agre|hopping hop|hoping hope|falling fall|happy happi|by by|say say|relational relat|sensational sensat|national nation|skies sky|dying die|herrings herring|cement cement|replacement replac|adoption adopt|invoices invoic|missing miss|references refer|hopefulness hope|controlling control|y y|yes yes|employer employ".split("|")],
)
def test_stems(word, want):
    from kartei.functions.stem import stem, word_forms

    assert stem(word) == want
    assert word in word_forms(word) and all(stem(f) == want for f in word_forms(word))


def test_forms_hold_the_words_of_the_texts(tiny):
    """Whatever word of a group of one stem is asked for, the others are among its forms."""
    import re

    import duckdb

    from kartei.functions.stem import stem, word_forms

    texts = duckdb.sql(f"select text from '{tiny}/documents.parquet' where lang = 'en'").fetchall()
    words = {w for (t,) in texts for w in re.findall("[a-z]{3,12}", t)} | set("plans planned planning planner agree agrees agreed agreement agreeing happy happier happily happiness relate related relation relations relational connect connected connecting connection connections connective".split())
    groups: dict[str, set[str]] = {}
    for w in words:
        groups.setdefault(stem(w), set()).add(w)
    pairs = [(a, b) for g in groups.values() for a in g for b in g if a != b]
    assert len(pairs) > 50 and sum(b in word_forms(a) for a, b in pairs) >= 0.98 * len(pairs)
