"""Text operators against brute force, exact round trips and held-out accuracy, and their corner cases."""

from __future__ import annotations

import random
import unicodedata as ud

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kartei.llm import canonical, encoding, ftrl, language, leakage, lookalike, mixing, toxicity, truncation
from kartei.llm.arrowtext import code_points, from_code_points, sentences
from kartei.llm.lookalike import normalise_array

LONG = "word " * 60_000


def form(*texts):
    return normalise_array(pa.array(texts, pa.string())).to_pylist()


# 1: one form for text that looks the same


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Résumé", "Résumé", True),
        ("Ｆｉｎａｌ（１）", "Final(1)", True),
        ("a b", "a b", True),
        ("a​b­", "ab", True),
        ("Мой Вапумиба", "Мой Bапyмиба", True),
        ("Τhе", "The", True),
        ("ﬁne oﬃce", "fine office", True),
        ("죠난", ud.normalize("NFD", "죠난"), True),
        ("ｶﾞ", "ガ", True),
        ("ạ́", "ạ́", True),
        ("ⅽⅼ", "cl", True),
        ("x²", "x2", False),
        ("①", "1", False),
        ("Grüße", "Gruße", False),
        ("abc", "ABC", False),
        ("a.b", "a,b", False),
        ("don’t", "don't", False),
        ("мой", "moi", False),
    ],
)
def test_forms(a, b, same):
    x, y = form(a, b)
    assert (x == y) is same


def test_form_corner_cases():
    assert form(None, "", "​‍", "A", "A") == [None, "", "", "A", "A"]
    assert form() == []
    assert form(LONG) == [LONG]
    once = form("Мой Bапyмиба", "Ｔｈｅ", "ещё e", "Ré")
    assert form(*once) == once


MARKS = "".join(chr(c) for c in (*range(0x300, 0x330), 0x41, 0x61, 0x6F, 0xE9, 0x1100, 0x1161, 0x11A8, 0xAC00, 0x9C7, 0x9BE))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(MARKS.replace("͏", ""), max_size=12), max_size=8))
def test_composition_is_canonical(texts):
    assert form(*texts) == [ud.normalize("NFC", t) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=8)), max_size=6))
def test_code_points_round_trip(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    arr = pa.array(texts, pa.string())
    assert from_code_points(*code_points(arr), np.asarray(arr.is_null())).to_pylist() == texts


def test_pairs_match_brute_force(spark):
    rnd = random.Random(3)
    base = ["Scan 1", "Naïve", "Мой", "Track"]
    dirt = [lambda t: t, lambda t: ud.normalize("NFD", t), lambda t: t.replace(" ", " "), lambda t: t + "​", lambda t: t.replace("a", "а"), lambda t: t.upper()]
    rows = [(f"u{k}", rnd.choice(dirt)(rnd.choice(base))) for k in range(120)] + [("n", None), ("e", ""), ("z", "​")]
    forms = dict(zip([k for k, _ in rows], form(*[v for _, v in rows]), strict=True))
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x is not None and y is not None and x != y and forms[a] == forms[b]}
    df = spark.createDataFrame(rows + rows[:5], "urn string, title string")
    got = [tuple(r) for r in lookalike.lookalike_pairs(df, "urn", "title", rows_a_salt=7, kinds_a_way=2).select("urn_a", "urn_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert lookalike.lookalike_pairs(df.limit(0), "urn", "title").count() == 0


def test_form_column_replaces_a_clashing_one(spark):
    df = spark.createDataFrame([("a", "ＡＢ", "old")], "urn string, title string, form string")
    assert lookalike.with_form(df, "title").first().form == "AB"


# 2: values mapped to a list


def levenshtein_with_swaps(a, b):
    """The unrestricted distance by its textbook definition, one pair at a time."""
    last, big = {}, len(a) + len(b)
    h = {(-1, -1): big}
    for i in range(len(a) + 1):
        h[i, -1], h[i, 0] = big, i
    for j in range(len(b) + 1):
        h[-1, j], h[0, j] = big, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), db
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            h[i, j] = min(h[i - 1, j - 1] + cost, h[i, j - 1] + 1, h[i - 1, j] + 1, h[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return h[len(a), len(b)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.text("abc", max_size=7), st.text("abc", max_size=7)), min_size=1, max_size=6))
def test_distance(pairs):
    got = canonical.damerau([a for a, _ in pairs], [b for _, b in pairs]).tolist()
    assert got == [levenshtein_with_swaps(a, b) for a, b in pairs]


def test_tree_finds_all_within_the_threshold():
    rnd = random.Random(1)
    keys = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(2, 8))) for _ in range(300)})
    tree = canonical.BKTree(keys)
    queries = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 8))) for _ in range(60)]
    hits, measured = tree.search(queries, [2] * len(queries))
    got = {(queries[i], tree.keys[k], d) for i, k, d in hits}
    want = {(q, k, d) for q in queries for k in keys if (d := levenshtein_with_swaps(q, k)) <= 2}
    assert got == want and measured < len(queries) * len(keys)


GENRES = [(1, "Rock", None), (2, "Hard Rock", None), (3, "Drum and Bass", ["DnB"]), (4, "Classical", ["Klassik"]), (5, "Folk", None), (6, "Organ Music", ["Orgelmusik"]), (7, "Musical Theatre", None)]
VALUES = {
    "rock": {1}, "ROCK!!": {1}, "Hadr Rock": {2}, "hardrock": {2}, "Rock, Hard": {2}, "drum & bass": {3}, "dnb": {3}, "D&B": {3}, "klasik": {4}, "genre: Folk": {5}, "Folk / misc": {5},
    "Folk; Rock": {1, 5}, "(3)": {3}, "(3)Drum": {3}, " 4 ": {4}, "(99)": {-1}, "2009": {-1}, "Whale Recordings": {-1}, "misc": {-1}, "?": {-1}, "mus. theatre": {7}, "Folk (old)": {5}, "some Organ.Music": {6}, "x" * 3000: {-1},
}


@pytest.mark.parametrize("shard", [20_000, 3])
def test_values(spark, shard):
    genres = spark.createDataFrame(GENRES, "genre_id int, pref_label string, alt_labels array<string>")
    rows = [(f"u{k}", v) for k, v in enumerate(VALUES)]
    df = spark.createDataFrame(rows + rows + [("n", None), ("b", " "), ("e", ""), ("p", "Rock")], "urn string, genre string")
    got = {}
    for r in canonical.map_values(df, "genre", genres, "genre_id", "pref_label", "alt_labels", shard).collect():
        got.setdefault(r.value, set()).add(r.entry)
    assert got == VALUES


def test_shards_change_nothing(spark, tiny):
    """Whatever the number of shards: real values and list, and readings that depend on entries of several shards."""
    genres = spark.read.parquet(f"{tiny}/genres.parquet").select("genre_id", "pref_label", "alt_labels")
    odd = [(901, "Musical Theatre Play", None), (902, "Music Therapy Play", None), (909, "hip-hop beat", None), (903, "Other", ["Hip Hop Beat"]), (910, "The Old Time Mountain String Band Music Tradition", None), (911, "Mixed", None)]
    genres = genres.union(spark.createDataFrame(odd, genres.schema))
    odd_values = [(v,) for v in ("mus. the. play", "hiphop beat", "jazz; the old time mountain string band music tradition", "mixed", "mixd", "m. th. play", "nothing " * 300)]
    values = spark.read.parquet("/root/testdata/sf0.01/ies.parquet").select("genre").union(spark.createDataFrame(odd_values, "genre string"))
    got = [sorted(map(tuple, canonical.map_values(values, "genre", genres, "genre_id", "pref_label", "alt_labels", n).collect())) for n in (20_000, 50, 5)]
    assert got[0] == got[1] == got[2]
    named = {v: {e for w, e in got[0] if w == v} for (v,) in odd_values}
    assert named["mus. the. play"] == {-1} and named["hiphop beat"] == {909} and named["mixed"] == {911} and named["nothing " * 300] == {-1}
    assert 910 in named["jazz; the old time mountain string band music tradition"] and len(named["jazz; the old time mountain string band music tradition"]) == 2


def test_values_of_an_empty_list(spark):
    none = spark.createDataFrame([], "genre_id int, pref_label string, alt_labels array<string>")
    df = spark.createDataFrame([("u", "Rock")], "urn string, genre string")
    assert canonical.map_rows(df, "urn", "genre", none, "genre_id", "pref_label", "alt_labels").first().entry == -1
    assert canonical.map_rows(df.limit(0), "urn", "genre", none, "genre_id", "pref_label", "alt_labels").count() == 0


# 3: wrong encodings

CLEAN = ["Größe und Übung für die Brücke", "Où est l’été à Orléans ?", "El año de la canción está aquí", "Źródło książki i pieśń", "Письма из города", "A naïve résumé of the façade", "SÃO PAULO, NOITE", "IRMÃ DE MARIA", "Volume: 3 m³ ± 2 ‰", "Åren i Malmö"]


@pytest.fixture(scope="module")
def garble_model(tiny):
    import duckdb

    texts = [r[0] for r in duckdb.sql(f"select text from '{tiny}/documents.parquet'").fetchall()]
    texts += [t for c in ("title", "plain_text") for (t,) in duckdb.sql(f"select {c} from '{tiny}/ies.parquet' where {c} is not null").fetchall()]
    return encoding.train(texts + CLEAN * 3, 2500)


def test_chains_invert():
    for chain in encoding.CHAINS[1:]:
        for t in CLEAN:
            g = encoding.garble(t, chain)
            if g is not None and not chain.endswith(encoding.LOWERED) and encoding.invert(g, chain) is not None:
                assert encoding.invert(g, chain) == t


def test_held_out_garbling_is_found(garble_model):
    unseen = ["Die Straße über den Fluss führte schließlich nach Köln.", "Señor García volvió después de la lección.", "La forêt était très éloignée du château.", "Mêle-toi de tes affaires, s’il te plaît."]
    hits = total = wrong = 0
    for t in unseen:
        assert encoding.repair_texts([t], garble_model)[0] == (None, None)
        for chain in ("utf-8 as cp1252", "utf-8 as latin-1", "utf-8 as mac-roman", "utf-8 as cp437", "utf-8 as cp1252 twice", "cp1252 as mac-roman"):
            g = encoding.garble(t, chain)
            found, back = encoding.repair_texts([g], garble_model)[0]
            total, hits, wrong = total + 1, hits + (found is not None), wrong + (back not in (None, t))
    assert hits >= 0.9 * total and wrong <= 0.1 * total


def test_garbling_corner_cases(garble_model):
    texts = [None, "", "plain", "R�sum�", *CLEAN]
    got = encoding.repair_texts(texts, garble_model)
    assert got[:3] == [(None, None)] * 3 and got[3] == (encoding.LOSSY, None)
    assert got[4:] == [(None, None)] * len(CLEAN)
    assert encoding.repair_texts([], garble_model) == []
    part = "All is well here. " + encoding.garble("Die Brücke über den Fluss.", "utf-8 as cp1252")
    assert encoding.repair_texts([part], garble_model)[0][1] == "All is well here. Die Brücke über den Fluss."


def test_find_garbled_takes_empty_tables(spark):
    df = spark.createDataFrame([], "urn string, title string")
    assert encoding.find_garbled(df, "urn", {"title": "title"}).count() == 0


# 4: languages


@pytest.fixture(scope="module")
def language_model(tiny):
    import duckdb

    return language.train(duckdb.sql(f"select text, lang from '{tiny}/documents.parquet' where lang is not null").fetchall())


def test_held_out_accuracy(language_model, tiny):
    import duckdb

    rows = duckdb.sql(f"select distinct plain_text, ie_language from '{tiny}/ies.parquet' where ie_language in ('de', 'fr', 'es', 'en') and length(plain_text) > 40").fetchall()
    got = language.classify([t for t, _ in rows], language_model)
    right = sum(lang in language.languages(f) for f, (_, lang) in zip(got, rows, strict=True))
    assert right >= 0.75 * len(rows)  # some labels are wrong on purpose


def test_languages(language_model):
    one = lambda t: set(language.languages(language.classify([t], language_model)[0]))
    assert one(None) == one("") == one("12.5;13\n7;8") == set()
    assert one("The committee found the list in the old drawer.") == {"en"}
    mixed = "The committee found the list in the old drawer. Die Nachbarin hat den Ordner im Rathaus gefunden."
    assert one(mixed) == {"en", "de"}
    assert one("The committee said “Guten Morgen, meine Damen und Herren” and left the town hall early.") == {"en"}


def test_label_notations(spark):
    df = spark.createDataFrame([(x,) for x in ("en_US", "ENGLISH", "fre", "Deutsch", "und", "??", " ", None, "ja", "pt-BR", "русский")], "x string")
    assert [r[0] for r in df.select(language.label_code(F.col("x"))).collect()] == ["en", "en", "fr", "de", None, None, None, None, None, "pt", "ru"]


def test_label_errors(spark, tiny):
    ies = spark.read.parquet(f"{tiny}/ies.parquet")
    got = language.find_label_errors(ies, "urn", "plain_text", "ie_language")
    assert got.count() == got.distinct().count() > 0
    assert language.find_label_errors(ies.limit(0), "urn", "plain_text", "ie_language").count() == 0


def test_calibration():
    rng = np.random.default_rng(0)
    z = rng.normal(size=(3000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert 0.8 < ftrl.calibrate(z, y) < 1.25
    assert 2 < ftrl.calibrate(3 * z, y) < 4.5


# 5: cut texts


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("It was late.", "closed"), ("“As it is.”", "closed"), ("Is it?", "closed"), ("It was la", "open"), ("It was late ", "blank"), ("Room 5", "open"), ("It was l…", "ellipsis"),
        ("Text.\nBest wishes,\nAnna", "name"), ("Text.\nViele Grüße\nAnna", "name"), ("List:\n- one\n- two", "item"), ("Text.\n\nNotes 3/40", "page"), ("Text.\n\nfile:///a/b/c.odt", "path"), ("Text.\n\nfile:///a/b/c", "short"), ("1.5;2.5\n3.5;4.5", "numbers"), ("Text.\n\nThe", "short"),
        ("â€œas long as it agrees.â€\x9d", "closed"), ("List:\n- one\n- " + "two " * 900 + "x", "item"), ("See " + "long " * 900 + "file:///a/b.odt", "path"), ("/" * 100_000, "numbers"), (" \n ", "closed"),
    ],
)
def test_endings(text, kind):
    assert truncation.ending(text) == kind


def at_and_off_a_limit():
    """Three sources, one of which cuts at 300 characters with an ellipsis; complete texts of all end in one at times."""
    rnd = random.Random(6)
    rows, files = [], []
    for k in range(1500):
        text = ("some words go on and on " * 200)[: int(rnd.lognormvariate(5.6, 0.5)) + 20]
        cut = k % 3 == 0 and len(text) > 299
        text = text[:299] + "…" if cut else text.rstrip() + rnd.choice(["…", ".", "."])
        rows.append((f"u{k}", [f"f{k}"], text, cut))
        files.append((f"f{k}", f"s{k % 3}"))
    return rows, files


def test_the_censoring_posterior_decides(spark, monkeypatch):
    rows, files = at_and_off_a_limit()
    ies, f = spark.createDataFrame(rows, "urn string, stored_as array<string>, plain_text string, really boolean"), spark.createDataFrame(files, "url string, data_source string")
    find = lambda: {r.urn for r in truncation.find_cut(ies, "urn", "plain_text", "stored_as", f, "url", "data_source")[0].where("cut").collect()}
    got, want = find(), {u for u, _, _, cut in rows if cut}
    same = [u for u, _, t, cut in rows if not cut and t.endswith("…")]
    assert got >= want and len(want) > 200 and len(got & set(same)) <= 0.02 * len(same) and len(same) > 300
    monkeypatch.setattr(truncation, "limits_of", lambda *a: [])
    assert find() != got


def test_endings_are_learned_from_all_sources(spark):
    """More sources than once were chosen, against expectation and maximisation source by source."""
    kinds = list(truncation.KINDS)
    rows = [(f"s{k}", None, ("open", "closed", "short")[k % 3] if k < 10_000 else "path", 1 + k % 2) for k in range(10_400)]
    rows += [(f"s{k % 3}", 0.9, "open", 5) for k in range(3)] + [(None, None, "item", 4)]
    got = truncation.ending_ratios(spark.createDataFrame(rows, "source string, p double, ending string, n long"))
    kind, n = np.array([kinds.index(e) for *_, e, _ in rows]), np.array([n for *_, n in rows], float)
    prior, source = np.array([p or np.nan for _, p, *_ in rows]), np.unique([str(s) for s, *_ in rows], return_inverse=True)[1]
    free = np.isnan(prior)
    pseudo = truncation.STRENGTH * np.array(list(truncation.KINDS.values())).T
    rate, mass = np.full(source.max() + 1, truncation.RATE), pseudo
    for _ in range(truncation.ROUNDS):
        p = mass / mass.sum(axis=1, keepdims=True)
        x = np.where(free, rate[source], prior)
        r = x * p[0, kind] / (x * p[0, kind] + (1 - x) * p[1, kind])
        mass = pseudo + np.stack((np.bincount(kind, n * r, len(kinds)), np.bincount(kind, n * (1 - r), len(kinds))))
        rate = (truncation.RATE * truncation.SOURCE_WEIGHT + np.bincount(source, n * r * free)) / (truncation.SOURCE_WEIGHT + np.bincount(source, n * free))
    p = mass / mass.sum(axis=1, keepdims=True)
    assert np.allclose([got[k] for k in kinds], np.log(p[0] / p[1]))


def test_limits_are_found():
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(5.8, 0.5, 4000)).astype(int)
    x = np.where((x > 500) & (rng.random(4000) < 0.7), 500, x)
    v, n = np.unique(x, return_counts=True)
    found = truncation.limits_of(v, n, 0)
    assert [f[0] for f in found] == [500] and found[0][3] > 0.9
    v, n = np.unique(np.exp(rng.normal(5.8, 0.5, 4000)).astype(int), return_counts=True)
    assert truncation.limits_of(v, n, 0) == []
    mu, sd = truncation.fit_lognormal(np.array([1.0]), np.array([0]), 500, 10)
    assert np.isfinite(mu) and np.isfinite(sd)


def test_censored_fit_recovers_the_distribution():
    rng = np.random.default_rng(5)
    x = np.exp(rng.normal(5.5, 0.6, 20000))
    kept = x[x < 400]
    mu, sd = truncation.fit_lognormal(kept, np.ones(len(kept)), 400.0, float((x >= 400).sum()))
    assert abs(mu - 5.5) < 0.03 and abs(sd - 0.6) < 0.03


def test_cut_rows(spark):
    rows = [("a", ["f1"], "It was la"), ("b", ["f1", "f2"], "It was late."), ("c", None, "No file and cu"), ("d", ["gone"], "Done."), ("n", ["f1"], None), ("e", ["f1"], "")]
    ies = spark.createDataFrame(rows + rows[:1], "urn string, stored_as array<string>, plain_text string")
    files = spark.createDataFrame([("f1", "s1"), ("f2", "s2"), ("f1", "s1"), ("f3", None)], "url string, data_source string")
    judged, limits, rates = truncation.find_cut(ies, "urn", "plain_text", "stored_as", files, "url", "data_source")
    assert {r.urn for r in judged.where("cut").collect()} == {"a", "c"} and limits.count() == 0
    assert {(r.source, r.texts, r.cut_texts) for r in rates.collect()} == {("s1", 2, 1), ("s2", 1, 0), (None, 2, 1)}


# 6: leaked items


def covered_by_brute_force(doc, item, run=8):
    d, w = leakage.words_of(doc), leakage.words_of(item)
    have = {tuple(d[k : k + run]) for k in range(len(d) - run + 1)}
    mark = {p for k in range(len(w) - run + 1) if tuple(w[k : k + run]) in have for p in range(k, k + run)}
    return len(mark), len(w)


def test_leaks_match_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 40)))) for k in range(12)]
    items += [(50, items[0][1]), (51, None), (52, ""), (53, "too short an item")]
    docs = []
    for k in range(150):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))]
        if k % 2:
            w = leakage.words_of(rnd.choice(items[:12])[1])
            a = rnd.randint(0, max(0, len(w) - 8))
            text[10:10] = [x.upper() if rnd.random() < 0.2 else x for x in w[a : a + rnd.randint(8, 30)]]
        docs.append((k, rnd.choice([" ", ",\n "]).join(text)))
    docs += [(900, None), (901, ""), (902, LONG + items[1][1])]
    want = {(d, i) for d, t in docs for i, u in items if t and u and (c := covered_by_brute_force(t, u))[0] * 2 >= c[1] > 0 and c[0]}
    for block in (1 << 26, 300):
        out = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", block_bytes=block)
        assert {(r.doc_id, r.item_id) for r in out.where("leaked").collect()} == want
    empty = leakage.find_leaks(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([], "item_id long, text string"), "item_id", "text")
    assert empty.count() == 0


BIG = 2**60 + 1


def test_ids_pass_unchanged(spark, tiny):
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(BIG, text, "s", 1), (None, text, None, 2)], "doc_id long, text string, source string, score int")
    items = spark.createDataFrame([(BIG + 2, text, "x"), (None, text, "y")], "item_id long, text string, d string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(docs, "doc_id", "text", items, "item_id", "text").where("leaked").collect()}
    assert got == {(d, i) for d in (BIG, None) for i in (BIG + 2, None)}
    samples = spark.read.parquet(f"{tiny}/moderation_samples.parquet")
    scored = toxicity.score_documents(docs, "doc_id", "text", "source", samples, "text", "is_abusive")[0]
    assert {(r.doc_id, r.source) for r in scored.collect()} == {(BIG, "s"), (None, None)}


def test_null_keys_and_clashing_columns(spark):
    rows = [(None, "a b", "Rokc", "It was la", "en", ["f"], 1), ("u", "a b", None, None, None, None, 2), ("w", "a b", "Rock ", "", "x", [], 3)]
    names = "urn string, title string, genre string, plain_text string, ie_language string, stored_as array<string>"
    ies = spark.createDataFrame(rows, f"{names}, extra int")
    for n in ("form", "k", "v", "value", "entry", "lang", "segment", "t", "urls", "source", "n_chars", "ending", "_code", "field_name", "salt", "n"):
        ies = ies.withColumn(n, F.lit("clash"))
    assert lookalike.lookalike_pairs(ies, "urn", "title").count() == 0
    genres = spark.createDataFrame(GENRES, "genre_id int, pref_label string, alt_labels array<string>")
    assert {(r.urn, r.entry) for r in canonical.map_rows(ies, "urn", "genre", genres, "genre_id", "pref_label", "alt_labels").collect()} == {(None, 1), ("w", 1)}
    assert encoding.find_garbled(ies, "urn", {"title": "title", "plain_text": "plain_text"}).count() == 0
    assert language.find_label_errors(ies, "urn", "plain_text", "ie_language").count() >= 0
    files = spark.createDataFrame([("f", "s", 1), (None, "s", 2)], "url string, data_source string, ending int")
    assert [r.urn for r in truncation.find_cut(ies, "urn", "plain_text", "stored_as", files, "url", "data_source")[0].where("cut").collect()] == [None]


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_alignment(a, b):
    assert leakage.align(np.array(a, np.uint64), np.array(b, np.uint64)) == smith_waterman(a, b)


def test_edited_copies_are_found_by_alignment(spark, tiny, monkeypatch):
    """A word changed every five words, words left out and put in: no run of eight is left."""
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(20, 60)))) for k in range(30)]
    docs, want = [], set()
    for k in range(300):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 200))]
        if k % 3 == 0:
            i, w = rnd.choice(items)
            w, a = w.split(), rnd.randint(0, 4)
            copy = []
            for n, x in enumerate(w):
                how = rnd.choice("cdi") if n % 5 == a else ""
                copy += {"c": ["other"], "d": [], "i": [x, "more"], "": [x]}[how]
            text[10:10] = copy
            want.add((k, i))
        elif k % 3 == 1:  # two short pieces in the wrong order
            w = rnd.choice(items)[1].split()
            text[5:5], text[0:0] = w[:5], w[-5:]
        docs.append((k, " ".join(text)))
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, "doc_id", "text", q, "item_id", "text").where("edited").collect()}
    got = found()
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.05 * len(got)
    assert {(k, i) for k, i in want if leakage.Items([items[i]], 8, 0.5).match([docs[k][1]], 0.5)} >= got & want
    m, texts = leakage.Items(items, 8, 0.5), [t for _, t in docs]
    with_alignment = [x for x in m.match(texts, 0.5) if x[-1]]
    for constant in (0, 10**6):
        monkeypatch.setattr(leakage, "align_many", lambda a, b, c=constant: np.full(len(a), c))
        assert [x for x in m.match(texts, 0.5) if x[-1]] != with_alignment
        assert len([x for x in m.match(texts, 0.5) if x[-1]]) == 0 if not constant else len([x for x in m.match(texts, 0.5) if x[-1]]) > len(with_alignment)


# 7: mixing


def test_mix(spark):
    docs = [(k, f"text number {k} " * (1 + k % 3), "big" if k % 4 else "small") for k in range(2000)] + [(5000, "unused", "other"), (5001, None, "big"), (5002, "", "big")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.45, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    used, shares = mixing.mix(df, "doc_id", "text", "source", targets)
    s = {r.source: r for r in shares.collect()}
    assert s["small"].rate == 3 and s["absent"].used_tokens == 0 and s["big"].rate < 2
    assert abs(s["small"].actual_share / s["big"].actual_share - 0.9) < 0.03
    assert used.where("uses > 3").count() == 0 and {r.source for r in used.select("source").distinct().collect()} == {"big", "small"}
    again = mixing.mix(df.repartition(7), "doc_id", "text", "source", targets)[0]
    assert sorted(map(tuple, used.collect())) == sorted(map(tuple, again.collect()))
    capped = {r.source: r for r in mixing.mix(df, "doc_id", "text", "source", targets, total_tokens=10**9)[1].collect()}
    assert capped["big"].rate == 2 and capped["small"].rate == 3
    assert mixing.mix(df.limit(0), "doc_id", "text", "source", targets)[0].count() == 0


def test_tokens_match_the_tokenizer(spark):
    texts = ["Hello world", "", None, "naïve — 你好 " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.n_tokens for r in mixing.count_tokens(df, "text").collect()]
    enc = mixing.encoding()
    assert got == [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


# 8: abusive passages


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_best_segment_is_the_maximum_sum(scores):
    best = max([sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)] + [0])
    found = toxicity.maximal_segments([float(x) for x in scores])
    assert max([s for s, _, _ in found] + [0]) == best
    assert all(abs(sum(scores[a:b]) - s) < 1e-9 for s, a, b in found)
    spans = sorted((a, b) for _, a, b in found)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def unified(text):
    return normalise_array(pa.array([text])).to_pylist()[0].casefold()


def test_disguises():
    r = toxicity.Reader({"bastard", "vermin", "halfwit", "horny"})
    for t in ("b45t4rd", "b*****d", "bas\u200btard", "b.a.s.t.a.r.d", "baaaastard", "b a s t a r d", "b\u0430st\u0430rd", "ＢＡＳＴＡＲＤ", "bast***"):
        assert "bastard" in r.words(unified(t)), t
        assert toxicity.hash_words(["bastard"])[0] in np.concatenate([b.words for b in toxicity.lex([f"One. Oh you {t} there. Two."], r)]), t
    assert r.words("book 45 page 1.5") == ["book", "45", "page", "1", ".", "5"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab1.*! \nB", max_size=25)), max_size=8))
def test_lines_are_read_as_one_by_one(texts):
    """Hashed words and sentences of all texts at once against the regular expression on each."""
    r = toxicity.Reader({"abba", "baab"})
    want = []
    for k, t in enumerate(texts):
        n = 0
        for w in [w for line in (t or "").lower().split("\n") for w in [*r.words(line), "\n"]]:
            n += w in toxicity.STOPS
            if w and w not in toxicity.STOPS:
                want.append((k, n, int(toxicity.hash_words([w])[0])))
    got = []
    for b in toxicity.lex(texts, r):
        got += list(zip(b.row.tolist(), b.sentence.tolist(), b.words.tolist(), strict=True))
    breaks = lambda x: [i for i in range(1, len(x)) if x[i][:2] != x[i - 1][:2]]
    assert [(r, w) for r, _, w in got] == [(r, w) for r, _, w in want]
    assert breaks(got) == breaks(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-5, 5), min_size=1, max_size=8), min_size=1, max_size=6))
def test_best_score_of_every_sentence(rows):
    heads = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
    got = toxicity.best_scores(np.array([x for r in rows for x in r], float), heads)
    assert np.allclose(got, [max([sum(r[i:j]) for i in range(len(r)) for j in range(i + 1, len(r) + 1)] + [0]) for r in rows])


def test_extreme_values():
    rng = np.random.default_rng(2)
    bins = lambda x: np.unique((np.maximum(0, x) / toxicity.STEP).round(), return_counts=True)
    for scale in (0.5, 0.7, 1.2):
        x = rng.gumbel(0.5, scale, 60000)
        clean, dirty = bins(x), bins(np.concatenate([x, np.full(60000, 15.0)]))  # the same with as many far above the law
        for b, w in (clean, dirty):
            lam, k = toxicity.fit_extreme(b * toxicity.STEP, w, 10.0)
            assert abs(lam * scale - 1) < 0.1
            assert abs(np.exp(-k * 10 * np.exp(-lam * 0.5)) - np.exp(-1)) < 0.05
    assert toxicity.fit_extreme(np.array([9.0]), np.ones(1), 5.0) == (1.0, 0.2)


BAD = "You are a worthless bastard and everybody laughs behind your back."


def test_scores(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text", "source")
    extra = [(90001, BAD, "x"), (90002, f"{LONG}. {BAD}", "x"), (90003, None, "x"), (90004, "", None), (90005, "The bastard title, page 3, stands before the full title.", "x"), (90006, BAD, "x")]
    df = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string, source string"))
    samples = spark.read.parquet(f"{tiny}/moderation_samples.parquet")
    scored, rates = toxicity.score_documents(df, "doc_id", "text", "source", samples, "text", "is_abusive")
    got = {r.doc_id: r for r in scored.collect()}
    assert len(got) == df.count()
    assert got[90001].flagged and got[90002].flagged and not got[90005].flagged
    assert "bastard" in got[90001].passage and got[90002].n_words == 60_011
    assert got[90003].score == got[90004].score == 0 and got[90001].score == got[90006].score
    assert rates.where("source = 'x'").first().flagged == 3
    assert toxicity.score_documents(df.limit(0), "doc_id", "text", "source", samples, "text", "is_abusive")[0].count() == 0
    assert toxicity.score_documents(docs, "doc_id", "text", "source", samples.limit(0), "text", "is_abusive")[0].count() == docs.count()


def test_neither_share_nor_length_raises_the_bar(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("text is not null").select("doc_id", "text", "source")
    samples = spark.read.parquet(f"{tiny}/moderation_samples.parquet")
    plain = "The list of old recordings lay on the table. "
    n = docs.count()
    for extra in ([], [(10**6 + k, BAD, "bad") for k in range(n)]):
        more = [(1, BAD, "x"), (2, plain * 20_000 + BAD, "x"), (3, plain, "x"), *extra]
        df = docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, source string"))
        scored = toxicity.score_documents(df, "doc_id", "text", "source", samples, "text", "is_abusive")[0].where("flagged")
        found = {r.doc_id for r in scored.collect()}
        assert {1, 2} <= found and 3 not in found and {e[0] for e in extra} <= found


def fitted(samples, docs):
    m = toxicity.Model(samples)
    blocks = list(toxicity.lex(docs, m.reader))
    h, n = np.unique(np.concatenate([b.words for b in blocks]), return_counts=True)
    m.fit([s for b in blocks for s in m.seeded(b)], 1.0, dict(zip(h.view(np.int64).tolist(), n.tolist(), strict=True)), int(n.sum()))
    top, size = zip(*((toxicity.best_scores(m.score(b.words), b.heads()), np.diff(np.append(b.heads(), len(b.words)))) for b in blocks), strict=True)
    b, w = np.unique((np.concatenate(top) / toxicity.STEP).round(), return_counts=True)
    m.lam, m.k = toxicity.fit_extreme(b * toxicity.STEP, w, float(np.concatenate(size).mean()))
    return m


def flagged(m, text, alpha=1e-5):
    return any((m.p_value(toxicity.best_scores(m.score(b.words), b.heads()), np.diff(np.append(b.heads(), len(b.words)))) < alpha).any() for b in toxicity.lex([text], m.reader) if len(b.words))


def test_samples_are_told_apart(tiny):
    """Held-out samples; the same without the law, that is with every positive score, tells nothing apart."""
    import duckdb

    rows = duckdb.sql(f"select text, is_abusive from '{tiny}/moderation_samples.parquet' order by hash(sample_id)").fetchall()
    docs = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    m = fitted(rows[:150], docs)
    got = [(flagged(m, t), flagged(m, t, 1.0), bool(y)) for t, y in rows[150:]]
    assert sum(f == y for f, _, y in got) >= 0.9 * len(got)
    assert sum(f for f, _, y in got if not y) <= 1 < sum(f for _, f, y in got if not y)


def test_the_list_alone_finds_nothing_in_ordinary_phrases(tiny):
    import duckdb

    docs = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    m = fitted([], docs)
    for t in ("we miss you", "clean the toilet", "this book of yours belongs here", "run and jump", "sat down on it", "begging for time", "she swallowed the pill", "a parasites and throat clinic", "du bist da", "eres un amigo", "nackt auf", "toute nue", "partir la semaine"):
        assert not flagged(m, t), t
    assert flagged(m, "oh you fucking dickhead")


def test_what_stands_beside_abuse_is_learned(tiny):
    """A sentence of unknown words that mostly stands in documents with abuse is found alone, one that merely stands there too isn't."""
    import duckdb

    samples = duckdb.sql(f"select text, is_abusive from '{tiny}/moderation_samples.parquet'").fetchall()
    docs = [t for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    other, usual = "Zelmak krovt obnuk tirsel quandu.", "Mirvel dorpat keeps sundal okrim."
    with_abuse = [f"Note {k} was read. {BAD} What kind of moron writes this crap, {k} times? {other} {usual}" for k in range(24)]
    alone = [f"Note {k} was read. {other}" for k in range(12)] + [f"Note {k} was written. {usual}" for k in range(600)]
    m = fitted(samples, docs + with_abuse + alone)
    assert flagged(m, BAD) and flagged(m, other) and not flagged(m, usual)
    m = fitted(samples, docs + with_abuse[:1] * 24 + alone)  # one document many times says no more than once
    assert flagged(m, BAD) and not flagged(m, other)


def test_all_samples_and_seeds_count(spark):
    """The model of all rows, of more samples than were once chosen, equals the one fitted to lists."""
    samples = [(f"You are a {'krevik' if k % 3 else 'bastard'} number {k}.", 1) if k % 2 else (f"A list of number {k} lay there.", 0) for k in range(20_500)]
    docs = [f"The bastard krevik took {k % 7} of them. The list {k} lay there." if k % 5 == 0 else f"A list of number {k} lay there. Read it." for k in range(300)]
    d, s = spark.createDataFrame([(t,) for t in docs], "text string"), spark.createDataFrame(samples, "text string, y int")
    m = toxicity.build_model(d, "text", s, "text", "y")
    want = fitted(samples, docs)
    assert np.array_equal(m.vocabulary, want.vocabulary) and np.allclose(m.odds, want.odds)


def test_sentences():
    assert sentences("One two. Three? “Four.” Five\nSix 3.5 x") == ["One two.", "Three?", "“Four.”", "Five", "Six 3.5 x"]
    assert sentences("") == []


def test_spread_join_is_the_join(spark):
    from kartei.llm.skew import spread_join

    big = spark.createDataFrame([(k, "hot" if k % 3 else f"v{k}") for k in range(300)] + [(None, "hot"), (7, None)], "k int, v string")
    small = spark.createDataFrame([("hot", 1), ("v0", 2), ("v9", 3), (None, 4)], "v string, w int")
    plain = sorted(map(str, big.join(small, "v").select("k", "v", "w").collect()))
    for ways in (1, 16):
        assert sorted(map(str, spread_join(big, small, ["v"], "k", ways).select("k", "v", "w").collect())) == plain
    assert spread_join(big.limit(0), small, ["v"], "k").count() == 0
