"""Full-text search: matching, postings, snippets and the search queries.

Indexed properties: file name, title, comment, plain text, album title and artist name. Several words must all occur, in
any order, each in any form that has its English stem. There are no stop words; words over 200 characters are not indexed.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kartei.catalog import FILE_SYSTEM, Catalog, explode_links, is_a, page, with_availability
from kartei.functions.stem import stem, word_forms
from kartei.functions.text import fold, tokens
from kartei.plans import listing
from kartei.plans.registry import query


def query_words(terms: list[str]) -> list[str]:
    """The folded words of the search terms."""
    import re
    import unicodedata as ud

    text = "".join(c for c in ud.normalize("NFD", " ".join(terms).lower()) if not ud.combining(c))
    return [w for w in re.split(r"[\W_]+", text) if w]


def matches(terms: list[str], *columns: Column) -> Column:
    """True where the columns together hold every word of the terms, in any form."""
    words = query_words(terms)
    if not words:
        return F.lit(False)
    have = tokens(F.concat_ws("\n", *columns))
    return functools.reduce(lambda a, b: a & b, [F.arrays_overlap(have, F.array(*[F.lit(f) for f in word_forms(w)])) for w in words])


def snippet(text: Column, terms: list[str], before: int = 30, after: int = 60, begin: str = "«", end: str = "»") -> Column:
    """The text around the first match of the first word, marked; line ends as blanks."""
    flat = F.translate(text, "\r\n", "  ")
    word = query_words(terms)[0]
    at = F.locate(word, fold(flat))
    start = F.greatest(at - before, F.lit(1))
    n = len(word)
    marked = F.concat(F.substring(flat, start, at - start), F.lit(begin), F.substring(flat, at, F.lit(n)), F.lit(end), F.substring(flat, at + n, F.lit(after)))
    return F.when(at > 0, marked).otherwise(F.left(flat, F.lit(before + after)))


def postings(c: Catalog) -> DataFrame:
    """The index (token, graph, urn, tf, first_pos) of the interpretations' texts."""
    text = F.concat_ws("\n", "title", "ie_comment", "plain_text")
    each = c.ies.select("graph", "urn", F.posexplode(tokens(text)).alias("pos", "token"))
    return each.groupBy("token", "graph", "urn").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.count_distinct("pos").alias("tf")).select("token", "graph", "urn", "tf", "first_pos")


#: Folders of a stored index; the postings of a token, however many, lie in one folder, in several files.
BUCKETS, FILES = 256, 4


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def write_postings(index: DataFrame, folder: str) -> None:
    """Store an index by the hash of its tokens, so that a look-up reads the folders of its words alone."""
    placed = index.withColumn("bucket", _bucket(F.col("token")))
    placed.repartition("bucket", F.pmod(F.xxhash64("urn"), F.lit(FILES))).write.mode("overwrite").partitionBy("bucket").parquet(folder)


def read_postings(spark: SparkSession, folder: str, terms: list[str]) -> DataFrame:
    """The postings of the words of the terms, in any form, from a stored index."""
    forms = sorted({f for w in query_words(terms) for f in word_forms(w)})
    if not forms:
        return spark.read.parquet(folder).drop("bucket").where(F.lit(False))
    places = functools.reduce(lambda a, b: a | b, [F.col("bucket") == _bucket(F.lit(f)) for f in forms])
    return spark.read.parquet(folder).where(places & F.col("token").isin(forms)).drop("bucket")


def lookup(index: DataFrame, terms: list[str]) -> DataFrame:
    """(graph, urn) that hold every word, from the index: one pass and one aggregation however many words."""
    stems = {stem(w): w for w in query_words(terms)}
    of = {f: s for s, w in stems.items() for f in word_forms(w)}
    meant = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col("token")]
    return index.where(F.col("token").isin(*of)).groupBy("graph", "urn").agg(F.count_distinct(meant).alias("k")).where(F.col("k") == len(stems)).select("graph", "urn")


def _text() -> list[Column]:
    return [F.col("title"), F.col("ie_comment"), F.col("plain_text")]


def search_content(c: Catalog, kind: str, terms: list[str], detailed: bool = False, show_all: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """(urn, url, snippet) of the interpretations of a content graph."""
    graph, cls = listing.CONTENT[kind]
    files = with_availability(c.located("url", "data_source", graph=graph), c.roots, show_all).select("url")
    hit = c.in_graph("ies", graph).where(is_a(F.col("rdf_types"), cls) & matches(terms, *_text()))
    shown = snippet(F.concat_ws(" ", *_text()), terms) if detailed else F.lit("")
    found = explode_links(hit.select("urn", "stored_as", shown.alias("snippet")), "stored_as", "url")
    return page(found.join(files, "url", "left_semi").select("urn", "url", "snippet").distinct(), ["url", "urn"], offset, limit)


def search_files(c: Catalog, terms: list[str], detailed: bool = False, show_all: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """(url, snippet) of the files whose name matches."""
    hit = c.in_graph("files", FILE_SYSTEM).where(matches(terms, F.col("file_name"))).select("url", "data_source", (snippet(F.col("file_name"), terms) if detailed else F.lit("")).alias("snippet")).distinct()
    return page(with_availability(hit, c.roots, show_all).select("url", "snippet"), ["url"], offset, limit)


def search_folders(c: Catalog, terms: list[str], show_all: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """(urn, url) of the folders whose own name matches."""
    hit = listing.folders_with_source(c).where(matches(terms, F.regexp_extract("url", r"[^/]*$", 0)))
    return page(with_availability(hit, c.roots, show_all).select("urn", "url"), ["url", "urn"], offset, limit)


def search_all(c: Catalog, terms: list[str], detailed: bool = False, show_all: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """(elem, url, snippet): files by name, and interpretations of every graph by their texts."""
    files = c.located("url", "data_source", "file_name")
    named = files.where(matches(terms, F.col("file_name"))).select(F.lit(None).cast("string").alias("elem"), "url", (snippet(F.col("file_name"), terms) if detailed else F.lit("")).alias("snippet"))
    shown = snippet(F.concat_ws(" ", *_text()), terms) if detailed else F.lit("")
    meant = explode_links(c.ies.where(matches(terms, *_text())).select(F.col("urn").alias("elem"), "stored_as", shown.alias("snippet")), "stored_as", "url").select("elem", "url", "snippet")
    seen = with_availability(files.select("url", "data_source"), c.roots, show_all).select("url")
    return page(named.unionByName(meant).join(seen, "url", "left_semi").select("elem", "url", "snippet").distinct(), ["url", "elem"], offset, limit)


def search_albums(c: Catalog, terms: list[str]) -> DataFrame:
    return listing.albums(c).where(matches(terms, F.col("title")))


def search_artists(c: Catalog, terms: list[str], show_all: bool = False) -> DataFrame:
    return listing.list_artists(c, show_all).where(matches(terms, F.col("artist_name")))


#: Kinds in the order in which the front end looks at its flags; "all" is first.
KINDS = ("all", "files", "folders", "artists", "albums", "music", "images", "videos", "documents", "software")


def search(c: Catalog, kinds: set[str], terms: list[str], detailed: bool = False, show_all: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """The front end: without terms a list, with terms a search; the first asked kind in the fixed order wins."""
    kind = next((k for k in KINDS if k in kinds), "all")
    if not terms:
        if kind in listing.CONTENT:
            return listing.list_content(c, kind, show_all, offset, limit)
        if kind == "albums":
            return listing.list_albums(c, offset, limit)
        return {"all": listing.list_all, "files": listing.list_files, "folders": listing.list_folders, "artists": listing.list_artists}[kind](c, show_all, offset, limit)
    if kind in listing.CONTENT:
        return search_content(c, kind, terms, detailed, show_all, offset, limit)
    if kind == "albums":
        return search_albums(c, terms)
    if kind == "artists":
        return search_artists(c, terms, show_all)
    if kind == "folders":
        return search_folders(c, terms, show_all, offset, limit)
    return {"all": search_all, "files": search_files}[kind](c, terms, detailed, show_all, offset, limit)


_AVAILABLE = "(select distinct urn from roots where available)"


def sql_tokens(text: str) -> str:
    return rf"[x for x in regexp_split_to_array(strip_accents(lower({text})), '[^\p{{L}}\p{{N}}]+') if length(x) between 1 and 200]"


#: The forms of the words that the queries ask for, stated by hand.
_FORMS = {"resume": "resum(e|es|ed|er|ers|ing)", "references": "refer(s|red|ring|ence|ences|enced|encing|ent|ents|able|er|ers)?", "letters": "letter(e|s|es|ed|ing)?", "missing": "miss(es|ed|ing)?", "invoice": "invoic(e|es|ed|ing)", "seating": "seat(s|ed|ing)?", "plan": "plan(s|ned|ning)?"}


def sql_matches(terms: list[str], text: str) -> str:
    held = [f"len([x for x in {sql_tokens(text)} if regexp_full_match(x, '{_FORMS.get(w, w)}')]) > 0" for w in query_words(terms)]
    return " and ".join(held)


def sql_snippet(text: str, terms: list[str]) -> str:
    flat, word = f"translate({text}, chr(13) || chr(10), '  ')", query_words(terms)[0]
    at = f"instr(strip_accents(lower({flat})), '{word}')"
    return f"case when {at} > 0 then substr({flat}, greatest({at} - 30, 1), {at} - greatest({at} - 30, 1)) || '«' || substr({flat}, {at}, {len(word)}) || '»' || substr({flat}, {at} + {len(word)}, 60) else left({flat}, 90) end"


_TEXT = "concat_ws(chr(10), title, ie_comment, plain_text)"
TERMS = ["Résumé", "references"]


def _register_content() -> None:
    terms = {"documents": TERMS, "images": ["gruße"], "music": ["letters"], "videos": ["the"], "software": ["the"]}
    for letter, kind in zip("abcde", listing.CONTENT, strict=True):
        graph, typed = listing.sql_content(kind)

        def run(spark: SparkSession, sf_dir: str, kind: str = kind) -> DataFrame:
            return search_content(listing.loaded(spark, sf_dir, kind), kind, terms[kind], detailed=True)

        query(f"r12{letter}_search_{kind}", f"""
select distinct urn, url, snippet from (select urn, unnest(stored_as) as url, {sql_snippet("concat_ws(' ', title, ie_comment, plain_text)", terms[kind])} as snippet from ies where graph = '{graph}' and {typed} and {sql_matches(terms[kind], _TEXT)})
where url in (select url from files where graph = '{graph}' and data_source in {_AVAILABLE})""")(run)


_register_content()


@query("r11_search_all", f"""
with f as (select distinct url, data_source, file_name from files where graph = '{FILE_SYSTEM}'),
x as (select null as elem, url, {sql_snippet("file_name", ["letters"])} as snippet from f where {sql_matches(["letters"], "file_name")} union select urn, unnest(stored_as), {sql_snippet("concat_ws(' ', title, ie_comment, plain_text)", ["letters"])} from ies where {sql_matches(["letters"], _TEXT)})
select distinct elem, url, snippet from x where url in (select url from f where data_source in {_AVAILABLE})""")
def r11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_all(Catalog.load(spark, sf_dir), ["letters"], detailed=True)


@query("r13_search_files", f"select distinct url, {sql_snippet("file_name", ["mp3"])} as snippet from files where graph = '{FILE_SYSTEM}' and data_source in {_AVAILABLE} and {sql_matches(['mp3'], 'file_name')}")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_files(Catalog.load(spark, sf_dir), ["mp3"], detailed=True)


@query("r14_search_folders", f"""
with w as (select regexp_extract(min(url), '[^/]*$') as w from folders),
s as (select f.urn, f.url, arg_max(r.urn, length(r.url)) as ds from (select distinct urn, url from folders) f join roots r on f.url = r.url or starts_with(f.url, r.url || '/') group by 1, 2)
select s.urn, s.url from s, w where ds in {_AVAILABLE} and list_contains({sql_tokens("regexp_extract(s.url, '[^/]*$')")}, w.w)""")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return search_folders(c, [c.folders.agg(F.min("url")).first()[0].rsplit("/", 1)[1]])


@query("r15_search_albums", f"""
with a as (select distinct album, url_decode(regexp_extract(album, '^urn:album:([^:]*)', 1)) as title from ies where graph = 'tracker:Audio' and album is not null),
w as (select regexp_extract(min(title), '^[^ ]*') as w from a)
select a.album, a.title from a, w where list_contains({sql_tokens("a.title")}, strip_accents(lower(w.w)))""")
def r15a(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    return search_albums(c, [listing.albums(c).agg(F.min("title")).first()[0].split(" ")[0]])


@query("r15_search_artists", f"""
with w as (select regexp_extract(max(artist_name), '^[^ ]*') as w from artists where urn in (select artist from ies where graph = 'tracker:Audio' and len(stored_as) > 0))
select distinct a.urn, a.artist_name from w, artists a join (select artist, unnest(stored_as) as url from ies where graph = 'tracker:Audio') i on i.artist = a.urn
where i.url in (select url from files where graph = 'tracker:Audio') and list_contains({sql_tokens("a.artist_name")}, strip_accents(lower(w.w)))""")
def r15b(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog.load(spark, sf_dir)
    heard = c.in_graph("ies", "tracker:Audio").where(F.size("stored_as") > 0).select(F.col("artist").alias("urn"))
    return search_artists(c, [c.artists.join(heard, "urn", "left_semi").agg(F.max("artist_name")).first()[0].split(" ")[0]], show_all=True)


@query("r28_front_end", f"select distinct url, file_name from files where graph = '{FILE_SYSTEM}'")
def r28(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The front end with two flags and no terms: files come before folders."""
    return search(Catalog.load(spark, sf_dir), {"folders", "files"}, [], show_all=True)


@query("t01_match_all", rf"select doc_id from documents where {sql_matches(['Seating', 'PLAN'], 'text')}")
def t01(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.where(matches(["Seating", "PLAN"], F.col("text"))).select("doc_id")


@query("t01_postings", f"""
with t as (select distinct graph, urn, {sql_tokens(_TEXT)} as w from ies), p as (select graph, urn, unnest(w) as token, unnest(range(len(w))) as pos from t)
select token, graph, urn, count(*) as tf, min(pos)::int as first_pos from p group by 1, 2, 3""")
def t01b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(Catalog.load(spark, sf_dir))


@query("t01_lookup", f"select distinct graph, urn from ies where {sql_matches(['missing', 'invoice'], _TEXT)}")
def t01c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(postings(Catalog.load(spark, sf_dir)), ["missing", "invoice"])


_FLAT = r"translate(text, chr(13) || chr(10), '  ')"


@query("t02_snippet", f"""
with f as (select doc_id, {_FLAT} as t, instr(strip_accents(lower({_FLAT})), 'harbour') as a from documents)
select doc_id, substr(t, greatest(a - 30, 1), a - greatest(a - 30, 1)) || '«' || substr(t, a, 7) || '»' || substr(t, a + 7, 60) as snippet from f where a > 0""")
def t02(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.where(F.locate("harbour", fold(F.translate("text", "\r\n", "  "))) > 0).select("doc_id", snippet(F.col("text"), ["harbour"]).alias("snippet"))


@query("t04_token_counts", f"select token, count(*) as n from (select unnest({sql_tokens('file_name')}) as token from (select distinct url, file_name from files where graph = '{FILE_SYSTEM}')) group by 1")
def t04(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Catalog.load(spark, sf_dir).data_objects("url", "file_name")
    return f.select(F.explode(tokens(F.col("file_name"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
