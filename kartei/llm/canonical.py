"""Problem 2: free-entered values mapped to the entries of a reference list.

The reference entries (labels and alternative labels) form a BK-tree under the unrestricted Damerau-Levenshtein
distance, which is a metric, so the triangle inequality prunes safely and a search returns every entry within the
threshold. Searches run for all keys of an Arrow batch at once: a frontier of (key, node) pairs is measured with one
vectorised dynamic programme per level. A list of up to ``shard_entries`` entries is one tree in every task; a longer
one is cut into shards by key that each see all values. A shard gives all that may count, and what wins, what is the only
reading of a shortened name and what a nearer entry rules out is decided over all shards, so their number changes nothing.

Defined results: NULL and blank values, and values that are exactly a label, give no row; a value that names several
entries gives one row for each; one that names none gives entry -1; equal distances go to the smaller entry id; equal
values are searched once however many rows hold them; an empty list gives -1 for all.
"""

from __future__ import annotations

import functools
import re
import unicodedata as ud
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.llm.skew import spread_join
from kartei.session import materialize

#: Words that may stand beside an entry without meaning anything.
FILLERS = frozenset("a and diverse etc genre genres live misc miscellaneous music musik musique música old other some style stuff the various general mixed my mix new type".split())
SPLIT = re.compile(r"[;,/&|+\n]")
NUMBER = re.compile(r"\s*\(\s*(\d{1,9})\s*\)|^\s*(\d{1,9})\s*$")
NUMBERED = 1 << 30  # parts from here on are numbers of entries
NEAR, SHORT, SHORT_OTHER = 0, 1, 2


def fold(text: str) -> str:
    """Lower case without accents; marks become blanks; & becomes and."""
    text = ud.normalize("NFKD", text.replace("&", " and ").replace("'", "").replace("’", "")).casefold()
    return re.sub(r"[\W_]+", " ", "".join(c for c in text if not ud.combining(c))).strip()


def key_of(text: str) -> str:
    return fold(text).replace(" ", "")


def threshold(length: int) -> int:
    """Edits allowed for an entry key of that length."""
    return 0 if length < 3 else 1 if length < 8 else 2


def damerau(a: list[str], b: list[str]) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances of the pairs (a[i], b[i]), all pairs at once."""
    n = len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    wa, wb = int(la.max(initial=0)), int(lb.max(initial=0))
    code: dict[str, int] = {}
    for s in {*a, *b}:
        for c in s:
            code.setdefault(c, len(code) + 1)
    pad = lambda xs, w: np.array([[*(code[c] for c in x), *[0] * (w - len(x))] for x in xs], np.int64).reshape(n, w)
    ca, cb, every = pad(a, wa), pad(b, wb), np.arange(n)
    big = wa + wb + 1
    h = np.full((wa + 2, wb + 2, n), big, np.int64)  # shifted by one: row and column 0 are the border
    h[1:, 1] = np.arange(wa + 1)[:, None]
    h[1, 1:] = np.arange(wb + 1)[:, None]
    seen = np.zeros((n, len(code) + 1), np.int64)  # the last row in which a character of a stood
    for i in range(1, wa + 1):
        match_col = np.zeros(n, np.int64)
        for j in range(1, wb + 1):
            same = ca[:, i - 1] == cb[:, j - 1]
            i1, j1 = seen[every, cb[:, j - 1]], match_col
            swap = np.where((i1 > 0) & (j1 > 0), h[i1, j1, every] + (i - i1 - 1) + 1 + (j - j1 - 1), big)
            h[i + 1, j + 1] = np.minimum(np.minimum(h[i, j] + ~same, np.minimum(h[i + 1, j], h[i, j + 1]) + 1), swap)
            match_col = np.where(same, j, match_col)
        seen[every, ca[:, i - 1]] = i
    return h[la + 1, lb + 1, every]


class BKTree:
    """A BK-tree over distinct keys; children of a node lie at distinct distances from it."""

    def __init__(self, keys: list[str]):
        self.keys = list(dict.fromkeys(keys))
        self.children: list[dict[int, int]] = [{} for _ in self.keys]
        at = {i: 0 for i in range(1, len(self.keys))}  # where each key waits on its way down
        while at:
            items, nodes = list(at), list(at.values())
            d = damerau([self.keys[i] for i in items], [self.keys[k] for k in nodes])
            for i, k, e in zip(items, nodes, d.tolist(), strict=True):
                child = self.children[k].setdefault(e, i)
                if child == i:
                    del at[i]
                else:
                    at[i] = child
        self.size = len(self.keys)

    def search(self, keys: list[str], most: list[int]) -> tuple[list[tuple[int, int, int]], int]:
        """(key index, entry index, distance) of every entry within the key's threshold; and the distances measured."""
        out, measured = [], 0
        front = [(i, 0) for i in range(len(keys))] if self.size else []
        while front:
            step: list[tuple[int, int]] = []
            for at in range(0, len(front), 4096):
                part = front[at : at + 4096]
                d = damerau([keys[i] for i, _ in part], [self.keys[k] for _, k in part]).tolist()
                measured += len(part)
                for (i, k), e in zip(part, d, strict=True):
                    if e <= most[i]:
                        out.append((i, k, e))
                    step.extend((i, c) for edge, c in self.children[k].items() if abs(edge - e) <= most[i])
            front = step
        return out, measured


class Matcher:
    """Reads values against one shard of entries: rows (entry id, label, 0 or 1 for an alternative label)."""

    def __init__(self, entries: tuple[tuple[int, str, int], ...], most_words: int):
        """most_words: words of the longest label of all shards."""
        self.most_words = most_words
        self.ids = {i for i, _, _ in entries}
        self.of_key: dict[str, int] = {}
        self.words = [(other, i, fold(label).split()) for i, label, other in sorted(entries)]
        for i, label, _ in sorted(entries, key=lambda e: (e[2], e[0], e[1])):
            if k := key_of(label):
                self.of_key.setdefault(k, i)
        self.tree = BKTree(sorted(self.of_key))

    def shortened(self, text: str) -> set[tuple[int, int]]:
        """(0 or 1 for an alternative label, entry) whose words begin like those of a shortened text ("mus. theatre", "D&B")."""
        raw = re.findall(r"[^\W_]+\.?", text.replace("&", " and "))
        words = [(fold(w), w.endswith(".") or len(w) == 1) for w in raw]
        if not any(cut for _, cut in words) or len(words) == 1 and len(words[0][0]) < 3:
            return set()

        def fits(short: str, full: str) -> bool:
            rest = iter(full)
            return short[:1] == full[:1] and all(c in rest for c in short)

        return {(o, i) for o, i, full in self.words if len(full) == len(words) and all(w == f or cut and (f.startswith(w) if len(words) == 1 else fits(w, f)) for (w, cut), f in zip(words, full, strict=True))}

    @staticmethod
    def parts(value: str) -> list[tuple[int, str]]:
        """(number, text) of the ways to read a value: -1 as a whole, -2 turned round at a comma, 0.. by separator."""
        pieces = [p for p in SPLIT.split(value) if p.strip()]
        out = [(-1, value)]
        if len(pieces) == 2 and "," in value:
            out.append((-2, f"{pieces[1]} {pieces[0]}"))
        return out + list(enumerate(pieces if len(pieces) > 1 else [value]))

    def spans(self, number: int, text: str) -> list[tuple[str, float, bool]]:
        """(key, cost of what is left over, whole) of the runs of words that may name an entry."""
        bare = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", text)
        words = fold(bare if fold(bare) else text).split()
        if number < 0:
            return [("".join(words), 0.0, True)] if words else []
        cost = [0.5 if w in FILLERS else 3.0 for w in words]
        total = sum(cost)
        return [("".join(words[i:j]), total - sum(cost[i:j]), j - i == len(words)) for i in range(len(words)) for j in range(i + 1, min(len(words), i + self.most_words) + 1)]

    def match(self, values: list[str]) -> Iterator[tuple[str, int, int, bool, float, int]]:
        """(value, part, kind, whole, score, entry) of all that may name an entry; whole: with all words of the part."""
        read, wanted = [], {}
        for v in values:
            for number, text in self.parts(v):
                if number >= 0:
                    for m in NUMBER.finditer(text):
                        if (i := int(m[1] or m[2])) in self.ids:
                            yield v, NUMBERED + number, NEAR, True, 0.0, i
                    text = NUMBER.sub(" ", text)
                for key, left, whole in self.spans(number, text):
                    read.append((v, number, key, left, text if whole else None))
                    wanted.setdefault(key, len(wanted))
        keys = list(wanted)
        hits, _ = self.tree.search(keys, [threshold(len(k) + 2) if len(k) > 2 else 0 for k in keys])
        near: dict[str, list[tuple[int, int]]] = {}
        for i, k, d in hits:
            # a filler counts only where it is an entry itself
            if d <= threshold(len(self.tree.keys[k])) and (not d or keys[i] not in FILLERS):
                near.setdefault(keys[i], []).append((d, self.of_key[self.tree.keys[k]]))
        best: dict[tuple[str, int], tuple[float, int]] = {}
        full: set[tuple[str, int]] = set()
        for v, number, key, left, text in read:
            for d, entry in near.get(key, ()):
                if d and left > 2 and len(key) < 6:
                    continue  # a short inexact word beside unknown ones
                found = (2 * d + left + (1.5 if number == -2 and d else 0), entry)
                best[v, number] = min(best.get((v, number), found), found)
            if text is not None and key in near:
                full.add((v, number))
            elif text is not None and number != -2 and key not in FILLERS:
                for other, entry in self.shortened(text):
                    yield v, number, SHORT_OTHER if other else SHORT, True, 2.5, entry
        for (v, number), (score, entry) in best.items():
            yield v, number, NEAR, (v, number) in full, score, entry


@functools.cache
def _matcher(entries: tuple[tuple[int, str, int], ...], most_words: int) -> Matcher:
    return Matcher(entries, most_words)


def map_values(values: DataFrame, column: str, reference: DataFrame, entry_id: str, label: str, alternatives: str, shard_entries: int = 20_000) -> DataFrame:
    """(value, entry) of every distinct non-blank value of a column that is not exactly a label.

    Each shard is a pass over the distinct values, which are checkpointed if there are several.
    """
    spark = values.sparkSession
    labels = reference.select(F.col(entry_id).cast("long").alias("entry"), F.col(label).alias("label"), F.lit(0).alias("other"))
    more = reference.select(F.col(entry_id).cast("long").alias("entry"), F.explode(alternatives).alias("label"), F.lit(1).alias("other"))

    @F.pandas_udf("key string, words int")
    def keyed(label: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"key": label.map(key_of), "words": label.map(lambda x: len(fold(x).split()))})

    entries = materialize(labels.unionByName(more).where("label is not null and entry is not null").distinct().withColumn("k", keyed("label")))
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("k.words"), F.lit(0)).alias("words")).first()
    shards = max(1, -(-size.n // shard_entries))
    blank = F.regexp_replace(F.col("value"), r"[\s\u00a0\u2000-\u200b\u202f\u3000\ufeff]+", "") == ""
    wanted = values.select(F.col(column).alias("value")).where("value is not null").distinct().where(~blank)
    wanted = wanted.join(labels.select(F.col("label").alias("value")).where("value is not null"), "value", "left_anti")
    if shards > 1:
        wanted = materialize(wanted)
    found = []
    for n in range(shards):
        mine = entries.where(F.pmod(F.xxhash64("k.key"), F.lit(shards)) == n) if shards > 1 else entries
        one = spark.sparkContext.broadcast(tuple(sorted((r[0], r[1], r[2]) for r in mine.select("entry", "label", "other").collect())))

        def run(batches, one=one, most_words=size.words):
            for b in batches:
                yield pd.DataFrame(list(_matcher(one.value, most_words).match(b["value"].tolist())), columns=["value", "part", "kind", "whole", "score", "entry"])

        found.append(wanted.mapInPandas(run, "value string, part int, kind int, whole boolean, score double, entry long"))
    found = functools.reduce(DataFrame.unionByName, found)
    # the winner of each part over all shards; numbers name entries of their own
    of = lambda kind, f: f(F.when(F.col("kind") == kind, F.col("entry")))
    best = found.groupBy("value", "part", F.when(F.col("part") >= NUMBERED, F.col("entry")).alias("own")).agg(
        F.min(F.when(F.col("kind") == NEAR, F.struct("score", "entry"))).alias("near"),
        F.coalesce(F.bool_or((F.col("kind") == NEAR) & F.col("whole")), F.lit(False)).alias("whole"),
        *[f(k).alias(name) for k, f, name in ((SHORT, lambda k: of(k, F.min), "a"), (SHORT, lambda k: of(k, F.max), "z"), (SHORT_OTHER, lambda k: of(k, F.min), "oa"), (SHORT_OTHER, lambda k: of(k, F.max), "oz"))],
    )
    only = F.when(F.col("a").isNotNull(), F.when(F.col("a") == F.col("z"), F.col("a"))).when(F.col("oa") == F.col("oz"), F.col("oa"))
    short = F.when(~F.col("whole") & only.isNotNull(), F.struct(F.lit(2.5).alias("score"), only.alias("entry")))
    best = best.select("value", "part", F.least("near", short).alias("w")).where("w is not null")
    ways = best.groupBy("value").agg(F.collect_set(F.struct("part", F.col("w.score").alias("score"), F.col("w.entry").alias("entry"))).alias("ways"))
    pick = lambda test: F.filter("ways", test)
    number, turned, whole, pieces = pick(lambda w: w.part >= NUMBERED), pick(lambda w: w.part == -2), pick(lambda w: w.part == -1), pick(lambda w: w.part.between(0, NUMBERED - 1))
    chosen = F.when(F.size(number) > 0, number).when(F.size(whole) > 0, whole).when(F.size(turned) > 0, turned).otherwise(pieces)
    named = ways.select("value", F.explode(F.array_distinct(F.transform(chosen, lambda w: w.entry))).alias("entry"))
    return wanted.join(named, "value", "left").select("value", F.coalesce("entry", F.lit(-1)).alias("entry"))


def map_rows(df: DataFrame, key: str, column: str, reference: DataFrame, entry_id: str, label: str, alternatives: str) -> DataFrame:
    """(key, entry) of every row whose value is not blank and not exactly a label; repeated rows count once."""
    mapped = map_values(df, column, reference, entry_id, label, alternatives)
    return spread_join(df.select(F.col(key), F.col(column).alias("value")), mapped, ["value"], key).select(key, "entry").distinct()
