"""Problem 1: one consistent form for text that looks the same.

Arrow strings become numpy code-point arrays. A lookup table sends each code point to a run in a pool (decomposed,
width folded, blanks unified, invisible ones dropped, look-alike letters replaced); the runs are gathered with expansion
offsets, marks are put in canonical order by a stable sort and composed rank by rank for all rows at once.

Defined results: NULL stays NULL; '' stays ''; a text of invisible characters only becomes ''; letter case, accents,
punctuation and raised or circled digits are kept; equal input rows give equal output rows, in place; no rows give none.
"""

from __future__ import annotations

import functools
import unicodedata as ud

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kartei.llm.arrowtext import as_string, code_points, from_code_points
from kartei.llm.skew import spread_join
from kartei.session import materialize

# Letters that have the shape of a Latin letter (Cyrillic, Greek, Roman numerals, Latin script g, Armenian).
CYRILLIC = dict(zip("аеіѕорсухјԁһԛԝӏАВЕЅІЈКМНОРСТХԌԚԜҮӀ", "aeisopcyxjdhqwlABESIJKMHOPCTXGQWYl", strict=True))
GREEK = dict(zip("ονϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿ", "ovjABEZHIKMNOPTYXJ", strict=True))
OTHER = dict(zip("ɡոօսⅰⅴⅹⅼⅽⅾⅿⅠⅤⅩⅬⅭⅮⅯ", "gnouivxlcdmIVXLCDM", strict=True))
EXTRA_BLANKS = "\t\n\v\f\r\u2028\u2029\u2800"
LIGATURES = range(0xFB00, 0xFB07)
#: Default-ignorable code points that are not of category Cf.
IGNORABLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
SIZE = 0x110000
L_BASE, V_BASE, T_BASE, S_BASE, L_COUNT, V_COUNT, T_COUNT = 0x1100, 0x1161, 0x11A7, 0xAC00, 19, 21, 28


def _fold(ch: str) -> str:
    """What one character becomes before composition."""
    out = []
    for x in ud.normalize("NFD", ch):
        kind = ud.decomposition(x)
        if kind.startswith(("<wide>", "<narrow>")) or ord(x) in LIGATURES:
            out.extend(ud.normalize("NFD", "".join(chr(int(h, 16)) for h in kind.split()[1:])))
        else:
            out.append(x)
    done = []
    for x in out:
        if ud.category(x) == "Zs" or x in EXTRA_BLANKS:
            done.append(" ")
        elif ud.category(x) != "Cf" and ord(x) not in IGNORABLE:
            done.append(CYRILLIC.get(x) or GREEK.get(x) or OTHER.get(x) or x)
    return "".join(done)


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """Lookup tables by code point, made once per Python process from the interpreter's Unicode data."""
    start, count = np.arange(SIZE, dtype=np.int32), np.ones(SIZE, np.uint8)
    combining, kind, pool = np.zeros(SIZE, np.uint8), np.zeros(SIZE, np.uint8), [np.arange(SIZE, dtype=np.uint32)]
    size, first, second, composed = SIZE, [], [], []
    plain = [*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]
    for c in plain:
        ch = chr(c)
        combining[c] = ud.combining(ch)
        if ud.category(ch)[0] in "LM":
            name = ud.name(ch, "")
            kind[c] = 2 if name.startswith("CYRILLIC") else 3 if name.startswith("GREEK") else 1
        to = _fold(ch)
        if to != ch:
            start[c], count[c] = size, len(to)
            pool.append(np.array([ord(x) for x in to], np.uint32))
            size += len(to)
        d = ud.decomposition(ch)
        if d and d[0] != "<" and " " in d and ud.normalize("NFC", ch) == ch:
            a, b = (int(h, 16) for h in d.split())
            first.append(a), second.append(b), composed.append(c)
    pair = np.array(first, np.int64) << 21 | np.array(second, np.int64)
    order = np.argsort(pair)
    back = {2: np.arange(SIZE, dtype=np.uint32), 3: np.arange(SIZE, dtype=np.uint32)}
    for script, letters in ((2, CYRILLIC), (3, GREEK)):
        for x, latin in reversed(letters.items()):
            back[script][ord(latin)] = ord(x)
    joins = np.zeros(SIZE, bool)
    joins[[b for b in second if combining[b] == 0]] = True
    # characters that stand for themselves in any surroundings of their like
    steady = np.zeros(SIZE, bool)
    for c in range(0x2800):
        ch = chr(c)
        steady[c] = not 0x1100 <= c < 0x1200 and combining[c] == 0 and kind[c] < 2 and not joins[c] and ud.normalize("NFC", _fold(ch)) == ch
    return {"steady": steady, "start": start, "count": count, "pool": np.concatenate(pool), "ccc": combining, "kind": kind, "pair": pair[order], "to": np.array(composed, np.uint32)[order], "cyrillic": back[2], "greek": back[3], "joins": joins}


def _lookup_pair(t: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The composition of each pair, 0 where there is none."""
    key = a.astype(np.int64) << 21 | b.astype(np.int64)
    at = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
    out = np.where(t["pair"][at] == key, t["to"][at], 0).astype(np.int64)
    a, b = a.astype(np.int64), b.astype(np.int64)
    lv = (a >= L_BASE) & (a < L_BASE + L_COUNT) & (b >= V_BASE) & (b < V_BASE + V_COUNT)
    out[lv] = S_BASE + ((a[lv] - L_BASE) * V_COUNT + b[lv] - V_BASE) * T_COUNT
    lvt = (a >= S_BASE) & (a < S_BASE + L_COUNT * V_COUNT * T_COUNT) & ((a - S_BASE) % T_COUNT == 0) & (b > T_BASE) & (b < T_BASE + T_COUNT)
    out[lvt] = a[lvt] + b[lvt] - T_BASE
    return out


def _compose(t: dict, p: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition. p: code points in canonical order; row: the row of each."""
    while True:
        ccc = t["ccc"][p]
        starter = ccc == 0
        head = np.maximum.accumulate(np.where(starter, np.arange(len(p)), -1))
        head = np.where((head >= 0) & (row[np.maximum(head, 0)] == row), head, -1)
        rank = np.where(starter | (head < 0), 0, np.arange(len(p)) - head)
        keep, cur, last = np.ones(len(p), bool), p.astype(np.int64), np.zeros(len(p), np.int64)
        for k in range(1, int(rank.max(initial=0)) + 1):
            i = np.flatnonzero(rank == k)
            h = head[i]
            new = _lookup_pair(t, cur[h], p[i])
            ok = (new > 0) & ((last[h] == 0) | (last[h] < ccc[i]))
            cur[h[ok]], keep[i[ok]] = new[ok], False
            last[h[~ok]] = ccc[i[~ok]]
        p, row = cur[keep].astype(np.uint32), row[keep]
        if len(p) < 2:
            return p, row
        # starters that join the starter right before them (Hangul, some Indic vowels)
        new = np.where(row[1:] == row[:-1], _lookup_pair(t, p[:-1], p[1:]) * (t["ccc"][p[1:]] == 0), 0)
        hit = np.flatnonzero(new)
        if not len(hit):
            return p, row
        hit = hit[np.concatenate(([True], np.diff(hit) > 1))]
        p = p.copy()
        p[hit] = new[hit]
        rest = np.ones(len(p), bool)
        rest[hit + 1] = False
        p, row = p[rest], row[rest]


#: Bytes of text worked on at once: some forty bytes of working arrays go with each.
BLOCK_BYTES = 1 << 20


def normalise_array(arr: pa.Array) -> pa.StringArray:
    """The consistent form of every row of an Arrow string array, in blocks of rows of bounded size."""
    arr = as_string(arr)
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    cuts = [0]
    while cuts[-1] < len(arr):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(off, off[cuts[-1]] + BLOCK_BYTES, "right")) - 1))
    return pa.concat_arrays([_normalise(arr.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]) if len(cuts) > 1 else arr


def _normalise(arr: pa.StringArray) -> pa.StringArray:
    """Rows of steady characters only are kept as they are."""
    points, off = code_points(arr)
    changing = np.concatenate(([0], np.cumsum(~tables()["steady"][points])))[off]
    rows = np.flatnonzero(changing[1:] > changing[:-1])
    if not len(rows):
        return arr
    changed = _normalise_rows(arr.take(pa.array(rows)))
    at = np.arange(len(arr))
    at[rows] = len(arr) + np.arange(len(rows))
    return pa.concat_arrays([arr, changed]).take(pa.array(at))


def _normalise_rows(arr: pa.StringArray) -> pa.StringArray:
    t = tables()
    n = len(arr)
    points, off = code_points(arr)
    row = np.repeat(np.arange(n), np.diff(off))
    # gather with expansion offsets
    count = t["count"][points].astype(np.int64)
    end = np.cumsum(count)
    step = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - count, count)
    p = t["pool"][np.repeat(t["start"][points], count) + step]
    row = np.repeat(row, count)
    if len(p):
        ccc = t["ccc"][p]
        if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & (row[1:] == row[:-1])).any():
            run = np.cumsum(np.concatenate(([True], (ccc[1:] == 0) | (row[1:] != row[:-1]))))
            p = p[np.lexsort((np.arange(len(p)), ccc, run))]
        # a word with a letter that only Cyrillic or Greek has is written in that script
        kind = t["kind"][p]
        cut = np.concatenate(([True], ((kind[1:] > 0) != (kind[:-1] > 0)) | (row[1:] != row[:-1])))
        at = np.flatnonzero(cut)
        word = np.cumsum(cut) - 1
        cyrillic = np.logical_or.reduceat(kind == 2, at)[word]
        greek = np.logical_or.reduceat(kind == 3, at)[word] & ~cyrillic
        p = np.where(cyrillic, t["cyrillic"][p], np.where(greek, t["greek"][p], p)).astype(np.uint32)
        if (t["ccc"][p] > 0).any() or t["joins"][p].any() or ((p >= V_BASE) & (p < T_BASE + T_COUNT)).any():
            p, row = _compose(t, p, row)
    out = np.searchsorted(row, np.arange(n + 1))
    return from_code_points(p, out, np.asarray(arr.is_null()))


def with_form(df: DataFrame, column: str, into: str = "form") -> DataFrame:
    """df with the consistent form of a string column in a further one; a column of that name is replaced."""
    keep = [c for c in df.columns if c != into]
    source = df.select(*keep)
    at = keep.index(column)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, normalise_array(b.column(at))], names=[*keep, into])

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField(into, T.StringType())]))


def lookalike_pairs(df: DataFrame, key: str, column: str, rows_a_salt: int = 50_000, kinds_a_way: int = 1000) -> DataFrame:
    """Pairs of keys whose texts have one form but are different strings: (key_a, key_b, form), key_a < key_b.

    Pairs are made between the different strings of a form and only then given to their rows, so work follows the
    result, and rows that hold the very same string are never paired. A string held by many rows is spread over salts.
    Rows with NULL text give none; repeated rows count once.
    """
    rows = materialize(with_form(df.select(F.col(key).alias("k"), F.col(column).alias("v")).where(F.col("v").isNotNull()), "v"))
    held = rows.groupBy("form", "v").agg(F.count(F.lit(1)).alias("n"))
    many = held.groupBy("form").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    held = held.join(many, "form").withColumn("salts", F.ceil(F.col("n") / rows_a_salt).cast("int")).withColumn("ways", F.ceil(F.col("kinds") / kinds_a_way).cast("int")).drop("kinds")
    held = materialize(held)
    rows = spread_join(rows, held.select("form", "v", "salts"), ["form", "v"], "k").distinct()
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("k"), F.col("salts")).cast("int")).select("form", "v", "salt", "k")
    a, b = held.select("form", F.col("v").alias("va"), F.col("salts").alias("sa"), F.col("ways").alias("wa")), held.select("form", F.col("v").alias("vb"), F.col("salts").alias("sb"), F.col("ways").alias("wb"))
    # a form of many strings is spread: each string goes one way and meets the others, which go all ways
    a = a.withColumn("way", F.pmod(F.xxhash64("va"), F.col("wa")).cast("int")).drop("wa")
    b = b.withColumn("way", F.explode(F.sequence(F.lit(0), F.col("wb") - 1))).drop("wb")
    kinds = a.join(b, ["form", "way"]).where("va < vb").drop("way")
    left = kinds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("sa") - 1))).join(rows.select("form", F.col("v").alias("va"), "salt", F.col("k").alias("ka")), ["form", "va", "salt"])
    both = (
        left.drop("salt")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)))
        .join(rows.select("form", F.col("v").alias("vb"), "salt", F.col("k").alias("kb")), ["form", "vb", "salt"])
        .where("ka <> kb")
    )
    return both.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b"), "form").distinct()
