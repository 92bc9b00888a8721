"""Problem 6: passages of test items in a corpus.

Rare n-gram seeds join documents to items: the runs of four words of all items (a bounded query set, taken in blocks of
bounded bytes if it is larger) are counted over the whole corpus, and for each item the commonest ones that no leak can
consist of alone are put aside. Words and seeds are hashed for many documents at once. A document that holds a seed of an
item is aligned with it word by word (Smith-Waterman, linear gaps) in windows around the seeds, many windows at a time; the
score, as a share of a perfect one, decides about edited copies. The exact test follows: runs of at least ``run`` words in
common must cover at least ``share`` of the item's words. As such a run alone makes an alignment, only ``edited`` depends on
the score; it needs two seeds at different places of the item.

Defined results: NULL or empty texts match nothing; NULL ids are kept as they are; items shorter than a run never leak; an item repeated under several
ids matches under each; several copies of a passage count once; documents of any length are read whole.
"""

from __future__ import annotations

import functools
import re
import unicodedata as ud

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.llm.words import word_hashes

WORD = re.compile(r"[^\W_]+")
PRIME = np.uint64(0x9E3779B97F4A7C15)
MATCH, MISMATCH, GAP = 2, -1, -1
SEED = 4
CELLS = 1 << 21  # of alignment tables worked on at once


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits without regard to case."""
    return WORD.findall(composed(text).lower())


def composed(text: str | None) -> str:
    return "" if not text else text if text.isascii() else ud.normalize("NFC", text)


def hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts and where each text begins in them, one more for the end."""
    h, row = word_hashes([composed(t) for t in texts])
    return h, np.searchsorted(row, np.arange(len(texts) + 1))


def grams(hashes: np.ndarray, run: int) -> np.ndarray:
    """The hash of every run of that many words."""
    n = len(hashes) - run + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(run):
            out = out * PRIME + hashes[k : k + n]
            out ^= out >> np.uint64(29)
    return out


def grams_within(hashes: np.ndarray, off: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all runs that lie within one text, and where they begin."""
    g = grams(hashes, run)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    at = np.flatnonzero(text[: len(g)] == text[len(text) - len(g) :]) if len(g) else np.zeros(0, np.int64)
    return g[at], at


class Postings:
    """Where each n-gram stands in the items."""

    def __init__(self, hashes: np.ndarray, off: np.ndarray, run: int):
        g, at = grams_within(hashes, off, run)
        item = np.searchsorted(off, at, "right") - 1
        order = np.argsort(g, kind="stable")
        self.grams, start = np.unique(g[order], return_index=True)
        self.start = np.append(start, len(g))
        self.item, self.at = item[order], (at - off[item])[order]

    def find(self, g: np.ndarray) -> np.ndarray:
        """The number of each n-gram, -1 for others."""
        if not len(self.grams):
            return np.full(len(g), -1)
        at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        return np.where(self.grams[at] == g, at, -1)

    def hits(self, g: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position given with the n-gram, posting) of every n-gram that items have."""
        n = self.find(g)
        some = np.flatnonzero(n >= 0)
        n, where = n[some], where[some]
        count = self.start[n + 1] - self.start[n]
        post = np.repeat(self.start[n], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(where, count), post


class Items:
    """A block of items: their word hashes, and the postings of their seeds and runs."""

    def __init__(self, rows: list[tuple[str | None, str | None]], run: int, share: float):
        self.run, self.share = run, share
        self.ids = [i for i, _ in rows]
        self.words, self.off = hashes_of([t for _, t in rows])
        self.seeds, self.runs = Postings(self.words, self.off, SEED), Postings(self.words, self.off, run)
        self.rare = np.ones(len(self.seeds.item), bool)  # by posting

    def of(self, k: int) -> np.ndarray:
        return self.words[self.off[k] : self.off[k + 1]]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """In how many texts each seed stands."""
        h, off = hashes_of(texts)
        g, at = grams_within(h, off, SEED)
        n = self.seeds.find(g)
        some = np.flatnonzero(n >= 0)
        text = np.searchsorted(off, at[some], "right") - 1
        seen = np.unique(text * len(self.seeds.grams) + n[some])
        return np.bincount(seen % max(len(self.seeds.grams), 1), minlength=len(self.seeds.grams))

    def keep_rare(self, count: np.ndarray) -> None:
        """Put aside the commonest seeds of each item: as many as the least leak has, less one, so that one of its seeds is left."""
        common = np.repeat(count, np.diff(self.seeds.start))
        size = np.diff(self.off)
        need = np.maximum(np.ceil(size * self.share).astype(np.int64), 1)
        whole = need // self.run  # a leak of so many runs without overlap has the fewest seeds, or one of a run more
        least = np.minimum(np.where(whole > 0, need - (SEED - 1) * whole, size), -(-need // self.run) * (self.run - SEED + 1))
        order = np.lexsort((np.arange(len(common)), -common, self.seeds.item))
        first = np.searchsorted(self.seeds.item[order], np.arange(len(size)))
        rank = np.arange(len(order)) - first[self.seeds.item[order]]
        self.rare[order] = rank >= least[self.seeds.item[order]] - 1

    def match(self, texts: list[str | None], edited: float) -> list[tuple[int, int, float, int, int, bool, bool]]:
        """(text, item, score, words covered, seeds, leaked, edited) of every text and item that align."""
        h, off = hashes_of(texts)
        g, at = grams_within(h, off, SEED)
        where, post = self.seeds.hits(g, at)
        if not len(where):
            return []
        text, item = np.searchsorted(off, where, "right") - 1, self.seeds.item[post]
        pair = text * len(self.ids) + item
        wanted = np.unique(pair[self.rare[post]])
        keep = np.isin(pair, wanted)
        where, post, pair = where[keep], post[keep], pair[keep]
        order = np.lexsort((where, pair))
        where, at_item, pair = where[order], self.seeds.at[post[order]], pair[order]
        pairs, head, seeds = np.unique(pair, return_index=True, return_counts=True)
        tail = np.append(head[1:], len(pair))
        covered = self._covered(h, off, pairs)
        size = np.diff(self.off)[pairs % max(len(self.ids), 1)]
        leaked = (covered > 0) & (covered >= self.share * size)
        # a copy with two seeds at different places of the item may be an edited one
        spread = np.maximum.reduceat(at_item, head) - np.minimum.reduceat(at_item, head) >= SEED
        chosen = np.flatnonzero(leaked | (covered > 0) | spread)
        jobs = []
        for n, k in enumerate(chosen):
            t, i = divmod(int(pairs[k]), len(self.ids))
            w = where[head[k] : tail[k]] - off[t]
            jobs += [(n, h[off[t] + a : off[t] + b], self.of(i)) for a, b in windows(w, SEED, len(self.of(i)), int(off[t + 1] - off[t]))]
        best = np.zeros(len(chosen), np.int64)
        np.maximum.at(best, np.array([n for n, _, _ in jobs], np.int64), align_many([a for _, a, _ in jobs], [b for _, _, b in jobs]))
        out = []
        for k, s in zip(chosen, best.tolist(), strict=True):
            t, i = divmod(int(pairs[k]), len(self.ids))
            part = s / (MATCH * int(size[k]))
            if leaked[k] or covered[k] or part >= edited:
                out.append((t, i, part, int(covered[k]), int(seeds[k]), bool(leaked[k]), bool(not leaked[k] and part >= edited)))
        return out

    def _covered(self, h: np.ndarray, off: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Words of the item in runs that stand in the text, for each pair."""
        where, post = self.runs.hits(*grams_within(h, off, self.run))
        out = np.zeros(len(pairs), np.int64)
        if not len(where):
            return out
        pair = (np.searchsorted(off, where, "right") - 1) * len(self.ids) + self.runs.item[post]
        longest = int(np.diff(self.off).max()) + 1
        # the places of a pair's runs in order: each adds what lies behind the end of the one before
        key = np.unique(pair * longest + self.runs.at[post])
        pair, at = key // longest, key % longest
        new = np.full(len(key), self.run, np.int64)
        same = pair[1:] == pair[:-1]
        new[1:][same] = np.minimum(self.run, at[1:] - at[:-1])[same]
        n = np.searchsorted(pairs, pair)
        ok = (n < len(pairs)) & (pairs[np.minimum(n, len(pairs) - 1)] == pair)
        np.add.at(out, n[ok], new[ok])
        return out


def align(a: np.ndarray, b: np.ndarray) -> int:
    """The best local alignment score of two word sequences."""
    return int(align_many([a], [b])[0])


def align_many(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The best local alignment scores (Smith-Waterman) of many pairs, a row of all tables at a time."""
    out = np.zeros(len(a), np.int64)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    order = np.lexsort((la, lb))
    done = 0
    while done < len(order):
        wide = max(1, int(lb[order[done]]))
        part = order[done : done + max(1, CELLS // (4 * wide))]
        part = part[lb[part] <= 2 * wide]
        done += len(part)
        part = part[np.argsort(-la[part], kind="stable")]
        wide = int(lb[part].max())
        if not wide or not la[part].max():
            continue
        y = np.zeros((len(part), wide), np.uint64)
        inside = np.arange(wide) < lb[part][:, None]
        for r, k in enumerate(part):
            y[r, : lb[k]] = b[k]
        slope = (-GAP * np.arange(wide + 1)).astype(np.int32)
        h, best = np.zeros((len(part), wide + 1), np.int32), np.zeros(len(part), np.int32)
        live = len(part)
        for step in range(int(la[part[0]])):
            while la[part[live - 1]] <= step:
                live -= 1
            x = np.array([a[k][step] for k in part[:live]], np.uint64)
            now = h[:live]
            t = np.zeros((live, wide + 1), np.int32)
            t[:, 1:] = np.maximum(now[:, :-1] + np.where((y[:live] == x[:, None]) & inside[:live], MATCH, MISMATCH), np.maximum(now[:, 1:] + GAP, 0))
            h[:live] = np.maximum.accumulate(t + slope, axis=1) - slope  # gaps along the row
            best[:live] = np.maximum(best[:live], h[:live].max(axis=1))
        out[part] = best
    return out


def windows(at: np.ndarray, run: int, reach: int, size: int) -> list[tuple[int, int]]:
    """Stretches of a document around seed positions."""
    at = np.unique(at)
    cut = np.flatnonzero(np.diff(at) > 2 * reach)
    return [(max(0, int(at[i]) - reach), min(size, int(at[j]) + run + reach)) for i, j in zip([0, *(cut + 1)], [*cut, len(at) - 1], strict=True)]


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 8, share: float = 0.5, edited: float = 0.5, block_bytes: int = 1 << 26) -> DataFrame:
    """(doc, item, score, covered, item_words, seeds, leaked, edited) of every document and item with a run in common or an edited copy.

    score is the alignment's share of a perfect one. leaked: runs of ``run`` words cover ``share`` of the item; edited: not
    leaked, but a score of at least ``edited``. Items are held in blocks of about ``block_bytes`` of text; each block is two
    passes over the documents.
    """
    spark = docs.sparkSession
    query = items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    total = query.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-total // block_bytes))
    kind, other = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    # ids pass through Python as strings: a missing number would turn the others into floats
    columns = ["d", "i", "score", "covered", "item_words", "seeds", "leaked", "edited"]
    schema = "d string, i string, score double, covered int, item_words int, seeds int, leaked boolean, edited boolean"
    source = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t")).where("t is not null")
    found = []
    for n in range(blocks):
        rows = query.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n) if blocks > 1 else query
        block = Items(sorted(((r.i, r.t) for r in rows.collect()), key=str), run, share)
        shared = spark.sparkContext.broadcast(block)

        def count(batches, shared=shared):
            total = np.zeros(len(shared.value.seeds.grams), np.int64)
            for b in batches:
                total += shared.value.count(b["t"].tolist())
            at = np.flatnonzero(total)
            yield pd.DataFrame({"g": at, "n": total[at]})

        counted = source.select("t").mapInPandas(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1").toPandas()
        seen = np.zeros(len(block.seeds.grams), np.int64)
        seen[counted["g"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
        block.keep_rare(seen)
        seeded = spark.sparkContext.broadcast(block)

        def run_block(batches, seeded=seeded):
            m = seeded.value
            for b in batches:
                d = b["d"].tolist()
                out = [(d[t], m.ids[i], s, c, len(m.of(i)), k, leaked, changed) for t, i, s, c, k, leaked, changed in m.match(b["t"].tolist(), edited)]
                yield pd.DataFrame(out, columns=columns)

        found.append(source.mapInPandas(run_block, schema))
    out = functools.reduce(DataFrame.unionByName, found)
    return out.select(F.col("d").cast(kind).alias(doc_id), F.col("i").cast(other).alias(item_id), *columns[2:])
