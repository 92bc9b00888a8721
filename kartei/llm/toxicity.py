"""Problem 8: abusive, hateful or sexually explicit passages.

Words are brought out of disguise (look-alike letters, invisible characters, digits and signs for letters, masks, stretched
or dotted spelling) and hashed; plain lines never pass through a call per word. A sentence is scored word by word with the
log odds of abusive against ordinary text. Abusive counts come from labelled samples, from a list of general abuse terms
(pseudo-counts) and, by expectation and maximisation, from all documents with a listed word. There a seed sentence, one with a
listed word, counts as abusive to the degree that two or more of its words say so. And a word that stands beside abusive
sentences, in other sentences of their documents, more often than chance allows is abusive in as many of its uses as explain
that: abusive sentences are known to stand beside others at some rate, ordinary ones at the rate of all words. However large the corpus,
what it teaches weighs no more than samples and list together. Ordinary counts are those of all documents. The counts of the whole corpus
are the Dirichlet prior of both, and positive odds are lowered by a standard error. One linear scan finds all maximal-scoring
segments (Ruzzo and Tompa) of a sentence. The highest scores of all sentences follow the extreme-value law
P(S >= x) = 1 - exp(-K n exp(-lambda x)) for n words, fitted by maximum likelihood to the scores below a bound, as a truncated
sample, so that abusive sentences don't raise the bar. A document is flagged if a sentence has a p below ``alpha``; its score is
the sum of -log10 p of its significant sentences.

Defined results: NULL and empty texts score 0; NULL ids and sources are kept as they are; texts of any length are scanned
whole; equal texts score equally; without samples the list and the corpus are left alone. All samples and all documents with
a listed word train; only words and their counts reach the driver.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.llm.lookalike import normalise_array
from kartei.llm.words import LETTER, blocks, hash_runs, hash_words, points_of, runs, tables
from kartei.session import materialize

# Words that are abusive, threatening or explicit in most uses, by language. They are terms of general use;
# what else marks abuse is left to the samples and the counts, and so is how ordinary a listed word is in a corpus.
WORDS = """
asshole arsehole bastard bitch cunt dickhead moron scumbag slut whore twat wanker loser cretin halfwit fuck fucking fucker motherfucker cocksucker shit faggot nigger
subhuman vermin filth horny nudes blowjob handjob gangbang cum tits pussy dildo masturbate rape imbecile idiot retard dumbass jackass douchebag skank tosser
boobs boner clit orgasm porn milf nympho orgy fellatio threesome upskirt
arschloch hurensohn fotze schlampe wichser missgeburt drecksau dreckskerl vollidiot vollpfosten fresse ungeziefer untermenschen abschaum verrecke ficken titten nutte schwuchtel kanake spast trottel
connard connasse salope salaud pute enculé enfoiré bâtard crétin vermine racaille ordure baiser nique nichons abruti raclure branler
puta puto cabrón gilipollas mierda maricón desgraciado imbécil follar zorra escoria tetas polla subnormal
stronzo puttana troia coglione vaffanculo cazzo scopare feccia bastardo frocio pompino
caralho foder merda cabrão escumalha buceta otário vagabunda
klootzak hoer kut teringlijer neuken tuig eikel lul mongool flikker
kurwa skurwysyn chuj dziwka jebać śmieć pizda suka pedał
fitta hora jävla knulla kuk slyna bög slampa
сука блядь хуй ебать мразь пидор шлюха ублюдок тварь пизда гандон дебил
""".split()
LEET = str.maketrans("013457@$!|", "oieastasii")
LEET_L = str.maketrans("013457@$!|", "oleastasil")
TOKEN = re.compile(r"(?:[^\W\d_][.\-_·*]){2,}[^\W\d_](?![^\W_])|(?<![^\W_])(?:[^\W\d_] ){3,}[^\W\d_](?![^\W_])|[^\W_]+(?:[*#@$!|]+[^\W_]+)+|[^\W_]+[*#]{2,}|[$@][^\W_]+|[^\W_]+|[.!?\n]")
TRIPLE = re.compile(r"(.)\1\1")
STOPS = frozenset(".!?\n")
#: Weight of the corpus as a prior, in abusive words; pseudo-count of a listed word; standard errors taken off; bounds of the
#: evidence of one word, and the log odds against a seed, when seeds are judged; scores above BULK take no part in the fit of the law.
PRIOR, PSEUDO, ERRORS, HIGHEST, PROBABLE, BULK = 0.5, 1.0, 2.0, 5.0, 7.0, 6.0
STEP, SHOWN = 0.1, 1e-2
#: A longer sentence is learned from in pieces of so many words.
LONGEST = 200
#: How much less likely than one in all words of the vocabulary it must be, as a log, that a word stands beside abuse by chance.
SURPRISE = 5.0
FLUSH, LINE = 1 << 22, "\x1e"


class Reader:
    """Splits lines into undisguised words, given the words that may be hidden."""

    def __init__(self, hidden: set[str], first: set[str] = frozenset()):
        """A mask that fits several words is read as one of ``first`` if it can be."""
        self.hidden = hidden
        self.ordered = sorted(hidden, key=lambda w: (w not in first, w))
        self.by_length: dict[int, list[str]] = {}
        for w in self.ordered:
            self.by_length.setdefault(len(w), []).append(w)
        self.memo: dict[str, str] = {}

    def plain(self, token: str) -> str:
        got = self.memo.get(token)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[token] = self._plain(token)
        return got

    def _plain(self, t: str) -> str:
        if t in self.hidden:
            return t
        joined = re.sub(r"[.\-_· ]", "", t)
        if "*" in joined or "#" in joined:
            mask = re.compile("".join("[^\\W\\d_]" if c in "*#" else re.escape(c) for c in joined))
            loose = re.compile("".join(p if p[0] not in "*#" else r"[^\W\d_]+" for p in re.split(r"([*#]+)", joined) if p))
            for test, pool in ((mask, self.by_length.get(len(joined), ())), (loose, self.ordered)):
                for w in pool:
                    if test.fullmatch(w):
                        return w
            joined = re.sub(r"[*#]", "", joined)
        forms = [joined, joined[:-1], joined[1:]] if " " in t else [joined]  # a word of one letter may stand beside it
        if re.search(r"[\d@$!|]", joined) and re.search(r"[^\W\d_]", joined):
            forms += [joined.translate(LEET), joined.translate(LEET_L)]
        for f in forms:
            for g in (f, re.sub(r"(.)\1{2,}", r"\1", f), re.sub(r"(.)\1{2,}", r"\1\1", f)):
                if g in self.hidden:
                    return g
        return re.sub(r"(.)\1{2,}", r"\1", joined)

    def words(self, text: str) -> list[str]:
        """Words, and a stop for every end of a sentence."""
        return [t if t in STOPS or t.isdigit() or t.isalpha() and not TRIPLE.search(t) else self.plain(t) for t in TOKEN.findall(text)]


@dataclass
class Block:
    """The words of some sentences in order: hash, sentence and row of each, and where to find it in the text."""

    words: np.ndarray
    sentence: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    points: np.ndarray

    def heads(self) -> np.ndarray:
        """The first word of every sentence."""
        return np.flatnonzero(np.concatenate(([True], self.sentence[1:] != self.sentence[:-1]))) if len(self.sentence) else np.zeros(0, np.int64)

    def text(self, i: int, j: int) -> str:
        return self.points[self.start[i] : max(self.end[i:j])].tobytes().decode("utf-32-le", "replace")


@functools.cache
def _signs() -> np.ndarray:
    out = np.zeros(len(tables()["kind"]), np.uint8)
    out[[ord(c) for c in "*#@$!|"]] = 1
    out[[ord(c) for c in "*#"]] = 3
    out[[ord(c) for c in STOPS]] |= 4
    return out


def lex(texts: list[str | None] | pa.Array, reader: Reader) -> Iterator[Block]:
    """The words of all texts, block by block. Only lines that may hide a word are read one by one."""
    t, marks = tables(), _signs()
    arr = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    unified = normalise_array(pc.replace_substring(arr, "\n", LINE)).to_pylist()  # one form has no line breaks
    for piece_row, piece_at, joined in blocks(unified):
        p = t["lower"][points_of(joined)]
        p[p == ord(LINE)] = 10
        kind, sign = t["kind"][p], marks[p]
        inside = kind > 0
        start, end = runs(inside)
        stops = np.cumsum((sign & 4) > 0)
        # places that may hide a word
        letter = kind == LETTER
        size, letters = end - start, np.add.reduceat(letter.astype(np.int32), start) if len(start) else start
        single = (size == 1) & (letters == 1)
        near = end[:-1] + 1 == start[1:]
        three = np.flatnonzero(single[:-2] & single[1:-1] & single[2:] & near[:-1] & near[1:])
        odd = [start[(letters > 0) & (letters < size)], start[three]]
        odd.append(np.flatnonzero((p[2:] == p[1:-1]) & (p[1:-1] == p[:-2]) & letter[2:]))
        odd.append(np.flatnonzero(((sign[:-1] & 1) > 0) & inside[1:]))
        odd.append(np.flatnonzero(((sign[2:] & 2) > 0) & ((sign[1:-1] & 2) > 0) & inside[:-2]))
        odd = np.unique(np.concatenate(odd))
        line_end = np.append(np.flatnonzero(p == 10), len(p))
        lines = np.unique(np.searchsorted(line_end, odd))
        words, sentence = hash_runs(p, start, end), stops[start] if len(start) else np.zeros(0, np.int64)
        if len(lines):
            keep = ~np.isin(np.searchsorted(line_end, start), lines)
            more: list[str] = []
            place: list[tuple[int, int, int]] = []
            for k in lines:
                a, b = int(line_end[k - 1]) + 1 if k else 0, int(line_end[k])
                n = int(stops[a - 1]) if a else 0
                for w in reader.words(p[a:b].tobytes().decode("utf-32-le", "replace")):
                    if w in STOPS:
                        n += 1
                    elif w:
                        more.append(w), place.append((n, a, b))
            extra = np.array(place, np.int64).reshape(-1, 3)
            words, sentence = np.concatenate((words[keep], hash_words(more))), np.concatenate((sentence[keep], extra[:, 0]))
            start, end = np.concatenate((start[keep], extra[:, 1])), np.concatenate((end[keep], extra[:, 2]))
            order = np.argsort(sentence, kind="stable")
            words, sentence, start, end = words[order], sentence[order], start[order], end[order]
        yield Block(words, sentence, piece_row[np.searchsorted(piece_at, start, "right") - 1], start, end, p)


def sentences_of(text: str | None, reader: Reader) -> list[np.ndarray]:
    out = []
    for b in lex([text], reader):
        out += np.split(b.words, b.heads()[1:]) if len(b.words) else []
    return out


def hiding(samples: list[tuple[str | None, int]]) -> list[set[str]]:
    """The words of ordinary and those of abusive samples that a disguise may hide."""
    out: list[set[str]] = [set(), set()]
    for x, (_, y) in zip(normalise_array(pa.array([x for x, _ in samples], pa.string())).to_pylist(), samples, strict=True):
        out[bool(y)] |= {w for w in TOKEN.findall(x.casefold()) if w.isalpha() and len(w) > 3 and not TRIPLE.search(w)} if x else set()
    return out


#: A document or sample to learn from: its label (None for a document), how often it occurs, its words and the size of each sentence.
Lesson = tuple[int | None, int, np.ndarray, np.ndarray]
#: Uses of words in abusive and in other sentences of samples; in abusive sentences of documents; probable sentences of both;
#: uses beside abusive sentences, and different documents with such uses.
COUNTS = ("own_bad", "own_good", "bad", "sentences", "beside", "places")


class Model:
    """Log odds of words."""

    def __init__(self, samples: list[tuple[str | None, int]], hidden: set[str] | None = None):
        """hidden: words of the samples that a disguise may hide, if they are known."""
        if hidden is None:
            ordinary, abusive = hiding(samples)
            hidden = abusive - ordinary
        self.reader = Reader(hidden | {*WORDS}, {*WORDS})
        self.listed = np.unique(hash_words(WORDS))
        self.samples = [(y, 1, *self.lesson(sentences_of(x, self.reader))) for x, y in samples]
        self.vocabulary, self.odds, self.unknown = self.listed, np.zeros(len(self.listed)), -1.0
        self.lam = self.k = 1.0

    @staticmethod
    def lesson(sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The words and the sizes of the sentences, long ones in pieces."""
        sizes = [min(LONGEST, len(x) - i) for x in sentences for i in range(0, len(x), LONGEST)]
        return np.concatenate([*sentences, np.zeros(0, np.uint64)]), np.array(sizes, np.int64)

    def seeded(self, block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
        """The lessons of the documents with a listed word."""
        at = np.flatnonzero(np.isin(block.words, self.listed))
        heads, out = block.heads(), []
        for r in np.unique(block.row[at]):
            a, b = np.searchsorted(block.row, [r, r + 1])
            inside = heads[(heads > a) & (heads < b)]
            out.append(self.lesson(np.split(block.words[a:b], inside - a)))
        return out

    def evidence(self, lessons: list[Lesson], first: bool) -> tuple[pd.DataFrame, np.ndarray]:
        """COUNTS by word, and the abusive sentences of documents, all and those beside others, as the model has it.

        A sample is labelled as a whole: ``first`` all its sentences, then the highest counts as abusive, the others as ordinary.
        """
        lessons = [x for x in lessons if len(x[2])]
        if not lessons:
            return pd.DataFrame({"h": np.zeros(0, np.int64)} | {c: np.zeros(0) for c in COUNTS}), np.zeros(2)
        words = np.concatenate([x[2] for x in lessons])
        size = np.concatenate([x[3] for x in lessons])
        row = np.repeat(np.arange(len(lessons)), [len(x[3]) for x in lessons])
        of = np.repeat(np.arange(len(size)), size)
        heads = np.cumsum(size) - size
        own = np.array([y is not None for y, *_ in lessons])[row]
        label = np.array([bool(y) for y, *_ in lessons])[row]
        copies = np.array([n for _, n, *_ in lessons], float)[row]
        vocabulary, at = np.unique(words, return_inverse=True)
        score = best_scores(np.minimum(self.score(vocabulary)[at], HIGHEST), heads)
        held = np.maximum.reduceat(np.isin(vocabulary, self.listed)[at], heads)
        weight = np.where(held & ~own, 0.0 if first else 1 / (1 + np.exp(PROBABLE - score)), 0.0)
        none = np.log1p(-np.minimum(weight, 1 - 1e-9))
        beside = np.where(own, 0.0, -np.expm1(np.bincount(row, none)[row] - none))
        if first:
            weight = np.where(own, label, weight)
        else:
            order = np.lexsort((np.arange(len(score)), -score, row))
            top = order[np.concatenate(([True], row[order][1:] != row[order][:-1]))]
            weight[top[label[top]]] = 1
        tell = lambda x: np.bincount(at, (copies * x)[of], len(vocabulary))
        # a word counts once for each document, as likely as it stands beside abuse at its likeliest place
        pair = row[of] * len(vocabulary) + at
        order = np.lexsort((beside[of], pair))
        last = order[np.concatenate((pair[order][1:] != pair[order][:-1], [True]))]
        counts = (tell(own * weight), tell(own * (1 - weight)), tell(~own * weight), tell(weight > 0.5), tell(beside), np.bincount(at[last], beside[of][last], len(vocabulary)))
        spread = copies * ~own * weight
        return pd.DataFrame({"h": vocabulary.view(np.int64)} | dict(zip(COUNTS, counts, strict=True))), np.array([spread.sum(), (spread * beside).sum()])

    def fit(self, seeds: list[tuple[np.ndarray, np.ndarray]], share: float, count: dict[int, int], total: int, rounds: int = 4) -> Model:
        """seeds: lessons, a ``share`` of all of the corpus; count: uses of words in the corpus of ``total``."""
        same: dict[tuple[bytes, bytes], list] = {}
        for w, n in seeds:
            same.setdefault((w.tobytes(), n.tobytes()), [None, 0, w, n])[1] += 1 / max(share, 1e-9)
        lessons = [*self.samples, *map(tuple, same.values())]
        words = np.unique(np.concatenate([self.listed, *(x[2] for x in lessons)]))
        corpus = np.array([count.get(int(h), 0) for h in words.view(np.int64)], float)
        return self.learn(lambda first: self.evidence(lessons, first), words, corpus, total, rounds)

    def learn(self, gather: Callable[[bool], tuple[pd.DataFrame, np.ndarray]], words: np.ndarray, corpus: np.ndarray, total: int, rounds: int = 4) -> Model:
        """gather: the evidence of all lessons; words: those of all lessons and listed ones, in order; corpus: their uses in the corpus of ``total``."""
        self.vocabulary, self.odds = words, np.zeros(len(words))
        listed = np.isin(words, self.listed)
        size = len(words)
        self.unknown = math.log(PRIOR / (1 + PRIOR))
        for turn in range(rounds + 1):
            found, (abusive, together) = gather(turn == 0)
            at = np.searchsorted(words, found["h"].to_numpy(np.int64).view(np.uint64))
            own_bad, own_good, inside, sentences, beside, places = (np.bincount(at, found[c].to_numpy(float), size) for c in COUNTS)
            inside = np.minimum(inside, corpus)
            # as many uses as explain that a word stands beside abuse more often than words do
            base, rate = beside.sum() / max(total, 1), together / max(abusive, 1e-9)
            if rate > 2 * base > 0:
                chance = np.maximum(base * corpus * places / np.maximum(beside, 1e-9), 1e-9)
                surprise = places * np.log(np.maximum(places, 1e-9) / chance) - (places - chance)
                least = np.maximum(beside - ERRORS * np.sqrt(beside), 0)
                uses = np.clip((least - base * corpus) / (rate - base), 0, corpus)
                drawn = (places > chance) & (surprise > math.log(size + 1) + SURPRISE)
                inside = np.where(drawn, np.maximum(inside, uses), inside)
                sentences = np.where(drawn, sentences + uses, sentences)
            own_bad = own_bad + PSEUDO * listed
            bad = own_bad + inside * min(1.0, own_bad.sum() / max(inside.sum(), 1e-9))
            good = np.maximum(corpus - inside, 0) + own_good
            n_bad = bad.sum()
            prior = PRIOR * n_bad
            before = prior * (corpus + 0.5) / (total + 0.5 * size + 1)
            n_good = max(total, good.sum()) + 1
            odds = np.log((bad + before) / (n_bad + prior)) - np.log((good + 0.5) / (n_good + 0.5 * size))
            sure = np.maximum(0, odds - ERRORS / np.sqrt(np.maximum(own_bad + inside, 1e-9)))
            self.odds = np.where(odds <= 0, odds, np.where(listed | (sentences > 1), sure, 0.0))
        return self

    def score(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, self.odds[at], self.unknown)

    def p_value(self, score: np.ndarray, words: np.ndarray) -> np.ndarray:
        return -np.expm1(-self.k * np.maximum(words, 1) * np.exp(-self.lam * np.asarray(score, float)))


def best_scores(scores: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """The highest sum of neighbouring words of each sentence, 0 if none is positive. heads: where sentences begin."""
    if not len(scores):
        return np.zeros(0)
    after = np.cumsum(scores)
    before = after - scores
    sentence = np.zeros(len(scores), np.int64)
    sentence[heads[1:]] = 1
    sentence = np.cumsum(sentence)
    before, after = before - before[heads][sentence], after - before[heads][sentence]
    lift = (np.abs(after).max() + np.abs(before).max() + 1) * sentence
    lowest = np.minimum.accumulate(before - lift) + lift
    return np.maximum(np.maximum.reduceat(after - lowest, heads), 0.0)


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end), in linear time (Ruzzo and Tompa)."""
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        seg = (before, total, i, i + 1)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= seg[0]:
                j -= 1
            if j < 0 or found[j][1] >= seg[1]:
                found.append(seg)
                break
            seg = (found[j][0], seg[1], found[j][2], seg[3])
            del found[j:]
    return [(b - a, i, j) for a, b, i, j in found]


def fit_extreme(best: np.ndarray, weight: np.ndarray, words: float, below: float = BULK) -> tuple[float, float]:
    """lambda and K of the extreme-value law by maximum likelihood from binned highest scores.

    best: scores, in steps of STEP; weight: sentences with that score; words: words of a sentence on average. Scores above
    ``below`` are left out and the sample is taken as truncated there; a score of 0 is only known not to be above it.
    """
    kept = best <= below
    b, w = best[kept], weight[kept].astype(float)
    if w.sum() < 10 or not (b > 0).any():
        return 1.0, 1.0 / max(words, 1.0)
    lam = np.linspace(0.3, 4, 186)[:, None, None]
    rate = np.exp(np.linspace(math.log(1e-4), math.log(1e3), 240))[None, :, None]  # K n
    up, down = b + STEP / 2, np.maximum(b - STEP / 2, 0)
    low = np.where(b > 0, np.exp(-rate * np.exp(-lam * down)), 0.0)
    mass = np.maximum(np.exp(-rate * np.exp(-lam * up)) - low, 1e-300)
    top = -rate[..., 0] * np.exp(-lam[..., 0] * (below + STEP / 2))
    likely = (np.log(mass) * w).sum(-1) - w.sum() * top
    i, j = np.unravel_index(np.argmax(likely), likely.shape)
    return float(lam[i, 0, 0]), float(rate[0, j, 0]) / max(words, 1.0)


def build_model(docs: DataFrame, text: str, samples: DataFrame, sample_text: str, label: str) -> Model:
    """From all samples, all documents with a listed word and the counts of all documents; only words reach the driver."""
    spark = docs.sparkSession
    rows = samples.where(F.col(label).isNotNull() & F.col(sample_text).isNotNull()).select(F.col(sample_text).alias("t"), F.col(label).cast("int").alias("y"))

    def sides(batches):
        for b in batches:
            for y, found in enumerate(hiding(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))):
                yield pa.RecordBatch.from_pydict({"w": pa.array(sorted(found), pa.string()), "y": pa.array([y] * len(found), pa.int32())})

    hidden = rows.mapInArrow(sides, "w string, y int").groupBy("w").agg(F.min("y").alias("y")).where("y = 1").select("w").toArrow()
    empty = spark.sparkContext.broadcast(Model([], set(hidden.column(0).to_pylist())))
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("y", pa.int32()), ("w", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])
    names = "h long, n long, y int, w array<long>, sizes array<long>"

    def counts(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        none = pa.nulls(len(h), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64)), pa.nulls(len(h), pa.int32()), none, none], schema=schema)

    def lessons(found: list[tuple[int | None, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        none = pa.nulls(len(found), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([y for y, *_ in found], pa.int32()), pa.array([w.view(np.int64) for _, w, _ in found], schema.field("w").type), pa.array([z for *_, z in found], schema.field("w").type)], schema=schema)

    def run(batches):
        m, parts, held = empty.value, [], 0
        for b in batches:
            for block in lex(b.column(0), m.reader):
                parts.append(block.words)
                held += len(block.words)
                if found := m.seeded(block):
                    yield lessons([(None, *x) for x in found])
                if held > FLUSH:
                    yield counts(parts)
                    parts, held = [], 0
        if held:
            yield counts(parts)

    def labelled(batches):
        m = empty.value
        for b in batches:
            yield lessons([(y, *m.lesson(sentences_of(t, m.reader))) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)])

    seen = materialize(docs.select(F.col(text).alias("t")).where("t is not null").mapInArrow(run, names))
    used = seen.where("w is null").groupBy("h").agg(F.sum("n").alias("n"))
    learned = seen.where("w is not null").select("y", "w", "sizes").unionByName(rows.mapInArrow(labelled, names).select("y", "w", "sizes"))
    # equal documents are one lesson; of samples all count
    learned = materialize(learned.groupBy("y", "w", "sizes").agg(F.count(F.lit(1)).alias("n")))
    words = learned.select(F.explode("w").alias("h")).union(spark.createDataFrame(pd.DataFrame({"h": empty.value.listed.view(np.int64)}))).distinct()
    counted = words.join(used, "h", "left").select("h", F.coalesce("n", F.lit(0)).alias("n")).toArrow()
    total = seen.where("w is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    vocabulary = counted.column("h").to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    model = Model([], set(hidden.column(0).to_pylist()))
    spread = ("abusive", "together")

    def gather(first: bool) -> tuple[pd.DataFrame, np.ndarray]:
        shared = spark.sparkContext.broadcast(model)

        def weigh(batches):
            m = shared.value
            for b in batches:
                flat = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (b.column("w"), b.column("sizes"))]
                (w, i), (z, j) = flat
                found, sums = m.evidence([(y, n, w[i[k] : i[k + 1]].view(np.uint64), z[j[k] : j[k + 1]]) for k, (y, n) in enumerate(zip(b.column("y").to_pylist(), b.column("n").to_pylist(), strict=True))], first)
                yield pa.RecordBatch.from_pandas(found.assign(**dict.fromkeys(spread, 0.0)), each, preserve_index=False)
                yield pa.RecordBatch.from_pandas(pd.DataFrame([(None, *np.zeros(len(COUNTS)), *sums)], columns=each.names), each, preserve_index=False)

        each = pa.schema([("h", pa.int64())] + [(c, pa.float64()) for c in (*COUNTS, *spread)])
        got = learned.mapInArrow(weigh, "h long, " + ", ".join(f"{c} double" for c in (*COUNTS, *spread)))
        got = got.groupBy("h").agg(*[F.sum(c).alias(c) for c in (*COUNTS, *spread)]).toArrow()
        shared.unpersist()
        return got.filter(pc.is_valid(got["h"])).to_pandas(), got.select(spread).to_pandas().sum().to_numpy(float)

    return model.learn(gather, vocabulary[order], counted.column("n").to_numpy().astype(float)[order], total)


def score_documents(docs: DataFrame, doc_id: str, text: str, source: str, samples: DataFrame, sample_text: str, label: str, alpha: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """The scored documents (doc, source, n_words, best, passage, passages, score, flagged) and the rate per source.

    flagged: some sentence has a p below alpha. As alpha is the rate of ordinary sentences that pass by chance, ten
    sentences to a document make ten times alpha the rate of ordinary documents that are flagged.
    """
    spark = docs.sparkSession
    model = build_model(docs, text, samples, sample_text, label)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        m = shared.value
        for b in batches:
            n = b.num_rows
            total, best = np.zeros(n, np.int64), np.zeros(n)
            scores: list[list[float]] = [[] for _ in range(n)]
            sizes: list[list[int]] = [[] for _ in range(n)]
            passage: list[str | None] = [None] * n
            bins, words = np.zeros(0, np.int64), 0
            for block in lex(b.column(2), m.reader):
                if not len(block.words):
                    continue
                heads = block.heads()
                size = np.diff(np.append(heads, len(block.words)))
                s = m.score(block.words)
                top = best_scores(s, heads)
                np.add.at(total, block.row[heads], size)
                more = np.bincount(np.rint(top / STEP).astype(np.int64))
                bins = more + np.pad(bins, (0, max(0, len(more) - len(bins))))[: len(more)] if len(more) >= len(bins) else bins + np.pad(more, (0, len(bins) - len(more)))
                words += len(block.words)
                for k in np.flatnonzero(top > BULK / 2):
                    i = int(block.row[heads[k]])
                    for x, a, z in maximal_segments(s[heads[k] : heads[k] + size[k]].tolist()):
                        if x > BULK / 2:
                            scores[i].append(x), sizes[i].append(int(size[k]))
                            if x > best[i]:
                                best[i], passage[i] = x, block.text(int(heads[k]) + a, int(heads[k]) + z)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total), pa.array(best), pa.array(scores, pa.list_(pa.float64())), pa.array(sizes, pa.list_(pa.int64())), pa.array(passage, pa.string()), pa.nulls(n, pa.list_(pa.int64()))], schema=schema)
            if words:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([words]), pa.array([0.0]), pa.nulls(1, pa.list_(pa.float64())), pa.nulls(1, pa.list_(pa.int64())), pa.nulls(1, pa.string()), pa.array([bins.tolist()], pa.list_(pa.int64()))], schema=schema)

    schema = pa.schema([("d", pa.string()), ("s", pa.string()), ("n_words", pa.int64()), ("best", pa.float64()), ("scores", pa.list_(pa.float64())), ("sizes", pa.list_(pa.int64())), ("passage", pa.string()), ("bins", pa.list_(pa.int64()))])
    # ids pass through Python as strings: a missing number would turn the others into floats
    source_rows = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(source).cast("string").alias("s"), F.col(text).alias("t"))
    scored = materialize(source_rows.mapInArrow(run, "d string, s string, n_words long, best double, scores array<double>, sizes array<long>, passage string, bins array<long>"))
    bins = scored.where("bins is not null").select(F.posexplode("bins").alias("b", "w")).groupBy("b").agg(F.sum("w").alias("w")).toPandas()
    words = scored.where("bins is not null").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first().n
    model.lam, model.k = fit_extreme(bins["b"].to_numpy(float) * STEP, bins["w"].to_numpy(float), words / max(1.0, float(bins["w"].sum())))
    p = lambda x, n: -F.expm1(-F.lit(model.k) * F.greatest(n, F.lit(1)) * F.exp(-F.lit(model.lam) * x))
    ps = F.filter(F.zip_with("scores", "sizes", p), lambda x: x < SHOWN)
    out = scored.where("bins is null").withColumn("ps", ps)
    score = F.aggregate("ps", F.lit(0.0), lambda acc, x: acc - F.log10(F.greatest(x, F.lit(1e-300))))
    out = out.select(F.col("d").cast(kind).alias(doc_id), F.col("s").alias(source), "n_words", "best", "passage", F.size("ps").alias("passages"), score.alias("score"), F.coalesce(F.array_min("ps") < alpha, F.lit(False)).alias("flagged"))
    rates = out.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.avg("score").alias("mean_score")).withColumn("rate", F.col("flagged") / F.col("documents"))
    return out, rates
