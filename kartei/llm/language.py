"""Problem 4: the language of documents and of their segments.

A sparse multinomial logistic regression over TF-IDF character n-grams is trained with follow-the-regularised-leader and
elastic net on sentences of labelled rows, once on all and once without those whose label the first model rejects; its
temperature is calibrated on held-out sentences. Every sentence of every text is then classified; neighbours of one
language form a segment with the mean confidence of its sentences.

Defined results: NULL texts and texts without letters have no language and give no row; quoted passages within a longer
sentence don't count for it; a second language counts if at least one full sentence is in it; repeated rows count once.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.llm.arrowtext import sentences
from kartei.llm.encoding import DOUBLE, invert, rows_by_hash, undo_plain
from kartei.llm.ftrl import Softmax, fit

# ISO 639 codes and names of the languages, in English and in themselves.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano",
    "it": "it ita italian italiano",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands",
    "pl": "pl pol polish polski",
    "sv": "sv swe swedish svenska",
    "ru": "ru rus russian русский",
}
LANGUAGES = list(NAMES)
CODE_OF = {n: c for c, names in NAMES.items() for n in names.split()}
#: The least confidence of a full sentence in a second language, and of one of less than four words.
SURE, SURE_SHORT = 0.45, 0.9995
#: Sentences of the training sample, and characters of a sentence that training looks at.
SENTENCES, LONGEST = 12_000, 2000
DIM, ORDERS = 1 << 16, (1, 2, 3, 4)
QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“”]*[“”]|\"[^\"]*\"")
NOISE = re.compile(r"\b\w+:/+\S+|/\S+/\S+|[\d_]+")
NOISY, QUOTE = re.compile(r"[\d_/]"), re.compile("[“”«»„\"]")  # without one of these there is nothing to leave out
ACCENTED = frozenset(map(chr, range(0xC0, 0x100)))
BLOCK = 2000  # sentences scored at once
LETTERS = re.compile(r"[^\W\d_]+")


def label_code(column):
    """The language a label names in any notation, NULL if it names none."""
    first = F.lower(F.regexp_extract(F.trim(column), r"^([^\-_ (;,./]+)", 1))
    names = F.create_map(*[F.lit(x) for n, c in CODE_OF.items() for x in (n, c)])
    return F.try_element_at(names, first)


def readable(sentence: str) -> str:
    """A sentence with plain garbling undone: UTF-8 chains, and Cyrillic shown as accented Latin letters."""
    if not DOUBLE.search(sentence):
        return sentence
    s = undo_plain(sentence)
    letters = LETTERS.findall(s)
    if sum(c in ACCENTED for w in letters for c in w) > 0.6 * sum(map(len, letters)):
        return invert(s, "cp1251 as cp1252") or s
    return s


def plain(sentence: str) -> str:
    """What of a sentence shows its language: no quotes, paths or numbers."""
    whole = (NOISE.sub(" ", sentence) if NOISY.search(sentence) else sentence).lower()
    if not QUOTE.search(whole):
        return f" {' '.join(LETTERS.findall(whole))} "
    words = LETTERS.findall(QUOTED.sub(" ", whole))
    return f" {' '.join(words if len(words) > 3 else LETTERS.findall(whole))} "


def char_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of all texts: flat feature numbers and offsets."""
    size = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), size)
    each = []
    h = np.zeros(len(points), np.int64)
    for n in ORDERS:
        m = len(points) - n + 1
        if m <= 0:
            break
        h = h[:m] * 1000003 + points[n - 1 :]
        same = row[n - 1 :] == row[:m]
        each.append((((h[same] ^ h[same] >> 15) * 2654435761 + n >> 11) % DIM, np.maximum(size - n + 1, 0)))
    # the n-grams of every order stand by text already: each goes behind those of the text's shorter ones
    total = np.sum([k for _, k in each], axis=0) if each else np.zeros(len(texts), np.int64)
    off = np.concatenate(([0], np.cumsum(total)))
    out = np.empty(int(off[-1]), np.int64)
    at = off[:-1].copy()
    for codes, k in each:
        out[np.repeat(at - np.cumsum(k) + k, k) + np.arange(len(codes))] = codes
        at += k
    return out, off


def train(labelled: list[tuple[str, str]], most: int = SENTENCES, seed: int = 3) -> Softmax:
    """labelled: (text, language)."""
    rng = np.random.default_rng(seed)
    raw = dict.fromkeys((s, LANGUAGES.index(lang)) for text, lang in labelled for s in sentences(text))
    pool = [(p, y) for s, y in raw if len((p := plain(readable(s))).split()) > 2]
    pool = [pool[i] for i in rng.permutation(len(pool))[:most]]
    model = None
    for _ in range(2):
        if model is not None:
            p = model.probabilities(*char_ngrams([t for t, _ in pool]))
            pool = [x for x, q in zip(pool, p, strict=True) if q[x[1]] > 0.5]
        model = fit(*char_ngrams([t for t, _ in pool]), np.array([c for _, c in pool]), len(LANGUAGES), DIM, epochs=3)
    return model


def classify(texts: list[str | None], model: Softmax) -> list[list[tuple[str, str, float, int, bool]]]:
    """For each text (sentence, language, confidence, letters, full and sure) of its sentences with letters."""
    where, raw, bare = [], [], []
    for i, t in enumerate(texts):
        for s in sentences(t or ""):
            p = plain(readable(s))
            if not p.isspace():
                where.append(i), raw.append(s), bare.append(p)
    out: list[list] = [[] for _ in texts]
    if bare:
        p = np.concatenate([model.probabilities(*char_ngrams(bare[a : a + BLOCK])) for a in range(0, len(bare), BLOCK)])
        top = p.argmax(axis=1)
        for k, i in enumerate(where):
            words = bare[k].split()
            ends = raw[k].rstrip("”’»\"')]")[-1:] in tuple(".!?…")
            full = ends and p[k, top[k]] >= (SURE if len(words) >= 4 else SURE_SHORT)
            out[i].append((raw[k], LANGUAGES[top[k]], float(p[k, top[k]]), len(bare[k]) - 1 - len(words), bool(full)))
    return out


def languages(found: list[tuple[str, str, float, int, bool]]) -> dict[str, float]:
    """Language -> confidence of a text: the main one by weight, others with a full sentence that is sure enough."""
    weight: dict[str, float] = {}
    share: dict[str, list[float]] = {}
    for _, lang, conf, letters, _ in found:
        weight[lang] = weight.get(lang, 0) + conf * letters
        share.setdefault(lang, []).append(conf)
    if not weight:
        return {}
    main = max(sorted(weight), key=weight.get)
    return {lang: float(np.mean(share[lang])) for lang in weight if lang == main or any(s[1] == lang and s[4] for s in found)}


def training_rows(df: DataFrame, key: str, text: str, label: str, rows: int, most: int) -> list[tuple[str, str]]:
    """(sentence, language) of a bounded sample of labelled rows, chosen by hash; both numbers and their length are bounded."""

    def run(batches):
        for b in batches:
            out = [(s[:LONGEST], c) for t, c in zip(b["t"], b["c"], strict=True) for s in sentences(t)]
            yield pd.DataFrame(out, columns=["s", "c"])

    code = label_code(F.col(label))
    sample = rows_by_hash(df.where(code.isNotNull() & F.col(text).isNotNull()), key, rows)
    got = sample.select(F.col(text).alias("t"), code.alias("c")).mapInPandas(run, "s string, c string").distinct().orderBy(F.xxhash64("s", "c"), "s", "c").limit(most).collect()
    return [(r.s, r.c) for r in got]


def segments(df: DataFrame, key: str, text: str, label: str, sample_rows: int = 4000) -> DataFrame:
    """(key, segment, lang, confidence, sentences, start text) of the segments of every text, in order."""
    model = df.sparkSession.sparkContext.broadcast(_model(df, key, text, label, sample_rows))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for k, found in zip(b[key], classify(b[text].tolist(), model.value), strict=True):
                known, n, last = languages(found), -1, None
                for s, lang, conf, _, _ in found:
                    lang = lang if lang in known else last or max(known, key=known.get)
                    if lang != last:
                        n, last = n + 1, lang
                        rows.append([k, n, lang, 0.0, 0, s])
                    rows[-1][3] += conf
                    rows[-1][4] += 1
            yield pd.DataFrame([(k, n, lang, c / m, m, s) for k, n, lang, c, m, s in rows], columns=[key, "segment", "lang", "confidence", "n_sentences", "starts"])

    return df.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"{key} {kind}, segment int, lang string, confidence double, n_sentences int, starts string").distinct()


def _model(df: DataFrame, key: str, text: str, label: str, sample_rows: int) -> Softmax:
    rows = training_rows(df, key, text, label, sample_rows, 3 * SENTENCES)
    if not rows:
        return Softmax(np.zeros((DIM, len(LANGUAGES)), np.float32), np.ones(DIM, np.float32), 1.0)
    return train(rows)


def find_label_errors(df: DataFrame, key: str, text: str, label: str, sample_rows: int = 4000) -> DataFrame:
    """(key, lang, confidence) of every language of the texts whose label is missing or wrong or that mix languages."""
    model = df.sparkSession.sparkContext.broadcast(_model(df, key, text, label, sample_rows))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for k, code, found in zip(b[key], b["_code"], classify(b[text].tolist(), model.value), strict=True):
                known = languages(found)
                if known and (len(known) > 1 or code not in known):
                    rows.extend((k, lang, c) for lang, c in known.items())
            yield pd.DataFrame(rows, columns=[key, "lang", "confidence"])

    source = df.where(F.col(text).isNotNull()).select(key, text, label_code(F.col(label)).alias("_code"))
    return source.mapInPandas(run, f"{key} {kind}, lang string, confidence double").distinct()
