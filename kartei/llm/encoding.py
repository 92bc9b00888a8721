"""Problem 3: text decoded with a wrong encoding.

Segments (sentences or lines) with characters beyond ASCII are described by hashed byte bigrams of their UTF-8 bytes. A
multinomial classifier, trained on clean segments garbled synthetically along every chain, predicts the exact chain of
wrong decodings, or that the segment is clean. The chain is inverted; the inversion must decode strictly, must change the
text, and the restored segment must itself be classified as clean.

Single-byte chains always decode: what they restore must be words of clean segments of the whole table.

Defined results: NULL, empty and ASCII fields are never cases; a field with U+FFFD is a case that can't be restored; a
partly garbled field is a case whose garbled segments alone are restored; repeated rows count once.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartei.llm.arrowtext import sentences
from kartei.llm.ftrl import Softmax, fit
from kartei.llm.lookalike import normalise_array
from kartei.llm.words import hash_words, word_hashes
from kartei.session import materialize

DIM = 1 << 15
CLEAN = "clean"
#: (decoded as, stored as) for each step; a step garbles by storing and then decoding.
STEPS = {
    **{f"utf-8 as {c}": ((c, "utf-8"),) for c in ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac-roman", "koi8-r", "cp866")},
    "utf-8 as cp1252 twice": (("cp1252", "utf-8"), ("cp1252", "utf-8")),
    "utf-8 as latin-1 twice": (("latin-1", "utf-8"), ("latin-1", "utf-8")),
    "utf-8 as cp1252 three times": (("cp1252", "utf-8"),) * 3,
    **{f"{a} as {b}": ((b, a),) for a, b in (("cp1252", "mac-roman"), ("mac-roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("iso8859-2", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "cp1250"), ("cp1250", "iso8859-2"), ("iso8859-2", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "koi8-r"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1252"))},
}
LOWERED = " lowered"
CHAINS = [CLEAN, *STEPS, f"utf-8 as cp1252{LOWERED}", f"utf-8 as latin-1{LOWERED}"]
LOSSY = "replaced"
SURE = 0.95  # probability from which a segment is clean
BLOCK = 5000  # segments scored at once
MIXED = re.compile("[a-zA-Z][\u0400-\u04ff]|[\u0400-\u04ff][a-zA-Z]")
WORD = re.compile(r"[^\W\d_]+")
DOUBLE = re.compile(r"[^\x00-\x7f]{2}")
PIECE = re.compile(r"[^ \n\r\t]*[^\x00-\x7f][^ \n\r\t]*")


@functools.cache
def _page(name: str) -> tuple[dict[int, str], dict[str, int]]:
    """byte -> character and back for a single-byte encoding; bytes without a character stand for themselves."""
    to = {b: bytes([b]).decode(name, "ignore") or chr(b) for b in range(256)}
    return to, {c: b for b, c in reversed(to.items())}


def _store(text: str, name: str) -> bytes:
    if name == "utf-8":
        return text.encode("utf-8")
    back = _page(name)[1]
    try:
        return bytes(back[c] for c in text)
    except KeyError as e:
        raise ValueError(name) from e


def _read(data: bytes, name: str) -> str:
    if name == "utf-8":
        return data.decode("utf-8")
    to = _page(name)[0]
    return "".join(to[b] for b in data)


def garble(text: str, chain: str) -> str | None:
    """The text as the chain leaves it, None where it can't be stored that way or doesn't change."""
    try:
        out = text
        for shown, stored in STEPS[chain.removesuffix(LOWERED)]:
            out = _read(_store(out, stored), shown)
    except ValueError:
        return None
    out = out.lower() if chain.endswith(LOWERED) else out
    return out if out != text and not (chain.endswith(LOWERED) and out == garble(text, chain.removesuffix(LOWERED))) else None


def invert(text: str, chain: str) -> str | None:
    """The text before the chain, by strict decoding only."""
    try:
        out = _raised(text) if chain.endswith(LOWERED) else text
        for shown, stored in reversed(STEPS[chain.removesuffix(LOWERED)]):
            out = _read(_store(out, shown), stored)
    except ValueError:
        return None
    return out if out != text else None


def _raised(text: str) -> str:
    """The lead characters of a lowered garbling: capitals, but for the â of quotes and dashes."""
    return "".join(c if c == "â" and text[i + 1 : i + 2] in ("€", "\x80") else u if ord(c) > 127 and len(u := c.upper()) == 1 else c for i, c in enumerate(text))


def byte_bigrams(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams with a byte beyond ASCII, and the two-bigram runs around them: flat feature numbers and offsets."""
    blobs = [b"\x02" + s.encode("utf-8", "replace") + b"\x03\x03" for s in segments]
    size = np.array([len(b) for b in blobs], np.int64)
    data = np.frombuffer(b"".join(blobs), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(len(blobs)), size)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(segments) + 1, np.int64)
    high = data >= 0x80
    two = (row[1:] == row[:-1]) & (high[1:] | high[:-1])
    at2 = np.flatnonzero(two)
    three = (row[2:] == row[:-2]) & two[:-1] & two[1:]
    at3 = np.flatnonzero(three)
    pair = data[:-1] << 8 | data[1:]
    code = np.concatenate((pair[at2] * 2654435761 >> 7, (pair[at3] << 16 | pair[at3 + 1]) * 40503 * 2654435761 >> 9)) % DIM
    where = np.concatenate((row[at2], row[at3]))
    order = np.argsort(where, kind="stable")
    return code[order], np.searchsorted(where[order], np.arange(len(segments) + 1))


def segments_of(text: str) -> list[str]:
    """The sentences with characters beyond ASCII."""
    return [] if text.isascii() else [s for s in sentences(text) if not s.isascii()]


def _surely_garbled(s: str) -> bool:
    return "�" in s or any(invert(p, c) is not None for c in CHAINS[1:] if c.startswith("utf-8") for p in PIECE.findall(s))


@dataclass
class Garbling:
    """The classifier, and the hashes of the words seen in more than one clean segment."""

    softmax: Softmax
    known: frozenset[int]

    def probabilities(self, segments: list[str]) -> np.ndarray:
        return np.concatenate([self.softmax.probabilities(*byte_bigrams(segments[a : a + BLOCK])) for a in range(0, len(segments), BLOCK)])

    def known_share(self, before: str, after: str) -> float:
        """The share of known words among those of ``after`` that ``before`` lacks."""
        had = set(WORD.findall(before))
        new = hashed([w for w in WORD.findall(after) if w not in had])
        return sum(h in self.known for h in new) / max(1, len(new))

    def unread(self, segment: str, back: str) -> bool:
        """True if the segment, look-alike letters and blanks unified, reads no better than the restored one."""
        plain = unified(segment)
        return not plain.isascii() and self.known_share(back, plain) == 0


def hashed(words: list[str]) -> list[int]:
    return hash_words([w.lower() for w in words]).view(np.int64).tolist()


def unified(segment: str) -> str:
    return normalise_array(pa.array([segment])).to_pylist()[0]


def train(texts: list[str], most: int = 3000, seed: int = 5) -> Garbling:
    """Clean segments are those no UTF-8 chain inverts; a second round drops those the first model sees as garbled.

    Each clean segment is garbled along eight chains, those with the fewest examples so far.
    """
    rng = np.random.default_rng(seed)
    pool = list(dict.fromkeys(s for t in texts for s in segments_of(t)))
    pool = [s for s in pool if not _surely_garbled(s)]
    pool = [pool[i] for i in sorted(rng.permutation(len(pool))[:most])]
    model = None
    for _ in range(2):
        if model is not None:
            pool = [s for s, p in zip(pool, model.probabilities(pool), strict=True) if p[0] > 0.5 or not _confirmed(s, p, None)]
        words = Counter(w.lower() for s in pool for w in set(WORD.findall(s)))
        xs, ys = [], []
        seen = np.zeros(len(CHAINS), np.int64)
        for s in pool:
            xs.append(s), ys.append(0)
            options = [(int(seen[k]), k, g) for k in range(1, len(CHAINS)) if (g := garble(s, CHAINS[k])) is not None and not g.isascii()]
            for _, k, g in sorted(options)[:8]:
                xs.append(g), ys.append(k)
                seen[k] += 1
        model = Garbling(fit(*byte_bigrams(xs), np.array(ys, np.int64), len(CHAINS), DIM, epochs=2), frozenset(hashed([w for w, n in words.items() if n > 1])))
    return model


def likely(p: np.ndarray) -> list[str]:
    """The chains worth a try, likeliest first."""
    return [CHAINS[k] for k in np.argsort(-p)[:6] if CHAINS[k] != CLEAN and p[k] >= 0.02]


def inverted(segment: str, chain: str) -> tuple[str | None, int]:
    """The segment before the chain, as a whole or else in its garbled words, and how many words could not be undone."""
    back = invert(segment, chain)
    if back is not None or not chain.startswith("utf-8"):
        return back, 0
    words = [invert(m.group(), chain) for m in PIECE.finditer(segment)]
    rest = sum(w is None for w in words)
    return (PIECE.sub(lambda m: invert(m.group(), chain) or m.group(), segment) if rest < len(words) else None), rest


def _confirmed(segment: str, p: np.ndarray, model: Garbling | None) -> tuple[str, str] | None:
    """(chain, restored) of the likeliest chain that inverts strictly: as a whole, else in most garbled words.

    Only UTF-8 decodes strictly by more than chance: of the words that another chain restores, a third must be known,
    or none while the chain is likely and the segment as it stands has no known words either. The restored segment must be classified as clean, or two thirds of those words be known.
    """
    best = None
    for chain in likely(p):
        sure = chain.startswith("utf-8") and not chain.endswith(LOWERED)
        back, rest = inverted(segment, chain)
        if back is None or best and best[0] <= rest or any(ord(c) < 32 and c not in "\n\r\t" or 0x7F <= ord(c) < 0xA0 for c in back) or not sure and MIXED.search(back):
            continue
        share = model.known_share(segment, back) if model else 1.0
        if model is None or (sure or share >= 1 / 3 or share == 0 and p[CHAINS.index(chain)] > 0.9 and model.unread(segment, back)) and (back.isascii() or not sure and share >= 2 / 3 or model.probabilities([back])[0, 0] > 0.5):
            best = rest, chain, back
    return best[1:] if best else None


def repair_texts(texts: list[str | None], model: Garbling) -> list[tuple[str | None, str | None]]:
    """(chain, restored text) of every text: (None, None) if it is no case, (chain, None) if it can't be restored."""
    where, pool = [], []
    for i, t in enumerate(texts):
        if t:
            for s in segments_of(t):
                where.append(i), pool.append(s)
    out: list[tuple[str | None, str | None]] = [(None, None)] * len(texts)
    if not pool:
        return out
    p = model.probabilities(pool)
    for i, s, q in zip(where, pool, p, strict=True):
        if "�" in s:
            out[i] = (LOSSY, None)
        elif q[0] < SURE and (found := _confirmed(s, q, model)):
            chain, now = out[i]
            if chain != LOSSY:
                out[i] = (found[0], (texts[i] if now is None else now).replace(s, found[1]))
    return out


@functools.lru_cache(1 << 16)
def _undone(piece: str, chain: str) -> str | None:
    return invert(piece, chain)


def undo_plain(text: str) -> str:
    """A text with its UTF-8 chains undone where words decode strictly: no model needed.

    What was stored in UTF-8 beyond ASCII took two bytes or more, so only words with two such characters in a row can decode.
    """
    if text.isascii() or not DOUBLE.search(text):
        return text
    pieces = [p for p in PIECE.findall(text) if DOUBLE.search(p)]
    for chain in ("utf-8 as cp1252 twice", "utf-8 as cp1252", "utf-8 as latin-1", "utf-8 as mac-roman", "utf-8 as cp437", "utf-8 as cp850", "utf-8 as cp1251"):
        if any(_undone(p, chain) for p in pieces):
            return PIECE.sub(lambda m, c=chain: _undone(m.group(), c) or m.group(), text)
    return text


#: Characters of a segment that training looks at.
LONGEST = 2000


def rows_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About so many rows, those whose keys have the lowest hashes; only the hashes are ordered, the rows stay in place."""
    h = F.xxhash64(key)
    top = df.select(h.alias("h")).orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    return df.where(h <= top) if top is not None else df.where(F.lit(False))


def training_texts(df: DataFrame, columns: list[str], key: str, rows: int, segments: int) -> list[str]:
    """Segments beyond ASCII of a bounded sample of rows, chosen by hash; both numbers and their length are bounded."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"s": [s[:LONGEST] for c in columns for t in b[c] if t for s in segments_of(t)]}, dtype=object)

    some = functools.reduce(lambda a, b: a | b, [F.col(c).rlike(r"[^\x00-\x7f]") for c in columns])
    sample = rows_by_hash(df.where(some), key, rows)
    got = sample.select(*columns).mapInPandas(run, "s string").distinct().orderBy(F.xxhash64("s"), "s").limit(segments).collect()
    return [r.s for r in got]


def clean_words(segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of segments, and for each the lowest and the highest hash of a segment that has it."""
    h, row = word_hashes(segments)
    order = np.argsort(h, kind="stable")
    of = hash_words(segments).view(np.int64)[row[order]]
    words, head = np.unique(h[order], return_index=True)
    return words.view(np.int64), np.minimum.reduceat(of, head) if len(head) else of, np.maximum.reduceat(of, head) if len(head) else of


def words_wanted(segments: list[str], p: np.ndarray) -> list[np.ndarray]:
    """The hashes of the words that decide about each segment: those its likely chains restore, and its own in one form."""
    plain = normalise_array(pa.array(segments, pa.string())).to_pylist()
    words = []
    for s, q, own in zip(segments, p, plain, strict=True):
        backs = [x for chain in likely(q) if (x := inverted(s, chain)[0]) is not None]
        words.append([w.lower() for x in [*backs, own] for w in WORD.findall(x)])
    h = hash_words([w for x in words for w in x]).view(np.int64)
    return np.split(h, np.cumsum([len(x) for x in words])[:-1]) if words else []


def find_garbled(df: DataFrame, key: str, columns: dict[str, str], sample_rows: int = 3000, sample_segments: int = 12_000) -> DataFrame:
    """(key, field_name, chain, restored) of every garbled field. columns: column -> name of the field.

    The sample is for the classifier alone. One pass over all rows scores every segment: the words of those that are
    surely clean are counted, the fields with others are kept with the words that their likely chains restore. A word is
    known if two different clean segments of the table have it; each field is confirmed with what is known of its words.
    """
    texts = training_texts(df, list(columns), key, sample_rows, sample_segments)
    model = df.sparkSession.sparkContext.broadcast(train(texts)) if texts else None
    kind = df.schema[key].dataType.simpleString()
    none = {"k": None, "field_name": None, "t": None, "wanted": None, "w": None, "low": None, "high": None}

    def scan(batches):
        m = model.value if model else None
        for b in batches:
            clean: list[str] = []
            for c, name in columns.items():
                texts = b[c].tolist()
                cut = [segments_of(t) if m and t else () for t in texts]
                pool = list(dict.fromkeys(s for x in cut for s in x))
                if not pool:
                    continue
                p = m.probabilities(pool)
                unsure = [k for k, (s, q) in enumerate(zip(pool, p[:, 0], strict=True)) if q < SURE or "\ufffd" in s]
                wanted = dict(zip([pool[k] for k in unsure], words_wanted([pool[k] for k in unsure], p[unsure]), strict=True))
                clean += [s for s in pool if s not in wanted]
                found = [(k, t, [wanted[s] for s in x if s in wanted]) for k, t, x in zip(b[key], texts, cut, strict=True)]
                rows = [(k, name, t, np.unique(np.concatenate(w))) for k, t, w in found if w]
                if rows:
                    yield pd.DataFrame(rows, columns=["k", "field_name", "t", "wanted"]).assign(w=None, low=None, high=None)
            if clean:
                w, low, high = clean_words(list(dict.fromkeys(clean)))
                yield pd.DataFrame({**none, "w": w, "low": low, "high": high}, index=range(len(w)))

    def confirm(batches):
        m = model.value if model else None
        for b in batches:
            hits = []
            for k, name, t, known in zip(b["k"], b["field_name"], b["t"], b["known"], strict=True):
                chain, restored = repair_texts([t], replace(m, known=frozenset(() if known is None else known.tolist())))[0]
                if chain:
                    hits.append((k, name, chain, restored))
            yield pd.DataFrame(hits, columns=[key, "field_name", "chain", "restored"])

    some = functools.reduce(lambda a, b: a | b, [F.col(c).rlike(r"[^\x00-\x7f]") for c in columns])
    seen = df.select(key, *columns).where(some).mapInPandas(scan, f"k {kind}, field_name string, t string, wanted array<long>, w long, low long, high long")
    seen = materialize(seen)
    words = seen.where("w is not null").groupBy("w").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("w")
    fields = seen.where("t is not null").select("k", "field_name", "t", "wanted").distinct().withColumn("id", F.xxhash64("k", "field_name", "t"))
    asked = fields.select("id", F.explode("wanted").alias("w")).distinct().join(words, "w", "left_semi")
    known = asked.groupBy("id").agg(F.collect_list("w").alias("known"))
    ready = fields.join(known, "id", "left").select("k", "field_name", "t", "known")
    return ready.mapInPandas(confirm, f"{key} {kind}, field_name string, chain string, restored string").distinct()
