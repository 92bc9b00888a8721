"""Words of many texts at once, as 64-bit hashes, without a call per word."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

SIZE = 0x110000
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: Characters worked on at once: some fifty bytes of working arrays go with each.
BLOCK = 1 << 20
LETTER, DIGIT = 1, 2


@functools.cache
def tables() -> dict[str, np.ndarray]:
    """By code point: the lower-case one, the class (letter, digit or other) and a random number."""
    lower, kind = np.arange(SIZE, dtype=np.uint32), np.zeros(SIZE, np.uint8)
    for c in (*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000)):
        ch = chr(c)
        if ch.isalnum():
            kind[c] = LETTER if ch.isalpha() else DIGIT
        low = ch.lower()
        if len(low) == 1 and low != ch:
            lower[c] = ord(low)
    kind[0x3400:0xA000] = kind[0x20000:0x32000] = LETTER
    x = np.arange(1, SIZE + 1, dtype=np.uint64) * np.uint64(BASE)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return {"lower": lower, "kind": kind, "mix": x ^ x >> np.uint64(31)}


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    return edge[::2], edge[1::2]


def hash_runs(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the code points of each run."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(20, int(len(points)).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tables()["mix"][points] * up[: len(points)], dtype=np.uint64)))
    h = (total[end] - total[start]) * down[start]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def hash_words(words: list[str]) -> np.ndarray:
    """The hash of each string taken as one word."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    out = np.zeros(len(words), np.uint64)
    some = size > 0
    out[some] = hash_runs(points_of("".join(words)), (end - size)[some], end[some])
    return out


def blocks(texts: list[str | None], size: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
    """(row of each piece, where it starts, pieces joined by line breaks), of bounded length; only a longer text is cut, at a blank."""
    rows: list[int] = []
    pieces: list[str] = []
    total = 0

    def done() -> tuple[np.ndarray, np.ndarray, str]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        return np.array(rows), np.concatenate(([0], np.cumsum(lengths + 1)[:-1])), "\n".join(pieces)

    for i, t in enumerate(texts):
        t = t or ""
        while t:
            piece = t
            if len(t) > size:
                at = max(t.rfind("\n", 1, size), t.rfind(" ", 1, size))
                piece = t[: at if at > 0 else size]
            t = t[len(piece) :]
            if total and total + len(piece) > size:
                yield done()
                rows, pieces, total = [], [], 0
            rows.append(i), pieces.append(piece)
            total += len(piece) + 1
    if pieces:
        yield done()


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the lower-case words (runs of letters and digits) of all texts, and the row of each."""
    t = tables()
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for piece_row, piece_at, joined in blocks(texts):
        p = t["lower"][points_of(joined)]
        start, end = runs(t["kind"][p] > 0)
        hashes.append(hash_runs(p, start, end))
        rows.append(piece_row[np.searchsorted(piece_at, start, "right") - 1])
    return np.concatenate(hashes), np.concatenate(rows)
