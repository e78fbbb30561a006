"""Words of a batch of texts as NumPy arrays: positions, lengths and 64-bit hashes.

Helpers for tasks that get their texts in Arrow batches. They work on the UTF-8 bytes of a whole
batch at once, never per word, and are independent of how texts are cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text worked on at once. Longer single texts are taken alone, whole.
CHUNK_BYTES = 1 << 18

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: ``[^\x20\x09-\x0D]+``
SPACE_WORDS = ~_SPACES
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, letters and all beyond ASCII.
ALNUM_WORDS = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


LOWER = _lower_table()


def _byte_codes() -> np.ndarray:
    """A fixed random 64-bit number per byte, from the mixing rule itself."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_CODES = _byte_codes()
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BASE = int(_MULTIPLIER)
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _POWERS[key] = np.multiply.accumulate(factors)
    return _POWERS["up"], _POWERS["down"]


_ASCII_LETTERS = np.array([c < 0x80 and chr(c).isalpha() for c in range(256)])


def _within(some: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(some)] = True
    return table


class Words:
    """The words of some texts: ``start`` and ``end`` in ``data`` (their bytes), ``hash``,
    ``begins`` of
    the texts, and ``first``: the words of text i are first[i] to first[i + 1]."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, alphabet: np.ndarray, apart: bytes = b""):
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = alphabet[data]
        # texts are one separator byte apart, so no word runs over the end of its text
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        if apart and len(edge):
            last = edge[1::2] - 1
            mark = _within(apart)[data[last]] & _ASCII_LETTERS[data[np.maximum(last - 1, 0)]] & (last > edge[0::2])
            edge = np.sort(np.concatenate([edge, last[mark], last[mark]]))
        self.data, self.begins, self.start, self.end = data, begins, edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, begins)
        if len(data):
            up, down = _powers(len(data) + 1)
            total = np.empty(len(data) + 1, np.uint64)
            total[0] = 0
            np.cumsum(_CODES[data] * up[: len(data)], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def text(self, lo: int, hi: int) -> list[bytes]:
        """Words lo to hi, for an exact check of a hit."""
        return [self.data[s:e].tobytes() for s, e in zip(self.start[lo:hi], self.end[lo:hi], strict=True)]

    def owner(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: list[str | None], alphabet: np.ndarray, lower: bool = True, apart: bytes = b"") -> Words:
    """The words of these texts, A-Z lower-cased unless asked otherwise; a missing text has none.

    One of the bytes ``apart`` behind an ASCII letter at a word's end becomes a word of its own.
    """
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in raw], out=begins[1:])
    data = np.frombuffer(b" ".join(raw), np.uint8)
    data = LOWER[data] if lower else data
    return Words(data, begins, alphabet, apart)


def runs(texts: list[str | None], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of at most ``size`` characters; a longer text is a run of its own."""
    lo = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and held + n > size:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(texts):
        yield lo, len(texts)


_STEP = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words; windows over text borders are the caller's to drop."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * _STEP[k % 64]
    return mix(total + np.uint64(width))
