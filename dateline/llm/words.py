"""Words of whole texts as numpy arrays, for use inside tasks.

A word is a run of ASCII letters and digits and of bytes beyond ASCII; a point or comma
between two digits belongs to the number. Letters are lower-cased (ASCII and Latin-1).
Memory in a task follows the larger of ``PIECE`` and its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_INSIDE = _DIGIT | _UPPER | (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128)
_LOWER = np.where(_UPPER, _BYTE + 32, _BYTE).astype(np.uint8)
_BREAK = np.isin(_BYTE, list(b".!?\n"))
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value."""
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def _power(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        held = np.full(max(n, PIECE + 1), base, np.uint64)
        held[0] = 1
        np.cumprod(held, out=held)
        if n <= 4 * PIECE:
            _powers[name] = held
    return held[:n]


@dataclass
class Words:
    """Parallel arrays, one item per word, in text order.

    ``start`` and ``stop`` are byte positions in ``data``, the texts joined by line
    feeds; ``doc`` is the text's number; ``sentence`` numbers the sentences of all texts
    in ascending order, with gaps.
    """

    data: np.ndarray
    low: np.ndarray
    first: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    sentence: np.ndarray
    _sums: np.ndarray

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A 64-bit hash of every word, or of its first ``longest`` bytes."""
        stop = self.stop if longest is None else np.minimum(self.stop, self.start + longest)
        inverse = _power("inverse", pow(_BASE, -1, 1 << 64), len(self.data) + 1)
        return mix((self._sums[stop] - self._sums[self.start]) * inverse[self.start])

    def digit(self) -> np.ndarray:
        return _DIGIT[self.data[self.start]]

    def capital(self) -> np.ndarray:
        """Words that begin with a capital letter (ASCII or Latin-1)."""
        second = np.minimum(self.start + 1, self.stop - 1)
        changed = self.low != self.data
        return changed[self.start] | (changed[second] & (self.data[self.start] == 0xC3))

    def text(self, i: int) -> bytes:
        return self.low[self.start[i] : self.stop[i]].tobytes()


def _words(texts: list[bytes]) -> Words:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = _LOWER[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    low[latin] += 32
    inside = _INSIDE[data]
    points = np.flatnonzero((data[1:-1] == 46) | (data[1:-1] == 44)) + 1
    inside[points[_DIGIT[data[points - 1]] & _DIGIT[data[points + 1]]]] = True
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, stop = edges[::2], edges[1::2]
    breaks = np.cumsum(_BREAK[data] & ~inside)
    powers = _power("power", _BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    return Words(data, low, first, np.searchsorted(ends, start, "right"), start, stop, breaks[start], sums)


def pieces(texts: Sequence[str | None]) -> Iterator[tuple[int, int, Words]]:
    """``(from, to, words)`` for runs of whole texts of about ``PIECE`` bytes; null is empty."""
    begun, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        if held and size + len(data) > PIECE:
            yield begun, i, _words(held)
            begun, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield begun, len(texts), _words(held)
