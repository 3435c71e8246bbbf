"""Windows of consecutive tokens, grouped by the gram that stands for them.

A gram of a window is chosen by its content alone: the one with the least
hash, leftmost if several have it. Equal windows choose equal grams at the same
place. Neighbouring windows mostly choose the same occurrence, so a text falls
into runs of windows, one run for each chosen occurrence (its pivot). Runs are
what the duplicate operators shuffle, a twentieth of the windows they hold.

A run's content is all tokens under its windows and the pivot's place in it.
Runs of equal content hold equal windows. Windows of runs with different
content can only be equal if the pivots' grams are.

Identifiers are 64-bit sums of token hashes times powers of an odd number,
which give the identifier of any span in two look-ups; a gram and a span
together identify a window by 128 bits.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def need(cls, n: int) -> None:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                powers = np.full(n, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers, dtype=np.uint64))


def scramble(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; different numbers stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Identifiers of all spans of a sequence of token hashes."""

    def __init__(self, tokens: np.ndarray) -> None:
        _Powers.need(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * _Powers.up[: len(tokens)], out=self.sums[1:])

    def all(self, length: int) -> np.ndarray:
        """Of the spans of ``length`` tokens at every place."""
        n = len(self.sums) - length
        return scramble((self.sums[length:] - self.sums[:n]) * _Powers.down[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.sums[end] - self.sums[start]) * _Powers.down[start] + (end - start).astype(np.uint64))


class Runs(NamedTuple):
    start: np.ndarray  # the first window
    count: np.ndarray  # windows in the run
    pivot: np.ndarray  # identifier of the chosen gram
    content: np.ndarray  # identifier of all tokens and the pivot's place


def runs(tokens: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[Runs, np.ndarray]:
    """Runs of the windows of texts that lie end to end in ``tokens``, and the
    identifiers of the grams at all places.

    Text i is tokens[bounds[i]:bounds[i + 1]]; no window crosses a bound.
    """
    spans = Spans(tokens)
    none = np.zeros(0, np.int64)
    n = len(tokens) - window + 1
    if n <= 0:
        return Runs(none, none, none.astype(np.uint64), none.astype(np.uint64)), none.astype(np.uint64)
    grams = spans.all(gram)
    places = np.arange(len(grams), dtype=np.uint64)
    least = (grams & np.uint64(_WORD ^ 0xFFFFFFFF)) | places
    width, have = window - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    first, last = bounds[:-1], bounds[1:] - window
    good = last >= first
    np.add.at(inside, first[good], 1)
    np.add.at(inside, last[good] + 1, -1)
    inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
    opens = inside.copy()
    opens[1:] &= chosen[1:] != chosen[:-1]
    opens[first[good]] = True
    start = np.flatnonzero(opens)
    ends = np.flatnonzero(inside & ~np.append(inside[1:] & ~opens[1:], False)) + 1
    count = ends - start
    pivot = chosen[start]
    content = spans.at(start, start + count + window - 1) ^ scramble((pivot - start).astype(np.uint64))
    return Runs(start, count, grams[pivot], content), grams


def covered(starts: np.ndarray, counts: np.ndarray, window: int, length: int) -> np.ndarray:
    """Which of ``length`` tokens lie under any of the given windows."""
    delta = np.zeros(length + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + counts + window - 1, -1)
    return np.cumsum(delta[:length]) > 0
