"""Words of many texts at once, as numpy arrays: helpers for code that runs inside tasks.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return: the pattern [^\\x20\\x09-\\x0D]+ on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Text bytes taken at once.
PART_BYTES = 1 << 20

_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MULTIPLIERS = np.random.default_rng(7).integers(1 << 62, 1 << 63, 64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1), mod 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        table = np.full(max(n, PART_BYTES + (PART_BYTES >> 2)), base, np.uint64)
        table[0] = 1
        known = np.multiply.accumulate(table)
        if len(known) <= PART_BYTES * 2:
            _powers[int(base)] = known
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that makes every bit depend on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of a run of texts: where each lies in `data`, its 64-bit hash, and for each text its first word's index (`first`, with the total behind)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def bytes_between(self, a: int, b: int) -> bytes:
        """Words a to b - 1, joined as they are in the text."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes()


def words_of(texts: list[bytes], lower_ascii: bool = False) -> Words:
    """The words of the texts."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if lower_ascii:
        data = _LOWER[data]
    inside = ~_GAP[data]
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    upto = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inside * _power_table(_BASE, len(data)), out=upto[1:])
    hashes = mixed((upto[end] - upto[start]) * _power_table(_BASE_INVERSE, max(1, len(data)))[start])
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    return Words(data, start, end, hashes, first)


def parts(texts: Iterable[bytes], size: int = PART_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about `size` bytes together, each with the first's index."""
    run, held, at, i = [], 0, 0, -1
    for i, text in enumerate(texts):
        if run and held + len(text) > size:
            yield at, run
            run, held, at = [], 0, i
        run.append(text)
        held += len(text)
    if run:
        yield at, run


def ngrams(words: Words, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of n words of one text starts (word index), and its 64-bit hash; another salt gives an independent one."""
    total = len(words.hash) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h += words.hash[k : k + total] * _MULTIPLIERS[(k + 16 * salt) % len(_MULTIPLIERS)]
    at = np.arange(total)
    whole = at + n <= words.first[1:][words.text_of()[:total]]
    return at[whole], mixed(h[whole])


def single_spaced(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space behind each, all texts in a row: the bytes, and each word's start and end there."""
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1
    start = end - length
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[end] = False
    out[inside] = words.data[~_GAP[words.data]]
    return out, start, end


def slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, behind: int) -> np.ndarray:
    """data[start:end] for each pair, one after the other, with the byte `behind` after each."""
    length = end - start + 1
    if not len(length):
        return data[:0]
    last = np.cumsum(length) - 1
    at = np.arange(int(last[-1]) + 1) + np.repeat(start - (last - length + 1), length)
    at[last] = 0
    out = data[at]
    out[last] = behind
    return out
