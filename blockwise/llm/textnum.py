"""Numpy views of many texts laid end to end: words, lines and 64-bit hashes of byte spans."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: The bytes that part words: space, and TAB to CR.
SPACE = _table(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_BASE, _UNBASE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0 to n of the base or of its inverse, modulo 2**64."""
    if len(_powers[kind]) <= n:
        own = np.full(n + 1 + n // 4, _BASE if kind == "up" else _UNBASE, dtype=U64)
        own[0] = 1
        _powers[kind] = np.multiply.accumulate(own)
    return _powers[kind]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Texts:
    """Texts of one Arrow string array (null counts as empty) as bytes end to end."""

    def __init__(self, column: pa.Array, lower: bool = False) -> None:
        column = pc.fill_null(column, "").cast(pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        raw = raw[at[0] : at[-1]]
        self.n = len(column)
        self.at = at - at[0]
        self.data = LOWER[raw] if lower else raw

    def _edges(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of True that don't cross texts."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = np.unique(self.at[(self.at > 0) & (self.at < len(inside))])
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    @cached_property
    def spaces(self) -> np.ndarray:
        return SPACE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self._edges(~self.spaces)

    @cached_property
    def word_at(self) -> np.ndarray:
        """Index of each text's first word, and the number of words."""
        return np.searchsorted(self.words[0], self.at)

    @cached_property
    def word_text(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(self.n), np.diff(self.word_at))

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each line of a split at \\n; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        texts = np.repeat(np.arange(self.n), 1 + np.diff(np.searchsorted(breaks, self.at)))
        # a line begins with its text or behind a break; of a text's lines the first has no break before it
        first = np.append(True, texts[1:] != texts[:-1])[: len(texts)]
        starts = np.empty(len(texts), dtype=np.int64)
        starts[first], starts[~first] = self.at[:-1], breaks + 1
        last = np.append(texts[1:] != texts[:-1], True)[-len(texts) :] if len(texts) else first
        ends = np.empty(len(texts), dtype=np.int64)
        ends[last], ends[~last] = self.at[1:], breaks
        return starts, ends, texts

    @cached_property
    def _sums(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum(_BYTES[self.data] * _power("up", len(self.data))[: len(self.data)], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span."""
        if not len(starts):
            return np.zeros(0, dtype=U64)
        down = _power("down", len(self.data))
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(U64))

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.hashes(*self.words)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of `width` words within a text."""
        total = len(self.word_hash) - width + 1
        if total <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        whole = self.word_text[: total] == self.word_text[width - 1 :]
        out = np.zeros(total, dtype=U64)
        for k in range(width):
            out = out * U64(0xD6E8FEB86659FD93) + self.word_hash[k : k + total]
        first = np.flatnonzero(whole)
        return first, mix(out[first])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.at])


def twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=bool)
    order = np.sort(keys)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return np.zeros(len(keys), dtype=bool)
    return again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys
