"""Token ids of whole texts, from a tokenizer file, each distinct piece encoded once per worker.

The library spends some ten microseconds on a word, however often it comes. Both vocabularies used
here cut a text into pieces (runs of letters, digits, other characters and white space) before they
merge, so the ids of a text are the ids of its pieces one after another. A worker finds the pieces
of many texts with numpy, keeps the ids of those it has met, up to a bound, by 64-bit hash, and asks
the library for new ones only. Texts whose pieces the bytes alone don't tell (letters beyond Latin,
contractions, strings of special tokens) go to the library whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textnum import U64, Texts

#: Pieces that a worker keeps (some 100 MB); when there are more it starts anew.
KEPT_PIECES = 2_000_000


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


# Lead bytes of U+00C0 to U+024F, all letters but for three places.
_LEADS = np.isin(np.arange(256), np.arange(0xC3, 0xCA))
_LETTER_BYTE = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(128, 256)])
_DIGIT_BYTE = np.isin(np.arange(256), np.arange(48, 58))
_AFTER_APOSTROPHE = np.isin(np.arange(256), list(b"stmdrvlSTMDRVL"))
_CONTROL_SPACE = np.isin(np.arange(256), np.arange(28, 32))


class HashTable:
    """Open addressing from 64-bit hashes to numbers, a whole array at a time."""

    def __init__(self, bits: int = 16) -> None:
        self.keys, self.values, self.n = np.zeros(1 << bits, dtype=U64), np.zeros(1 << bits, dtype=np.int64), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it has none."""
        out, rest, mask = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys)), U64(len(self.keys) - 1)
        at = keys & mask
        while len(rest):
            there = self.keys[at]
            hit = there == keys
            out[rest[hit]] = self.values[at[hit]]
            on = ~hit & (there != 0)
            rest, keys, at = rest[on], keys[on], (at[on] + U64(1)) & mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Take in keys that are new and unlike each other."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            full = self.keys != 0
            keys, values = np.concatenate([self.keys[full], keys]), np.concatenate([self.values[full], values])
            self.__init__(max(16, int(3 * len(keys)).bit_length()))
        self.n += len(keys)
        mask = U64(len(self.keys) - 1)
        at = keys & mask
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + U64(1)) & mask


class Encoder:
    """Encodes Arrow arrays of texts into one run of ids and the offsets of the texts in it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.folds = self.whole.normalizer is not None
        self.specials = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.whole.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.table = HashTable()
        self.pool, self.used = np.zeros(1 << 18, dtype=self.kind), 0
        self.starts, self.sizes = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)

    def _cut(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of plain texts, in order."""
        data, space = texts.data, texts.spaces
        letter, digit = _LETTER_BYTE[data], _DIGIT_BYTE[data]
        if self.folds:
            lone = np.flatnonzero(digit)
            starts, ends = zip(texts._edges(letter), (lone, lone + 1), texts._edges(~(space | letter | digit)), strict=True)
            starts, ends = np.concatenate(starts), np.concatenate(ends)
        else:
            starts, ends = zip(texts._edges(letter), texts._edges(digit), texts._edges(~(space | letter | digit)), strict=True)
            starts, ends = np.concatenate(starts), np.concatenate(ends)
            first = np.zeros(len(data) + 1, dtype=bool)
            first[texts.at] = True
            led = (starts > 0) & ~first[starts]
            led[led] = data[starts[led] - 1] == 32
            starts = starts - led
            lo, hi = texts._edges(space)
            closing = first[hi]
            long = ~closing & (hi - lo > 1)
            odd = ~closing & (data[hi - 1] != 32)
            starts = np.concatenate([starts, lo[closing], lo[long], hi[odd] - 1])
            ends = np.concatenate([ends, hi[closing], hi[long] - 1, hi[odd]])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def _learn(self, pieces: list[str], keys: np.ndarray) -> None:
        if self.folds:
            pieces = [p.lower() for p in pieces]
        as_letters = [p.encode().decode("latin-1").translate(_LETTERS) for p in pieces]
        ids = [x.ids for k in range(0, len(pieces), 4096) for x in self.bare.encode_batch_fast(as_letters[k : k + 4096], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=self.kind, count=int(sizes.sum()))
        n = self.table.n
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(ids) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(ids)] = sizes
        self.used += len(flat)
        self.table.add(keys, np.arange(n, n + len(ids)))

    def _plain(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self._cut(texts)
        keys = texts.hashes(starts, ends) | U64(1)
        number = self.table.find(keys)
        if (number < 0).any():
            fresh, first = np.unique(keys[number < 0], return_index=True)
            if self.table.n + len(fresh) > KEPT_PIECES:
                self.clear()
                fresh, first = np.unique(keys, return_index=True)
                where = first
            else:
                where = np.flatnonzero(number < 0)[first]
            raw = texts.data.tobytes()
            self._learn([raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], fresh)
            number = self.table.find(keys)
        sizes = self.sizes[number]
        at = np.zeros(len(number) + 1, dtype=np.int64)
        np.cumsum(sizes, out=at[1:])
        ids = self.pool[np.repeat(self.starts[number] - at[:-1], sizes) + np.arange(at[-1])]
        return ids, at[np.searchsorted(starts, texts.at)]

    def _is_plain(self, texts: Texts, column: pa.Array) -> np.ndarray:
        """Texts whose pieces the bytes alone tell: letters up to U+024F, no contraction, no special token."""
        data = texts.data
        beyond = data >= 0xC0
        odd = (beyond & ~_LEADS[data]) | _CONTROL_SPACE[data]
        if beyond.any():
            lead = np.flatnonzero(beyond)
            lead = lead[lead + 1 < len(data)]
            pair = data[lead].astype(np.int32) * 256 + data[lead + 1]
            odd[lead[np.isin(pair, [0xC397, 0xC3B7, 0xC4B0]) | (pair >= 0xC990)]] = True
        quote = np.flatnonzero(data == 39)
        quote = quote[quote + 1 < len(data)]
        odd[quote[_AFTER_APOSTROPHE[data[quote + 1]]]] = True
        plain = texts.per_text(odd) == 0
        for special in self.specials:
            plain &= ~pc.match_substring(column, special).to_numpy(zero_copy_only=False)
        return plain

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, and len(column) + 1 offsets; null is empty."""
        column = pc.fill_null(column, "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        plain = self._is_plain(Texts(column), column)
        if plain.all():
            return self._plain(Texts(column, lower=self.folds))
        ids, at = self._plain(Texts(column.filter(pa.array(plain)), lower=self.folds))
        rest = self._by_library(column.filter(pa.array(~plain)).to_pylist())
        out, k, sizes = [], 0, np.zeros(len(column), dtype=np.int64)
        for j, is_plain in enumerate(plain.tolist()):
            if is_plain:
                out.append(ids[at[k] : at[k + 1]])
                k += 1
            else:
                out.append(np.array(next(rest), dtype=self.kind))
            sizes[j] = len(out[-1])
        return np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])

    def _by_library(self, texts: list[str]) -> Iterator[list[int]]:
        for k in range(0, len(texts), 64):
            for found in self.whole.encode_batch_fast(texts[k : k + 64], add_special_tokens=False):
                yield found.ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by the end id, as unsigned 32-bit integers."""
    n = len(at) - 1
    out = np.full(len(ids) + n, end, dtype="<u4")
    keep = np.ones(len(out), dtype=bool)
    keep[at[1:] + np.arange(n)] = False
    out[keep] = ids
    return out, at + np.arange(n + 1)


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def runs(at: np.ndarray) -> Iterator[tuple[int, int]]:
    yield from zip(at[:-1].tolist(), at[1:].tolist(), strict=True)
