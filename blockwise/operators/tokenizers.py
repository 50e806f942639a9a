"""Token counters: an id, a version and count(text). Additive ones can also count any slice at once."""

from __future__ import annotations

from typing import Protocol

import numpy as np

from ..functions.text import RUN, SAFE_INTEGER, is_blank, lone_surrogate
from ..functions.validate import TokenizerError


class Tokenizer(Protocol):
    id: str
    version: str

    def count(self, text: str) -> int: ...


class Additive(Protocol):
    """A tokenizer that answers for slices of one text from sums; its counts never fall as a slice grows."""

    def slices(self, text: str) -> SliceCounts: ...


class SliceCounts:
    """Counts of text[start:end] as sums[end] - sums[start] + carried[start]; 0 for an empty slice."""

    def __init__(self, sums: np.ndarray, carried: np.ndarray | None = None) -> None:
        self.sums, self.carried = sums, carried

    def count(self, start: int, ends: np.ndarray) -> np.ndarray:
        more = int(self.carried[start]) if self.carried is not None and start < len(self.carried) else 0
        return np.where(ends > start, self.sums[ends] - self.sums[start] + more, 0)

    def farthest(self, start: int, most: int) -> int:
        """The last end up to which a slice from start counts at most `most`."""
        more = int(self.carried[start]) if self.carried is not None and start < len(self.carried) else 0
        return int(np.searchsorted(self.sums, self.sums[start] + most - more, "right")) - 1


class CodePoints:
    """One token a code point."""

    id, version = "test:code-point", "1"

    def count(self, text: str) -> int:
        return len(text)

    def slices(self, text: str) -> SliceCounts:
        return SliceCounts(np.arange(len(text) + 1))


class Words:
    """One token a run of other than white space."""

    id, version = "test:word", "1"

    def count(self, text: str) -> int:
        return sum(1 for part in RUN.split(text) if part)

    def slices(self, text: str) -> SliceCounts:
        inside = np.ones(len(text) + 1, dtype=bool)
        inside[-1] = False
        for run in RUN.finditer(text):
            inside[run.start() : run.end()] = False
        begins = inside[:-1].copy()
        begins[1:] &= ~inside[:-2]
        return SliceCounts(np.concatenate([[0], np.cumsum(begins)]), (inside[:-1] & ~begins).astype(np.int64))


class Table:
    """Exact counts of known texts; any other text is an error."""

    def __init__(self, entries: list[tuple[str, int]], id: str = "fake:table", version: str = "1") -> None:
        self.id, self.version, self.known = id, version, {}
        for text, tokens in entries:
            if text in self.known:
                raise TokenizerError("FAKE_TOKENIZER_DUPLICATE_TEXT", f"given twice: {text!r}")
            if isinstance(tokens, bool) or not isinstance(tokens, int) or not 0 <= tokens <= SAFE_INTEGER:
                raise TokenizerError("FAKE_TOKENIZER_INVALID_COUNT", f"not a count: {tokens!r}")
            self.known[text] = tokens

    def count(self, text: str) -> int:
        if text not in self.known:
            raise TokenizerError("FAKE_TOKENIZER_UNKNOWN_TEXT", f"no count for {text!r}")
        return self.known[text]


class BytePair:
    """Byte-pair counts by tiktoken. Ranks come from a file or from tiktoken's own store; without them it fails, and never estimates."""

    def __init__(self, encoding: str = "o200k_base", ranks: str | None = None, pattern: str | None = None, version: str = "1.0.21") -> None:
        self.id, self.version = f"js-tiktoken:{encoding}" if ranks is None else f"tiktoken:{encoding}", version
        self.made_from, self._encoder = (encoding, ranks, pattern), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_encoder": None}

    def _load(self):
        import base64

        import tiktoken

        encoding, ranks, pattern = self.made_from
        try:
            if ranks is None:
                return tiktoken.get_encoding(encoding)
            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            return tiktoken.Encoding(encoding, pat_str=pattern, mergeable_ranks=known, special_tokens={})
        except Exception as cause:
            raise TokenizerError("TOKENIZER_ENCODING_FAILED", f"no ranks for {encoding}: {cause}") from cause

    def count(self, text: str) -> int:
        at = lone_surrogate(text)
        if at is not None:
            raise TokenizerError("TOKENIZER_INVALID_UNICODE", f"lone surrogate at code unit {at}")
        self._encoder = self._encoder or self._load()
        return len(self._encoder.encode_ordinary(text))


def checked_count(tokenizer: Tokenizer, text: str) -> int:
    """A usable count, or the tokenizer's own error."""
    found = tokenizer.count(text)
    if isinstance(found, bool) or not isinstance(found, int) or not 0 <= found <= SAFE_INTEGER:
        raise TokenizerError("TOKENIZER_BAD_COUNT", f"{tokenizer.id} returned {found!r}")
    return found


__all__ = ["Additive", "BytePair", "CodePoints", "SliceCounts", "Table", "Tokenizer", "Words", "checked_count", "is_blank"]
