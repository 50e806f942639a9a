"""Structural Markdown chunking of one document; no Spark here.

A document is a row of lines. A list of constructs, tried in a fixed order, says what a line opens
and where that ends; what opens nothing is a paragraph, up to a blank line or to a line that opens
something. Headings part the document into sections; blocks of a section are split if they are
paragraphs over the limit, then merged towards the target. Offsets are code points here.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np

from ..functions.text import RUN, WHITESPACE, WHITESPACE_CLASS, is_blank
from ..functions.validate import ChunkingError, ChunkOptions
from .tokenizers import Tokenizer, checked_count

# The patterns that tell what a line is, with the script language's meaning of dot, white space and word.
_REST = "[^\n\r\u2028\u2029]*"
_HEADING = re.compile(rf" {{0,3}}(#{{1,6}})({_REST})")
_CLOSING_MARKS = re.compile(r"[ \t]+#+[ \t]*\Z")
_FENCE = re.compile(rf" {{0,3}}(`{{3,}}|~{{3,}})({_REST})")
_FENCE_END = re.compile(r" {0,3}(`+|~+)[ \t]*")
_MARKER = re.compile(r"( *)([-+*]|[0-9]+[.)])[ \t]+")
_QUOTE = re.compile(r" {0,3}>")
_HTML = re.compile(rf" {{0,3}}<(?:!--|/?[A-Za-z][A-Za-z0-9_-]*(?:{WHITESPACE_CLASS}|>|/))")
_CELL = re.compile(r":?-{3,}:?")
_SENTENCE = re.compile(rf"[.!?…][\"'»”)\]]*(?={WHITESPACE_CLASS})")


@dataclass(frozen=True)
class Line:
    start: int
    end: int
    full_end: int
    text: str


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


@dataclass(frozen=True)
class Chunk:
    headings: tuple[str, ...]
    start: int
    end: int
    tokens: int
    first_line: int
    last_line: int


def scan_lines(content: str) -> list[Line]:
    """Lines end at LF only; one CR before it isn't text. A final LF begins no line."""
    out, at = [], 0
    for piece in content.split("\n"):
        end = at + len(piece)
        if at < len(content):
            text = piece.removesuffix("\r")
            out.append(Line(at, at + len(text), min(end + 1, len(content)), text))
        at = end + 1
    return out


def heading(text: str) -> tuple[int, str] | None:
    """Level and title of an ATX heading."""
    m = _HEADING.fullmatch(text)
    if not m or m[2][:1] not in ("", " ", "\t"):
        return None
    title = _CLOSING_MARKS.sub("", m[2].strip(WHITESPACE))
    return len(m[1]), re.sub(r"[ \t]+", " ", title.strip(WHITESPACE))


def marker(text: str) -> tuple[int, int, bool] | None:
    """Indent, column of the item's content, and whether it is numbered."""
    m = _MARKER.match(text)
    return (len(m[1]), m.end(), m[2][0].isdigit()) if m else None


def is_delimiter(text: str) -> bool:
    row = text.strip(WHITESPACE)
    return "|" in row and all(_CELL.fullmatch(c.strip(WHITESPACE)) for c in row.removeprefix("|").removesuffix("|").split("|"))


class Document:
    """The lines of a body and what stands in them."""

    def __init__(self, lines: list[Line]) -> None:
        self.lines, self.text = lines, [x.text for x in lines]
        self.blank = [is_blank(t) for t in self.text]

    def _until(self, i: int, stop: Callable[[int], bool]) -> int:
        while i < len(self.lines) and not stop(i):
            i += 1
        return i

    # Each construct: the line after the last that belongs to what opens at i; None if it doesn't open there.

    def _code(self, i: int) -> int | None:
        m = _FENCE.fullmatch(self.text[i])
        if not m or (m[1][0] == "`" and "`" in m[2]):
            return None
        closing = lambda j: bool((e := _FENCE_END.fullmatch(self.text[j])) and e[1][0] == m[1][0] and len(e[1]) >= len(m[1]))
        return min(self._until(i + 1, closing) + 1, len(self.lines))

    def _heading(self, i: int) -> int | None:
        return i + 1 if heading(self.text[i]) else None

    def _table(self, i: int) -> int | None:
        if "|" not in self.text[i] or i + 1 >= len(self.lines) or not is_delimiter(self.text[i + 1]):
            return None
        return self._until(i + 2, lambda j: self.blank[j] or "|" not in self.text[j])

    def _list(self, i: int) -> int | None:
        root = marker(self.text[i])
        if not root or root[0] > 3:
            return None
        indent, column, numbered = root
        i += 1
        while True:
            i = self._until(i, lambda j: self.blank[j] or bool(heading(self.text[j])) and len(self.text[j]) - len(self.text[j].lstrip(" ")) < column)
            if i == len(self.lines) or not self.blank[i]:
                return i
            after = self._until(i, lambda j: not self.blank[j])
            item = marker(self.text[after]) if after < len(self.lines) else None
            if not item or not (item[0] > indent or item[0] == indent and item[2] == numbered):
                return i
            i = after + 1

    def _to_blank(self, pattern: re.Pattern) -> Callable[[int], int | None]:
        return lambda i: self._until(i + 1, lambda j: self.blank[j]) if pattern.match(self.text[i]) else None

    def opens(self, i: int) -> tuple[str, int] | None:
        """What opens at line i, and where it ends; the order decides."""
        for kind, end_of in (("code", self._code), ("heading", self._heading), ("table", self._table), ("list", self._list), ("quote", self._to_blank(_QUOTE)), ("html", self._to_blank(_HTML))):
            end = end_of(i)
            if end is not None:
                return kind, end
        return None

    def spans(self, i: int = 0) -> Iterator[tuple[str, int, int]]:
        """kind, first line and line after the last, from line i on."""
        while (i := self._until(i, lambda j: not self.blank[j])) < len(self.lines):
            kind, end = self.opens(i) or ("paragraph", self._until(i + 1, lambda j: self.blank[j] or self.opens(j) is not None))
            yield kind, i, end
            i = end


def line_kind(text: str) -> str:
    """What a line opens where it stands alone; a row of delimiters, which a table needs, has a name of its own."""
    opened = Document([Line(0, len(text), len(text), text)]).opens(0)
    return opened[0] if opened else "delimiter" if is_delimiter(text) else "text"


def body_line(lines: list[Line]) -> int:
    """The first line after front matter: `---` on the very first line (a byte order mark may stand before) up to the next such line."""
    if lines and lines[0].text.removeprefix("﻿") == "---" and lines[0].text in ("---", "﻿---"):
        for k, line in enumerate(lines[1:], 1):
            if line.text == "---":
                return k + 1
    return 0


class Counter:
    """Token counts of slices of one content, from sums where the tokenizer is additive."""

    def __init__(self, tokenizer: Tokenizer, content: str) -> None:
        self.tokenizer, self.content = tokenizer, content
        self.sums = tokenizer.slices(content) if hasattr(tokenizer, "slices") else None

    def one(self, start: int, end: int) -> int:
        if self.sums is not None:
            return int(self.sums.count(start, np.array([end]))[0])
        try:
            return checked_count(self.tokenizer, self.content[start:end])
        except Exception as cause:
            raise ChunkingError("MARKDOWN_CHUNKING_TOKENIZER_FAILED", f"{self.tokenizer.id} failed for [{start}, {end}): {cause}", (start, end)) from cause

    def many(self, start: int, ends: np.ndarray) -> np.ndarray:
        return self.sums.count(start, ends) if self.sums is not None else np.array([self.one(start, int(e)) for e in ends], dtype=np.int64)


class Splitter:
    """Cuts a paragraph over the limit at sentence ends, else at white space, else between code points."""

    def __init__(self, content: str, span: Span, counter: Counter, options: ChunkOptions) -> None:
        self.content, self.span, self.counter, self.options = content, span, counter, options
        ends = [m.end() for m in _SENTENCE.finditer(content, span.start, span.end)]
        runs = list(RUN.finditer(content, span.start, span.end))
        self.sentences = np.array(ends, dtype=np.int64)
        self.gaps = np.array([m.start() for m in runs], dtype=np.int64)
        self.gap_starts = [m.start() for m in runs]
        self.gap_ends = [m.end() for m in runs]
        self.after_gaps = np.array(self.gap_ends, dtype=np.int64)

    def _trimmed(self, start: int, cuts: np.ndarray) -> np.ndarray:
        """The cuts moved back over white space that ends there, but not before start."""
        if not self.gap_starts:
            return cuts
        k = np.searchsorted(self.after_gaps, cuts, "left")
        near = np.minimum(k, len(self.gap_starts) - 1)
        inside = (k < len(self.gap_starts)) & (self.gaps[near] < cuts)
        return np.maximum(np.where(inside, self.gaps[near], cuts), start)

    def _best(self, start: int, cuts: np.ndarray) -> tuple[int, int] | None:
        """Of all cuts that fit, the one nearest the target, the later of two as near."""
        cuts = cuts[: np.searchsorted(cuts, self._reach(start), "right")]
        ends = self._trimmed(start, cuts)
        cuts, ends = cuts[ends > start], ends[ends > start]
        if not len(cuts):
            return None
        counts = self.counter.many(start, ends)
        apart = np.where(counts <= self.options.maxTokens, np.abs(counts - self.options.targetTokens), np.iinfo(np.int64).max)
        if not len(apart) or apart.min() == np.iinfo(np.int64).max:
            return None
        k = len(apart) - 1 - int(np.argmin(apart[::-1]))
        return int(ends[k]), int(cuts[k])

    def _reach(self, start: int) -> int:
        """No cut beyond this can fit: known where counts only rise, else the paragraph's end."""
        if self.counter.sums is None:
            return self.span.end
        far = self.counter.sums.farthest(start, self.options.maxTokens)
        k = bisect_right(self.gap_starts, far) - 1
        return max(far, self.gap_ends[k]) if k >= 0 else far

    def _window(self, cuts: np.ndarray, start: int) -> np.ndarray:
        return cuts[np.searchsorted(cuts, start, "right") :]

    def pieces(self) -> list[Span]:
        span, limit, out, at = self.span, self.options.maxTokens, [], self.span.start
        if self.counter.one(span.start, span.end) <= limit:
            return [span]
        while at < span.end:
            k = bisect_right(self.gap_starts, at) - 1
            if k >= 0 and self.gap_ends[k] > at:
                at = self.gap_ends[k]
                continue
            rest = int(self._trimmed(at, np.array([span.end]))[0])
            if rest > at and self.counter.one(at, rest) <= limit:
                out.append(Span("paragraph", at, rest))
                break
            found = self._best(at, self._window(self.sentences, at)) or self._best(at, self._window(self.gaps, at)) or self._best(at, np.arange(at + 1, min(span.end, self._reach(at)) + 1)) or (at + 1, at + 1)
            out.append(Span("paragraph", at, found[0]))
            at = max(found[1], at + 1)
        return out or [span]


def merged(spans: list[Span], counter: Counter, options: ChunkOptions) -> Iterator[tuple[int, int, int]]:
    """Start, end and tokens of neighbours put together while that fits and comes no farther from the target."""
    target, limit, held = options.targetTokens, options.maxTokens, None
    for span in spans:
        alone = counter.one(span.start, span.end)
        if held and not (span.kind != "paragraph" and alone > limit):
            both = counter.one(held[0], span.end)
            if both <= limit and abs(both - target) <= abs(held[2] - target):
                held = (held[0], span.end, both)
                continue
        if held:
            yield held
        held = (span.start, span.end, alone)
        if span.kind != "paragraph" and alone > limit:
            yield held
            held = None
    if held:
        yield held


def chunk(content: str, title: str | None, tokenizer: Tokenizer, options: ChunkOptions) -> list[Chunk]:
    """The chunks of one document, in order."""
    lines = scan_lines(content)
    root = (title,) if title is not None and not is_blank(title) else ()
    counter, starts = Counter(tokenizer, content), [x.start for x in lines]
    path, section, number, placed = root, [], 0, []
    for kind, first, after in Document(lines).spans(body_line(lines)):
        if kind == "heading":
            level, text = heading(lines[first].text)
            section = [x for x in section if x[0] < level] + [(level, text)]
            path = tuple(t for _, t in section if t) or root
            number += 1
        else:
            placed.append((number, path, Span(kind, lines[first].start, lines[after - 1].end)))
    out = []
    for (_, path), members in groupby(placed, key=lambda x: x[:2]):
        spans = [p for *_, s in members for p in (Splitter(content, s, counter, options).pieces() if s.kind == "paragraph" else [s])]
        for start, end, tokens in merged(spans, counter, options):
            out.append(Chunk(path, start, end, tokens, bisect_right(starts, start), bisect_right(starts, end - 1)))
    return out
