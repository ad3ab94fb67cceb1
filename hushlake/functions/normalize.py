"""Views of a text that keep, for each of their characters, the range of the source it came from."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import regex

_ESCAPE = regex.compile(r"\\u([0-9a-fA-F]{4})")
_PERCENT = regex.compile(r"%([0-7][0-9a-fA-F])")
_CLUSTER = regex.compile(r"\X")
_NEWLINES = regex.compile(r"[ \t\f\r\n]*\n[ \t\f\r\n]*")


@dataclass
class View:
    """Text with the start and end in the source of each character; None stands for the identity."""

    text: str
    starts: list[int] | None = None
    ends: list[int] | None = None

    def source(self, start: int, end: int) -> tuple[int, int]:
        """Range of the source that a non-empty range of the view covers, whole units at its edges."""
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def _replaced(self, pieces: list[tuple[int, int, str]]) -> View:
        """The view with ranges replaced; each character put in stands for its whole range."""
        if not pieces:
            return self
        n = len(self.text)
        s0 = self.starts if self.starts is not None else range(n)
        e0 = self.ends if self.ends is not None else range(1, n + 1)
        out, starts, ends, at = [], [], [], 0
        for a, b, new in [*pieces, (n, n, "")]:
            out += [self.text[at:a], new]
            starts += s0[at:a]
            ends += e0[at:a]
            if new:
                starts += [s0[a]] * len(new)
                ends += [e0[b - 1]] * len(new)
            at = b
        return View("".join(out), starts, ends)

    def nfkc(self) -> View:
        if self.text.isascii() or unicodedata.is_normalized("NFKC", self.text):
            return self
        found = ((m.start(), m.end(), unicodedata.normalize("NFKC", m[0])) for m in _CLUSTER.finditer(self.text) if not m[0].isascii())
        return self._replaced([(a, b, new) for a, b, new in found if new != self.text[a:b]])

    def unescaped(self) -> View:
        """``\\uXXXX`` of a scalar value as its character."""
        if "\\u" not in self.text:
            return self
        return self._replaced([(m.start(), m.end(), chr(int(m[1], 16))) for m in _ESCAPE.finditer(self.text) if not 0xD800 <= int(m[1], 16) < 0xE000])

    def unquoted(self) -> View:
        """``%XX`` of an ASCII byte as its character, once."""
        return self._replaced([(m.start(), m.end(), chr(int(m[1], 16))) for m in _PERCENT.finditer(self.text)]) if "%" in self.text else self

    def one_line(self) -> View | None:
        """White space around newlines as one space; None without a newline."""
        if "\n" not in self.text:
            return None
        return self._replaced([(m.start(), m.end(), " ") for m in _NEWLINES.finditer(self.text)])

    def stripped(self) -> View:
        """Without combining marks."""
        if self.text.isascii():
            return self
        pieces = []
        for i, c in enumerate(self.text):
            new = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
            if new != c:
                pieces.append((i, i + 1, new))
        return self._replaced(pieces)


def normalized(text: str) -> View:
    return View(text).nfkc().unescaped().unquoted()


def strip_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def byte_offsets(text: str) -> list[int] | range:
    """UTF-8 offset of each character and of the end."""
    if text.isascii():
        return range(len(text) + 1)
    out, at = [0], 0
    for c in text:
        at += 1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4
        out.append(at)
    return out
