"""The match language of full-text search: from a string to a tree.

Words side by side must all be there; OR, AND, NOT (in capitals) and brackets join them
otherwise, NOT before AND before OR. ``"a b"`` is a phrase, ``w*`` a prefix, ``field: x``
restricts to a field and ``NEAR(a b, n)`` asks for at most n terms in between. What is no
sentence of this language is one phrase.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

FIELDS = ("transcript", "ocr", "ideas_text", "title", "description")
_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([^\s"()*:,{}^+\-.?!@#$%&=<>;/\\|~`\'\[\]]+)|(.))', re.S)


@dataclass(frozen=True)
class Phrase:
    """Text whose terms stand in a row; ``prefix`` lets the last one go on."""

    text: str
    prefix: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Near:
    parts: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Op:
    """AND, OR or NOT of two trees."""

    name: str
    left: object
    right: object


class _Parser:
    def __init__(self, text: str):
        self.lexed: list[tuple[str, str]] = []
        at = 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            kind = "quoted" if m[1] else "word" if m[2] else "mark"
            self.lexed.append((kind, m[1] or m[2] or m[3]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.lexed[self.at] if self.at < len(self.lexed) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if got[0] == "end" or (value is not None and got != ("mark", value)):
            raise ValueError("syntax error")
        self.at += 1
        return got

    def either(self):
        out = self.both()
        while self.peek() == ("word", "OR"):
            self.at += 1
            out = Op("OR", out, self.both())
        return out

    def both(self):
        out = self.without()
        while self.peek() == ("word", "AND"):
            self.at += 1
            out = Op("AND", out, self.without())
        return out

    def without(self):
        out = self.one()
        while self.peek() == ("word", "NOT"):
            self.at += 1
            out = Op("NOT", out, self.one())
        return out

    def one(self):
        """A bracket, or phrases side by side, which are joined before any operator counts."""
        if self.peek() == ("mark", "("):
            self.at += 1
            out = self.either()
            self.take(")")
            return out
        out = self.leaf()
        while self.peek()[0] == "quoted" or (self.peek()[0] == "word" and self.peek()[1] not in ("AND", "OR", "NOT")):
            out = Op("AND", out, self.leaf())
        return out

    def leaf(self):
        kind, value = self.peek()
        after = self.lexed[self.at + 1 : self.at + 2]
        if kind == "word" and value == "NEAR" and after == [("mark", "(")]:
            return self.near()
        if kind == "word" and value in FIELDS and after == [("mark", ":")]:
            self.at += 2
            p = self.phrase()
            return Phrase(p.text, p.prefix, value)
        return self.phrase()

    def near(self) -> Near:
        self.at += 2
        parts, distance = [], 10
        while self.peek()[0] in ("word", "quoted"):
            parts.append(self.phrase())
        if self.peek() == ("mark", ","):
            self.at += 1
            distance = int(self.take()[1])
        self.take(")")
        return Near(tuple(parts), distance)

    def phrase(self) -> Phrase:
        kind, value = self.take()
        if kind == "mark" or (kind == "word" and value in ("AND", "OR", "NOT")):
            raise ValueError("syntax error")
        text = value[1:-1].replace('""', '"') if kind == "quoted" else value
        if self.peek() == ("mark", "*"):
            self.at += 1
            return Phrase(text, True)
        return Phrase(text)


def parse(query: str):
    """The tree of a query of at most 500 characters; None if it is blank."""
    text = query.strip().replace("\0", "")[:500]
    if not text:
        return None
    try:
        parser = _Parser(text)
        out = parser.either()
        if parser.peek()[0] != "end":
            raise ValueError("syntax error")
        return out
    except (ValueError, IndexError):
        return Phrase(text)
