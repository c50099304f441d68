"""The query language: words, "phrases"~n, field:x, AND OR NOT + -, ( ), * ?, ~ fuzzy, [a TO b], ^boost.

Words without an operator between them must all occur (or any, on request), and
are one clause: all in the same field. A text that breaks the grammar is read as
plain words, so no query is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Node:
    """kind: words, phrase, wildcard, fuzzy, range, exists, and, or, not, all."""

    kind: str
    field: str | None = None
    text: str = ""
    slop: int = 0
    boost: float = 1.0
    low: str | None = None
    high: str | None = None
    closed: tuple[bool, bool] = (True, True)
    parts: tuple[Node, ...] = ()


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<open>\()|(?P<close>\))|
      (?P<and>AND\b|&&)|(?P<or>OR\b|\|\|)|(?P<not>NOT\b|!)|
      (?P<sign>[+\-](?=\S))|
      (?P<field>[\w.]+(?:\\.[\w.]+)*):(?=\S)|
      (?P<range>[\[{][^\]}]*\sTO\s[^\]}]*[\]}])|
      "(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))?|
      (?P<word>(?:\\.|[^\s()"^~])+)(?P<fuzzy>~(?P<edits>\d(?:\.\d+)?)?)?
    )(?:\^(?P<boost>\d+(?:\.\d+)?))?""",
    re.X,
)


class _Parser:
    def __init__(self, text: str, default: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(text[at:])
            self.tokens.append(m)
            at = m.end()
        self.i, self.default = 0, default

    def peek(self) -> str | None:
        return next((k for k in ("open", "close", "and", "or", "not", "sign", "field", "range", "phrase", "word") if self.tokens[self.i][k] is not None), None) if self.i < len(self.tokens) else None

    def take(self) -> re.Match:
        self.i += 1
        return self.tokens[self.i - 1]

    def alternatives(self, field: str | None) -> Node:
        parts = [self.conjunction(field)]
        while self.peek() == "or":
            self.take()
            parts.append(self.conjunction(field))
        return parts[0] if len(parts) == 1 else Node("or", parts=tuple(parts))

    def conjunction(self, field: str | None) -> Node:
        parts: list[Node] = []
        joined = True
        while (k := self.peek()) not in (None, "close", "or"):
            if k == "and":
                self.take()
                joined = True
                continue
            node = self.unary(field)
            last = parts[-1] if parts else None
            if last and not joined and last.kind == node.kind == "words" and (last.field, last.boost) == (node.field, node.boost):
                parts[-1] = Node("words", last.field, f"{last.text} {node.text}", boost=last.boost)
            else:
                parts.append(node)
            joined = False
        if not parts:
            raise ValueError("nothing to search for")
        if len(parts) == 1:
            return parts[0]
        return Node(self.default if not any(p.kind == "not" for p in parts) and not self._signed else "and", parts=tuple(parts))

    _signed = False

    def unary(self, field: str | None) -> Node:
        k = self.peek()
        if k == "not":
            self.take()
            return Node("not", parts=(self.unary(field),))
        if k == "sign":
            sign = self.take()["sign"]
            node = self.unary(field)
            self._signed = True
            return Node("not", parts=(node,)) if sign == "-" else Node("and", parts=(node,))
        if k == "field":
            return self.unary(self.take()["field"])
        m = self.take()
        boost = float(m["boost"] or 1)
        if k == "open":
            node = self.alternatives(field)
            if self.peek() != "close":
                raise ValueError("not closed")
            boost = float(self.take()["boost"] or 1)
            return node if boost == 1 else Node("and", boost=boost, parts=(node,))
        if k == "range":
            low, high = re.split(r"\s+TO\s+", m["range"][1:-1].strip())
            closed = (m["range"][0] == "[", m["range"][-1] == "]")
            open_ = lambda v: None if v == "*" else v.strip('"')
            return Node("range", field, low=open_(low), high=open_(high), closed=closed, boost=boost)
        if k == "phrase":
            return Node("phrase", field, m["phrase"], int(m["slop"] or 0), boost)
        word = m["word"]
        if m["fuzzy"]:
            return Node("fuzzy", field, _plain(word), int(float(m["edits"])) if m["edits"] else -1, boost)
        bare = re.sub(r"\\.", "", word)
        if bare == "*":
            return Node("exists", field, boost=boost) if field else Node("all", boost=boost)
        if ("*" in bare or "?" in bare) and bare[0] not in "*?":
            return Node("wildcard", field, word, boost=boost)
        return Node("words", field, _plain(word), boost=boost)


def _plain(word: str) -> str:
    return re.sub(r"\\(.)", r"\1", word)


def parse(text: str, default: str = "and") -> Node:
    """The tree of a query text; without text the node that matches all."""
    if not text or not text.strip():
        return Node("all")
    try:
        p = _Parser(text, default)
        node = p.alternatives(None)
        if p.peek() is not None:
            raise ValueError("not opened")
        return node
    except (ValueError, IndexError):
        words = " ".join(re.findall(r"\w+", text))
        return Node("words", None, words) if words else Node("all")
