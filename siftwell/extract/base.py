"""What every extractor shares: the rows it emits and the text around them."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from ..functions.text import python_identifiers, python_marker, python_markers, python_meaningful


class Rows:
    """Collects the definitions and references of one file, in order."""

    def __init__(self, language: str, content: str) -> None:
        self.language = language
        self.lines = content.split("\n")
        self.definitions: list[dict] = []
        self.references: list[dict] = []

    def around(self, line: int, before: int = 2, after: int = 2) -> list[str]:
        """Trimmed lines around a 1-based line."""
        return [x.strip() for x in self.lines[max(0, line - 1 - before) : line + after]]

    def define(self, term: str, kind: str, line: int, column: int = 0, context: str | None = None, related: Iterable[str] = (), surrounding: list[str] | None = None, first: bool = False, **meta) -> None:
        here = self.lines[line - 1].strip() if 0 < line <= len(self.lines) else ""
        row = {
            "term": term, "type": kind, "line": line, "column": column, "context": here if context is None else context,
            "surrounding_lines": [here] if surrounding is None else surrounding, "related_terms": list(related), "language": self.language,
            "metadata": json.dumps(meta) if meta else None,
        }
        self.definitions.insert(0, row) if first else self.definitions.append(row)

    def refer(self, target: str, kind: str, line: int, column: int = 0, context: str | None = None, **meta) -> None:
        here = self.lines[line - 1].strip() if 0 < line <= len(self.lines) else ""
        self.references.append({"target_term": target, "reference_type": kind, "line": line, "column": column, "context": here if context is None else context, "metadata": json.dumps(meta) if meta else None})

    def named(self, term: str, kind: str, line: int, column: int = 0, extra: Iterable[str] = (), language: str | None = None) -> None:
        """A definition related to the identifiers on its line."""
        text = self.lines[line - 1]
        self.define(term, kind, line, column, related=[*extra, *python_identifiers(text, language or self.language)], surrounding=self.around(line))

    def comment(self, text: str, line: int, column: int = 0, context: str | None = None, related: Iterable[str] = (), surrounding: list[str] | None = None) -> None:
        """A line comment; a marker it starts with is noted."""
        found = python_marker(text)
        meta = {"isDevelopmentMarker": True, "markerType": found} if found else {}
        self.define(text, "comment", line, column, context, related, surrounding, **meta)

    def block_comment(self, text: str, line: int, context: str, surrounding: list[str] | None = None) -> None:
        """A longer comment; all markers in it are noted."""
        found = python_markers(text)
        meta = {"isDevelopmentMarker": True, "markerTypes": found} if found else {}
        self.define(text, "comment", line, 0, context, (), surrounding, **meta)

    def strings(self, line: int, patterns: Iterable[re.Pattern], wanted=python_meaningful) -> None:
        """Quoted strings on a line that are worth indexing."""
        text = self.lines[line - 1]
        for pattern in patterns:
            for m in pattern.finditer(text):
                value = next(g for g in m.groups() if g is not None)
                if wanted(value):
                    self.define(value, "string", line, m.start())

    def calls(self, line: int, pattern: re.Pattern, kind: str = "call", skip=lambda name: False) -> None:
        for m in pattern.finditer(self.lines[line - 1]):
            if not skip(m.group(1)):
                self.refer(m.group(1), kind, line, m.start())


DOUBLE = re.compile(r'"([^"]{4,})"')
SINGLE = re.compile(r"'([^']{4,})'")
BLOCK_COMMENT = re.compile(r"/\*(.*?)\*/", re.S)
#: What the words of a pattern stand for.
_WORDS = {"NAME": r"[A-Za-z_]\w*", "CAPITAL": r"[A-Z]\w*", "LOUD": r"[A-Z_][A-Z0-9_]*", "INNER": r"[^)]+", "REST": r".+", "UNQUOTED": r"""[^"']+""", "QUOTE": r"""["']""", " ": r"\s+", "~": r"\s*"}


def compiled(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern with ASCII classes in which a blank is some white space, ~ is
    perhaps white space, and words in capitals are as above."""
    for word, text in _WORDS.items():
        pattern = pattern.replace(word, text)
    return re.compile(pattern, flags | re.ASCII)


def line_at(content: str, offset: int) -> int:
    return content.count("\n", 0, offset) + 1


def column_at(content: str, offset: int) -> int:
    return offset - content.rfind("\n", 0, offset) - 1


def block_comments(rows: Rows, content: str) -> None:
    for m in BLOCK_COMMENT.finditer(content):
        text = m.group(1).strip()
        if len(text) > 5:
            rows.block_comment(text, line_at(content, m.start()), "Multi-line comment", [x.strip() for x in m.group().split("\n")])


class Depth:
    """Brace depth, and the names whose blocks are open."""

    def __init__(self) -> None:
        self.depth = 0
        self.open: dict[str, tuple[str, int]] = {}

    def enter(self, slot: str, name: str, line: str) -> None:
        """The block that starts on this line; one that also ends on it is not
        entered."""
        opens = line.count("{") > line.count("}")
        if opens or "{" not in line:
            self.open[slot] = (name, self.depth - line.count("{") + line.count("}") if opens else self.depth)

    def see(self, line: str) -> None:
        """Counts a line's braces and leaves the blocks it closes."""
        self.depth += line.count("{") - line.count("}")
        for slot, (_, at) in list(self.open.items()):
            if self.depth <= at and "}" in line:
                del self.open[slot]

    def get(self, slot: str) -> str | None:
        return self.open[slot][0] if slot in self.open else None
