"""Python sources."""

from __future__ import annotations

import re

from ..functions.text import KEYWORDS
from .base import DOUBLE, SINGLE, Rows, compiled

_DEF = compiled(r"(~)(?:async )?def (NAME)~\(")
_CLASS = compiled(r"(~)class (NAME)~(?:\((INNER)?\))?:")
_ASSIGN = compiled(r"(~)(NAME)~(?::~[^=]+)?~=~(?!=)(REST)")
_IMPORT = compiled(r"~(?:from ([\w.]+) )?import (REST)")
_DECORATOR = compiled(r"~@(NAME)")
_CALL = compiled(r"(NAME(?:\.NAME)*)~\(")
_NEW = compiled(r"(CAPITAL)~\(")
_STRINGS = [compiled(r'"""([^"]+)"""'), compiled(r"'''([^']+)'''"), DOUBLE, SINGLE]
_QUOTES = compiled(r"""~(\"\"\"|''')""")


def extract(content: str, path: str) -> Rows:
    rows = Rows("python", content)
    keyword = KEYWORDS["python"]
    owner, level = None, -1
    for at, line in enumerate(rows.lines, 1):
        text = line.strip()
        if not text:
            continue
        if text.startswith("#"):
            comment = text[1:].strip()
            if len(comment) > 5:
                rows.comment(comment, at)
            continue
        indent = len(line) - len(line.lstrip())
        if owner and indent <= level:
            owner, level = None, -1
        function, klass = _DEF.match(line), _CLASS.match(line)
        if function:
            name = function.group(2)
            rows.named(f"{owner}.{name}" if owner else name, "function", at, indent)
            if owner and name[:2] == name[-2:] == "__":
                rows.refer(name, "implements", at, indent)
        if klass:
            owner, level = klass.group(2), indent
            rows.named(owner, "class", at, indent)
            for base in (klass.group(3) or "").split(","):
                base = base.split("[")[0].strip()
                if base and base != "object":
                    rows.refer(base, "extends", at, indent)
        assigned = None if function or klass else _ASSIGN.match(line)
        if assigned and (indent == 0 or owner and indent == level + 4):
            name = assigned.group(2)
            rows.named(f"{owner}.{name}" if owner else name, "constant" if name == name.upper() and "_" in name else "variable", at, indent)
        imported = _IMPORT.match(line)
        if imported:
            for part in imported.group(2).strip("() ").split(","):
                name = re.split(r"\s+as\s+", part.strip())[-1]
                if name and "*" not in name:
                    rows.define(name, "import", at, related=[imported.group(1)] if imported.group(1) else [])
        decorated = _DECORATOR.match(line)
        if decorated:
            rows.refer(decorated.group(1), "call", at)
        rows.calls(at, _CALL, skip=lambda x: x.split(".")[0] in keyword)
        rows.calls(at, _NEW, "instantiation")
        rows.strings(at, _STRINGS)
    _docstrings(rows)
    return rows


def _docstrings(rows: Rows) -> None:
    """Strings that open a module, class or function."""
    start, quote, body = 0, "", []
    for at, line in enumerate(rows.lines, 1):
        if not quote:
            m = _QUOTES.match(line)
            before = rows.lines[at - 2].strip() if at > 1 else "def :"
            if not m or not (before.endswith(":") and ("def " in before or "class " in before)):
                continue
            head, _, rest = line[m.end() :].partition(m.group(1))
            if m.group(1) in line[m.end() :]:
                if len(head.strip()) > 5:
                    rows.block_comment(head.strip(), at, "Docstring")
                continue
            start, quote, body = at, m.group(1), [head]
        elif quote in line:
            body.append(line.partition(quote)[0])
            text = "\n".join(body).strip()
            if len(text) > 5:
                rows.block_comment(text, start, "Docstring", [x.strip() for x in rows.lines[start - 1 : at]])
            quote = ""
        else:
            body.append(line)
