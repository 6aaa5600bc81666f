"""TypeScript and JavaScript, from tokens rather than a syntax tree."""

from __future__ import annotations

import re
from typing import NamedTuple

from ..functions.text import python_identifiers, python_meaningful
from .base import Rows, compiled

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)
    |(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
    |(?P<template>`)
    |(?P<number>\d[\w.]*)
    |(?P<name>[A-Za-z_$\#@][\w$]*)
    |(?P<punct>=>|\?\.|\.\.\.|[{}()\[\];,.=:<>?!+\-*/%&|^~])
    |(?P<other>\S)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_VALUE = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => return typeof case in of delete void throw new else do await yield".split())
_CONTROL = frozenset("if for while switch catch return typeof function super import await new throw delete void case in of do else with yield async get set static".split())
_MODIFIERS = frozenset("public private protected static async get set readonly abstract override declare * accessor".split())


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    column: int


class Unreadable(Exception):
    pass


def tokenize(source: str) -> list[Token]:
    out: list[Token] = []
    at, line, start = 0, 1, 0
    previous = ""
    while at < len(source):
        c = source[at]
        if c == "\n":
            line, start = line + 1, at + 1
        if c.isspace():
            at += 1
            continue
        regex = _REGEX.match(source, at) if c == "/" and (not previous or previous in _BEFORE_VALUE) else None
        m = regex or _TOKEN.match(source, at)
        kind, text = ("regex", m.group()) if regex else (m.lastgroup, m.group())
        if kind == "template":
            text = _template(source, at)
        out.append(Token(kind, text, line, at - start))
        if kind != "comment":
            previous = text
        breaks = text.count("\n")
        if breaks:
            line, start = line + breaks, at + text.rfind("\n") + 1
        at += len(text)
    return out


def _template(source: str, at: int) -> str:
    """A template literal with what it holds, nested ones too."""
    k, depth = at + 1, 0
    while k < len(source):
        c = source[k]
        if c == "\\":
            k += 2
            continue
        if depth == 0 and c == "`":
            return source[at : k + 1]
        if c == "$" and depth == 0 and source[k : k + 2] == "${":
            depth, k = 1, k + 2
            continue
        if depth:
            if c == "`":
                k += len(_template(source, k))
                continue
            depth += (c == "{") - (c == "}")
        k += 1
    raise Unreadable("template without an end")


class Walker:
    def __init__(self, rows: Rows, tokens: list[Token]) -> None:
        self.rows = rows
        self.comments = [t for t in tokens if t.kind == "comment"]
        self.tokens = [t for t in tokens if t.kind != "comment"]
        self.stack: list[tuple[str, str]] = []
        self.closing = self._pairs()

    def _pairs(self) -> dict[int, int]:
        out, stack = {}, []
        for k, t in enumerate(self.tokens):
            if t.kind == "punct" and t.text in "({[":
                stack.append(k)
            elif t.kind == "punct" and t.text in ")}]":
                if not stack or {"(": ")", "{": "}", "[": "]"}[self.tokens[stack[-1]].text] != t.text:
                    raise Unreadable("brackets")
                out[stack.pop()] = k
        if stack:
            raise Unreadable("brackets")
        return out

    def text(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def named(self, k: int, term: str, kind: str, token: Token | None = None) -> None:
        t = token or self.tokens[k]
        line = self.rows.lines[t.line - 1]
        self.rows.define(term, kind, t.line, t.column, related=python_identifiers(line, "typescript"), surrounding=self.rows.lines[max(0, t.line - 2) : t.line + 2])

    def walk(self) -> None:
        bodies: dict[int, tuple[str, str]] = {}
        k = 0
        while k < len(self.tokens):
            t = self.tokens[k]
            if t.text in ("{", "(", "["):
                self.stack.append(bodies.pop(k, ("block", "")) if t.text == "{" else (t.text, ""))
            elif t.text in ("}", ")", "]") and t.kind == "punct":
                self.stack.pop()
            elif t.kind == "string":
                self._string(t.text[1:-1], t)
            elif t.kind == "template":
                self._string(re.sub(r"\$\{.*?\}", "${...}", t.text[1:-1], flags=re.S), t)
                self._inner(t)
            elif t.kind == "name" and self.text(k - 1) not in (".", "?."):
                k = self._name(k, t, bodies)
                continue
            elif t.kind == "name" and self._called(k):
                self._call(k, t)
            k += 1
        for t in self.comments:
            text = t.text[2:-2] if t.text.startswith("/*") else t.text[2:]
            text = "\n".join(x.strip().lstrip("*").strip() for x in text.split("\n")).strip()
            if len(text) > 5:
                self.rows.comment(text, t.line, t.column)

    def _string(self, value: str, t: Token) -> None:
        if len(value) > 3 and python_meaningful(value):
            self.rows.define(value, "string", t.line, t.column, surrounding=self.rows.lines[max(0, t.line - 2) : t.line + 2])

    def _inner(self, t: Token) -> None:
        """Calls within a template's expressions."""
        for m in re.finditer(r"\$\{([^{}]*)\}", t.text):
            for call in re.finditer(r"(?<![.\w$])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)?)\(", m.group(1)):
                self.rows.refer(call.group(1), "call", t.line + t.text.count("\n", 0, m.start()))

    def _called(self, k: int) -> bool:
        """Whether the name is followed by an argument list, perhaps after type
        arguments."""
        j = k + 1
        if self.text(j) == "?." and self.text(j + 1) == "(":
            return True
        if self.text(j) == "<":
            depth = 0
            while j < len(self.tokens) and j < k + 40:
                x = self.text(j)
                depth += (x == "<") - (x == ">")
                if x in (";", "{", "&", "|", "=>") and x != "{":
                    return False
                j += 1
                if depth == 0:
                    break
        return self.text(j) == "("

    def _declares_body(self, k: int) -> int:
        """For a name with a parameter list and a body: the body's position."""
        j = k + 1
        if self.text(j) == "<":
            while j < len(self.tokens) and self.text(j) != "(" and j < k + 40:
                j += 1
        if self.text(j) != "(":
            return 0
        j = self.closing[j] + 1
        if self.text(j) == ":":
            while j < len(self.tokens) and self.text(j) not in ("{", ";", ",", "=>"):
                j = self.closing.get(j, j) + 1
        return j if self.text(j) == "{" else 0

    def _call(self, k: int, t: Token) -> None:
        receiver = self.text(k - 2)
        simple = self.tokens[k - 2].kind == "name" and self.text(k - 3) not in (".", "?.") if k > 1 else False
        self.rows.refer(f"{receiver}.{t.text}" if simple else t.text, "call", t.line, self.tokens[k - 2].column if simple else t.column)

    def _name(self, k: int, t: Token, bodies: dict[int, tuple[str, str]]) -> int:
        word = t.text
        place = self.stack[-1] if self.stack else ("block", "")
        if word == "function":
            j = k + 1 + (self.text(k + 1) == "*")
            if self.tokens[j].kind == "name" if j < len(self.tokens) else False:
                self.named(j, self.text(j), "function", t)
                return j + 1
            return k + 1
        if word == "class" and self.text(k - 1) != ".":
            return self._class(k, t, bodies)
        if word in ("interface", "type", "enum") and self.tokens[k + 1 : k + 2] and self.tokens[k + 1].kind == "name" and self.text(k + 2) in ("{", "<", "=", "extends"):
            self.named(k, self.text(k + 1), "class", t)
            j = k + 2
            if word == "interface":
                while self.text(j) not in ("{", ""):
                    j += 1
                if self.text(j) == "{":
                    bodies[j] = ("type", self.text(k + 1))
            return k + 2
        if word == "import":
            return self._import(k, t)
        if word == "export" and self.text(k + 1) == "{":
            end = self.closing[k + 1]
            for j in range(k + 2, end):
                if self.tokens[j].kind == "name" and self.text(j) not in ("as", "type") and self.text(j + 1) in (",", "}"):
                    self.named(j, self.text(j), "variable")
            return end + 1
        if word in ("const", "let", "var") and self.tokens[k + 1 : k + 2] and self.tokens[k + 1].kind == "name":
            return self._variable(k + 1)
        if word == "new" and self.tokens[k + 1 : k + 2] and self.tokens[k + 1].kind == "name":
            j, parts = k + 1, [self.text(k + 1)]
            while self.text(j + 1) == "." and self.tokens[j + 2].kind == "name":
                j += 2
                parts.append(self.text(j))
            self.rows.refer(parts[-1] if len(parts) == 1 else ".".join(parts), "instantiation", t.line, t.column)
            return j + 1
        if place[0] == "class" and self.text(k - 1) in ("{", "}", ";", *_MODIFIERS) or place[0] == "class" and self.tokens[k - 1].line < t.line:
            body = 0 if word in _MODIFIERS else self._declares_body(k)
            if body:
                self.named(k, f"{place[1]}.{word}", "function")
                return k + 1
        elif place[0] == "block" and self.text(k - 1) in ("{", ",", "async", "*", "get", "set") and word not in _CONTROL and self._declares_body(k):
            self.named(k, word, "function")
            return k + 1
        if self._called(k) and word not in _CONTROL and place[0] != "type":
            self.rows.refer(word, "call", t.line, t.column)
        elif word == "super" and self._called(k):
            self.rows.refer(word, "call", t.line, t.column)
        return k + 1

    def _class(self, k: int, t: Token, bodies: dict[int, tuple[str, str]]) -> int:
        name = self.text(k + 1) if self.tokens[k + 1 : k + 2] and self.tokens[k + 1].kind == "name" and self.text(k + 1) not in ("extends", "implements") else ""
        j = k + 1
        while j < len(self.tokens) and self.text(j) != "{":
            if self.text(j) == "extends":
                self.rows.refer(self.text(j + 1), "extends", t.line, t.column)
            elif self.text(j) == "implements":
                for i in range(j + 1, len(self.tokens)):
                    if self.text(i) == "{":
                        break
                    if self.tokens[i].kind == "name" and self.text(i - 1) in ("implements", ","):
                        self.rows.refer(self.text(i), "implements", t.line, t.column)
            j += 1
        if j < len(self.tokens):
            bodies[j] = ("class", name)
        if name:
            self.named(k, name, "class", t)
        return j if j > k + 1 else k + 1

    def _import(self, k: int, t: Token) -> int:
        if self.text(k + 1) in ("(", "."):
            if self.text(k + 1) == "(":
                self.rows.refer("import", "call", t.line, t.column)
            return k + 1
        j, names = k + 1, []
        while j < len(self.tokens) and self.text(j) not in ("from", ";") and self.tokens[j].kind != "string":
            if self.tokens[j].kind == "name" and self.text(j) not in ("as", "type") and self.text(j + 1) != "as":
                names.append(j)
            j += 1
        source = next((self.tokens[i].text[1:-1] for i in (j, j + 1) if i < len(self.tokens) and self.tokens[i].kind == "string"), "")
        for i in names:
            self.rows.define(self.text(i), "import", self.tokens[i].line, self.tokens[i].column, related=[source] if source else [])
        return j + 1 if self.text(j) == "from" else j

    def _variable(self, k: int) -> int:
        t, j = self.tokens[k], k + 1
        if self.text(j) == ":":
            while j < len(self.tokens) and self.text(j) not in ("=", ";", ","):
                j = self.closing.get(j, j) + 1
        if self.text(j) != "=":
            return k + 1
        self.named(k, t.text, "function" if self._is_function(j + 1) else "variable")
        return j + 1

    def _is_function(self, j: int) -> bool:
        if self.text(j) == "async":
            j += 1
        if self.text(j) == "function":
            return True
        if self.text(j) == "<":
            while self.text(j) not in ("(", ""):
                j += 1
        if self.text(j) == "(":
            j = self.closing[j] + 1
            if self.text(j) == ":":
                while j < len(self.tokens) and self.text(j) not in ("=>", ";", "="):
                    j = self.closing.get(j, j) + 1
            return self.text(j) == "=>"
        return j < len(self.tokens) and self.tokens[j].kind == "name" and self.text(j + 1) == "=>"


def extract(content: str, path: str) -> Rows:
    rows = Rows("typescript", content)
    try:
        Walker(rows, tokenize(content)).walk()
        return rows
    except (Unreadable, IndexError, KeyError):
        return by_lines(content)


_BY_LINE = [
    compiled(r"(?:export )?(?:default )?(?:async )?function~\*?~(NAME)"),
    compiled(r"(?:const|let|var) (NAME)~=~(?:async~)?(?:\((?:INNER)?\)|NAME)~=>"),
    compiled(r"^~(?:async )?(NAME)~\((?:INNER)?\)~\{"),
]
_CLASS_LINE = compiled(r"class (NAME)")
_QUOTED = compiled(r"""["'`]([^"'`]{4,})["'`]""")
_COMMENT_LINE = compiled(r"//~(REST)|/\*~(REST?)~\*/")


def by_lines(content: str) -> Rows:
    """What single lines show, for sources that don't parse."""
    rows = Rows("typescript", content)
    for at, line in enumerate(rows.lines, 1):
        for pattern in _BY_LINE:
            m = pattern.search(line)
            if m and m.group(1) not in _CONTROL:
                rows.define(m.group(1), "function", at)
                break
        m = _CLASS_LINE.search(line)
        if m:
            rows.define(m.group(1), "class", at)
        rows.strings(at, [_QUOTED])
        for row in rows.definitions:
            if row["line"] == at and row["type"] == "string":
                row["column"] = 0
        m = _COMMENT_LINE.search(line)
        text = (m.group(1) or m.group(2)).strip() if m else ""
        if len(text) > 5:
            rows.comment(text, at)
    return rows
