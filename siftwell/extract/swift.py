"""Swift sources."""

from __future__ import annotations

from ..functions.text import KEYWORDS, python_meaningful
from .base import DOUBLE, Depth, Rows, block_comments, compiled

_ATTRIBUTES = r"~(?:@[A-Za-z]+(?:\(INNER\))? )*"
_ACCESS = r"(?:(?:fileprivate|internal|open|private|public)(?:\(set\))? )?"
_MEMBER = r"(?:(?:class|convenience|final|lazy|mutating|nonmutating|override|required|static|unowned|weak) )*"
_IMPORT = compiled(r"~(?:@testable )?import (NAME)")
_FUNC = compiled(_ATTRIBUTES + _ACCESS + _MEMBER + r"func (NAME)")
_KIND = compiled(_ATTRIBUTES + _ACCESS + r"(?:final |indirect )?(class|struct|protocol|enum|actor) (?!func\b|var\b|let\b)(NAME)")
_EXTENSION = compiled(_ATTRIBUTES + _ACCESS + r"extension (NAME)")
_PROPERTY = compiled(_ATTRIBUTES + _ACCESS + _MEMBER + r"(let|var) (NAME)")
_BUILDER = compiled(r"@(IBAction|IBOutlet) (?:weak )?(?:func|var) (NAME)")
_WRAPPER = compiled(r"@(Binding|EnvironmentObject|Environment|ObservedObject|Published|StateObject|State)(?:\(INNER\))? (?:private )?var (NAME)")
_BASES = compiled(r":~([^{]+)")
_CALL = compiled(r"(NAME)~\(")
_NEW = compiled(r"(CAPITAL)~\(")


def extract(content: str, path: str) -> Rows:
    rows, blocks = Rows("swift", content), Depth()
    keyword = KEYWORDS["swift"] | frozenset("willSet didSet get set typeof".split())
    for at, line in enumerate(rows.lines, 1):
        text = line.strip()
        if not text:
            continue
        if text.startswith("//"):
            documented = text.startswith("///")
            comment = text.lstrip("/").strip()
            if len(comment) > 5:
                rows.comment(comment, at, context="Documentation comment" if documented else "Comment", related=["documentation"] if documented else [])
            continue
        blocks.see(line)
        owner = blocks.get("class") or blocks.get("protocol") or blocks.get("extension")
        member = lambda name, owner=owner: f"{owner}.{name}" if owner else name
        m = _IMPORT.match(line)
        if m:
            rows.define(m.group(1), "import", at, related=["import", "framework"])
        m = _FUNC.match(line)
        if m:
            rows.named(member(m.group(1)), "function", at)
        kind = _KIND.match(line)
        if kind:
            what, name = kind.groups()
            slot = what if what in ("protocol", "enum") else "class"
            blocks.enter(slot, name, line)
            rows.named(name, "interface" if what == "protocol" else "class", at, extra=[what] if what in ("struct", "enum") else [])
        extension = _EXTENSION.match(line)
        if extension:
            blocks.enter("extension", extension.group(1), line)
        if extension or kind and kind.group(1) in ("class", "actor"):
            bases = _BASES.search(line)
            for base in bases.group(1).split(",") if bases else ():
                if base.strip() and "<" not in base:
                    rows.refer(base.strip(), "implements" if extension else "extends", at)
        m = _PROPERTY.match(line)
        if m:
            rows.named(member(m.group(2)), "constant" if m.group(1) == "let" else "variable", at)
            if m.group(2) == "body" and blocks.get("class") and "some View" in line:
                rows.define(f"{blocks.get('class')} (SwiftUI View)", "class", at, context="SwiftUI View body", related=["swiftui", "view", "body"])
        inside = blocks.get("class") or "Global"
        m = _BUILDER.search(line)
        if m:
            rows.define(f"{inside}.{m.group(2)}", "function" if m.group(1) == "IBAction" else "variable", at, context=f"Interface Builder {m.group(1)}", related=["interface-builder", m.group(1).lower(), "ui"])
        m = _WRAPPER.search(line)
        if m:
            rows.define(f"{inside}.{m.group(2)}", "variable", at, context=f"SwiftUI @{m.group(1)}", related=["swiftui", m.group(1).lower(), "property-wrapper"])
        rows.calls(at, _CALL, skip=lambda x: x in keyword)
        rows.calls(at, _NEW, "instantiation", skip=lambda x: x in keyword)
        rows.strings(at, [DOUBLE], python_meaningful)
    block_comments(rows, content)
    return rows
