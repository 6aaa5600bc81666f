"""Rust sources."""

from __future__ import annotations

from ..functions.text import KEYWORDS
from .base import DOUBLE, Depth, Rows, compiled

_PUB = r"~(?:pub(?:\(INNER\))? )?"
_MOD = compiled(_PUB + r"mod (NAME)")
_USE = compiled(_PUB + r"use (REST?);")
_FN = compiled(_PUB + r'(?:const )?(?:async )?(?:unsafe )?(?:extern (?:"[^"]+" )?)?fn (NAME)')
_ITEM = compiled(_PUB + r"(struct|enum|trait) (NAME)")
_ALIAS = compiled(_PUB + r"type (NAME)~(?:<[^>]*>)?~=")
_IMPL = compiled(r"~impl(?:<[^>]+>)? (?:(NAME)(?:<[^>]*>)? for )?(NAME)")
_CONST = compiled(_PUB + r"(?:const|static) (?:mut )?(LOUD):")
_LET = compiled(r"~let (?:mut )?(NAME)")
_MACRO = compiled(_PUB + r"macro(?:_rules)?! (NAME)")
_CALL = compiled(r"(NAME(?:::NAME)*)~\(")
_BANG = compiled(r"(NAME)!(?!=)")
_PATH = compiled(r"(CAPITAL)~::")
_DERIVE = compiled(r"#\[derive\((INNER)\)\]")
_DOC = compiled(r"~///(?!/)\s?(.*)")
BUILT_IN_MACROS = frozenset("assert assert_eq assert_ne dbg debug_assert eprint eprintln format macro_rules panic print println todo unimplemented unreachable vec write writeln".split())


def extract(content: str, path: str) -> Rows:
    rows, blocks = Rows("rust", content), Depth()
    keyword = KEYWORDS["rust"]
    for at, line in enumerate(rows.lines, 1):
        text = line.strip()
        if not text:
            continue
        if text.startswith("//"):
            comment = text.lstrip("/").lstrip("!").strip()
            if len(comment) > 5 and not text.startswith("///"):
                rows.comment(comment, at)
            continue
        blocks.see(line)
        m = _MOD.match(line)
        if m:
            blocks.enter("mod", m.group(1), line)
            rows.define(m.group(1), "module", at)
        m = _USE.match(line)
        if m:
            name = m.group(1).split("::")[-1].translate({ord(c): None for c in "{}*"}).strip()
            if name not in ("", "self", "super"):
                rows.define(name, "import", at, related=[m.group(1)])
        m = _FN.match(line)
        if m:
            owner = blocks.get("impl")
            rows.named(f"{owner}::{m.group(1)}" if owner else m.group(1), "function", at)
            if owner and blocks.get("trait"):
                rows.refer(blocks.get("trait"), "implements", at)
        m = _ITEM.match(line)
        if m:
            if m.group(1) == "trait":
                blocks.enter("trait", m.group(2), line)
            rows.named(m.group(2), "interface" if m.group(1) == "trait" else "class", at)
        m = _ALIAS.match(line)
        if m and not blocks.get("impl"):
            rows.named(m.group(1), "class", at)
        m = _IMPL.match(line)
        if m:
            blocks.enter("impl", m.group(2), line)
            if m.group(1):
                blocks.enter("trait", m.group(1), line)
                rows.refer(m.group(1), "implements", at)
        for pattern, kind in ((_CONST, "constant"), (_LET, "variable")):
            m = pattern.match(line)
            if m:
                rows.named(m.group(1), kind, at)
        m = _MACRO.match(line)
        if m:
            rows.define(m.group(1) + "!", "function", at, related=["macro"], surrounding=rows.around(at))
        rows.calls(at, _CALL, skip=lambda x: x in keyword)
        for m in _BANG.finditer(line):
            if m.group(1) not in BUILT_IN_MACROS:
                rows.refer(m.group(1) + "!", "call", at, m.start())
        rows.calls(at, _PATH, "instantiation")
        rows.strings(at, [DOUBLE])
        m = _DERIVE.search(line)
        for trait in m.group(1).split(",") if m else ():
            if trait.strip():
                rows.refer(trait.strip(), "implements", at)
    _documentation(rows)
    return rows


def _documentation(rows: Rows) -> None:
    """Runs of /// lines, also one that ends the file."""
    body: list[str] = []
    for at, line in enumerate([*rows.lines, ""], 1):
        m = _DOC.match(line)
        if m:
            body.append(m.group(1))
            continue
        text = "\n".join(body).strip()
        if len(text) > 5:
            rows.block_comment(text, at - len(body), "Doc comment", [x.strip() for x in body])
        body = []
