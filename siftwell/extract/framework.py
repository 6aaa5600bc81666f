"""Single-file components: Svelte, Vue, Astro and MDX."""

from __future__ import annotations

import re
from typing import NamedTuple

from . import typescript
from .base import Rows, column_at, compiled, line_at


class Section(NamedTuple):
    kind: str
    content: str
    line: int


_SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script>", re.S)
_STYLE = re.compile(r"<style\b[^>]*>(.*?)</style>", re.S)
_TEMPLATE = re.compile(r"<template\b[^>]*>(.*)</template>", re.S)
_EXPORTED = compiled(r"export (?:class|const|function|let) (\w+)")
_FRONT = re.compile(r"\A---\n(.*?)\n---", re.S)


def sections(content: str, kind: str) -> list[Section]:
    """Scripts, template and styles, each with its first line in the file."""
    found = lambda what, pattern: [Section(what, m.group(1), line_at(content, m.start(1))) for m in pattern.finditer(content)]
    if kind == "vue":
        return found("script", _SCRIPT) + found("template", _TEMPLATE) + found("style", _STYLE)
    if kind == "svelte":
        blank = lambda m: re.sub(r"[^\n]", " ", m.group())
        rest = _STYLE.sub(blank, _SCRIPT.sub(blank, content))
        return found("script", _SCRIPT) + ([Section("template", rest, 1)] if rest.strip() else []) + found("style", _STYLE)
    if kind == "astro":
        front = _FRONT.match(content)
        end = front.end() if front else 0
        out = [Section("script", front.group(1), 2)] if front else []
        rest = content[end:]
        return out + ([Section("template", rest, line_at(content, end))] if rest.strip() else []) + found("style", _STYLE)
    imports = [(line_at(content, m.start()), m.group()) for m in re.finditer(r"^import\s.+$", content, re.M)]
    return [Section("script", text, at) for at, text in imports] + [Section("markdown", content, 1)]


class Feature(NamedTuple):
    """A pattern that means something to a framework: what it defines (kind,
    related terms) or refers to (reference kind), under which name."""

    pattern: str
    term: str
    kind: str
    feature: str
    related: str = ""
    refers: bool = False


_SCRIPTS = {
    "svelte": [
        Feature(r"(\$(?:bindable|derived|effect|host|inspect|props|state))\b", "{}", "function", "svelte-rune", "rune svelte5 reactive"),
        Feature(r"\b(afterUpdate|beforeUpdate|onDestroy|onMount|tick)~\(", "{}", "svelte-lifecycle", "svelte-lifecycle", refers=True),
        Feature(r"\b(getAllContexts|getContext|hasContext|setContext)~\(", "{}", "svelte-context", "svelte-context-api", refers=True),
        Feature(r"from QUOTEsvelte(?:/(\w+))?QUOTE", "svelte/{}", "import", "svelte-import", "svelte import"),
        Feature(r"\$(?!(?:bindable|derived|effect|host|inspect|props|state)\b)(NAME)", "{}", "store-subscription", "svelte-store", refers=True),
        Feature(r"^~(\$:)", "$: reactive", "variable", "svelte-reactive-statement", "reactive svelte"),
    ],
    "vue": [
        Feature(r"\b(computed|inject|onMounted|onUnmounted|provide|reactive|ref|watch|watchEffect)~\(", "{}", "vue-composition-api", "vue-composition-api", refers=True),
        Feature(r"\b(defineEmits|defineExpose|defineProps|defineSlots)~(?:<[^>]*>)?~\(", "{}", "function", "vue-compiler-macro", "vue3 setup composition"),
    ],
    "astro": [
        Feature(r"Astro\.(cookies|glob|params|props|redirect|request|response|slots)", "Astro.{}", "astro-global", "astro-global", refers=True),
        Feature(r"interface (Props)~\{", "{}", "interface", "astro-props-interface", "astro component props"),
    ],
}
_TEMPLATES = {
    "svelte": [
        Feature(r"\{(?![#@/:{])([^{}]+)\}", "{}", "variable", "svelte-interpolation", "svelte interpolation"),
        Feature(r"\bbind:(\w+)", "{}", "variable", "svelte-bind", "svelte bind"),
        Feature(r"\bon:(\w+)", "{}", "variable", "svelte-event", "svelte event"),
        Feature(r"\buse:(\w+)", "{}", "variable", "svelte-action", "svelte action"),
        Feature(r"\{[:/@#](\w+)(?: [^}]+)?\}", "{{#{}}}", "function", "svelte-directive", "svelte template directive"),
    ],
    "vue": [
        Feature(r"\{\{([^}]+)\}\}", "{}", "variable", "vue-interpolation", "vue interpolation"),
        Feature(r"""v-model(?:[.:][\w.]+)?="([^"]+)\"""", "{}", "variable", "vue-v-model", "vue v-model"),
        Feature(r"(?<=[\s])@(\w[\w-]*)(?:\.\w+)*=", "{}", "event-handler", "vue-event", refers=True),
        Feature(r"\bv-(else-if|else|for|if|show)\b", "v-{}", "function", "vue-directive", "vue directive"),
    ],
    "astro": [
        Feature(r"\bclient:(idle|load|media|only|visible)\b", "client:{}", "function", "astro-client-directive", "astro hydration client"),
        Feature(r"\bset:(html|text)\b", "set:{}", "function", "astro-set-directive", "astro set directive"),
        Feature(r"\{\.\.\.(\w+)\}", "{}", "props-spread", "astro-props-spread", refers=True),
    ],
}
_STYLES = [
    Feature(r"\.(-?[A-Za-z_][\w-]*)(?=[^{};]*\{)", ".{}", "string", "css-class", "css class style"),
    Feature(r"(--[A-Za-z][\w-]*)~:", "{}", "variable", "css-variable", "css custom-property variable"),
]
_COMPONENT = Feature(r"<(CAPITAL)", "{}", "instantiation", "component", refers=True)


def _apply(rows: Rows, section: Section, features: list[Feature]) -> None:
    for f in features:
        for m in compiled(f.pattern, re.M).finditer(section.content):
            name = (m.group(1) or "core").strip()
            term = f.term.format(name)
            at = section.line - 1 + line_at(section.content, m.start())
            column = column_at(section.content, m.start())
            if f.refers:
                rows.refer(term, f.kind, at, column, frameworkFeature=f.feature)
            else:
                rows.define(term, f.kind, at, column, related=[*f.related.split(), *([name] if f.feature == "svelte-import" else [])], surrounding=rows.around(at), frameworkFeature=f.feature)


def component_name(path: str) -> str:
    """The file's name in Pascal case."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return "".join(x[:1].upper() + x[1:] for x in stem.split("-"))


def extract(content: str, path: str) -> Rows:
    kind = path.rsplit(".", 1)[-1].lower()
    rows = Rows(kind, content)
    parts = sections(content, kind)
    for s in parts:
        if s.kind == "script":
            inner = typescript.extract(s.content, path)
            for row in inner.definitions + inner.references:
                row["line"] += s.line - 1
            rows.definitions += inner.definitions
            rows.references += inner.references
            _apply(rows, s, _SCRIPTS.get(kind, []))
        elif s.kind in ("template", "markdown"):
            _apply(rows, s, [_COMPONENT, *_TEMPLATES.get(kind, [])])
        else:
            _apply(rows, s, _STYLES)
    name = component_name(path)
    if name:
        exports = [x for s in parts if s.kind == "script" for x in _EXPORTED.findall(s.content)]
        rows.define(name, "class", 1, 0, f"{kind} component: {name}", exports, first=True)
    return rows
