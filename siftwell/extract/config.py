"""Configuration files: JSON, YAML, TOML and environment files."""

from __future__ import annotations

import json
import re
from urllib.parse import urlsplit

from ..functions.text import _SENSITIVE, python_env_category, python_env_terms, python_masked
from .base import Rows, compiled, line_at

_COMMENT_OR_STRING = re.compile(r'("(?:\\.|[^"\\\n])*")|/\*.*?\*/|//[^\n]*', re.S)
_TRAILING_COMMA = re.compile(r",(\s*[}\]])")
_IMPORTANT_JSON = re.compile(
    r"(?i)(api|auth|conn|connection|config|database|db|debug|description|duration|endpoint|env|environment|host|interval|key|mode|name|options|password|port|secret|settings|timeout|token|uri|url|version|(?:disable|enable|is|use).*)"
)
TS_OPTIONS = "esModuleInterop jsx lib module moduleResolution skipLibCheck strict target".split()


def meaningful_json(value: str) -> bool:
    if len(value) < 4 or re.fullmatch(r"[0-9]+", value) or re.fullmatch(r"[A-Z_]+", value) and len(value) < 10:
        return False
    return len(value) > 15 or any(c in value for c in " ./-")


def without_comments(content: str) -> str:
    """JSON without comments (not those within strings) and trailing commas."""
    return _TRAILING_COMMA.sub(r"\1", _COMMENT_OR_STRING.sub(lambda m: m.group(1) or "", content))


def extract_json(content: str, path: str) -> Rows:
    rows = Rows("json", content)
    try:
        data = json.loads(without_comments(content))
    except ValueError:
        for m in re.finditer(r'"([^"]{4,})"', content):
            if meaningful_json(m.group(1)):
                rows.define(m.group(1), "string", line_at(content, m.start()), m.start() - content.rfind("\n", 0, m.start()) - 1, context=m.group())
        return rows
    name = path.rsplit("/", 1)[-1]
    if name == "package.json" and isinstance(data, dict):
        _package(rows, data)
    elif name in ("tsconfig.json", "jsconfig.json") and isinstance(data, dict):
        _tsconfig(rows, data)
    else:
        _flatten(rows, data, "")
    return rows


def _one(rows: Rows, term, kind: str, context: str, related: list[str]) -> None:
    rows.define(str(term), kind, 1, 0, context, related, [context])


def _package(rows: Rows, data: dict) -> None:
    if data.get("name"):
        _one(rows, data["name"], "module", f"Package: {data['name']}", ["package", "npm"])
    for name, command in (data.get("scripts") or {}).items():
        _one(rows, f"npm run {name}", "function", str(command), ["script", "npm", name])
    for group in ("dependencies", "devDependencies", "peerDependencies"):
        for package, version in (data.get(group) or {}).items():
            _one(rows, package, "import", f"{group}: {version}", [group, "npm", "package"])
            rows.refer(package, "import", 1, context=f"{group}: {package}@{version}")
    for field in ("main", "module", "browser"):
        if isinstance(data.get(field), str):
            _one(rows, data[field], "variable", f"Entry point: {field}", ["entry", field])


def _tsconfig(rows: Rows, data: dict) -> None:
    options = data.get("compilerOptions") or {}
    for key in TS_OPTIONS:
        if key in options:
            _one(rows, f"compilerOptions.{key}", "constant", f"{key}: {json.dumps(options[key])}", ["typescript", "config", key])
    for alias, targets in (options.get("paths") or {}).items():
        _one(rows, alias, "variable", f"Path alias: {alias} → {','.join(map(str, targets))}", ["alias", "import", "path"])
    for field in ("include", "exclude"):
        patterns = data.get(field) or []
        for pattern in patterns if isinstance(patterns, list) else [patterns]:
            _one(rows, pattern, "string", f"{field} pattern", ["pattern", field])


def _shown(value) -> str:
    if isinstance(value, dict):
        return "{...}"
    return "[...]" if isinstance(value, list) else json.dumps(value, ensure_ascii=False)


def _flatten(rows: Rows, data, prefix: str) -> None:
    for key, value in data.items() if isinstance(data, dict) else enumerate(data) if isinstance(data, list) else ():
        key = str(key)
        path = f"{prefix}.{key}" if prefix else key
        if _IMPORTANT_JSON.fullmatch(key) or isinstance(value, (dict, list, bool, int, float)):
            terms = [key]
            if isinstance(value, bool):
                terms += ["boolean", "flag"]
            elif isinstance(value, (int, float)):
                terms += ["number", "value"]
            elif isinstance(value, str) and value.startswith("http"):
                terms += ["url", "endpoint"]
            terms += ["path", "file"] * ("path" in key.lower()) + ["port", "network"] * ("port" in key.lower())
            _one(rows, path, "constant", f"{key}: {_shown(value)}", terms)
        if isinstance(value, str) and meaningful_json(value):
            _one(rows, value, "string", f'{path}: "{value}"', [key])
        elif isinstance(value, dict):
            _flatten(rows, value, path)
        elif isinstance(value, list):
            for item in value:
                if isinstance(item, str) and meaningful_json(item):
                    _one(rows, item, "string", f"{path}[]", [key])
                elif isinstance(item, dict):
                    _flatten(rows, item, path)


YAML_KEYS = frozenset("config database debug description disabled enabled endpoint env environment host interval name port retry schema timeout url username version".split())
_YAML_PATHS = re.compile(r"(?i)(api|auth|cache|client|cors|database|logging|monitoring|queue|redis|security|server)")
_YAML_PAIR = compiled(r"(\s*)(-\s+)?([\w.\-/]+):(?:\s+(.*))?$")
_YAML_ITEM = compiled(r"(\s*)-\s+(.+)$")


def _yaml_value(value: str) -> str:
    return re.sub(r"\$\{[^}]+\}", "", re.sub(r"""^["']|["']$""", "", value)).strip()


def meaningful_yaml(value: str) -> bool:
    if len(value) < 3 or re.fullmatch(r"(?i)true|false|null|yes|no|on|off|[0-9]+", value):
        return False
    return not (re.fullmatch(r"[A-Z_]+", value) and len(value) < 10)


def extract_yaml(content: str, path: str) -> Rows:
    rows = Rows("yaml", content)
    name = path.rsplit("/", 1)[-1]
    kubernetes = "apiVersion:" in content and ("kind:" in content or "metadata:" in content)
    dialect = "gitlab" if ".gitlab-ci" in path else "github" if ".github/workflows" in path else "compose" if "docker-compose" in name else "kubernetes" if kubernetes else ""
    stack: list[tuple[int, str]] = []
    block: list[str] | None = None
    start, base = 0, 0
    around = lambda at: rows.around(at, 1, 1)
    for at, line in enumerate([*rows.lines, ""], 1):
        text, indent = line.strip(), len(line) - len(line.lstrip())
        if block is not None and (at > len(rows.lines) or text and indent <= base):
            whole = "\n".join(block)
            if meaningful_yaml(whole):
                rows.define(whole, "string", start, context="Multiline string", related=[k for _, k in stack])
            block = None
        if block is not None:
            block.append(text)
            continue
        if not text or text.startswith("#"):
            if len(text) > 2:
                rows.comment(text[1:].strip(), at, context=text)
            continue
        pair = _YAML_PAIR.match(line)
        level = indent + len(pair.group(2) or "") if pair else indent
        while stack and stack[-1][0] >= level:
            stack.pop()
        context = [k for _, k in stack]
        if pair:
            key, value = pair.group(3), (pair.group(4) or "").strip()
            dotted = ".".join([*context, key])
            _dialect(rows, dialect, key, value, context, dotted, at)
            if key.lower() in YAML_KEYS or _YAML_PATHS.match(dotted):
                terms = [key] + ["url", "endpoint"] * ("http" in value) + ["port"] * bool(re.search(r":.*\d|\d.*:", value)) + ["docker", "container"] * ("image" in key.lower()) + ["command", "shell"] * ("script" in key.lower())
                rows.define(dotted, "constant", at, indent, f"{key}: {value or '{...}'}", terms, around(at))
            if value[:1] in ("|", ">"):
                block, start, base = [], at, level
                if key.lower() not in YAML_KEYS:
                    stack.append((level, key))
                continue
            clean = _yaml_value(value)
            if clean and meaningful_yaml(clean):
                rows.define(clean, "string", at, line.index(":") + 2, f"{key}: {value}", [key, *context])
            if not value:
                stack.append((level, key))
            continue
        item = _YAML_ITEM.match(line)
        if item:
            clean = _yaml_value(item.group(2))
            if clean and meaningful_yaml(clean):
                rows.define(clean, "string", at, indent, f"- {item.group(2)}", context)
            if dialect == "gitlab" and "script" in context:
                rows.define(clean, "function", at, indent, f"Script command: {clean}", ["script", "command", *context])
            elif dialect == "compose" and context[-1:] == ["ports"] and ":" in clean:
                rows.define(clean, "constant", at, indent, f"Port mapping: {clean}", ["port", "network", "docker"])
    return rows


def _dialect(rows: Rows, dialect: str, key: str, value: str, context: list[str], dotted: str, at: int) -> None:
    put = lambda term, kind, about, related: rows.define(term, kind, at, 0, f"{about}: {term}", related)
    if dialect == "gitlab":
        if not context and not key.startswith(".") and not value and key not in ("variables", "stages"):
            put(key, "function", "GitLab CI Job", ["job", "ci", "gitlab"])
        if key == "stage" and value:
            rows.refer(value, "call", at, context=f"stage: {value}")
    elif dialect == "github":
        if key == "name" and not context and value:
            put(value, "module", "GitHub Actions Workflow", ["workflow", "github", "actions"])
        if context == ["jobs"] and not value:
            put(key, "function", "GitHub Actions Job", ["job", "github", "actions"])
        if key == "uses" and value:
            put(value, "import", "GitHub Action", ["action", "github", "uses"])
            rows.refer(value.split("@")[0], "import", at, context=f"uses: {value}")
    elif dialect == "compose":
        if context == ["services"] and not value:
            put(key, "class", "Docker Service", ["service", "docker", "container"])
    elif dialect == "kubernetes":
        if key == "kind" and value and not context:
            rows.define(value, "class", at, 0, f"Kubernetes {value}", ["kubernetes", "k8s", value.lower()])
        if dotted == "metadata.name" and value:
            put(value, "variable", "Resource name", ["name", "metadata", "kubernetes"])
        if key == "image" and value and "containers" in context:
            put(value, "import", "Container image", ["container", "image", "kubernetes"])
    if dialect in ("gitlab", "compose") and key == "image" and value:
        put(value, "import", "Docker image", ["docker", "image"] + ["container"] * (dialect == "gitlab"))


TOML_KEYS = frozenset("author build database description format homepage host license lint name port repository test threads timeout url version workers".split())
_TOML_KEY = re.compile(r"(?i)^(enable|disable|use|min|max)_|_(url|uri|host|port)$")
_TOML_PAIR = compiled(r"""\s*["']?([\w.\-]+)["']?\s*=\s*(.+)$""")
_TABLE_TERMS = [("dependencies", "dependency import"), ("dev", "development dev"), ("build", "build compile"), ("test", "test testing"), ("package", "package metadata")]


def meaningful_toml(value: str) -> bool:
    if len(value) < 3 or re.fullmatch(r"(?i)true|false|[0-9]+(\.[0-9]+)?", value):
        return False
    return not (re.fullmatch(r"[A-Z_]+", value) and len(value) < 10)


def _toml_string(value: str) -> str:
    for quote in ('"""', "'''", '"', "'"):
        if len(value) >= 2 * len(quote) and value.startswith(quote) and value.endswith(quote):
            return value[len(quote) : -len(quote)]
    return value


def _toml_items(value: str) -> list[str]:
    return [a if a is not None and a != "" else b for a, b in re.findall(r"""\"((?:\\.|[^"\\])*)\"|'([^']*)'""", value)]


def extract_toml(content: str, path: str) -> Rows:
    rows = Rows("toml", content)
    name = path.rsplit("/", 1)[-1]
    table, block, quote, key = "", None, "", ""
    start, pending = 0, ""
    for at, line in enumerate(rows.lines, 1):
        text = line.strip()
        if block is not None:
            if quote in line:
                block.append(line.partition(quote)[0])
                whole = "\n".join(block).strip()
                if meaningful_toml(whole):
                    rows.define(whole, "string", start, context=f"{key} = {quote}...{quote}", related=[key, table])
                block = None
            else:
                block.append(line)
            continue
        if pending:
            pending += " " + text.split(" #")[0]
            if text.split(" #")[0].rstrip().endswith("]"):
                _toml_pair(rows, name, table, key, pending, start)
                pending = ""
            continue
        if not text or text.startswith("#"):
            if len(text) > 2:
                rows.comment(text[1:].strip(), at, context=text)
            continue
        header = re.fullmatch(r"\[(\[)?([^\]]+)\](\])?(?:\s*#.*)?", text)
        if header:
            table = header.group(2).strip()
            terms = [x for part, words in _TABLE_TERMS if part in table for x in words.split()]
            if header.group(1):
                rows.define(table, "class", at, 0, f"TOML Array Table: {table}", ["array", *terms])
            else:
                rows.define(table, "module", at, 0, f"TOML Table: {table}", terms)
                if name == "Cargo.toml" and table == "package":
                    rows.define("Cargo Package", "module", at, 0, "Rust package configuration", ["rust", "cargo", "package"])
                elif name == "Cargo.toml" and "dependencies" in table:
                    rows.define(table, "import", at, 0, "Rust dependencies", ["rust", "cargo", "dependencies"])
                elif name == "pyproject.toml" and table in ("project", "tool.poetry"):
                    rows.define("Python Project", "module", at, 0, "Python project configuration", ["python", "project", "pyproject"])
            continue
        m = _TOML_PAIR.match(line)
        if not m:
            continue
        key, value = m.group(1), m.group(2).strip()
        opened = next((q for q in ('"""', "'''") if value.startswith(q) and q not in value[3:]), None)
        if opened:
            block, quote, start = [value[3:]], opened, at
        elif value.startswith("[") and not value.split(" #")[0].rstrip().endswith("]"):
            pending, start = value, at
        else:
            _toml_pair(rows, name, table, key, value, at)
    return rows


def _toml_pair(rows: Rows, name: str, table: str, key: str, value: str, at: int) -> None:
    full = f"{table}.{key}" if table else key
    line = rows.lines[at - 1]
    project = name == "pyproject.toml"
    if key == "name" and (name == "Cargo.toml" and table == "package" or project and table in ("project", "tool.poetry")):
        about, related = ("Python package", ["package", "python", "module"]) if project else ("Rust crate", ["crate", "rust", "package"])
        rows.define(_toml_string(value), "module", at, 0, f"{about}: {_toml_string(value)}", related)
    if name == "Cargo.toml" and "dependencies" in table:
        rows.define(key, "import", at, 0, f"Rust dependency: {key} = {value}", ["dependency", "crate", "rust"])
        rows.refer(key, "import", at, context=f"{table}: {key} = {value}")
    if project and (key == "dependencies" or "dependencies" in table):
        for item in _toml_items(value) if value.startswith("[") else [key]:
            package = re.split(r"[<>=!~;\[ ]", item)[0].strip()
            if package:
                rows.define(package, "import", at, 0, f"Python dependency: {item}", ["dependency", "package", "python"])
                rows.refer(package, "import", at, context=f"Python dependency: {item}")
    if key.lower() in TOML_KEYS or _TOML_KEY.search(key):
        terms = [key] + ["url", "endpoint"] * ("http" in value) + [x for part, words in (("version", "version semver"), ("author", "author maintainer"), ("license", "license legal")) if part in key for x in words.split()]
        rows.define(full, "constant", at, 0, f"{key} = {value if len(value) <= 50 else value[:47] + '...'}", terms)
    if value[:1] in "\"'" and meaningful_toml(_toml_string(value)):
        rows.define(_toml_string(value), "string", at, line.index("=") + 2, f"{key} = {value}", [key, table])
    elif value.startswith("["):
        for item in _toml_items(value):
            if meaningful_toml(item):
                rows.define(item, "string", at, line.index("=") + 2, f"{key} = [...]", [key, table, "array"])
    elif value.startswith("{"):
        rows.define(full, "class", at, 0, f"{key} = {value}", [key, table, "table"])


_ENV_PAIR = compiled(r"(?:export )?(LOUD)~=~(.*)$")
_ENV_USE = compiled(r"\$\{?(LOUD)\}?")


def meaningful_env(value: str) -> bool:
    if len(value) < 2 or value in ("true", "false") or re.fullmatch(r"[0-9]{1,4}", value) or re.fullmatch(r"[A-Z_]{1,9}", value):
        return False
    return len(value) > 10 or any(c in value for c in "/.:")


def _env_value(value: str) -> str:
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    return "" if value in ("null", "undefined") else value.strip()


def extract_env(content: str, path: str) -> Rows:
    rows = Rows("env", content)
    section = ""

    def hidden(line: str) -> str:
        m = _ENV_PAIR.match(line)
        return f"{m.group(1)}={python_masked(m.group(1), m.group(2))}" if m and re.search(_SENSITIVE, m.group(1)) else line

    for at, line in enumerate(rows.lines, 1):
        text = line.strip()
        if text.startswith("#"):
            comment = text[1:].strip()
            if len(comment) > 2:
                if re.fullmatch(r"[A-Z\s]+", comment) or "CONFIG" in comment or "SETTINGS" in comment:
                    section = comment
                rows.comment(comment, at, context=text, related=[section.lower()] if section else [])
            continue
        m = _ENV_PAIR.match(line)
        if not m:
            continue
        key, value = m.group(1), _env_value(m.group(2))
        category = python_env_category(key, value)
        terms = [category, *python_env_terms(key, value)] + ([section.lower()] if section else [])
        rows.define(key, "constant", at, 0, f"{key}={python_masked(key, value)}", terms, [hidden(x) for x in rows.around(at)])
        secret = re.search(_SENSITIVE, key)
        shown = f"{key}={python_masked(key, value)}"
        if value and not secret and meaningful_env(value):
            rows.define(value, "string", at, line.index("=") + 1, shown, [key, category])
        if "PORT" in key and re.fullmatch(r"[0-9]+", value):
            rows.refer(f"port:{value}", "config", at, context=shown)
        used = _ENV_USE.search(value)
        if used:
            rows.refer(used.group(1), "variable", at, context=shown)
        if "http://" in value or "https://" in value:
            try:
                host = urlsplit(value).hostname
            except ValueError:
                host = None
            if host:
                rows.refer(host, "endpoint", at, context=shown)
    return rows
