"""Which paths are read: globs, exclusions, inclusions, formats."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories and files that are not source. A trailing slash: directory only.
EXCLUSIONS = """
node_modules .git dist build out coverage .next .nuxt .cache .turbo .parcel-cache *.log .DS_Store thumbs.db .vscode .idea
__pycache__ *.pyc *.pyo .pytest_cache .mypy_cache venv/ env/ .env/ virtualenv/ .Python pip-log.txt
pip-delete-this-directory.txt .tox .coverage .hypothesis htmlcov .pytype poetry.lock *.egg-info *.egg
vendor *.exe *.dll *.so *.dylib *.test *.out go.sum .go-version
""".split()


def glob_regex(pattern: str) -> str:
    """An unanchored regular expression for a glob, as the legacy matcher reads
    it: ** spans directories, * does not, ? is one character; a pattern that
    doesn't start with * holds from the start of the path; nothing holds to its
    end."""
    out = []
    for part in re.split(r"(\*\*|\*|\?)", pattern):
        out.append({"**": ".*", "*": "[^/]*", "?": "."}.get(part) or re.escape(part))
    text = "".join(out)
    if pattern.startswith("**/"):
        return text.removeprefix(".*/")
    return text if pattern.startswith("*") else "^" + text


def segment_regex(pattern: str) -> str:
    """A regular expression that matches whole path segments: a name or glob
    without a slash matches any file or directory of that name; one with a slash
    matches from the start (after **/ anywhere)."""
    directory = pattern.endswith("/")
    body = pattern.rstrip("/")
    out = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p) or re.escape(p) for p in re.split(r"(\*\*/|\*\*|\*|\?)", body))
    start = "(?:^|/)" if "/" not in body or body.startswith("**/") else "^"
    return f"{start}{out}{'/' if directory else '(?:/|$)'}"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def excluded(path: Column, exclusions: list[str] = EXCLUSIONS, inclusions: list[str] = (), legacy: bool = False) -> Column:
    """Whether a path is left out; an inclusion that matches wins. legacy: plain
    patterns are substrings and globs aren't anchored at the end, so that
    `out` leaves out layout.tsx."""
    if legacy:
        test = lambda p: path.rlike(glob_regex(p)) if "*" in p else path.contains(p)
        wanted = _any([path.contains(p) | path.rlike(glob_regex(p)) for p in inclusions])
    else:
        test = lambda p: path.rlike(segment_regex(p))
        wanted = _any([test(p) for p in inclusions])
    return ~wanted & _any([test(p) for p in exclusions])


def merged(*lists: list[str]) -> list[str]:
    """Set union in order of first appearance."""
    return list(dict.fromkeys(x for part in lists for x in part or ()))


#: (format, pattern of the path); the first that matches is the format.
FORMATS = [
    ("framework", r"\.(astro|mdx|svelte|vue)$"),
    ("typescript", r"\.(cjs|js|jsx|mjs|ts|tsx)$"),
    ("python", r"\.py$"),
    ("go", r"\.go$"),
    ("rust", r"\.rs$"),
    ("swift", r"\.swift$"),
    ("shell", r"\.(bash|fish|sh|zsh)$|(^|/)\.(bash_profile|bashrc|profile|zshrc)$|(^|/)[^/.]+$"),
    ("json", r"\.(json|json5|jsonc)$"),
    ("yaml", r"\.(yaml|yml)$|\.gitlab-ci|\.github/workflows"),
    ("toml", r"\.toml$"),
    ("env", r"(^|/)\.env(\.[^/]*)?$|\.env$"),
]


def file_format(path: Column) -> Column:
    """The format that reads a path; null for none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(FORMATS):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def python_format(path: str) -> str | None:
    return next((name for name, pattern in FORMATS if re.search(pattern, path)), None)
