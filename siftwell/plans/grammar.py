"""The query language: text to a node, node to a DataFrame."""

from __future__ import annotations

import argparse
import re
import shlex
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.groups import all_groups
from ..operators import search as S


@dataclass(frozen=True)
class Node:
    """kind: fuzzy, exact, and, or, not, regex or words (and, failing that,
    or)."""

    kind: str
    terms: tuple[str, ...]


def parse(query: str, mode: str = "fuzzy") -> Node:
    """a b: all words, else any; a|b any; a&b all; !a not; /re/ regex."""
    special = any(c in query for c in "|&") or query[:1] in ("!", "/")
    if " " in query.strip() and not special:
        words = tuple(query.split())
        return Node("words", words)
    split = lambda c: tuple(t.strip() for t in query.split(c))
    if "|" in query and not (query.startswith("/") and query.endswith("/") and len(query) > 1):
        return Node("or", split("|"))
    if "&" in query:
        return Node("and", split("&"))
    if query.startswith("!"):
        return Node("not", (query[1:],))
    if mode == "regex" or query.startswith("/") and query.endswith("/") and len(query) > 1:
        return Node("regex", (query[1:-1] if query.startswith("/") else query,))
    return Node("exact" if mode == "exact" else "fuzzy", (query.strip(),))


def can_split(term: str) -> bool:
    return bool(re.search("[a-z][A-Z]", term) or re.search("[_-]", term) or "." in term and not term.startswith("."))


def smart_split(term: str) -> list[str]:
    """Parts in small letters: at case changes, _ and -, and dots that don't
    start a file extension; longer than 1, distinct."""
    text = re.sub("([a-z])([A-Z])", r"\1|\2", term)
    text = re.sub(r"[.](?![a-z]{2,4}$)", "|", re.sub("[_-]", "|", text))
    parts = (p.strip().lower() for p in text.split("|"))
    return list(dict.fromkeys(p for p in parts if len(p) > 1))


def smart_split_column(term: Column) -> Column:
    """smart_split() as a column."""
    text = F.regexp_replace(F.regexp_replace(term, "([a-z])([A-Z])", "$1|$2"), "[_-]", "|")
    parts = F.split(F.regexp_replace(text, r"[.](?![a-z]{2,4}$)", "|"), r"\|")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.lower(F.trim(p))), lambda p: F.length(p) > 1))


def evaluate(node: Node, index: DataFrame, options: S.Options = S.Options(), scan: int | None = None) -> DataFrame:
    """The node's results, without fallbacks."""
    if node.kind == "or":
        return S.any_of(index, list(node.terms), options)
    if node.kind == "and":
        return S.all_of(index, list(node.terms), options)
    if node.kind == "words":
        return S.all_of(index, list(node.terms), replace(options, limit=options.limit * 2))
    if node.kind == "not":
        return S.none_of(index, node.terms[0], options, scan)
    if node.kind == "regex":
        return S.matching(index, node.terms[0], options, scan)
    return S.ranked(index, node.terms[0], replace(options, exact=node.kind == "exact"))


def fallbacks(node: Node, config: dict | None = None) -> list[Node]:
    """What to try, in turn, where a node finds nothing."""
    if node.kind == "words":
        return [Node("or", node.terms)]
    if node.kind != "fuzzy":
        return []
    groups = {k.lower(): v for k, v in all_groups(config).items()}
    query, out = node.terms[0], []
    parts = smart_split(query) if can_split(query) else []
    if len(parts) > 1:
        out.append(Node("or", tuple(parts)))
    if query.lower() in groups:
        out.append(Node("or", tuple(groups[query.lower()])))
    terms = [t for p in parts for t in groups.get(p, [])]
    if terms:
        out.append(Node("or", tuple(dict.fromkeys(terms))))
    return out


def run(query: str, index: DataFrame, refs: DataFrame, options: S.Options = S.Options(limit=50), mode: str = "fuzzy", sort: str = "relevance", config: dict | None = None, scan: int | None = None) -> DataFrame:
    """A query's results with usage, in order. A node that finds nothing gives
    way to the next fallback; the test for that stops at the first row."""
    node = parse(query, mode)
    found = evaluate(node, index, options, scan)
    for other in fallbacks(node, config):
        if not found.isEmpty():
            break
        found = evaluate(other, index, options, scan)
    return S.in_order(S.with_usage(found, refs), sort)


def command_line(line: str) -> tuple[str, dict]:
    """Query and settings of a search command's arguments."""
    p = argparse.ArgumentParser(add_help=False, exit_on_error=False)
    p.add_argument("--type", default="")
    p.add_argument("--file", default="")
    p.add_argument("--max", type=int, default=50)
    p.add_argument("--sort", choices=["relevance", "usage", "name", "file"], default="relevance")
    for flag in ("exact", "regex", "no-context", "json", "compact", "human", "full"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("words", nargs="*")
    got = p.parse_args(shlex.split(line))
    names = lambda text: tuple(x.strip() for x in text.split(",") if x.strip())
    mode = "exact" if got.exact else "regex" if got.regex else "fuzzy"
    form = next((f for f in ("json", "compact", "human", "full") if getattr(got, f)), "summary")
    return (got.words[-1] if got.words else ""), {"options": S.Options(names(got.type), names(got.file), got.max or 50), "mode": mode, "sort": got.sort, "form": form, "context": not got.no_context}
