"""Operator 4, HTML extraction by union-free regular-expression inference."""

from __future__ import annotations

import bisect
import html as entities
import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import measured, written

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|$)|<[!?][^>]*(?:>|$)|[^<]+|<", re.S | re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_ASIDE = frozenset("nav footer aside head".split())
_MAIN = frozenset("article main".split())
#: Elements whose end may be left out in HTML, and is no token.
_OPEN_ENDED = frozenset("p li td th tr dt dd option optgroup thead tbody tfoot body html".split())
#: Units of up to 64 tokens; _wide() finds the longer ones.
_REPEAT = re.compile(r"(.{1,64}?)\1+", re.S)
NARROW, GRAM = 64, 32
_VOID = frozenset("area base basefont bgsound br col embed frame hr image img input keygen link meta param source track wbr".split())
_IN_HEAD = frozenset("html head title base basefont bgsound link meta".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BLOCKS = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split()) | _HEADINGS
_PARTS = frozenset("thead tbody tfoot".split())
_BOUNDS = frozenset("article aside blockquote body button details dl fieldset figure footer form header main menu nav object ol section table td th ul".split())


def _implied() -> dict[str, list]:
    """Of a start tag, what open elements it ends, and within which others."""
    table, ends = frozenset(["table"]), {}
    for names, closed, bounds in (
        (["li"], ["li"], _BOUNDS),
        (["dd", "dt"], ["dd", "dt"], _BOUNDS),
        (_BLOCKS, ["p"], frozenset("button td th caption table object".split())),
        (["option"], ["option"], frozenset(["select", "datalist"])),
        (["optgroup"], ["option", "optgroup"], frozenset(["select"])),
        (["td", "th"], ["td", "th", "caption", "colgroup"], table),
        (["tr"], ["tr", "td", "th", "caption", "colgroup"], table),
        (_PARTS, [*_PARTS, "tr", "td", "th", "caption", "colgroup"], table),
        (["button"], ["button"], frozenset()),
    ):
        for name in names:
            ends.setdefault(name, []).append((frozenset(closed), bounds))
    return ends


_IMPLIED = _implied()
_NO_BOUNDS = frozenset()
#: Within which elements an end tag looks for its start.
_SCOPE = {"li": frozenset("ul ol menu".split()), "p": frozenset("button td th caption table object".split())} | dict.fromkeys("td th tr thead tbody tfoot caption".split(), frozenset(["table"]))
TEXT = "#"
#: A text that not all pages of a host have is on so many of them, to be template.
SHARE = 0.2


#: Symbols that are possible, and distinct ones that a page or a host may add
#: with the classes of its tags; beyond that its tags are told by name alone.
SPACE, MANY = 0x10F000, 250_000
#: Cells of an alignment whose rows are kept, a bit each; larger ones are split.
CELLS = 1 << 28


class _Full(Exception):
    pass


class Symbols:
    """One character for each tag, and for each repeated group of them."""

    def __init__(self) -> None:
        self.char: dict = {TEXT: TEXT}
        self.item: dict = {TEXT: TEXT}
        self.limit = SPACE

    def of(self, item) -> str:
        c = self.char.get(item)
        if c is None:
            n = len(self.char)
            if n >= self.limit:
                raise _Full
            n += 0x100 if n < 0xD700 else 0x900  # not the surrogates
            c = self.char[item] = chr(n)
            self.item[c] = item
        return c

    def items(self, s: str) -> tuple:
        return tuple(self.item[c] for c in s)

    def text_of(self, s: str) -> str:
        """The characters of items (nested tuples are repeated groups)."""
        return "".join(self.of(x) for x in s)


class _Open:
    """The open elements at a place of a page, and the outermost one that isn't
    content. Ends are implied where HTML implies them: by a sibling's start, by
    a parent's end, and for head by what can't stand in one."""

    def __init__(self, classes: frozenset) -> None:
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.classes, self.region = classes, -1

    def _cut(self, k: int) -> None:
        for name in self.names[k:]:
            places = self.places[name]
            while places and places[-1] >= k:
                places.pop()
        del self.names[k:]
        if k <= self.region:
            self.region = -1

    def _last(self, names: frozenset) -> int:
        """The place of the innermost open element of these names."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def _close(self, closed: frozenset, bounds: frozenset, all_: bool = True) -> None:
        found, bound = self._last(closed), self._last(bounds)
        if found <= bound:
            return
        if all_:
            outer = (self.places[x] for x in closed if self.places.get(x))
            found = min(x[k] for x in outer if (k := bisect.bisect_right(x, bound)) < len(x))
        self._cut(found)

    def leave_head(self) -> None:
        if self.places.get("head"):
            self._cut(self.places["head"][0])

    def start(self, name: str, words: list[str], attributes: str) -> None:
        if name not in _IN_HEAD:
            self.leave_head()
        for closed, bounds in _IMPLIED.get(name, ()):
            self._close(closed, bounds)
        if name in _HEADINGS and self.names and self.names[-1] in _HEADINGS:
            self._cut(len(self.names) - 1)
        if name in _MAIN:
            self.region = -1
        if name in _VOID or attributes.endswith("/") and (self.places.get("svg") or self.places.get("math")):
            return
        if self.region < 0 and name not in ("html", "body") and (name in _ASIDE or not self.classes.isdisjoint(words)):
            self.region = len(self.names)
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name)

    def end(self, name: str) -> None:
        self._close(_HEADINGS if name in _HEADINGS else frozenset([name]), _SCOPE.get(name, _NO_BOUNDS), False)

    def text(self) -> bool:
        """Whether text that stands here is outside of the content."""
        if self.names and self.names[-1] == "head":
            self.leave_head()
        return self.region >= 0


def tokens(html: str, symbols: Symbols, aside_classes: frozenset = frozenset(), plain: bool = False) -> tuple[str, list[str], list[bool]]:
    """A page as one character per token, its texts, and of each whether it
    stands in a region that isn't content. Inline markup belongs to the text;
    comments, scripts, styles and end tags that may be left out are nothing. A
    tag's classes belong to its token, unless plain."""
    out, texts, aside, buffer, opened = [], [], [], [], _Open(aside_classes)

    def flush() -> None:
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            lines = [" ".join(x.split()) for x in text.split("\n\0")]
            text = "\n".join(x for x in lines if x)
            if text:
                out.append(TEXT)
                texts.append(text)
                aside.append(opened.text())

    for m in _TOKEN.finditer(html):
        name = m.group(3)
        if name is None:
            raw = m.group()
            if raw[0] != "<" or raw == "<":
                buffer.append(entities.unescape(raw).replace("\0", " "))
            continue
        name = name.lower()
        if name in _INLINE:
            continue
        if name == "br":
            buffer.append("\n\0")
            continue
        flush()
        if m.group(2):
            opened.end(name)
            if name not in _OPEN_ENDED:
                out.append(symbols.of("/" + name))
            continue
        cls = _CLASS.search(m.group(4)) if m.group(4) else None
        words = (cls.group(1) or cls.group(2) or cls.group(3) or "").split() if cls else []
        opened.start(name, words, m.group(4))
        out.append(symbols.of(".".join((name, " ".join(words))) if words and not plain else name))
    flush()
    return "".join(out), texts, aside


def page_tokens(html: str, symbols: Symbols, aside_classes: frozenset, plain: bool = False) -> tuple[str, list[str], list[bool]]:
    """tokens(), plain ones if there are too many distinct tags with classes."""
    symbols.limit = len(symbols.char) + MANY
    try:
        return tokens(html, symbols, aside_classes, plain)
    except _Full:
        symbols.limit = SPACE
        return tokens(html, symbols, aside_classes, True)
    finally:
        symbols.limit = SPACE


def _substitute(s: str, widths: list[int], pattern: re.Pattern, item) -> tuple[str, list[int]]:
    parts, spans, last = [], [], 0
    for m in pattern.finditer(s):
        parts += [s[last : m.start()], item(m)]
        spans += widths[last : m.start()]
        spans.append(sum(widths[m.start() : m.end()]))
        last = m.end()
    if not last:
        return s, widths
    return "".join(parts) + s[last:], spans + widths[last:]


def fold(s: str, symbols: Symbols, widths: list[int] | None = None) -> tuple[str, list[int]]:
    """Repetitions of one unit become one repeated group, innermost first; with
    each item, how many tokens it stands for."""
    widths = widths or [1] * len(s)
    while True:
        new, spans = _substitute(s, widths, _REPEAT, lambda m: symbols.of(("+", symbols.items(m.group(1)))) if not _group(m.group(1), symbols) else m.group(1))
        if new == s:
            new, spans = _fold_wide(s, widths, symbols)
        if new == s:
            return s, widths
        s, widths = new, spans


def _wide(s: str) -> list[tuple[int, int, int]]:
    """(start, period, end) of the leftmost repetitions of units of more than
    NARROW tokens, of any length. Of such a repetition, one of the places that
    are multiples of its period agrees with the next in GRAM tokens before or
    after it."""
    n = len(s)
    if n < 2 * (NARROW + 1):
        return []
    ids: dict[str, int] = {}
    gram = np.array([ids.setdefault(s[i : i + GRAM], len(ids)) for i in range(n - GRAM + 1)])
    if len(ids) == len(gram):
        return []
    codes, runs = np.frombuffer(s.encode("utf-32-le"), np.uint32), []
    for p in range(NARROW + 1, n // 2 + 1):
        after, before = gram[::p], gram[(-GRAM) % p :: p]
        if not ((after[1:] == after[:-1]).any() or (before[1:] == before[:-1]).any()):
            continue
        edges = np.flatnonzero(np.diff(np.r_[0, (codes[p:] == codes[:-p]).view(np.int8), 0]))
        runs += [(int(a), p, int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= p]
    out, at = [], 0
    while left := [(max(a, at), p, b) for a, p, b in runs if b - max(a, at) >= p]:
        a, p, b = min(left)
        at = a + p * (1 + (b - a) // p)
        out.append((a, p, at))
        runs = [(x, q, y) for x, q, y in runs if y - max(x, at) >= q]
    return out


def _fold_wide(s: str, widths: list[int], symbols: Symbols) -> tuple[str, list[int]]:
    parts, spans, last = [], [], 0
    for a, p, b in _wide(s):
        parts += [s[last:a], symbols.of(("+", symbols.items(s[a : a + p])))]
        spans += [*widths[last:a], sum(widths[a:b])]
        last = b
    return "".join(parts) + s[last:], spans + widths[last:]


def _group(unit: str, symbols: Symbols) -> bool:
    return len(unit) == 1 and isinstance(symbols.item[unit], tuple)


def fold_known(s: str, widths: list[int], units: list, symbols: Symbols) -> tuple[str, list[int]]:
    """Single occurrences of known repeated groups become those groups too."""
    while True:
        before = s
        for unit in units:
            c, body = symbols.of(unit), symbols.text_of(unit[1])
            s, widths = _substitute(s, widths, re.compile(f"(?:{re.escape(body)}|{c})+"), lambda m, c=c: c)
        s, widths = fold(s, symbols, widths)
        if s == before:
            return s, widths


def _units(items, found: set) -> set:
    for x in items:
        if isinstance(x, tuple):
            found.add(x)
            _units(x[1], found)
    return found


def align(a: str, b: str) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by rows of bits: memory for
    at most CELLS of them, beyond which the first string is halved where the
    two halves' lengths add up to most."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        tail = 0
        while i < n and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while n - tail > i and m - tail > j and a[n - 1 - tail] == b[m - 1 - tail]:
            tail += 1
            out.append((n - tail, m - tail))
        x, y = a[i : n - tail], b[j : m - tail]
        if not x or not y:
            continue
        if len(x) * len(y) <= CELLS or len(x) == 1:
            out += [(i + p, j + q) for p, q in _traced(x, y)]
        else:
            half = len(x) // 2
            total = _lengths(x[:half], y) + _lengths(x[half:][::-1], y[::-1])[::-1]
            k = int(total.argmax())
            todo += [(i, i + half, j, j + k), (i + half, i + len(x), j + k, j + len(y))]
    return sorted(out)


def _bits(x: str, y: str):
    """After each character of x, a number whose zeros are the places in y at
    which the longest common subsequence with what came so far grows."""
    masks = {c: 0 for c in set(x) & set(y)}
    for c in masks:
        raw = np.frombuffer(y.encode("utf-32-le"), np.uint32) == ord(c)
        masks[c] = int.from_bytes(np.packbits(raw, bitorder="little").tobytes(), "little")
    full = row = (1 << len(y)) - 1
    for c in x:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _lengths(x: str, y: str) -> np.ndarray:
    """Of x and each prefix of y the length of the longest common subsequence."""
    *_, row = _bits(x, y)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def _traced(x: str, y: str) -> list[tuple[int, int]]:
    rows = list(_bits(x[::-1], y[::-1]))
    i, j, out = len(x), len(y), []
    while i and j:
        if x[-i] == y[-j]:
            out.append((len(x) - i, len(y) - j))
            i, j = i - 1, j - 1
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


def merge(wrapper: str, groups: list[int], page: str) -> tuple[str, list[int]]:
    """The wrapper that covers another stream too. groups: 0 for a required
    item, else the number of the optional group it belongs to. Where the streams
    disagree, what either has alone becomes an optional group."""
    out, marks, i, j, fresh = [], [], 0, 0, max(groups, default=0) + 1
    for p, q in [*align(wrapper, page), (len(wrapper), len(page))]:
        if p > i:
            split: dict[int, int] = {}
            for k in range(i, p):
                out.append(wrapper[k])
                mark = split.setdefault(groups[k], fresh)
                if mark == fresh:
                    fresh += 1
                marks.append(mark)
        if q > j:
            out.extend(page[j:q])
            marks.extend([fresh] * (q - j))
            fresh += 1
        if p < len(wrapper):
            out.append(wrapper[p])
            marks.append(groups[p])
        i, j = p + 1, q + 1
    return "".join(out), marks


def infer(signatures: list[tuple[str, list[int], int, list[int]]]) -> str:
    """A host's wrapper as JSON, from (signature, slot hashes, pages, slot
    pages) of each distinct stream: items with their optional groups, the
    repeated groups that are known, and of each text slot outside of repeated
    groups its constant's hash, or 0 if it is data."""
    streams = [_load(json.loads(s)) for s, *_ in signatures]
    try:
        return _inferred(signatures, streams, False)
    except _Full:
        return _inferred(signatures, [_plain(s) for s in streams], True)


def _plain(items) -> tuple:
    """The items without the classes of their tags."""
    return tuple(("+", _plain(x[1])) if isinstance(x, tuple) else x.split(".", 1)[0] for x in items)


def _inferred(signatures: list, streams: list[tuple], plain: bool) -> str:
    symbols = Symbols()
    symbols.limit = SPACE if plain else MANY
    units = sorted({u for s in streams for u in _units(s, set())}, key=lambda u: (len(str(u)), str(u)))
    folded = []
    for s in streams:
        text = symbols.text_of(s)
        folded.append(fold_known(text, [1] * len(text), units, symbols))
    wrapper, groups = folded[0][0], [0] * len(folded[0][0])
    for text, _ in folded[1:]:
        if text != wrapper:
            wrapper, groups = merge(wrapper, groups, text)
    seen: dict[int, dict[int, int]] = {}
    for n, (stream, (text, widths), (_, hashes, _, _)) in enumerate(zip(streams, folded, signatures)):
        place = dict((q, p) for p, q in align(wrapper, text))
        at = slot = 0
        for k, width in enumerate(widths):
            inner = stream[at : at + width]
            own = sum(1 for x in inner if x == TEXT)
            if text[k] == TEXT and k in place:
                seen.setdefault(place[k], {})[n] = hashes[slot]
            slot += own
            at += width
    constants = _constants(seen, [n if any(map(_has_text, stream)) else 0 for stream, (_, _, n, _) in zip(streams, signatures)])
    if not any(v == 0 for v in constants.values()) and not any(c != TEXT and _has_text(symbols.item[c]) for c in wrapper):
        constants = dict.fromkeys(constants, 0)
    return json.dumps({"plain": plain, "items": symbols.items(wrapper), "groups": groups, "units": units, "const": [constants.get(k, 0) for k in range(len(wrapper))]}, separators=(",", ":"))


def _constants(seen: dict[int, dict[int, int]], pages: list[int]) -> dict[int, int]:
    """Of each slot its constant or 0, from the hash on each stream that has it
    and the pages of each stream. What not all pages have must be on a share of
    them, and these must differ wherever the host's pages do: copies of one
    page, which agree in more than its template, make nothing a constant."""
    total, varied, differ = sum(pages), {p for p, values in seen.items() if not _one(values.values())}, {}
    constants = dict.fromkeys(seen, 0)
    for p, values in seen.items():
        value, count, streams = _one(values.values()), sum(pages[n] for n in values), frozenset(values)
        if not value or count < 2:
            continue
        if count < total and streams not in differ:
            both = [seen[q] for q in varied if streams <= seen[q].keys()]
            differ[streams] = bool(both) and not any(_one([x[n] for n in streams]) for x in both)
        if count == total or count >= SHARE * total and differ[streams]:
            constants[p] = value
    return constants


def _one(values) -> int:
    """The hash that all of the values are, or 0."""
    (value,) = found if len(found := set(values)) == 1 else (0,)
    return value


def _has_text(item) -> bool:
    return item == TEXT or isinstance(item, tuple) and any(_has_text(x) for x in item[1])


def _load(items) -> tuple:
    return tuple(("+", _load(x[1])) if isinstance(x, list) else x for x in items)


def expression(wrapper: str) -> str:
    """The wrapper as a readable union-free regular expression."""
    w = json.loads(wrapper)
    show = lambda x: "".join(map(show, x[1])).join(("(", ")+")) if isinstance(x, (list, tuple)) else ("#text" if x == TEXT else f"<{x}>")
    out, k, items = [], 0, w["items"]
    while k < len(items):
        g, j = w["groups"][k], k
        while j < len(items) and w["groups"][j] == g and (g or j == k):
            j += 1
        body = "".join(show(x) for x in items[k:j])
        out.append(f"({body})?" if g else body)
        k = j
    return "".join(out)


def _hash(text: str) -> int:
    return (xxhash.xxh64_intdigest(text) >> 1) or 1


def _summaries(batches):
    """Per batch and host, each distinct folded stream once, with the hashes of
    the texts that are the same on all its pages (0: they differ)."""
    symbols, memo = Symbols(), {}
    for batch in batches:
        groups: dict[tuple[str, str], list] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            if len(symbols.char) > MANY:
                symbols, memo = Symbols(), {}
            s, texts, _ = page_tokens(page.as_py(), symbols, frozenset())
            if s not in memo:
                if len(memo) > 20000:
                    memo.clear()
                text, widths = fold(s, symbols)
                slots, at, tops = [], 0, []
                for c, width in zip(text, widths):
                    n = s.count(TEXT, at, at + width)
                    if c == TEXT:
                        tops.append(len(slots))
                    slots += [0] * n
                    at += width
                memo[s] = json.dumps(symbols.items(text), separators=(",", ":")), tops
            signature, tops = memo[s]
            hashes = [_hash(texts[k]) for k in tops]
            entry = groups.get((host, signature))
            if entry is None:
                groups[host, signature] = [1, hashes]
            else:
                entry[0] += 1
                entry[1] = [a if a == b else 0 for a, b in zip(entry[1], hashes)]
        rows = [(h, s, n, x) for (h, s), (n, x) in groups.items()]
        cols = list(zip(*rows)) or [(), (), (), ()]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["host", "signature", "pages", "hashes"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from pages (host, html). Streams are folded and counted
    where they are read; what is shuffled are distinct streams per host."""
    partial = pages.select("host", "html").mapInArrow(_summaries, "host string, signature string, pages long, hashes array<long>")
    slots = partial.select("host", "signature", "pages", F.posexplode_outer("hashes").alias("pos", "hash"))
    merged = slots.groupBy("host", "signature", "pos").agg(F.sum("pages").alias("pages"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    lists = merged.groupBy("host", "signature").agg(
        F.max("pages").alias("pages"),
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(0).alias("hash"), "pages")))).alias("slots"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pages", "signature"], ascending=[False, True])
        rows = []
        for signature, n, slots in zip(pdf["signature"], pdf["pages"], pdf["slots"]):
            rows.append((signature, [int(x["hash"]) for x in slots], int(n), [int(x["pages"]) for x in slots]))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [infer(rows)]})

    return lists.groupBy("host").applyInPandas(run, "host string, wrapper string")


class Matcher:
    """Matches pages to a wrapper; remembers what it found for each stream."""

    def __init__(self, wrapper: str | None, symbols: Symbols) -> None:
        w = json.loads(wrapper) if wrapper else {"plain": False, "items": [], "units": [], "const": []}
        self.symbols, self.const, self.plain = symbols, w["const"], w["plain"]
        self.items = symbols.text_of(_load(w["items"]))
        self.units, self.memo = [x for x in _load(w["units"])], {}

    def constants(self, s: str) -> list[int]:
        """Of each text of the stream the hash that makes it template, or 0."""
        if s not in self.memo:
            text, widths = fold(s, self.symbols)
            if self.units:
                text, widths = fold_known(text, widths, self.units, self.symbols)
            place, at, out = dict((q, p) for p, q in align(self.items, text)), 0, []
            for k, (c, width) in enumerate(zip(text, widths)):
                n = s.count(TEXT, at, at + width)
                out += [self.const[place[k]] if c == TEXT and k in place else 0] * n
                at += width
            if len(self.memo) > 5000:
                self.memo.clear()
            self.memo[s] = out
        return self.memo[s]


def _extracted(aside_classes: frozenset):
    def run(batches):
        symbols, matchers = Symbols(), {}
        for batch in batches:
            out: list[list] = [[], [], []]
            for wrapper, page in zip(batch.column(3).to_pylist(), batch.column(2)):
                if not page.is_valid:
                    row = (None, None, None)
                else:
                    if len(symbols.char) > MANY:
                        symbols, matchers = Symbols(), {}
                    m = matchers.get(wrapper)
                    if m is None:
                        if len(matchers) > 500:
                            matchers.clear()
                        m = matchers[wrapper] = Matcher(wrapper, symbols)
                    s, texts, aside = page_tokens(page.as_py(), symbols, aside_classes, m.plain)
                    data = [not c or c != _hash(t) for c, t in zip(m.constants(s), texts)]
                    row = ("\n".join(t for t, d, a in zip(texts, data, aside) if d and not a), sum(data), len(texts) - sum(data))
                for c, x in zip(out, row):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["page_id", "host", "text", "n_data", "n_template"])

    return run


def extract_text(pages: DataFrame, aside_classes: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, host, text, n_data, n_template): each page's content.

    The token streams of a host's pages are aligned into a wrapper, a regular
    expression without unions: repetitions become repeated groups, mismatches
    optional groups, differing texts slots. A text that all pages of a host
    that have text share in its slot (two pages at least) is template, and so
    is one that all pages with its optional group share, if they are a fifth of
    the host's and differ in each slot in which the host's pages do (copies of
    a page don't); the others are data.
    The text of a page is its data outside of nav, footer, aside and head, a
    line per slot; classes are not judged, unless aside_classes names some
    whose elements are left out too. Such an element ends at its end tag or
    where HTML implies it (a sibling, the parent's end, what can't stand in a
    head), and before an article or main; html, body and elements that are
    always empty are none. All pages of a host take part in its wrapper, each
    distinct stream once; equally frequent ones in order of their tokens.

    A null html gives a null text and null counts; an empty one, or one without
    data, an empty text. A null url, or one without a host, has host null and
    no wrapper: all its texts are data, as for a host of one page or of equal
    pages. Rows that repeat a page_id are pages each, and have a row each. Long
    pages are taken whole; a page, or a host, with more than 250000 distinct
    tags with their classes is compared by tag names. An empty table gives an
    empty one; other columns aren't read, whatever their names.
    """
    url = F.col("url").cast("string")
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.col("html").cast("string").alias("html"))
    known = written(wrappers(base.where("host IS NOT NULL AND html IS NOT NULL")), "wrappers")
    side = measured(known.withColumnRenamed("host", "of"))
    joined = base.join(side, F.col("host") == F.col("of"), "left").select("page_id", "host", "html", "wrapper")
    return joined.mapInArrow(_extracted(frozenset(aside_classes)), "page_id long, host string, text string, n_data int, n_template int")
