"""Text helpers as Column expressions (all JVM-side)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKERS = "TODO FIXME HACK XXX BUG OPTIMIZE REFACTOR NOTE REVIEW DEPRECATED WORKAROUND TEMP KLUDGE SMELL".split()
_ANY_MARKER = "|".join(MARKERS)

KEYWORDS: dict[str, frozenset[str]] = {
    "python": frozenset(
        """False None True and as assert async await break class continue def del elif else except finally for from global
        if import in is lambda nonlocal not or pass raise return try while with yield self super int str float list dict set
        tuple bool print len range type isinstance enumerate zip map filter""".split()
    ),
    "go": frozenset(
        """append bool break byte cap case chan close complex const continue copy default defer delete else error fallthrough
        false float32 float64 for func go goto if imag import int int16 int32 int64 int8 interface len make map new nil
        package panic print println range real recover return rune select string struct switch true type uint uint16 uint32
        uint64 uint8 uintptr var""".split()
    ),
    "rust": frozenset(
        """as async await bool break char const continue crate dyn else enum extern f32 f64 false fn for i128 i16 i32 i64 i8
        if impl in isize let loop match mod move mut pub ref return self Self static str String struct super trait true type
        u128 u16 u32 u64 u8 unsafe use usize Vec Option Result Box Some None Ok Err where while""".split()
    ),
    "swift": frozenset(
        """Any AnyObject Array Bool Character Dictionary Double Float Int Optional Result Set String Void as associatedtype
        async await break case catch class continue default defer deinit do else enum extension fallthrough false
        fileprivate for func guard if import in init inout internal is let nil open operator precedencegroup private
        protocol public repeat rethrows return self Self static struct subscript super switch throw throws true try
        typealias var where while""".split()
    ),
    "typescript": frozenset(
        """any array async await boolean break case catch class const continue default delete else enum export extends false
        finally for function if implements import in instanceof interface let new null number object private protected
        public return static string super switch this throw true try type typeof undefined var void while with yield""".split()
    ),
}
IDENTIFIER = {"typescript": r"[A-Za-z_$][\w$]*"}


def meaningful(value: Column) -> Column:
    """Worth indexing as a string: more than a number or a short constant, with
    a blank, slash or dot, or longer than 10."""
    data = value.rlike("^[0-9]+$") | (value.rlike("^[A-Z_]+$") & (F.length(value) < 10))
    return ~data & (value.contains(" ") | value.contains("/") | value.contains(".") | (F.length(value) > 10))


def meaningful_shell(value: Column) -> Column:
    return ~(value.rlike("^[0-9]+$") | (F.length(value) < 3))


def meaningful_json(value: Column) -> Column:
    data = value.rlike("^[0-9]+$") | (value.rlike("^[A-Z_]+$") & (F.length(value) < 10))
    marks = value.contains(" ") | value.contains("/") | value.contains(".") | value.contains("-")
    return ~data & (marks | (F.length(value) > 15))


def identifiers(text: Column, language: str = "python") -> Column:
    """Distinct identifiers longer than 2 in order of appearance, without the
    language's keywords."""
    pattern = IDENTIFIER.get(language, r"[A-Za-z_]\w*")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.filter(F.array_except(found, F.array(*[F.lit(k) for k in sorted(KEYWORDS[language])])), lambda x: F.length(x) > 2)


def marker(comment: Column) -> Column:
    """The marker a comment starts with, in capitals; null without one."""
    return F.upper(F.nullif(F.regexp_extract(comment, rf"(?i)^\s*({_ANY_MARKER})\b", 1), F.lit("")))


def markers(text: Column) -> Column:
    """All markers in a text, in capitals, distinct, as they first appear."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)\b({_ANY_MARKER})\b"), F.lit(1)), F.upper))


#: Parts of a name that mark its value as secret.
SENSITIVE = "AUTH CREDENTIAL KEY PASSWORD PRIVATE SECRET SIGN TOKEN".split()
_SENSITIVE = "(?i)(" + "|".join(SENSITIVE) + ")"


def sensitive(name: Column) -> Column:
    return name.rlike(_SENSITIVE)


def masked(name: Column, value: Column) -> Column:
    """A sensitive variable's value, longer than 8: its first 4 characters and
    ****, else **** alone; other values as they are."""
    hidden = F.when(F.length(value) > 8, F.concat(F.left(value, F.lit(4)), F.lit("****"))).otherwise(F.lit("****"))
    return F.when(sensitive(name), hidden).otherwise(value)


def _rule(starts: str = "", holds: str = "", equals: str = "") -> str:
    parts = [f"^({'|'.join(starts.split())})_"] if starts else []
    return "|".join(parts + holds.split() + [f"^{x}$" for x in equals.split()])


#: (category, pattern of the name, pattern of the value): the first that finds
#: either names the category of an environment variable.
ENV_CATEGORIES = [
    ("database", _rule("DATABASE DB MONGO MYSQL POSTGRES REDIS", "_DB_", "DATABASE_URL"), None),
    ("api", _rule("API ENDPOINT HOST URI URL", "_API _URL"), "https?://"),
    ("auth", _rule("AUTH JWT KEY OAUTH PASSWORD SECRET TOKEN", "_KEY _PASSWORD _SECRET _TOKEN"), None),
    ("aws", _rule("AWS", "_AWS_"), None),
    ("email", _rule("EMAIL MAIL SMTP", "_MAIL_"), None),
    ("network", _rule(holds="HOST PORT"), None),
    ("feature", _rule("DISABLE ENABLE FEATURE FLAG USE", "_DISABLED _ENABLED"), None),
    ("logging", _rule("DEBUG LOG VERBOSE", "_LOG", "NODE_ENV"), None),
    ("path", _rule(holds="DIR PATH"), "/"),
]

#: (pattern of the name, terms related to it) and the same for values.
ENV_TERMS = [
    ("^NODE_ENV$", "environment node"), ("^PORT$", "server port"), ("REACT_APP", "react frontend"), ("NEXT_PUBLIC", "nextjs frontend"),
    ("VITE_", "vite frontend"), ("VUE_APP", "vue frontend"), ("STRIPE", "stripe payment"), ("SENDGRID", "sendgrid email"), ("TWILIO", "twilio sms"), ("SENTRY", "sentry monitoring"),
]
ENV_VALUE_TERMS = [("^(true|false)$", "boolean flag"), ("^[0-9]+$", "number"), ("localhost", "local development")]


def env_category(name: Column, value: Column) -> Column:
    out = F.lit("config")
    for label, pattern, content in reversed(ENV_CATEGORIES):
        hit = name.rlike(pattern) | value.rlike(content) if content else name.rlike(pattern)
        out = F.when(hit, label).otherwise(out)
    return out


def env_terms(name: Column, value: Column) -> Column:
    """Terms that a variable's name and value suggest, in rule order."""
    parts = [F.when(c.rlike(p), F.array(*[F.lit(x) for x in terms.split()])).otherwise(F.array().cast("array<string>")) for c, rules in ((name, ENV_TERMS), (value, ENV_VALUE_TERMS)) for p, terms in rules]
    return F.concat(*parts)


def url_host(value: Column) -> Column:
    return F.try_parse_url(value, F.lit("HOST"))


def unquoted(value: Column) -> Column:
    """Without surrounding quotes, ${...} and $(...)."""
    plain = F.regexp_replace(F.trim(value), r"""^(["'])(.*)\1$""", "$2")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\$\{[^}]*\}", ""), r"\$\([^)]*\)", ""))


def preview(value: Column, size: int) -> Column:
    return F.when(F.length(value) > size, F.concat(F.left(value, F.lit(size)), F.lit("..."))).otherwise(value)


def pascal_case(name: Column) -> Column:
    """my-card becomes MyCard."""
    return F.array_join(F.transform(F.split(name, "-"), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))), "")


def exported_names(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"export\s+(?:class|const|function|let)\s+(\w+)"), F.lit(1))


def short_path(path: Column) -> Column:
    """The last two segments."""
    return F.substring_index(path, "/", -2)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """All before the last slash; . where there is none."""
    head = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(head == "", ".").otherwise(head)


def line_of(content: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    before = F.left(content, offset)
    return F.length(before) - F.length(F.translate(before, "\n", "")) + 1


def human_bytes(size: Column) -> Column:
    """1.5 KB and the like, in steps of 1024."""
    out = F.format_string("%.1f GB", size / float(1 << 30))
    for unit, factor in (("MB", 1 << 20), ("KB", 1 << 10)):
        out = F.when(size < factor << 10, F.format_string(f"%.1f {unit}", size / float(factor))).otherwise(out)
    return F.when(size < 1024, F.format_string("%d B", size)).otherwise(out)


def human_duration(millis: Column) -> Column:
    """2h 5m, 3m 20s or 7s."""
    s = F.floor(millis / 1000).cast("long")
    h, m = (s / 3600).cast("long"), ((s / 60).cast("long")) % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def surrounding(lines: Column, line: Column, before: int, after: int) -> Column:
    """Lines around a 1-based line of an array, blanks trimmed."""
    start = F.greatest(F.lit(1), line - before)
    # not F.trim itself: transform() would give its second parameter the line's index, as the characters to trim
    return F.transform(F.slice(lines, start, F.least(F.size(lines), line + after) - start + 1), lambda x: F.trim(x))


def padded(value: Column, width: int) -> Column:
    """Filled with blanks to width, never cut."""
    return F.when(F.length(value) < width, F.rpad(value, width, " ")).otherwise(value)


_ICONS = {"python": "🐍", "typescript": "🔷", "javascript": "🟨", "go": "🐹", "rust": "🦀", "swift": "🦉", "shell": "🐚", "json": "📋", "yaml": "📝", "toml": "⚙️", "env": "🔐", "vue": "💚", "svelte": "🧡", "astro": "🚀", "mdx": "📄"}
_TYPES = {"function": "ƒ", "class": "◆", "interface": "◇", "variable": "v", "constant": "c", "import": "↓", "string": "s", "comment": "#", "module": "▣"}


def _lookup(table: dict[str, str], key: Column, default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def language_icon(language: Column) -> Column:
    return _lookup(_ICONS, language, "📄")


def type_icon(kind: Column) -> Column:
    return _lookup(_TYPES, kind, "•")


def python_env_category(name: str, value: str) -> str:
    return next((label for label, p, c in ENV_CATEGORIES if re.search(p, name) or c and re.search(c, value)), "config")


def python_env_terms(name: str, value: str) -> list[str]:
    return [x for text, rules in ((name, ENV_TERMS), (value, ENV_VALUE_TERMS)) for p, terms in rules if re.search(p, text) for x in terms.split()]


def python_masked(name: str, value: str) -> str:
    if not value or not re.search(_SENSITIVE, name):
        return value
    return value[:4] + "****" if len(value) > 8 else "****"


def python_marker(text: str) -> str | None:
    """marker() for code that runs in Python."""
    m = re.match(rf"\s*({_ANY_MARKER})\b", text, re.I)
    return m.group(1).upper() if m else None


def python_markers(text: str) -> list[str]:
    return list(dict.fromkeys(m.upper() for m in re.findall(rf"\b({_ANY_MARKER})\b", text, re.I)))


def python_meaningful(value: str) -> bool:
    if re.fullmatch(r"[0-9]+", value) or re.fullmatch(r"[A-Z_]+", value) and len(value) < 10:
        return False
    return " " in value or "/" in value or "." in value or len(value) > 10


def python_identifiers(text: str, language: str) -> list[str]:
    found = re.findall(IDENTIFIER.get(language, r"[A-Za-z_]\w*"), text, re.ASCII)
    return [x for x in dict.fromkeys(found) if len(x) > 2 and x not in KEYWORDS[language]]
