"""Built-in concept groups and abbreviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import CONCEPT_GROUPS

GROUPS: dict[str, tuple[str, str]] = {
    "auth": ("Signing in and what one may do", "auth authenticate login signin credential token oauth jwt session password permission role access"),
    "database": ("Stored data and queries", "db database query sql mongo redis orm migration schema model repository storage"),
    "cache": ("Data kept for reuse", "cache memo store persist temporary ttl expire invalidate buffer memory"),
    "api": ("Interfaces over a network", "api endpoint route request response controller handler rest graphql webhook rpc"),
    "error": ("Failures and their handling", "error exception fail invalid warning catch throw reject status bug issue problem"),
    "user": ("People and accounts", "user account profile member customer person client subscriber admin guest"),
    "payment": ("Money", "payment billing charge invoice transaction stripe paypal subscription refund price"),
    "config": ("Settings", "config setting environment env constant variable option preference parameter flag"),
    "test": ("Tests and doubles", "test spec mock fixture assert expect describe it jest vitest unit integration"),
    "async": ("Work in the background", "async await promise then catch finally callback resolve reject concurrent parallel"),
    "service": ("Services and helpers", "service provider manager orchestrator handler processor worker helper utility"),
    "flow": ("Processes in steps", "flow stream pipeline process workflow sequence chain step stage phase"),
    "architecture": ("Structure of a system", "architecture pattern structure design layer module component system framework"),
    "import": ("Modules and dependencies", "import export require module dependency package library from default"),
    "interface": ("Types and contracts", "interface type contract protocol schema definition spec api abstract"),
    "state": ("State and its scope", "state store redux context global local session memory data"),
    "event": ("Events and messages", "event emit listen subscribe publish trigger dispatch broadcast handler"),
    "logging": ("Logs and telemetry", "log logger console debug info warn error trace monitor telemetry"),
    "security": ("Protection of data", "security encrypt decrypt hash salt certificate ssl tls cors xss csrf"),
    "build": ("Building and bundling", "build compile bundle webpack rollup vite esbuild transpile minify"),
    "deploy": ("Releases and hosting", "deploy release publish ci cd docker kubernetes server host production"),
    "devmarkers": ("Notes that developers leave", "TODO FIXME HACK XXX BUG OPTIMIZE REFACTOR NOTE REVIEW DEPRECATED WORKAROUND TEMP KLUDGE SMELL"),
}

#: In order; one abbreviation may stand for several words.
ABBREVIATIONS: dict[str, list[str]] = {
    line.split(":")[0].strip(): line.split(":")[1].split()
    for line in """
    auth: authenticate authorization authorized
    config: configuration configure
    db: database
    ctx: context
    req: request require
    res: response result
    err: error
    msg: message
    usr: user
    pwd: password
    mgr: manager
    ctrl: controller control
    svc: service
    repo: repository
    util: utility utilities
    lib: library
    pkg: package
    proc: process processor
    exec: execute execution
    init: initialize initialization
    """.strip().splitlines()
}
BOUNDARY_PREFIXES = "get set is has create update delete handle process".split()
GENERIC_NAMES = "file path data value result item".split()


def variations(query: str) -> list[str]:
    """Words that a lower-case query may abbreviate or begin."""
    words = list(ABBREVIATIONS.get(query, []))
    if len(query) >= 3:
        words += [w for many in ABBREVIATIONS.values() for w in many if w.startswith(query)]
    return list(dict.fromkeys(words))


def custom_groups(config: dict) -> dict[str, tuple[str, str]]:
    """Groups from a configuration's customGroups: a list of terms, or an object
    with terms and perhaps a description."""
    out = {}
    for name, value in (config.get("customGroups") or {}).items():
        terms, about = (value, None) if isinstance(value, list) else (value.get("terms") or [], value.get("description"))
        out[name] = (about or f"Custom group: {name}", " ".join(terms))
    return out


def all_groups(config: dict | None = None) -> dict[str, list[str]]:
    """Name to terms; a custom group replaces a built-in one of its name."""
    merged = GROUPS | custom_groups(config or {})
    return {k: v[1].split() for k, v in merged.items()}


def group_terms(name: str, config: dict | None = None) -> list[str] | None:
    return all_groups(config).get(name)


def groups_table(spark: SparkSession, config: dict | None = None) -> DataFrame:
    custom = custom_groups(config or {})
    rows = [(k, v[0], None, v[1].split(), "custom" if k in custom else "built-in") for k, v in (GROUPS | custom).items()]
    return spark.createDataFrame(rows, CONCEPT_GROUPS)


def add_group(config: dict, name: str, terms: list[str]) -> dict:
    return config | {"customGroups": (config.get("customGroups") or {}) | {name: terms}}


def remove_group(config: dict, name: str) -> dict:
    """Without a custom group; a built-in one can't be removed."""
    custom = dict(config.get("customGroups") or {})
    if name not in custom:
        raise KeyError(f"no custom group {name}")
    del custom[name]
    return config | {"customGroups": custom}
