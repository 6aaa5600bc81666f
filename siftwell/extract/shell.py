"""Shell scripts."""

from __future__ import annotations

import re

from .base import DOUBLE, SINGLE, Rows, compiled

BUILT_IN = frozenset(
    """. [ [[ alias bg break case cd continue declare do done echo elif else esac eval exec exit export false fg fi for function
    getopts hash help history if jobs kill let local popd printf pushd pwd read readonly return set shift source test then time
    times trap true type typeset ulimit umask unalias unset until wait while""".split()
)
COMMON = frozenset(
    """apt apt-get awk base64 bc brew bun bundler bunx bunzip2 bzip2 cal cargo cat chgrp chmod chown clang clear comm composer cp
    cron crontab csplit curl cut date dd df diff disown dmesg dnf du env expr fdisk file find finger fsck ftp g++ gcc gem git go
    grep groupadd groups gunzip gzip head hostname hostnamectl htop id ifconfig info ip java javac join journalctl killall last
    lastlog ldconfig less ln locale localectl logout ls lsof make man md5sum mkdir mkfs more mount mv nc netcat netstat nice nl
    node nohup npm npx nproc od pacman parallel passwd paste patch perl pgrep php ping pip pkill pnpm pnpx printenv ps python
    python3 reboot renice reset rm rmdir rsync ruby rustc scp sed service sftp sha1sum sha256sum sha512sum shutdown sleep sort
    split ss ssh stat strace su sudo swift sync systemctl tac tail tar tee telnet timedatectl timeout top touch tr umount uname
    uniq unzip update-alternatives useradd userdel w watch wc wget whereis which who whoami xargs xz yarn yum zip zypper""".split()
)
_WORDS = frozenset("after at be before by from in into is it of on over to with".split())
_WELL_KNOWN = re.compile(r"(BASH_\w*|COLUMNS|FUNCNAME|HOME|HOSTNAME|IFS|LANG|LINENO|LINES|MACHTYPE|OLDPWD|OPTARG|OPTIND|OSTYPE|PATH|PS[1-4]|PWD|RANDOM|REPLY|SECONDS|SHELL|SHLVL|TERM|USER|ZSH_\w*)")
_HEREDOC = compiled(r"<<~-?~(QUOTE?)([A-Za-z_]+)\1")
_FUNCTION = compiled(r"~(?:function )?(NAME)~\(~\)~(?:\{.*)?$|~function (NAME)~\{")
_VARIABLE = compiled(r"~(?:export |readonly |local )?(NAME)=(.*)$")
_ALIAS = compiled(r"~alias ([\w-]+)=QUOTE(REST)QUOTE")
_SOURCE = compiled(r"~(?:source|\.) QUOTE?((?:(?!QUOTE)\S)+)")
_COMMAND = compiled(r"~([A-Za-z_][\w-]+)(?:~\(~\)|~$| [^=|&<>\s])")
_SUBSTITUTED = [compiled(r"\$\(([A-Za-z_][\w-]+)(?=[\s)])"), compiled(r"`([A-Za-z_][\w-]+)(?=[\s`])")]
_USED = compiled(r"\$\{?([A-Za-z_]\w+)\}?")
_CASE = compiled(r"~case (REST) in~$")
_LOOP = compiled(r"~(until|for|while) (REST)")
_OPTIONS = compiled(r"~while getopts QUOTE(UNQUOTED)QUOTE")
_TRAP = compiled(r"~trap QUOTE(UNQUOTED)QUOTE (REST)")


def meaningful(value: str) -> bool:
    return len(value) >= 3 and not re.fullmatch(r"-+|[0-9]+", value) and not (re.fullmatch(r"[A-Z_]+", value) and len(value) < 10)


def clean(value: str) -> str:
    value = re.sub(r"""^["']|["']$""", "", value)
    return re.sub(r"\$\([^)]+\)", "", re.sub(r"\$\{[^}]+\}", "", value)).strip()


def extract(content: str, path: str) -> Rows:
    rows = Rows("shell", content)
    if rows.lines[0].startswith("#!") and "sh" not in rows.lines[0]:
        return rows
    ending = None
    for at, line in enumerate(rows.lines, 1):
        text = line.strip()
        if not text:
            continue
        if ending is not None:
            if text == ending:
                ending = None
            continue
        m = _HEREDOC.search(line)
        if m and "<<<" not in line:
            ending = m.group(2)
        if text.startswith("#"):
            comment = text[1:].strip()
            if not text.startswith("#!") and len(comment) > 5:
                rows.comment(comment, at)
            continue
        m = _FUNCTION.match(line)
        if m:
            rows.define(m.group(1) or m.group(2), "function", at, related=["function", "shell"], surrounding=rows.around(at))
        m = _VARIABLE.match(line)
        if m and "$(" not in m.group(2) and "${" not in m.group(2):
            name, value = m.group(1), clean(m.group(2))
            rows.define(name, "constant" if name == name.upper() else "variable", at, context=f"{name}={value}", related=["export", "environment"] if "export" in line else ["variable"])
            if meaningful(value):
                rows.define(value, "string", at, line.index("=") + 1, context=f"{name}={m.group(2)}", related=[name])
        m = _ALIAS.match(line)
        if m:
            rows.define(m.group(1), "function", at, context=f'alias {m.group(1)}="{m.group(2)}"', related=["alias", "command"])
        m = _SOURCE.match(line)
        if m:
            rows.define(m.group(1), "import", at, related=["source", "import"])
            rows.refer(m.group(1), "import", at)
        m = _COMMAND.match(line)
        if m and len(m.group(1)) > 2 and m.group(1) not in BUILT_IN | COMMON | _WORDS:
            rows.refer(m.group(1), "call", at)
        for pattern in _SUBSTITUTED:
            rows.calls(at, pattern, skip=lambda x: len(x) <= 3 or x in BUILT_IN | COMMON)
        rows.calls(at, _USED, "usage", skip=lambda x: len(x) <= 3 or _WELL_KNOWN.fullmatch(x))
        m = _CASE.match(line)
        if m:
            rows.define(f"case {m.group(1)}", "function", at, related=["case", "pattern", "matching"], surrounding=rows.around(at))
        m = _LOOP.match(line)
        if m:
            rows.define(f"{m.group(1)} loop", "function", at, related=[m.group(1), "loop", "iteration"], surrounding=rows.around(at))
        m = _OPTIONS.match(line)
        if m:
            rows.define(f"Options: {m.group(1)}", "constant", at, context="Command-line options", related=["getopts", "options", "arguments"])
        m = _TRAP.match(line)
        if m:
            rows.define(f"trap {m.group(2)}", "function", at, context=f"Signal handler: {m.group(1)}", related=["trap", "signal", "handler"])
        rows.strings(at, [DOUBLE, SINGLE], lambda x: meaningful(x) and "$" not in x)
    return rows
