"""Changes of a working tree."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..operators.changes import staged_wins
from ..schema import CHANGES


def parse_status(text: str, staged: bool, start: int = 0) -> list[tuple[str, str, bool, int]]:
    """Rows of `git diff --name-status` output; a rename counts by its old path."""
    out = []
    for k, line in enumerate(x for x in text.splitlines() if "\t" in x):
        status, path = line.split("\t")[:2]
        out.append((path, status[:1], staged, start + k))
    return out


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """Staged and unstaged changes, each path once."""
    git = lambda *a: subprocess.run(["git", "-C", folder, "diff", "--name-status", *a], capture_output=True, text=True, check=True).stdout
    rows = parse_status(git("--cached"), True)
    rows += parse_status(git(), False, len(rows))
    return staged_wins(spark.createDataFrame(rows, CHANGES))
