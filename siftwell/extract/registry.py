"""Which extractor reads a file, and the extraction of a table of files."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import file_format, python_format
from . import config, framework, go, python, rust, shell, swift, typescript
from .base import Rows

#: Format to extractor; more can be added before a job starts.
EXTRACTORS: dict[str, Callable[[str, str], Rows]] = {
    "framework": framework.extract, "typescript": typescript.extract, "python": python.extract, "go": go.extract, "rust": rust.extract, "swift": swift.extract,
    "shell": shell.extract, "json": config.extract_json, "yaml": config.extract_yaml, "toml": config.extract_toml, "env": config.extract_env,
}

_TAGGED = (
    "tag string, file string, seq int, term string, type string, line int, column int, context string, "
    "surrounding_lines array<string>, related_terms array<string>, language string, metadata string"
)


def extract_file(path: str, content: str) -> Rows | None:
    """Definitions and references of one file; None if no extractor reads it."""
    kind = python_format(path)
    return EXTRACTORS[kind](content, path) if kind in EXTRACTORS else None


def _tagged(extractors: dict):
    kinds = pa.schema([("tag", pa.string()), ("file", pa.string()), ("seq", pa.int32()), ("term", pa.string()), ("type", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("context", pa.string()), ("surrounding_lines", pa.list_(pa.string())), ("related_terms", pa.list_(pa.string())), ("language", pa.string()), ("metadata", pa.string())])

    def run(batches):
        for batch in batches:
            out: list[dict] = []
            for path, kind, content in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    rows = extractors[kind](content, path)
                except Exception as e:  # a file that can't be read must not end the job; it is reported
                    out.append({"tag": "error", "file": path, "seq": 0, "term": f"{type(e).__name__}: {e}"[:500], "language": kind})
                    continue
                for k, d in enumerate(rows.definitions):
                    out.append({"tag": "definition", "file": path, "seq": k, **d})
                for k, r in enumerate(rows.references):
                    out.append({"tag": "reference", "file": path, "seq": k, "term": r["target_term"], "type": r["reference_type"], "line": r["line"], "column": r["column"], "context": r["context"], "metadata": r["metadata"]})
                if len(out) > 5000:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out = []
            yield pa.RecordBatch.from_pylist(out, kinds)

    return run


def extracted(files: DataFrame) -> DataFrame:
    """All rows of files (path, content), tagged definition, reference or error.
    Persist or write it before splitting it, or the files are read twice."""
    read = files.select("path", file_format(F.col("path")).alias("format"), "content").where(F.col("format").isin(*EXTRACTORS) & F.col("content").isNotNull())
    return read.mapInArrow(_tagged(EXTRACTORS), _TAGGED)


def _ordinal() -> F.Column:
    """An order by file, then by order in the file: 40 bits of the file's hash
    and 23 of the position, so that no global sort is needed."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64("file"), 24), 23) + F.col("seq")


def definitions(tagged: DataFrame) -> DataFrame:
    return tagged.where("tag = 'definition'").select(_ordinal().alias("entry_seq"), "term", "type", "file", "line", "column", "context", "surrounding_lines", "related_terms", "language", "metadata")


def references(tagged: DataFrame) -> DataFrame:
    return tagged.where("tag = 'reference'").select(_ordinal().alias("ref_seq"), F.col("term").alias("target_term"), F.col("type").alias("reference_type"), "file", "line", "column", "context", "metadata")


def errors(tagged: DataFrame) -> DataFrame:
    return tagged.where("tag = 'error'").select("file", F.col("language").alias("format"), F.col("term").alias("message"))


class ExtractDefinitions:
    """UDTF extract_definitions(path, content) for lateral joins in SQL."""

    def eval(self, path: str, content: str):
        rows = extract_file(path, content) if content is not None else None
        for d in rows.definitions if rows else ():
            yield d["term"], d["type"], d["line"], d["column"], d["context"], d["language"]


class ExtractReferences:
    """UDTF extract_references(path, content) for lateral joins in SQL."""

    def eval(self, path: str, content: str):
        rows = extract_file(path, content) if content is not None else None
        for r in rows.references if rows else ():
            yield r["target_term"], r["reference_type"], r["line"], r["column"], r["context"]


def register(spark) -> None:
    """Makes both table functions known to a session's SQL."""
    spark.udtf.register("extract_definitions", F.udtf(ExtractDefinitions, returnType="term string, type string, line int, column int, context string, language string"))
    spark.udtf.register("extract_references", F.udtf(ExtractReferences, returnType="target_term string, reference_type string, line int, column int, context string"))


def transformed(files: DataFrame, apply: Callable[[str, str], str | None]) -> DataFrame:
    """(path, result) of a function over files (path, content); a file on which
    it fails has no row."""

    def run(batches):
        for batch in batches:
            paths, results = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    result = apply(path, content)
                except Exception:  # left out, as the contract says
                    continue
                paths.append(path)
                results.append(result)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(results, pa.string())], ["path", "result"])

    return files.select("path", "content").mapInArrow(run, "path string, result string")
