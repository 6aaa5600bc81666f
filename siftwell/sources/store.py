"""The index on disk: Parquet tables whose hashes and rows change together."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.overview import stats
from ..operators.postings import postings, top_terms
from ..schema import DEFINITIONS, FILE_NODES, REFS

POSTINGS = DEFINITIONS + ", part int, key string, key_entry long, key_part int"
TABLES = {"definitions": DEFINITIONS, "refs": REFS, "files": "path string, size long, mtime timestamp, hash string", "nodes": FILE_NODES, "postings": POSTINGS}


class Store:
    """Versions of an index below a folder. A version is complete once its name
    is in the CURRENT file, written last; readers see whole versions only."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _filesystem(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> str | None:
        path, fs = self._filesystem("CURRENT")
        if not fs.exists(path):
            return None
        return self.spark.read.text(str(path.toString())).first()[0]

    def save(self, **tables: DataFrame) -> str:
        """Write a new version; tables that aren't given are carried over.

        Postings are derived from the definitions as they were written, in
        ranges of keys, so that the statistics in their files let a search by
        key or prefix skip most of them."""
        name, old = f"v-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}", self.version()
        for table in TABLES:
            df = tables.get(table)
            if table == "postings" and "definitions" in tables:
                schema = self.spark.createDataFrame([], DEFINITIONS).schema
                written = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/definitions")
                df = postings(written).repartitionByRange("key").sortWithinPartitions("key", "entry_seq")
            elif df is None and old:
                df = self.load(table)
            if df is not None:
                writer = df.write.mode("overwrite")
                (writer.partitionBy("language") if table == "definitions" else writer).parquet(f"{self.folder}/{name}/{table}")
        path, fs = self._filesystem("CURRENT")
        out = fs.create(path, True)
        out.write(bytearray(name.encode()))
        out.close()
        return name

    def load(self, table: str) -> DataFrame:
        """A table of the current version; empty if there is none."""
        version = self.version()
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        if version is None:
            return self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{version}/{table}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def exists(self) -> bool:
        return self.version() is not None and not self.load("definitions").isEmpty()

    def clear(self) -> None:
        path, fs = self._filesystem("CURRENT")
        fs.delete(path, False)

    def summary(self) -> dict:
        """Counts and most frequent keys, as a report."""
        d = self.load("definitions")
        row = stats(d).first().asDict()
        return {"type": "summary", "stats": row, "timestamp": int(time.time() * 1000), "topTerms": [list(r) for r in top_terms(postings(d)).collect()], "fileCount": row["total_files"], "version": self.version()}


def save_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_report(spark: SparkSession, report: dict, folder: str) -> str:
    """One report under a name that holds its time."""
    path = f"{folder.rstrip('/')}/report-{time.strftime('%Y%m%dT%H%M%S')}-{uuid.uuid4().hex[:6]}"
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.text(path)
    return path


def append_log(df: DataFrame, path: str) -> None:
    """Adds a text column's rows to a log folder."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.mode("append").text(path)
