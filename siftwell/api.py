"""The engine behind one object."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract import registry
from .functions.groups import all_groups, groups_table
from .operators import changes as C
from .operators import overview, references, search, tree
from .plans import grammar
from .sources import files, git
from .sources.store import Store


class Engine:
    """An index of one tree, kept in a store folder."""

    def __init__(self, spark: SparkSession, root: str, store: str, config: dict | None = None) -> None:
        self.spark, self.root = spark, root
        self.store = Store(spark, store)
        self.config = config if config is not None else files.load_config(root)
        self._flight = tree.SingleFlight()

    def index(self) -> dict:
        """Build the index anew."""
        listed = files.listing(self.spark, self.root, self.config)
        read = files.contents(self.spark, self.root, listed).persist()
        tagged = registry.extracted(read).persist()
        try:
            self.store.save(definitions=registry.definitions(tagged), refs=registry.references(tagged), files=read.select("path", "size", "mtime", "hash"), nodes=tree.file_nodes(read).withColumn("mtime", F.lit(None).cast("timestamp")))
        finally:
            tagged.unpersist()
            read.unpersist()
        return self.stats()

    def refresh(self) -> bool:
        """Bring the index up to date; whether anything changed. Calls that
        overlap share one run."""
        return self._flight(self._refresh)

    def _refresh(self) -> bool:
        if not self.store.exists():
            self.index()
            return True
        known = self.store.load("files")
        listed = files.listing(self.spark, self.root, self.config).persist()
        gone = known.join(listed, "path", "left_anti").select("path")
        stale = files.contents(self.spark, self.root, tree.need_hashing(listed, known)).persist()
        read = tree.changed_files(stale, known)
        try:
            if read.isEmpty() and gone.isEmpty():
                return False
            tagged = registry.extracted(read).persist()
            paths = read.select("path").unionByName(gone)
            d, r = (tree.remove_files(self.store.load(t), paths) for t in ("definitions", "refs"))
            hashes = tree.remove_files(known, stale.select("path").unionByName(gone), "path").unionByName(stale.select("path", "size", "mtime", "hash"))
            nodes = tree.file_nodes(hashes).withColumn("mtime", F.lit(None).cast("timestamp"))
            self.store.save(definitions=d.unionByName(registry.definitions(tagged)), refs=r.unionByName(registry.references(tagged)), files=hashes, nodes=nodes)
            tagged.unpersist()
            return True
        finally:
            stale.unpersist()
            listed.unpersist()

    def remove_file(self, path: str) -> None:
        gone = self.spark.createDataFrame([(path,)], "path string")
        self.store.save(definitions=tree.remove_files(self.store.load("definitions"), gone), refs=tree.remove_files(self.store.load("refs"), gone), files=tree.remove_files(self.store.load("files"), gone, "path"))

    def clear(self) -> None:
        self.store.clear()

    @property
    def definitions(self) -> DataFrame:
        return self.store.load("definitions")

    @property
    def refs(self) -> DataFrame:
        return self.store.load("refs")

    def postings(self) -> DataFrame:
        return self.store.load("postings")

    def search(self, query: str, **options) -> DataFrame:
        """Results of a query in the query language; options as of grammar.run()."""
        return grammar.run(query, self.postings(), self.refs, config=self.config, **options)

    def search_group(self, name: str, **options) -> DataFrame:
        terms = all_groups(self.config).get(name)
        if terms is None:
            raise KeyError(f"no concept group {name}")
        return search.in_group(self.postings(), self.refs, terms, **options)

    def groups(self) -> DataFrame:
        return groups_table(self.spark, self.config)

    def impact(self, term: str) -> DataFrame:
        return references.impact(self.refs, term)

    def references(self, term: str) -> DataFrame:
        return references.grouped_by_file(self.refs, term)

    def changes(self) -> DataFrame:
        """One row on what the working tree's changes touch."""
        symbols = C.changed_symbols(git.changes(self.spark, self.root), self.definitions, self.refs)
        return C.report(symbols, self.refs)

    def stats(self) -> dict:
        return overview.stats(self.definitions).first().asDict()

    def integrity(self) -> DataFrame:
        return tree.integrity(self.definitions.select(F.col("file").alias("path")), self.store.load("files"))

    def status(self) -> DataFrame:
        """(path, state) with the counts of the index and of its hash table."""
        tracked = self.store.load("files").agg(F.count("*").alias("tracked_files"))
        return overview.stats(self.definitions).crossJoin(tracked).withColumn("version", F.lit(self.store.version()))
