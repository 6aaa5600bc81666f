import pytest

import __spark_entry__
from siftwell import catalog

from .compare import same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, data, duck, name):
    same(catalog.QUERIES[name](spark, data), duck, catalog.SQL[name])


def test_queries_without_sql_run(spark, data):
    assert {r["change"] for r in catalog.QUERIES["q_stream_counters"](spark, data).collect()} <= {"added", "modified", "deleted"}
    tagged = catalog.QUERIES["q_extractors"](spark, data)
    assert tagged.where("tag = 'error'").count() == 0
    assert {r["file"] for r in tagged.select("file").distinct().collect()} == set(catalog.SAMPLES)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns[:2] == ["rank", "term"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_corpus_subpackage(tmp_path):
    """The rest must import and answer where the subpackage isn't there."""
    import shutil
    import subprocess
    import sys

    from .conftest import ROOT

    shutil.copytree(f"{ROOT}/siftwell", tmp_path / "siftwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_imports_the_corpus_subpackage():
    import pathlib
    import re

    from .conftest import ROOT

    for p in pathlib.Path(ROOT, "siftwell").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(?:from|import)\s+[\w.]*\bllm\b", p.read_text()), p
