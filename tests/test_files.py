import json

import pytest
from pyspark.sql import functions as F

from siftwell.api import Engine
from siftwell.functions import globs, groups, text
from siftwell.operators import changes, tree
from siftwell.sources import files, git, logs

LEGACY = {"src/router.ts": True, "src/layout.tsx": True, "checkout.ts": True, "src/foo.test.ts": True, "src/foo.spec.ts": False, ".github/workflows/ci.yml": True, ".gitlab-ci.yml": True, "src/a.logger.ts": True, "src/x.social.ts": True, "src/builder.ts": True, "src/distance.py": True, "prod.env": False, "src/env/x.ts": True, "pkg/vendor.go": True, "src/ok.ts": False}
NOW = {"src/router.ts": False, "out/a.ts": True, "src/foo.test.ts": False, ".github/workflows/ci.yml": False, ".git/config": True, "x/y.log": True, "src/env/x.ts": True, "src/env": False, "pkg/vendor.go": False, "vendor/a.go": True}


@pytest.mark.parametrize(("cases", "legacy"), [(LEGACY, True), (NOW, False)])
def test_exclusions(spark, cases, legacy):
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", globs.excluded(F.col("p"), legacy=legacy).alias("x")).collect()
    assert {r["p"]: r["x"] for r in rows} == cases


def test_inclusion_wins(spark):
    row = spark.createDataFrame([("dist/keep.ts",)], "p string").select(globs.excluded(F.col("p"), inclusions=["dist/keep.ts"]).alias("x")).first()
    assert row["x"] is False


def test_groups_and_config(tmp_path):
    assert len(groups.GROUPS) == 22 and sum(len(v[1].split()) for v in groups.GROUPS.values()) == 229
    config = groups.add_group({}, "mine", ["a", "b"])
    assert groups.group_terms("mine", config) == ["a", "b"] and groups.group_terms("auth", config)[0] == "auth"
    assert groups.group_terms("mine", groups.remove_group(config, "mine")) is None
    with pytest.raises(KeyError):
        groups.remove_group(config, "auth")
    (tmp_path / ".siftrc.json").write_text("{broken")
    (tmp_path / ".siftrc").write_text('{"include": ["x"]}')
    assert files.load_config(str(tmp_path)) == {"include": ["x"]}
    assert groups.variations("auth") == ["authenticate", "authorization", "authorized"]


def test_surrounding_lines_lose_blanks_only(spark):
    lines = F.array(F.lit(" 0x0 "), F.lit("1 and 1"), F.lit("  22"), F.lit(""))
    assert spark.range(1).select(text.surrounding(lines, F.lit(1), 2, 3).alias("x")).first()["x"] == ["0x0", "1 and 1", "22", ""]


def test_text_helpers(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.human_bytes(F.lit(1536))) == "1.5 KB" and one(text.human_bytes(F.lit(12))) == "12 B"
    assert one(text.human_duration(F.lit(7_500_000))) == "2h 5m"
    assert one(text.pascal_case(F.lit("my-card"))) == "MyCard"
    assert one(text.line_of(F.lit("a\nb\nc"), F.lit(4))) == 3
    assert one(text.padded(F.lit("abcdef"), 3)) == "abcdef"
    assert one(text.unquoted(F.lit('"a ${b}"'))) == "a"
    assert one(text.preview(F.lit("abcdef"), 3)) == "abc..."
    assert one(text.dir_name(F.lit("a"))) == "."
    assert one(text.surrounding(F.split(F.lit("a|b|c|d"), "\\|"), F.lit(1), 2, 1)) == ["a", "b"]
    assert one(text.language_icon(F.lit("go"))) == "🐹" and one(text.type_icon(F.lit("zzz"))) == "•"


def test_index_refresh_and_search(spark, tmp_path):
    src = tmp_path / "src"
    (src / "node_modules").mkdir(parents=True)
    (src / "a.py").write_text("class Cart:\n    def total(self):\n        return price()\n")
    (src / "b.py").write_text("from a import Cart\nx = Cart()\n")
    (src / "node_modules" / "z.py").write_text("def hidden(): pass\n")
    e = Engine(spark, str(src), str(tmp_path / "store"), {})
    assert e.refresh() is True
    assert e.stats()["total_files"] == 2
    top = e.search("Cart").orderBy("rank").first()
    assert top["term"] == "Cart" and top["usage_count"] == 2
    assert e.refresh() is False
    (src / "b.py").unlink()
    (src / "c.py").write_text("def added_later(): pass\n")
    assert e.refresh() is True
    names = {r["term"] for r in e.definitions.collect()}
    assert "added_later" in names and "x" not in names
    assert {r["path"] for r in e.store.load("files").collect()} == {"a.py", "c.py"}
    assert e.integrity().count() == 0
    rebuilt = Engine(spark, str(src), str(tmp_path / "again"), {})
    rebuilt.index()
    key = lambda x: sorted((r["term"], r["file"], r["line"]) for r in x.definitions.collect())
    assert key(e) == key(rebuilt)
    e.remove_file("c.py")
    assert e.search("added_later").count() == 0
    assert e.store.summary()["fileCount"] == 1
    e.clear()
    assert not e.store.exists()


def test_merkle_hashes_follow_content(spark):
    make = lambda h: tree.file_nodes(spark.createDataFrame([("a/b/x", h, 1), ("a/y", "2", 2), ("z", "3", 3)], "path string, hash string, size long"))
    one, two = ({r["path"]: r for r in make(h).collect()} for h in ("1", "9"))
    assert {p for p in one if one[p]["hash"] != two[p]["hash"]} == {"a/b/x", "a/b", "a", ""}
    assert one[""]["size"] == 6 and one["a"]["depth"] == 1


def test_git_changes(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("1")
    run("add", ".")
    run("commit", "-qm", "x")
    (tmp_path / "a").write_text("2")
    run("add", "a")
    (tmp_path / "a").write_text("3")
    (tmp_path / "b").write_text("2")
    rows = {r["path"]: (r["status"], r["is_staged"]) for r in git.changes(spark, str(tmp_path)).collect()}
    assert rows == {"a": ("M", True), "b": ("M", False)}
    assert changes.risk(F.lit(1)) is not None


def test_logs(spark, tmp_path):
    (tmp_path / "session-1.json").write_text(json.dumps({"id": "1", "projectPath": "/p", "createdAt": 5, "lastAccessedAt": 9}))
    (tmp_path / "session-2.json").write_text("not json")
    assert [r["id"] for r in logs.sessions(spark, str(tmp_path)).collect()] == ["1"]
    (tmp_path / "log.txt").write_text("\n".join(map(str, range(9))) + "\n")
    assert [r["value"] for r in logs.tail(spark, str(tmp_path / "log.txt"), 3).collect()] == ["6", "7", "8"]
    raw = [(1, "noise"), (2, '{"type":"assistant","message":{"content":[{"type":"text","text":"hi"},{"type":"tool_use","name":"Bash"}]}}'), (3, '{"type":"result","session_id":"s","result":"done","total_cost_usd":0.5}')]
    got = logs.events(spark.createDataFrame(raw, "seq long, raw string"))
    from siftwell.operators.sessions import reduced

    row = reduced(got).first()
    assert (row["session_id"], row["last_tool"], row["cost"], row["result"]) == ("s", "Bash", 0.5, "done")


def test_written_reports_and_logs(spark, tmp_path):
    from siftwell.sources import store

    path = store.save_report(spark, {"a": 1}, str(tmp_path / "r"))
    assert json.loads(spark.read.text(path).first()[0]) == {"a": 1}
    rows = spark.createDataFrame([("x",), ("y",)], "line string")
    store.append_log(rows, str(tmp_path / "log"))
    store.append_log(rows, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 4
    store.save_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_listing_and_priority(spark, tmp_path):
    for name in ("a/x.py", "a/y.ts", "b/z.py", "dist/no.py"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = [r["path"] for r in files.by_priority(files.listing(spark, str(tmp_path)), "b/*").collect()]
    assert got == ["b/z.py", "a/x.py", "a/y.ts"]
    assert sorted(r["path"] for r in files.paths(spark, str(tmp_path), config={"exclude": ["*.ts"], "include": ["dist/no.py"]}).collect()) == ["a/x.py", "b/z.py", "dist/no.py"]
    cut = {r["path"]: r["content"] for r in files.contents(spark, str(tmp_path), limit=3).collect()}
    assert cut["a/x.py"] == "a/x" + files.TRUNCATED
