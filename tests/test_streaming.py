import datetime as dt
import uuid

from siftwell.operators import tree
from siftwell.streaming import changes as stream


def test_debounce_keeps_the_last(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda ms: t + dt.timedelta(milliseconds=ms)
    rows = [("a", at(0), "added"), ("a", at(300), "modified"), ("a", at(1200), "deleted"), ("b", at(100), "added")]
    got = stream.debounced(spark.createDataFrame(rows, "path string, ts timestamp, change string")).collect()
    assert sorted((r["path"], r["change"], r["events"]) for r in got) == [("a", "deleted", 1), ("a", "modified", 2), ("b", "added", 1)]


def test_classified_stream(spark, tmp_path):
    src, t = tmp_path / "in", dt.datetime(2024, 1, 1)
    schema = "path string, ts timestamp, hash string"
    rows = [("a", t, "1"), ("a", t + dt.timedelta(seconds=1), "1"), ("a", t + dt.timedelta(seconds=2), "2"), ("a", t + dt.timedelta(seconds=3), None), ("b", t, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src))
    name = f"c{uuid.uuid4().hex}"
    q = stream.classified(spark.readStream.schema(schema).parquet(str(src))).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["path"], r["change"]) for r in spark.table(name).orderBy("ts").collect()] == [("a", "added"), ("a", "modified"), ("a", "deleted")]


def test_watched_folder_refreshes(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    (folder / "a.txt").write_text("1")
    seen = []
    q = stream.start_refresh(stream.watch(spark, str(folder)), lambda df, n: seen.extend((r["path"], r["change"]) for r in df.collect()), str(tmp_path / "cp"), "0 seconds")
    try:
        q.processAllAvailable()
        assert ("a.txt", "added") in seen
    finally:
        q.stop()


def test_single_flight():
    import threading
    import time

    flight, runs = tree.SingleFlight(), []

    def work():
        runs.append(1)
        time.sleep(0.2)
        return 7

    got = []
    ts = [threading.Thread(target=lambda: got.append(flight(work))) for _ in range(4)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert got == [7] * 4 and len(runs) == 1


def test_activity_tree_of_long_chains_and_cycles(spark):
    from siftwell.operators.sessions import activity_tree

    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(300)] + [("x", "y"), ("y", "x"), ("lost", "gone"), ("k", "n7")]
    got = {r["id"]: (r["root"], r["depth"]) for r in activity_tree(spark.createDataFrame(rows, "id string, parent_tool_use_id string")).collect()}
    assert got == {f"n{i}": ("n0", i) for i in range(300)} | {"k": ("n0", 8)}
