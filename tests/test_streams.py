"""Watched folders, settling, quiet periods and the fold over streams; restarts and replays."""

import json
import os
import time

import pytest

from rasterfold.plans.queries import QUERIES, H, W, level0
from rasterfold.operators import fuse
from rasterfold.streaming import watch

DIR = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def looks(tmp_path, clock, **more):
    return watch.Looks([str(tmp_path / "in")], str(tmp_path / "log"), more.get("keep", 5.0), 2, lambda: clock[0])


def rows_between(reader, start, end):
    return [r for p in reader.partitions(start, end) for r in reader.read(p)]


def test_looks_tell_of_what_is_new_and_read_again(tmp_path):
    (tmp_path / "in" / "sub" / "deep").mkdir(parents=True)
    for name in ("old.png", "sub/old.tif", "note.txt"):
        (tmp_path / "in" / name).write_text("x")
    clock = [100.0]
    reader = looks(tmp_path, clock)
    first = reader.initialOffset()
    (tmp_path / "in" / "new.PNG").write_text("ab")
    (tmp_path / "in" / "sub" / "new.jpeg").write_text("abc")
    (tmp_path / "in" / "sub" / "deep" / "new.png").write_text("too deep")
    one = reader.latestOffset()
    names = lambda rows: [(os.path.basename(r[0]) if r[0] else None, r[1], r[3]) for r in rows]
    assert names(rows_between(reader, first, one)) == [("new.PNG", 2, 100.0), ("new.jpeg", 3, 100.0), (None, 0, 100.0)]
    clock[0] = 103.0
    (tmp_path / "in" / "old.png").write_text("changed")
    two = looks(tmp_path, clock).latestOffset()  # a restart before anything was committed
    assert names(rows_between(reader, one, two)) == [("new.PNG", 2, 103.0), ("old.png", 7, 103.0), ("new.jpeg", 3, 103.0), (None, 0, 103.0)]
    assert rows_between(looks(tmp_path, clock), first, two) == rows_between(reader, first, one) + rows_between(reader, one, two)
    reader.commit(one)
    clock[0] = 110.0
    later = looks(tmp_path, clock)
    three = later.latestOffset()
    assert names(rows_between(later, two, three)) == [(None, 0, 110.0)] and rows_between(later, one, two)
    later.commit(three)
    assert sorted(os.listdir(tmp_path / "log")) == ["known"] and later.initialOffset() == three
    os.remove(tmp_path / "in" / "new.PNG")
    assert len(rows_between(later, three, later.latestOffset())) == 1


def sightings():
    """a grows twice and settles at 6; b settles at 3, c is seen once; d changes for ever."""
    out = []
    for t in range(0, 12):
        out.append(("a", min(t, 3) * 10, 1.0, float(t)))
        if 1 <= t <= 5:
            out.append(("b", 5, 2.0, float(t)))
        if t == 4:
            out.append(("c", 1, 1.0, 4.0))
        out += [("d", t, 1.0, float(t)), (None, 0, 0.0, float(t))]
    return out


def test_settle_of_a_table(spark):
    got = watch.settle(spark.createDataFrame(sightings(), watch.SIGHTING), 2.0).collect()
    assert sorted((r["path"], r["at"]) for r in got) == [("a", 5.0), ("b", 3.0)]


def write(spark, rows, path, schema=watch.SIGHTING):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def run(df, checkpoint, name, mode="append"):
    q = df.writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = q.start(name) if mode == "append" else q.queryName(name).start()
    q.awaitTermination()
    return q


def test_settle_of_a_stream_forgets(rocks, tmp_path):
    """State is there for files on their way; a restart goes on with it, and it is gone when they haven't been seen for a while."""
    spark, source = rocks, str(tmp_path / "s")
    write(spark, [r for r in sightings() if r[3] < 3], source)
    stream = watch.settle(spark.readStream.schema(watch.SIGHTING).parquet(source), 2.0, 5.0)
    run(stream, str(tmp_path / "c"), str(tmp_path / "o"))
    write(spark, [r for r in sightings() if r[3] >= 3], source)
    stream = watch.settle(spark.readStream.schema(watch.SIGHTING).parquet(source), 2.0, 5.0)
    run(stream, str(tmp_path / "c"), str(tmp_path / "o"))
    told = lambda: sorted((r["path"], r["at"]) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert told() == [("a", 5.0), ("b", 3.0)]
    for t in (100.0, 101.0, 200.0):
        write(spark, [(None, 0, 0.0, t)], source)
        q = run(watch.settle(spark.readStream.schema(watch.SIGHTING).parquet(source), 2.0, 5.0), str(tmp_path / "c"), str(tmp_path / "o"))
    assert told() == [("a", 5.0), ("b", 3.0)]
    rows = [s["numRowsTotal"] for p in q.recentProgress for s in json.loads(p.json)["stateOperators"]] if hasattr(q.recentProgress[0], "json") else [s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]]
    assert rows and rows[-1] <= 4  # the time keeper's own state and timer


def test_stacks_close_when_quiet(rocks, tmp_path):
    spark, source = rocks, str(tmp_path / "s")
    files = [("w", p, float(t)) for p, t in (("f1", 10), ("f2", 12), ("f3", 14), ("g1", 40), ("g2", 41))] + [("v", "h", 12.0)]
    schema = "watch string, path string, at double"

    def stacks():
        s = watch.timed(spark.readStream.schema(schema).parquet(source))
        return watch.stacks_when_quiet(s, 10.0)

    for rows in (files[:3] + files[5:], files[3:5], [("x", "far", 100.0)], [("x", "farther", 200.0)]):
        write(spark, rows, source, schema)
        run(stacks(), str(tmp_path / "c"), str(tmp_path / "o"))
    got = sorted((r["watch"], r["start"], r["end"], tuple(r["files"])) for r in spark.read.parquet(str(tmp_path / "o")).collect())
    assert got[:3] == [("v", 12.0, 12.0, ("h",)), ("w", 10.0, 14.0, ("f1", "f2", "f3")), ("w", 40.0, 41.0, ("g1", "g2"))]
    assert all(g[0] == "x" for g in got[3:])


def test_watch_from_folder_to_stacks(rocks, tmp_path):
    """The whole of it, live: what was there stays out, what comes is told once it has settled, and a restart tells nothing twice."""
    spark, box = rocks, tmp_path / "in"
    box.mkdir()
    (box / "old.png").write_text("x")

    def stream():
        return watch.settle(watch.watch(spark, [str(box)], str(tmp_path / "log"), 4.0), 0.5, 8.0)

    def go(until, names):
        q = stream().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start(str(tmp_path / "o"))
        try:
            deadline, n = time.time() + 60, 0
            while time.time() < deadline:
                time.sleep(0.5)
                n += 1
                if n == 6:
                    for name in names:
                        (box / name).write_text("image")
                if (tmp_path / "o").exists() and len(told()) >= until:
                    break
        finally:
            failed = q.exception()
            q.stop()
        assert failed is None

    def told():
        try:
            return sorted(os.path.basename(r["path"]) for r in spark.read.schema("path string, at double, ts timestamp").parquet(str(tmp_path / "o")).collect())
        except Exception:  # noqa: BLE001  nothing written yet
            return []

    go(2, ["f1.png", "f2.tif"])
    assert told() == ["f1.png", "f2.tif"]
    (box / "between.png").write_text("while nobody looked")
    go(4, ["f3.png"])
    assert told() == ["between.png", "f1.png", "f2.tif", "f3.png"]


def test_fold_of_a_stream_is_the_winner_map(spark, tmp_path):
    """Frames arrive out of order and twice, a batch is run again after a restart: the winners are those of the whole stack."""
    level = level0(spark, DIR).cache()
    schema = level.schema
    for f in (3, 0, 6, 1, 5, 3, 2, 4):
        level.filter(f"frame = {f}").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        time.sleep(0.01)
    sink = watch.FoldSink(str(tmp_path / "w"), lambda b: fuse.region_energy(b.dropDuplicates(["frame", "y", "x"]), H, W, ["frame"]), [])

    def run_with(sink):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "s"))
        s.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    failed = []

    def breaks_once(batch, number):
        sink(batch, number)
        if number == 1 and not failed:
            failed.append(number)
            raise RuntimeError("lost after the version was written")

    with pytest.raises(Exception, match="lost after"):
        run_with(breaks_once)
    run_with(breaks_once)
    got = {(r["y"], r["x"]): (r["winner"], r["e"]) for r in sink.winners(spark).collect()}
    want = {(r["y"], r["x"]): r["winner"] for r in QUERIES["winner_map"](spark, DIR).collect()}
    assert failed and {k: v[0] for k, v in got.items()} == want and len(sink._versions(spark)) == 2


def test_newest_request_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "s")
    for rows in ([("a", 1, "old"), ("b", 5, "only")], [("a", 3, "new"), ("a", 2, "late")]):
        spark.createDataFrame(rows, "channel string, gen int, payload string").coalesce(1).write.mode("append").parquet(source)
    s = spark.readStream.schema("channel string, gen int, payload string").option("maxFilesPerTrigger", 1).parquet(source)
    run(watch.newest(s), str(tmp_path / "c"), "newest_requests", "complete")
    assert {(r["channel"], r["payload"]) for r in spark.table("newest_requests").collect()} == {("a", "new"), ("b", "only")}
