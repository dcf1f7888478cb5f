"""Watched folders and frames that arrive: looks at folders, settling, quiet periods, the incremental fold, superseded requests.

Sightings are rows (path, size, mtime, at): what a look at the folders at time `at` saw; a look also sends a row without a path, so that
time goes on while nothing arrives. The rules work on event time, so a replay of old sightings gives the same stacks as a live run.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

SETTLE = 2.0
IMAGES = (".png", ".jpg", ".jpeg", ".tif", ".tiff")
SIGHTING = "path string, size long, mtime double, at double"


# ---- looks at folders -------------------------------------------------------------------------


def listed(folders: list[str]) -> dict[str, tuple[int, float]]:
    """Size and time of the images in the folders and in their direct subfolders; what vanishes meanwhile is left out."""
    out: dict[str, tuple[int, float]] = {}

    def visit(folder: str, deeper: bool) -> None:
        try:
            entries = list(os.scandir(folder))
        except OSError:
            return
        for e in entries:
            try:
                if e.is_dir():
                    if deeper:
                        visit(e.path, False)
                elif e.name.lower().endswith(IMAGES):
                    s = e.stat()
                    out[e.path] = s.st_size, s.st_mtime
            except OSError:
                continue

    for folder in folders:
        visit(folder, True)
    return out


class Looks(DataSourceStreamReader):
    """Each look is a file of the log, named by its number, which is the offset: what a batch has read it reads again after a restart.

    The first look only notes what is there. Later ones tell of a file when it is new or changed, and for `keep` seconds after
    that, so that a look has as many rows as files are on their way. A committed look is taken into one file of what is known.
    """

    def __init__(self, folders: list[str], log: str, keep: float, part: int, now: Callable[[], float] = time.time) -> None:
        self.folders, self.log, self.keep, self.part, self.now = folders, log, keep, part, now
        os.makedirs(log, exist_ok=True)

    def _write(self, name: str, value) -> None:
        with open(f"{self.log}/{name}.new", "w") as file:
            json.dump(value, file)
        os.replace(f"{self.log}/{name}.new", f"{self.log}/{name}")

    def _read(self, name: str):
        with open(f"{self.log}/{name}") as file:
            return json.load(file)

    def _numbers(self) -> list[int]:
        return sorted(int(n[5:]) for n in os.listdir(self.log) if n.startswith("look-") and not n.endswith(".new"))

    def _known(self) -> tuple[int, dict[str, list]]:
        """The last look and, for each file, its size, its time and when that was first seen."""
        if not os.path.exists(f"{self.log}/known"):
            self._write("known", {"look": 0, "files": {p: [s, t, None] for p, (s, t) in listed(self.folders).items()}})
        base = self._read("known")
        last, files = base["look"], base["files"]
        for k in self._numbers():
            if k > last:
                last = k
                for path, size, mtime, at in self._read(f"look-{k}"):
                    if path is not None and files.get(path, [None, None])[:2] != [size, mtime]:
                        files[path] = [size, mtime, at]
        return last, files

    def initialOffset(self) -> dict:
        return {"look": self._known()[0]}

    def latestOffset(self) -> dict:
        last, files = self._known()
        at, rows = self.now(), []
        for path, (size, mtime) in sorted(listed(self.folders).items()):
            was = files.get(path)
            if was is None or was[:2] != [size, mtime] or was[2] is not None and at - was[2] <= self.keep:
                rows.append([path, size, mtime, at])
        self._write(f"look-{last + 1}", [*rows, [None, 0, 0.0, at]])
        return {"look": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = [tuple(r) for k in range(start["look"] + 1, end["look"] + 1) for r in self._read(f"look-{k}")]
        return [InputPartition(rows[k : k + self.part]) for k in range(0, len(rows), self.part)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.value

    def commit(self, end: dict) -> None:
        base = self._read("known")
        for k in range(base["look"] + 1, end["look"] + 1):
            for path, size, mtime, at in self._read(f"look-{k}"):
                if path is not None and base["files"].get(path, [None, None])[:2] != [size, mtime]:
                    base["files"][path] = [size, mtime, at]
        self._write("known", {"look": max(end["look"], base["look"]), "files": base["files"]})
        for k in self._numbers():
            if k <= end["look"]:
                os.remove(f"{self.log}/look-{k}")


class FolderWatch(DataSource):
    """Format folder_watch: options folders (a JSON list), log (a folder that stays, one for each query), keep (seconds), part (rows of a task)."""

    @classmethod
    def name(cls) -> str:
        return "folder_watch"

    def schema(self) -> str:
        return SIGHTING

    def streamReader(self, schema) -> Looks:
        o = self.options
        return Looks(json.loads(o["folders"]), o["log"], float(o.get("keep", 4 * SETTLE)), int(o.get("part", 10_000)))


def watch(spark: SparkSession, folders: list[str], log: str, keep: float = 4 * SETTLE) -> DataFrame:
    """Sightings of new images in the folders, as a stream; what is there at the first start counts as handled. Driver and log share a mounted folder."""
    spark.dataSource.register(FolderWatch)
    return spark.readStream.format("folder_watch").options(folders=json.dumps(folders), log=log, keep=keep).load()


# ---- settling and quiet periods ---------------------------------------------------------------


def timed(sightings: DataFrame) -> DataFrame:
    """Sightings with `ts`, the time of the look, whose maximum is the watermark."""
    return sightings.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("ts", "0 seconds")


class Settling(StatefulProcessor):
    """For a path: its size and time and since when; told once when that has held for `seconds`, forgotten when not seen for `forget`."""

    def __init__(self, seconds: float, forget: float) -> None:
        self.seconds, self.forget = seconds, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "size long, mtime double, since double, last double, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        size, mtime, since, last, done = self.held.get() if self.held.exists() else (-1, -1.0, 0.0, 0.0, False)
        seen = sorted((float(r.at), int(r.size), float(r.mtime)) for frame in rows for r in frame.itertuples())
        told = []
        for at, s, t in seen:
            last = max(last, at)
            if (s, t) != (size, mtime):
                size, mtime, since, done = s, t, at, False if not done else True
            elif not done and at - since >= self.seconds:
                done = True
                told.append(at)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(old[0]) if isinstance(old, tuple) else int(old))
        self.handle.registerTimer(int((last + self.forget) * 1000))
        self.held.update((size, mtime, since, last, done))
        if told:
            yield pd.DataFrame({"path": [key[0]], "at": told[:1], "ts": pd.to_datetime([int(told[0] * 1e6)], unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


def settle(sightings: DataFrame, seconds: float = SETTLE, forget: float = 60.0) -> DataFrame:
    """path, at (and ts in a stream): each file once, at the first sighting that finds size and mtime unchanged for `seconds`.

    A table is handled by windows over each path's sightings. A stream keeps a state for each path until it hasn't been seen for `forget`
    seconds of the looks' time, which must be longer than a watch goes on telling of a file. Rows without a path only move the time on.
    """
    rows = sightings.select("path", F.col("size").cast("long").alias("size"), F.col("mtime").cast("double").alias("mtime"), F.col("at").cast("double").alias("at"))
    if sightings.isStreaming:
        keyed = timed(rows).withColumn("path", F.coalesce("path", F.lit("")))
        out = keyed.groupBy("path").transformWithStateInPandas(Settling(seconds, forget), "path string, at double, ts timestamp", "Append", "eventTime", eventTimeColumnName="ts")
        return out.filter("path != ''")
    order = Window.partitionBy("path").orderBy("at")
    changed = (F.lag("size").over(order) != F.col("size")) | (F.lag("mtime").over(order) != F.col("mtime"))
    parts = rows.filter("path is not null").withColumn("_p", F.sum(F.coalesce(changed, F.lit(True)).cast("int")).over(order))
    since = F.min("at").over(Window.partitionBy("path", "_p"))
    return parts.withColumn("_s", since).filter(F.col("at") - F.col("_s") >= seconds).groupBy("path").agg(F.min("at").alias("at"))


class Quiet(StatefulProcessor):
    """For a watch: the files since the last stack; a timer closes them when nothing has come for `seconds`."""

    def __init__(self, seconds: float) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getListState("files", "path string, at double")
        self.last = handle.getValueState("last", "at double")

    def _stack(self, key, files: list[tuple]) -> pd.DataFrame:
        files = sorted((at, path) for path, at in files)
        return pd.DataFrame({"watch": [key[0]], "start": [files[0][0]], "end": [files[-1][0]], "files": [[p for _, p in files]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((float(r.at), r.path) for frame in rows for r in frame.itertuples())
        last = self.last.get()[0] if self.last.exists() else new[0][0]
        held: list[tuple] = []
        for at, path in new:
            if at - last >= self.seconds:  # the timer would have closed it, had these rows come alone
                yield self._stack(key, [*self.files.get(), *held])
                self.files.clear()
                held = []
            held.append((path, at))
            last = max(last, at)
        for row in held:
            self.files.appendValue(row)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(int(old[0]) if isinstance(old, tuple) else int(old))
        self.handle.registerTimer(int((last + self.seconds) * 1000))
        self.last.update((last,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        files = list(self.files.get())
        self.files.clear()
        self.last.clear()
        if files:
            yield self._stack(key, files)

    def close(self) -> None:
        pass


def stacks_when_quiet(files: DataFrame, quiet: float) -> DataFrame:
    """watch, start, end, files: settled files (watch, path, at, ts) of a stream, a stack at a time, closed once the time has gone `quiet` seconds past the last."""
    schema = "watch string, start double, end double, files array<string>"
    return files.groupBy("watch").transformWithStateInPandas(Quiet(quiet), schema, "Append", "eventTime")


def close_quiet(files: DataFrame, quiet: float) -> DataFrame:
    """stack start and end and its files, in order: a stack closes once nothing arrived for `quiet` seconds. Needs a watermark on `ts` in a stream."""
    session = F.session_window("ts", f"{quiet} seconds")
    return files.groupBy("watch", session).agg(F.array_sort(F.collect_list(F.struct("ts", "path"))).alias("f")).select("watch", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), F.col("f.path").alias("files"))


# ---- folding as frames arrive -----------------------------------------------------------------


def incremental_fold(levels: DataFrame, keys: list[str]) -> DataFrame:
    """The winner of each coefficient so far; a streaming aggregate with one small state a coefficient (update or complete mode).

    The most energy and, of equals, the earliest frame: neither late frames nor frames that come twice change the result.
    """
    best = F.max_by(F.struct("frame", "e"), F.struct("e", (-F.col("frame")).alias("f")))
    return levels.groupBy(*keys, "y", "x").agg(best.alias("b")).select(*keys, "y", "x", F.col("b.frame").alias("winner"), F.col("b.e").alias("e"))


class FoldSink:
    """For foreachBatch: folds whole frames into a table of winners so far, one version a batch.

    Version n is made of the latest version before n and of batch n alone, so a batch that is run again after a failure writes
    the same version again. The last two versions stay. `rate` turns a batch into rated coefficients (keys, frame, y, x, e).
    """

    def __init__(self, path: str, rate: Callable[[DataFrame], DataFrame], keys: list[str]) -> None:
        self.path, self.rate, self.keys = path, rate, keys

    def _versions(self, spark: SparkSession) -> list[int]:
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        whole = [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []
        done = [p for p in whole if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = self.rate(batch).select(*self.keys, "frame", "y", "x", "e")
        before = [v for v in self._versions(spark) if v < number]
        if before:
            new = spark.read.parquet(f"{self.path}/v{before[-1]}").withColumnRenamed("winner", "frame").unionByName(new)
        incremental_fold(new, self.keys).write.mode("overwrite").parquet(f"{self.path}/v{number}")
        for v in before[:-1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}")
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def winners(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v{self._versions(spark)[-1]}")


def newest(requests: DataFrame) -> DataFrame:
    """Of each channel's requests the newest generation; older ones are superseded."""
    return requests.groupBy("channel").agg(F.max_by("payload", "gen").alias("payload"), F.max("gen").alias("gen"))


def run_stacks(batch: DataFrame, stacks: list, work) -> tuple[list, list[tuple]]:
    """For foreachBatch: every stack is tried; one that fails is noted and the others go on."""
    done, failed = [], []
    for stack in stacks:
        try:
            done.append(work(batch.filter(F.col("stack") == stack)))
        except Exception as error:  # noqa: BLE001
            failed.append((stack, str(error)))
    return done, failed
