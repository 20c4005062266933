"""Refreshing by snapshots: list again, compare, and analyse anew only if something changed.

Spark's file stream neither tells of deletions nor of a file replaced under its
own name, so a snapshot of (url, size, time) is compared with the one before: by watch()
as a stream that survives restarts, or by a Watcher that is polled.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import compare
from ..operators.findings import reconciled_keepers
from ..operators.graph import cut
from ..plans.analysis import Analysis
from ..plans.workspace import Bin
from ..sources.listing import listings

DEBOUNCE_S, LIST_DEBOUNCE_S = 0.6, 0.12
KEYS = ("byte_size", "modified_at")


def changes(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = KEYS) -> DataFrame:
    """(url, change): added, removed or replaced between two snapshots."""
    a = before.select("url", F.struct(*columns).alias("old"))
    b = after.select("url", F.struct(*columns).alias("new"))
    both = a.join(b, "url", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "replaced")
    return both.select("url", change.alias("change")).where("change is not null")


class Watcher:
    """Polls a listing; publishes a revision when it differs from the last."""

    def __init__(self, spark: SparkSession, scan: Callable[[], DataFrame], publish: Callable[[int, DataFrame, DataFrame], None], debounce: float = DEBOUNCE_S):
        self.spark, self.scan, self.publish, self.debounce = spark, scan, publish, debounce
        self.revision, self.snapshot, self.paused = 0, None, False
        self.running = self.pending = False

    def poll(self) -> bool:
        """Scan once; True if a new revision was published.  A paused watcher catches up when it goes on."""
        if self.paused:
            return False
        now = cut(self.scan())
        changed = None if self.snapshot is None else cut(changes(self.snapshot, now))
        if changed is not None and changed.isEmpty():
            return False
        self.revision += 1
        self.snapshot = now
        self.publish(self.revision, now, changed)
        return True

    def signal(self) -> bool:
        """Something changed: scan, or, while a scan runs, once more behind it."""
        if self.running:
            self.pending = True
            return False
        self.running, done = True, False
        try:
            while True:
                self.pending = False
                done |= self.poll()
                if not self.pending:
                    return done
        finally:
            self.running = False

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> bool:
        self.paused = False
        return self.poll()

    def run(self, rounds: int | None = None, interval: float | None = None) -> None:
        """Poll again and again; never two scans at a time."""
        while rounds is None or rounds > 0:
            self.poll()
            if rounds is not None:
                rounds -= 1
                if not rounds:
                    return
            time.sleep(self.debounce if interval is None else interval)


class Latest:
    """Lets through only results of the newest work; the Spark jobs of what was begun before are cancelled."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark, self.generation, self.name = spark, 0, f"work-{uuid.uuid4().hex}"

    def tag(self, generation: int) -> str:
        return f"{self.name}-{generation}"

    def begin(self) -> int:
        self.generation += 1
        if self.spark is not None:
            self.spark.sparkContext.cancelJobsWithTag(self.tag(self.generation - 1))
        return self.generation

    def holds(self, generation: int) -> bool:
        return generation == self.generation

    @contextmanager
    def running(self, generation: int) -> Iterator[None]:
        """Jobs of this thread belong to a generation; what a cancelled job raises ends the block quietly."""
        sc, tag = self.spark.sparkContext, self.tag(generation)
        sc.addJobTag(tag)
        try:
            yield
        except Exception:
            if self.holds(generation):
                raise
        finally:
            sc.removeJobTag(tag)


class Debounced:
    """The last value given, once nothing new has come for a while."""

    def __init__(self, delay: float = LIST_DEBOUNCE_S, clock: Callable[[], float] = time.monotonic):
        self.delay, self.clock, self.held = delay, clock, None

    def give(self, value) -> None:
        self.held = (value, self.clock() + self.delay)

    def due(self):
        """The value if it's time, else None."""
        if self.held is None or self.clock() < self.held[1]:
            return None
        value, self.held = self.held[0], None
        return value


class Library:
    """A collection as it's worked on: its analysis, chosen keepers, removals to undo, and a comparison with it."""

    def __init__(self, records: DataFrame, root: str = "", trash: Bin | None = None):
        self.analysis, self.trash = Analysis.make(records, root), trash
        self.keepers = records.sparkSession.createDataFrame([], "group_id string, keeper string")
        self.revision, self.comparison, self.work = 0, None, Latest(records.sparkSession)

    def choose(self, keepers: DataFrame) -> None:
        """Other members to keep: (group_id, keeper)."""
        self.keepers = cut(self.keepers.join(keepers, "group_id", "left_anti").unionByName(keepers))

    def compare(self, candidates: DataFrame, generation: int | None = None) -> DataFrame | None:
        """What of candidates the library has; None if newer work began meanwhile, which also cancels the jobs of this one."""
        generation = self.work.begin() if generation is None else generation
        rows = None
        with self.work.running(generation):
            rows = cut(compare(self.analysis.records, candidates))
        if not self.work.holds(generation):
            return None
        self.comparison = rows
        return rows

    def refresh(self, records: DataFrame) -> bool:
        """Take in a new scan if it differs: a new revision, keepers that still hold, nothing to undo, no comparison."""
        now = cut(records)
        if changes(self.analysis.records, now, ("byte_size", "modified_at", "content_hash", "problem")).isEmpty():
            return False
        self.analysis = Analysis.make(now, self.analysis.root)
        members = self.analysis.exact_members.select("group_id", "url").unionByName(self.analysis.near[1].select("group_id", "url"))
        self.keepers = cut(reconciled_keepers(self.keepers, members))
        if self.trash is not None:
            self.trash.forget()
        self.revision += 1
        self.work.begin()
        self.comparison = None
        return True


class SnapshotLog:
    """Published snapshots of a stream of listings, in a shared folder: a folder for each revision, the newest two kept.

    A revision counts once its rows are all written, so a restart goes on from the last one that did.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def revisions(self) -> list[tuple[int, int]]:
        """(revision, batch) of whole snapshots."""
        path, fs = self._fs()
        if not fs.exists(path(self.path)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return sorted(tuple(map(int, n.split("-")[1:])) for n in names if n.startswith("revision-") and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def snapshot(self, revision: int, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/revision-{revision}-{batch}")

    def write(self, revision: int, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/revision-{revision}-{batch}")
        path, fs = self._fs()
        for old in self.revisions()[:-2]:
            fs.delete(path(f"{self.path}/revision-{old[0]}-{old[1]}"), True)


def watch(spark: SparkSession, root: str, state: str, publish: Callable[[int, DataFrame, DataFrame], None], debounce: float = DEBOUNCE_S):
    """A running stream that calls publish(revision, snapshot, changes) when the listing of root differs from the last published.

    Folders are listed in tasks, a micro-batch for every trigger, never two at a time.  state is a shared folder
    for Spark's checkpoint and the snapshots.  A restart compares with the last snapshot, so it tells what
    changed in between, and a batch that's run again is compared with the one before it.
    """
    log = SnapshotLog(spark, f"{state.rstrip('/')}/snapshots")

    def step(rows: DataFrame, batch: int) -> None:
        known = [r for r in log.revisions() if r[1] < batch]
        now = cut(rows)
        before = log.snapshot(*known[-1]) if known else now.where("false")
        changed = cut(changes(before, now, ("byte_size", "modified_ms")))
        if known and changed.isEmpty():
            return
        revision = known[-1][0] + 1 if known else 1
        log.write(revision, batch, now)
        publish(revision, log.snapshot(revision, batch), changed)

    stream = listings(spark, root).writeStream.foreachBatch(step)
    return stream.option("checkpointLocation", f"{state.rstrip('/')}/checkpoint").trigger(processingTime=f"{int(debounce * 1000)} milliseconds").start()
