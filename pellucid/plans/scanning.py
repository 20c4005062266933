"""A scan that tells how far it is and can be stopped."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import SparkSession

from ..operators.graph import cut
from ..runtime import ship
from ..sources.folder import classified, decoded, in_path_order, read_facts
from ..sources.listing import base_url, discover
from .analysis import Analysis
from .progress import PHASES, ScanProgress


class Scan:
    """One scan of a folder; progress and cancel may be called from any thread while run works.

    Files are counted by the tasks that read them, through an accumulator: the count is of tasks that are done, and never goes back.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.tag = spark, root, f"scan-{uuid.uuid4().hex}"
        self._read, self._seen, self._total = spark.sparkContext.accumulator(0), 0, None
        self._phase, self._stopped, self._lock = PHASES[0], False, threading.Lock()

    @property
    def progress(self) -> ScanProgress:
        with self._lock:
            if self._total is not None:  # a task that ran again counts once
                self._seen = max(self._seen, min(self._total, self._read.value))
            return ScanProgress(self._phase, self._seen, self._total)

    def cancel(self) -> None:
        """Stop the scan's jobs, now and to come."""
        self._stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self) -> Analysis | None:
        """The analysis of the folder; None if it was cancelled.  NotADirectoryError if root is no folder."""
        sc = self.spark.sparkContext
        ship(self.spark)
        base = base_url(self.spark, self.root)
        sc.addJobTag(self.tag)
        try:
            found = cut(discover(self.spark, self.root))
            total = found.count()
            with self._lock:
                self._phase, self._total = PHASES[1], total
            facts = None if self._stopped else cut(read_facts(found, self._read))
            with self._lock:
                self._phase = PHASES[2]
            out = None if self._stopped else Analysis.make(in_path_order(classified(facts, decoded(self.spark, self.root), base)), self.root)
        except Exception:
            if not self._stopped:
                raise
            out = None
        finally:
            sc.removeJobTag(self.tag)
        if self._stopped:
            return None
        with self._lock:
            self._phase, self._seen = PHASES[3], total
        return out
