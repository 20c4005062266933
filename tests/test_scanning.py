"""Progress and cancelling of scans, and stale work whose jobs are stopped."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from pellucid.plans.progress import PHASES
from pellucid.plans.scanning import Scan
from pellucid.schema import RECORD
from pellucid.sources import folder, listing
from pellucid.streaming.watch import Library


def active(spark, tag):
    """Jobs with a tag that still run."""
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    of_tag = set(tracker.getJobIdsForTag(tag))
    return of_tag & set(spark.sparkContext.statusTracker().getActiveJobsIds())


def until(what, seconds=60):
    end = time.time() + seconds
    while not what():
        assert time.time() < end
        time.sleep(0.05)


def slow_facts(seconds):
    real = folder._facts

    def facts(batches):
        time.sleep(seconds)
        yield from real(batches)

    return facts


@pytest.fixture
def tree(tmp_path, monkeypatch):
    monkeypatch.setattr(listing, "FILES_A_TASK", 4)
    for k in range(80):
        path = tmp_path / f"d{k % 7}" / f"p{k}.png"
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * k)
    return str(tmp_path)


def in_background(f):
    out = []
    t = threading.Thread(target=lambda: out.append(f()))
    t.start()
    return t, out


def test_fractions_rise_to_one(spark, tree, monkeypatch):
    monkeypatch.setattr(folder, "_facts", slow_facts(0.3))
    scan = Scan(spark, tree)
    seen = [scan.progress]
    assert seen[0].fraction is None
    t, out = in_background(scan.run)
    while t.is_alive():
        seen.append(scan.progress)
        time.sleep(0.02)
    seen.append(scan.progress)
    fractions = [p.fraction for p in seen if p.fraction is not None]
    assert fractions == sorted(fractions) and fractions[-1] == 1 and len(set(fractions)) > 3
    assert [PHASES.index(p.phase) for p in seen] == sorted(PHASES.index(p.phase) for p in seen) and seen[-1].phase == PHASES[-1]
    assert seen[-1].processed == seen[-1].total == out[0].records.count() == 80


def test_a_cancelled_scan_leaves_no_jobs(spark, tree, monkeypatch):
    monkeypatch.setattr(folder, "_facts", slow_facts(30))
    scan = Scan(spark, tree)
    t, out = in_background(scan.run)
    until(lambda: scan.progress.phase == PHASES[1] and active(spark, scan.tag))
    scan.cancel()
    t.join(25)
    assert out == [None] and not active(spark, scan.tag)


def test_scans_of_nothing(spark, tmp_path):
    scan = Scan(spark, str(tmp_path))
    assert scan.run().records.count() == 0 and scan.progress.fraction == 1
    with pytest.raises(NotADirectoryError):
        Scan(spark, str(tmp_path / "missing")).run()


def test_a_stale_comparison_is_stopped(spark):
    """A newer comparison cancels the jobs of the one before, whose result is dropped; its own go on."""
    rows = [(f"file:///d/{k}", f"{k}.png", 10, None, "PNG", None, f"c{k % 5}", k, [128] * 48, None, "x", None) for k in range(20)]
    records = spark.createDataFrame(rows, RECORD)
    library = Library(records)
    wait = F.udf(lambda x: time.sleep(60) or x, "string")
    slow = records.withColumn("content_hash", wait("content_hash"))
    t, out = in_background(lambda: library.compare(slow))
    until(lambda: active(spark, library.work.tag(1)))
    fresh = library.compare(records)
    t.join(25)
    assert out == [None] and not t.is_alive() and not active(spark, library.work.tag(1))
    assert fresh.count() == 20 and library.comparison is fresh
    with pytest.raises(ZeroDivisionError), library.work.running(library.work.generation):
        _ = 1 / 0  # errors of work that still counts are told
