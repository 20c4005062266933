"""Discovery in tasks, and the stream of listings."""

import os
import time

import pytest

from pellucid.sources import listing
from pellucid.sources.listing import discover
from pellucid.streaming.watch import SnapshotLog, watch


def put(root, name, content=b"x"):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)
    return path


def brute(root):
    """What a walk of the whole tree finds."""
    out = set()
    for folder, folders, files in os.walk(root):
        folders[:] = [f for f in folders if not f.startswith(".") and not f.lower().endswith((".app", ".bundle", ".photoslibrary", ".framework")) and not os.path.islink(os.path.join(folder, f))]
        for f in files:
            p = os.path.join(folder, f)
            if not f.startswith(".") and f.lower().endswith((".png", ".jpg", ".gif")) and not os.path.islink(p):
                s = os.stat(p)
                out.add((f"file:{p}", s.st_size, s.st_mtime_ns // 1_000_000))
    return out


@pytest.mark.parametrize("listed", [512, 3])
def test_discovery_of_a_deep_tree(spark, tmp_path, monkeypatch, listed):
    """Thousands of folders, hidden ones, packages, links, odd names, other files; listed at once and level by level."""
    monkeypatch.setattr(listing, "DEALT", 2)
    root = str(tmp_path / "tree")
    n = 2000 if listed > 3 else 120
    for k in range(n):
        put(root, f"a{k % 7}/b {k % 31}/ü{k}/f.png" if k % 3 else f"d{k % 5}/" + "/".join("x" * (k % 6 + 1)) + f"/g{k}.JPG", b"y" * (k % 4))
    for name in (".hidden/a.png", "a0/.h.png", "My.app/b.png", "Lib.PhotosLibrary/c/d.png", "note.txt", "png", "a1/100%#?.gif", "empty/.keep"):
        put(root, name)
    os.symlink(os.path.join(root, "a0"), os.path.join(root, "loop"))
    os.symlink(put(root, "real.png"), os.path.join(root, "link.png"))
    real = listing._expanded

    def slow(batches):
        listing.LISTED = listed
        return real(batches)

    monkeypatch.setattr(listing, "_expanded", slow)
    got = [tuple(r) for r in discover(spark, root).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(root) and len(got) > n / 2


def test_discovery_of_no_folder(spark, tmp_path):
    assert discover(spark, str(tmp_path)).count() == 0
    for name in ("missing", os.path.basename(put(str(tmp_path), "f.png"))):
        with pytest.raises(NotADirectoryError):
            discover(spark, str(tmp_path / name))


def test_watch_tells_what_changed_and_goes_on_after_a_restart(spark, tmp_path):
    root, state = str(tmp_path / "seen"), str(tmp_path / "state")
    paths = [put(root, f"d{k}/p{k}.png", b"1") for k in range(5)]
    told = []

    def publish(revision, snapshot, changed):
        told.append((revision, {(r["url"].rpartition("/")[2], r["change"]) for r in changed.collect()}, snapshot.count()))

    def until(n, query):
        end = time.time() + 120
        while len(told) < n and time.time() < end:
            assert query.isActive, query.exception()
            time.sleep(0.1)
        assert len(told) == n

    query = watch(spark, root, state, publish, 0.2)
    try:
        until(1, query)
        assert told[0] == (1, {(f"p{k}.png", "added") for k in range(5)}, 5)
        put(root, "d9/new.png")
        until(2, query)
        assert told[1] == (2, {("new.png", "added")}, 6)
        put(root, "d0/p0.png", b"another")
        until(3, query)
        assert told[2] == (3, {("p0.png", "replaced")}, 6)
        seen = query.lastProgress["batchId"] if query.lastProgress else 0
        end = time.time() + 60
        while (query.lastProgress or {"batchId": 0})["batchId"] < seen + 2 and time.time() < end:
            time.sleep(0.1)
        assert len(told) == 3  # nothing changed, nothing told
    finally:
        query.stop()
    os.remove(paths[1])
    query = watch(spark, root, state, publish, 0.2)
    try:
        until(4, query)
    finally:
        query.stop()
    assert told[3] == (4, {("p1.png", "removed")}, 5)
    assert [r for r, _ in SnapshotLog(spark, f"{state}/snapshots").revisions()] == [3, 4]
