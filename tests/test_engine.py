"""Findings, comparison, vectors, cache, reports and watching on small fixtures."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pellucid.operators import cache, compare, findings, similarity, vectors
from pellucid.operators.graph import components
from pellucid.plans import report
from pellucid.plans.analysis import Analysis
from pellucid.plans.semantic import HashProvider, PixelProvider, SemanticSession
from pellucid.schema import RECORD
from pellucid.sources import embedding_log, folder
from pellucid.sources.pixels import Preprocessing, model_pixels
from pellucid.streaming.watch import Watcher, changes

GRAY = [128] * 48


def record(path, bits=None, content=None, size=100, color=GRAY, problem=None, label=None, split=None, pixels=None):
    return ("file:///d/" + path, path, size, None, "PNG", pixels, path if content is None else content, bits, color, problem, label, split)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), RECORD)


@pytest.fixture(scope="module")
def small(spark):
    return frame(
        spark,
        record("train/cat/a.png", 0, "same", 10, label="cat", split="train"),
        record("train/cat/a copy.png", 0, "same", 10, label="cat", split="train"),
        record("test/cat/b, c.png", 0, "same", 10, label="cat", split="test"),
        record("train/cat/big.png", 0xFF, size=50, pixels=(20, 20), label="cat", split="train"),
        record("train/dog/d.png", 0x7FFF << 40, label="dog", split="train"),
        record("train/dog/broken.png", 0, "same", problem="truncated", label="dog", split="train"),
        record("train/dog/none.png", None, size=0, problem="empty", label="dog", split="train"),
    ).cache()


def test_exact(small):
    g = findings.exact_groups(small).collect()
    assert [(r["n_members"], r["reclaimable_bytes"], r["first_path"], r["name"]) for r in g] == [(3, 20, "test/cat/b, c.png", "exact-1")]
    assert [r["relative_path"] for r in findings.exact_members(small).orderBy("member_rank").collect()] == ["test/cat/b, c.png", "train/cat/a.png", "train/cat/a copy.png"]
    assert findings.representatives(findings.usable(small)).count() == 3


@pytest.mark.parametrize("plan", ["broadcast", "bands"])
def test_near_and_leakage(small, plan):
    groups, members = findings.near_groups(small, plan=plan)
    assert [(r["n_members"], r["spread"], r["first_path"]) for r in groups.collect()] == [(2, 8, "train/cat/big.png")]
    groups, members = findings.leakage_groups(small, plan=plan)
    r = groups.first()
    assert (r["n_members"], r["splits"], r["identical"], r["name"]) == (4, "Train ↔ Test", True, "leak-1")
    assert {(x["split"], x["n"]) for x in findings.leakage_by_split(members).collect()} == {("train", 3), ("test", 1)}


def test_pairs_by_both_plans(spark):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        bits = rng.getrandbits(64)
        for j in range(3):
            rows.append((f"{k}-{j}", (bits ^ sum(1 << b for b in rng.sample(range(64), 4))) - 2**63, None if j == 2 else [rng.randrange(20)] * 48))
    df = spark.createDataFrame(rows, "id string, bits long, color array<smallint>")
    want = {
        (a[0], b[0], d)
        for a in rows
        for b in rows
        if a[0] < b[0] and (d := bin((a[1] + 2**63) ^ (b[1] + 2**63)).count("1")) <= 8 and (a[2] is None or b[2] is None or abs(a[2][0] - b[2][0]) <= 12)
    }
    for plan in ("broadcast", "bands"):
        got = [tuple(r) for r in similarity.pairs(df, df, ordered=True, plan=plan).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 160)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    alone = {a for a, b in edges if a == b}
    for one_task in (0, 1000):
        got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
        assert got == {x: find(x) for x in root if x in got} and set(root) - set(got) <= alone
        assert components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0


def test_health_and_tallies(small):
    a = Analysis.make(small)
    h = a.health.first()
    assert (h["n_images"], h["n_problems"], h["n_exact_groups"], h["n_redundant"], h["reclaimable_bytes"], h["n_near_images"], h["n_leaks"]) == (7, 2, 1, 2, 20, 2, 1)
    assert h["has_labels"] and h["has_splits"] and h["label_imbalance"] == pytest.approx(4 / 3) and not h["imbalance_concerning"]
    assert [(r["name"], r["n"]) for r in findings.split_tally(small).orderBy("place").collect()] == [("Train", 6), ("Test", 1)]
    assert {r["section"]: r["n"] for r in a.badge_counts.collect()} == {"exact": 1, "near": 1, "problems": 2, "leakage": 1}
    assert a.removing(small.where("content_hash = 'same'").select("url")).exact_groups.count() == 0


def test_findings_and_keepers(small):
    a = Analysis.make(small)
    got = {r["url"].rpartition("/")[2]: r["findings"] for r in a.findings_per_file.collect()}
    assert got["b, c.png"] == ["Exact duplicate", "Near duplicate", "Split leakage"] and got["none.png"] == ["Empty, the file contains no data"]
    m = a.exact_members
    choice = m.where("member_rank = 3").select("group_id", F.col("url").alias("keeper"))
    assert [r["url"] for r in findings.chosen_keepers(m, choice).where("is_keeper").collect()] == ["file:///d/train/cat/a copy.png"]
    assert findings.reconciled_keepers(choice, m.where("member_rank < 3")).count() == 0 and findings.reconciled_keepers(choice, m).count() == 1


def test_report(small, tmp_path):
    a = Analysis.make(small, root="/d")
    lines = report.csv_text(a).splitlines()
    assert lines[0] == report.HEADER and len(lines) == 1 + 2 + 3 + 2 + 4
    assert 'Exact duplicate,"test/cat/b, c.png",exact-1,keeping' in lines and "Near duplicate,train/cat/big.png,near-1,\"keeping, differs by 8 of 64 bits\"" in lines
    report.export(str(tmp_path / "r.CSV"), a)
    assert (tmp_path / "r.CSV").read_text().startswith(report.HEADER)
    page = report.contents("r.html", a)
    assert page.startswith("<!DOCTYPE html>") and "Folder balance" in page and "b, c.png" in page
    empty = Analysis.make(small.where("false"))
    assert report.csv_text(empty) == report.HEADER + "\n" and report.html_text(empty).count("Nothing found.") == 4
    assert report.escape('<a&"b">') == "&lt;a&amp;&quot;b&quot;&gt;" and [report.byte_text(n) for n in (1, 999, 1500, 2_500_000)] == ["1 byte", "999 bytes", "2 kB", "2.5 MB"]


def test_compare(spark):
    library = frame(
        spark, record("boundary", 0xFF), record("too-far", 0x1FF), record("exact-a", None, "same"), record("no-color", 0, color=None), record("broken", 0, problem="empty"), record("close", 1), record("recolored", 0, color=[200] * 48), record("exact-b", 0, "same")
    )
    new = frame(spark, record("near", 0), record("exact", 0, "same"), record("missing", None), record("unreadable", 0, problem="empty"))
    for plan in ("broadcast", "bands"):
        got = {r["candidate"][10:]: (r["kind"], [m[10:] for m in r["matches"]]) for r in compare.compare(library, new, plan=plan).collect()}
        assert got == {"near": ("near", ["boundary", "close", "exact-b"]), "exact": ("exact", ["exact-a", "exact-b"]), "missing": ("new", []), "unreadable": ("unreadable", [])}
    assert {r["kind"]: r["n"] for r in compare.kind_counts(compare.compare(library, new)).collect()} == {"near": 1, "exact": 1, "new": 1, "unreadable": 1}
    assert compare.roots_overlap("/tmp", "/tmp/x") and not compare.roots_overlap("/tmp/ab", "/tmp/a")


def embeddings(spark, rows):
    return spark.createDataFrame([(p, [float(x) for x in v]) for p, v in rows], "path string, embedding array<float>")


def test_search(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = embeddings(spark, [(f"p{k:03d}", v) for k, v in enumerate(x)])
    s = x @ x[7]
    want = sorted((-s[k], f"p{k:03d}") for k in range(300) if k != 7)[:60]
    got = vectors.similar_to(df, "p007").collect()
    assert [r["path"] for r in got] == [p for _, p in want] and all(abs(r["similarity"] + a) < 1e-5 for r, (a, _) in zip(got, want))
    assert vectors.nearest(df, [1.0], 5).count() == 0 and vectors.nearest(df, [0.0] * 64, 0).count() == 0 and vectors.similar_to(df, "no").count() == 0
    mixed = embeddings(spark, [("a", [1, 0]), ("b", [0, 1]), ("c", [1, 0, 0]), ("d", [0, 1, 0]), ("e", [1])])
    assert {r["path"] for r in vectors.majority_width(mixed).collect()} == {"c", "d"}


def plain_kmeans(x, k, iterations=25):
    rng = vectors.SplitMix64(vectors.SEED)
    c, near = [x[rng.below(len(x))]], np.full(len(x), -np.inf, np.float32)
    while len(c) < k:
        near = np.maximum(near, x @ c[-1])
        w = (1.0 - near.astype(np.float64)) ** 2
        if not w.sum() > 0:
            break
        t, chosen = rng.below(1_000_000) / 1_000_000 * w.sum(), len(x) - 1
        for i, v in enumerate(w):
            t -= v
            if t <= 0:
                chosen = i
                break
        c.append(x[chosen])
    c, last = np.stack(c), None
    for _ in range(iterations):
        a = (x @ c.T).argmax(1)
        if last is not None and (a == last).all():
            break
        last = a
        c = np.stack([(s / n if (n := np.linalg.norm(s := x[a == j].sum(0))) > 0 else s) if (a == j).any() else c[j] for j in range(len(c))])
    return (x @ c.T).argmax(1)


def test_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(np.eye(8)[:3], 6, 0) + rng.normal(0, 0.03, (18, 8))
    rows = [(f"p{k:02d}", v) for k, v in enumerate(x)]
    got = vectors.cluster(embeddings(spark, rows), 3).collect()
    far = vectors.cluster(embeddings(spark, rows), 3, one_task=0).collect()
    assert sorted((r["path"], r["cluster_id"], r["member_rank"]) for r in got) == sorted((r["path"], r["cluster_id"], r["member_rank"]) for r in far)
    assert sorted({(r["cluster_id"], r["n_members"]) for r in got}) == [(0, 6), (1, 6), (2, 6)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    want = plain_kmeans(x, 3)
    by_path = {r["path"]: r["cluster_id"] for r in got}
    assert len({(by_path[f"p{k:02d}"], a) for k, a in enumerate(want)}) == 3
    same = vectors.cluster(embeddings(spark, [(f"p{k}", [1, 0, 0]) for k in range(10)]), 5).collect()
    assert {(r["cluster_id"], r["n_members"]) for r in same} == {(0, 10)} and same[0]["cohesion"] == pytest.approx(1)
    assert vectors.cluster(embeddings(spark, [("a", [])])).count() == 0


def test_label_check(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{k}", np.array([1, 0.0]) + rng.normal(0, 0.05, 2), "cat") for k in range(6)] + [(f"d{k}", np.array([0, 1.0]) + rng.normal(0, 0.05, 2), "dog") for k in range(6)] + [("stray", np.array([0, 1.0]), "cat")]
    v = embeddings(spark, [(p, x) for p, x, _ in rows])
    labels = spark.createDataFrame([(p, y) for p, _, y in rows], "path string, label string")
    assert [(r["path"], r["current_label"], r["suggested_label"]) for r in vectors.label_suggestions(v, labels).collect()] == [("stray", "cat", "dog")]
    assert vectors.label_suggestions(v, labels.where("label = 'cat'")).count() == 0


def test_cache(spark, tmp_path):
    store = cache.EmbeddingStore(spark, str(tmp_path / "cache"), cap=3)
    batch = lambda *keys: spark.createDataFrame([(k, [float(len(k)), 1.0]) for k in keys], "content_hash string, embedding array<float>")
    assert store.count("p") == 0
    store.append(batch("a", "b"), "p")
    store.append(batch("a", "ccc", "d", "e"), "p")
    store.append(batch("a"), "q")
    assert (store.count("p"), store.count("q")) == (5, 1)
    store.compact()
    assert store.count("p") == 3 and store.count("q") == 1
    store.append(spark.createDataFrame([("z", [1.0])], "content_hash string, embedding array<float>"), "p")
    assert [r["content_hash"] for r in store.load("p").collect()] == ["z"] and store.count("q") == 1
    store.remove_all("q")
    assert store.count("q") == 0
    r = frame(spark, record("x", content="z"), record("y", content="nope"))
    assert [x["url"] for x in cache.hits(r, store.rows(), "p").collect()] == ["file:///d/x"] and cache.pending(r, store.rows(), "p").count() == 1


def test_record_file(spark, tmp_path):
    path = str(tmp_path / "v.log")
    embedding_log.write_log(path, "p", [("k1", [1.0, 2.0]), ("k2", [3.0, 4.0])])
    assert [tuple(r) for r in embedding_log.read_log(spark, path, "p").collect()] == [("k1", [1.0, 2.0], 0), ("k2", [3.0, 4.0], 1)]
    raw = open(path, "rb").read()
    open(path, "wb").write(raw[:-3])
    assert embedding_log.read_log(spark, path, "p").count() == 1
    assert embedding_log.read_log(spark, path, "q") is None and embedding_log.read_log(spark, path, "p", 3) is None and embedding_log.read_log(spark, path + "x", "p") is None


def test_semantic(spark, small, tmp_path):
    s = SemanticSession(small, HashProvider(), cache.EmbeddingStore(spark, str(tmp_path / "e")))
    assert s.build().count() == 3 and s.build().count() == 3 and s.store.rows().count() == 3
    assert s.search("cats").count() == 3 and s.search("  ").count() == 0
    assert s.find_similar("file:///d/train/cat/a copy.png").count() == 2
    assert s.clusters(2).count() == 3 and s.label_suggestions().count() == 0


def test_watching(spark):
    states = [[("a", 1), ("b", 1)], [("a", 1), ("b", 1)], [("a", 2), ("c", 1)]]
    seen = []
    scan = lambda: spark.createDataFrame(states[min(len(seen_polls), 2)], "url string, byte_size long").withColumn("modified_at", F.lit(0))
    seen_polls = []
    w = Watcher(spark, scan, lambda revision, now, change: seen.append((revision, None if change is None else {(r["url"], r["change"]) for r in change.collect()})))
    for _ in range(3):
        w.poll()
        seen_polls.append(1)
    w.pause()
    assert not w.poll() and not w.resume()
    assert seen == [(1, None), (2, {("a", "replaced"), ("b", "removed"), ("c", "added")})]


def png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def blocks(seed, size):
    g = np.random.default_rng(seed).integers(0, 256, (8, 8))
    at = np.arange(size) * 8 // size
    return np.repeat(g[np.ix_(at, at)][:, :, None], 3, 2)


def test_scan_folder(spark, tmp_path):
    png(tmp_path / "train/cat/original.png", blocks(1, 256))
    raw = (tmp_path / "train/cat/original.png").read_bytes()
    for name in ("train/cat/copy.png", "test/cat/leaked.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    png(tmp_path / "train/cat/resized.png", blocks(1, 96))
    png(tmp_path / "train/dog/dog1.png", blocks(2, 256))
    (tmp_path / "train/dog/broken.png").write_bytes(b"this is not an image, only some text")
    (tmp_path / "train/dog/blank.png").write_bytes(b"")
    (tmp_path / "train/dog/cut.png").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "notes.txt").write_text("no")
    (tmp_path / ".hidden.png").write_bytes(raw)
    rows = folder.scan_folder(spark, str(tmp_path)).cache()
    got = {r["relative_path"]: r for r in rows.collect()}
    assert list(got) == sorted(got) and len(got) == 8
    assert {p.rpartition("/")[2]: r["problem"] for p, r in got.items() if r["problem"]} == {"broken.png": "unreadable", "blank.png": "empty", "cut.png": "truncated"}
    assert got["train/cat/resized.png"]["pixel_size"] == (96, 96) and got["test/cat/leaked.png"]["split"] == "test" and got["train/dog/dog1.png"]["label"] == "dog"
    a = Analysis.make(rows, str(tmp_path))
    h = a.health.first()
    assert (h["n_exact_groups"], h["n_redundant"], h["n_near_images"], h["n_leaks"], h["n_problems"]) == (1, 2, 2, 1, 3)
    assert a.leakage[0].first()["identical"]
    with pytest.raises(NotADirectoryError):
        folder.scan_folder(spark, str(tmp_path / "none"))


def test_vectors_of_pixels(spark, tmp_path):
    """Every decodable picture but the one that fails has the vector of its pixels, copies share one, and a second session finds them all cached."""

    class MeanProvider(PixelProvider):
        """The mean of each channel; fails on a batch with a very bright picture, and on that picture."""

        identifier, batch_size, preprocessing = "mean-3", 3, Preprocessing(16)

        def embed_pixels(self, pixels):
            if pixels.max() > 1.6:
                raise ValueError("too bright")
            return pixels.mean((1, 2))

    for k in range(7):
        png(tmp_path / f"p{k}.png", blocks(k, 40 + 8 * k) // 4 * (4 if k == 5 else 3))
    (tmp_path / "copy.png").write_bytes((tmp_path / "p1.png").read_bytes())
    (tmp_path / "bad.png").write_bytes(b"text")
    rows = folder.scan_folder(spark, str(tmp_path)).cache()
    store = cache.EmbeddingStore(spark, str(tmp_path / "store"))
    session = SemanticSession(rows, MeanProvider(), store, images=folder.images(spark, str(tmp_path)))
    got = {r["path"].rpartition("/")[2]: r["embedding"] for r in session.build().collect()}
    assert set(got) == {"copy.png" if "copy.png" in got else "p1.png", "p0.png", "p2.png", "p3.png", "p4.png", "p6.png"}
    x = model_pixels(blocks(3, 64) // 4 * 3, Preprocessing(16))
    assert got["p3.png"] == pytest.approx(x.mean((0, 1)).tolist(), abs=1e-5)
    assert store.count("mean-3") == 6
    with pytest.raises(ValueError):
        SemanticSession(rows, MeanProvider(), store)


def test_area_means():
    x = np.arange(12.0).reshape(2, 6, 1)
    assert np.allclose(folder.area_means(x, 1, 2)[0, :, 0], [x[:, :3].mean(), x[:, 3:].mean()])
    assert math.isclose(folder.area_means(x, 1, 4).mean(), x.mean())
