"""Refreshing a library, stale results, debouncing, rounds of embedding, ranks, and the side of a join that is sent."""

import pytest
from pyspark.sql import functions as F

from pellucid.operators import compare, ranking, similarity, vector_index, vectors
from pellucid.operators.cache import EmbeddingStore
from pellucid.plans.semantic import HashProvider, SemanticSession
from pellucid.plans.workspace import Bin, FolderTrash
from pellucid.sources.documents import document_records
from pellucid.streaming.watch import Debounced, Latest, Library, Watcher


@pytest.fixture(scope="module")
def records(spark, data):
    return document_records(spark, data).drop("doc_id").cache()


def test_refresh(spark, records, tmp_path):
    moved = tmp_path / "a.txt"
    moved.write_text("x")
    trash = Bin(FolderTrash(str(tmp_path / "bin")))
    trash.remove([str(moved)])
    library = Library(records, "file:///data", trash)
    members = library.analysis.exact_members
    second = members.where("member_rank = 2").select("group_id", F.col("url").alias("keeper")).cache()
    library.choose(second)
    assert library.compare(records.limit(20)).count() == 20
    assert not library.refresh(records) and library.revision == 0 and library.comparison is not None and trash.done
    gone = second.orderBy("keeper").first()["keeper"]
    assert library.refresh(records.where(F.col("url") != gone))
    assert library.revision == 1 and library.comparison is None and trash.undo() is None
    assert {r["keeper"] for r in library.keepers.collect()} == {r["keeper"] for r in second.collect()} - {gone}


def test_stale_results_are_dropped(records):
    library = Library(records)
    old = library.work.begin()
    assert library.compare(records.limit(5)) is not None
    assert library.compare(records.limit(5), old) is None and library.comparison is not None
    work = Latest()
    first, second = work.begin(), work.begin()
    assert not work.holds(first) and work.holds(second)


def test_debounced():
    now = [0.0]
    d = Debounced(0.12, lambda: now[0])
    d.give("a")
    now[0] = 0.1
    d.give("ab")
    now[0] = 0.2
    assert d.due() is None
    now[0] = 0.23
    assert d.due() == "ab" and d.due() is None


def test_signal_during_a_scan_is_caught_up(spark, records):
    seen = []

    def publish(revision, now, changed):
        seen.append(revision)
        if revision == 1:
            assert not watcher.signal()  # a scan is running

    scans = iter([records, records.limit(10), records.limit(10)])
    watcher = Watcher(spark, lambda: next(scans), publish)
    assert watcher.signal() and seen == [1, 2]




def test_rounds_are_appended_one_by_one(spark, records, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "cache"))
    session = SemanticSession(records, HashProvider(), store, round_=40)
    appended, append = [], store.append

    def counting(batch, provider):
        appended.append(batch.count())
        if len(appended) == 3:
            raise OSError("full")
        append(batch, provider)

    store.append = counting
    with pytest.raises(OSError):
        session.build()
    assert store.count("hash-64") == sum(appended[:2]) and store.file_size("hash-64") > 0 and store.file_size("none") == 0
    store.append = append
    n = session.chosen.count()
    assert session.build().count() == n and store.count("hash-64") == n

    class Absent(HashProvider):
        def is_available(self):
            return False

    with pytest.raises(ValueError):
        SemanticSession(records, Absent(), store)


def test_ranked(spark):
    rows = [(k * 7919 % 1000, f"p{k}") for k in range(1000)] + [(3, "x"), (3, "y")]
    df = spark.createDataFrame(rows, "n int, place_of string").repartition(6)
    got = {r["place_of"]: r["place"] for r in ranking.ranked(df, [F.desc("n"), F.asc("place_of")]).collect()}
    assert got == {p: k + 1 for k, (_, p) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert ranking.ranked(df.where("false"), [F.asc("n")]).count() == 0


def brute_pairs(left, right):
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    return {(a, b, far(x, y)) for a, x in left for b, y in right if far(x, y) <= 8}


@pytest.mark.parametrize("sizes", [(10, 300), (300, 10), (60, 60)])
@pytest.mark.parametrize("rows", [5000, 20, 0])
def test_either_side_may_be_sent(spark, monkeypatch, sizes, rows):
    import random

    monkeypatch.setattr(similarity, "BROADCAST_ROWS", rows)
    rng = random.Random(sum(sizes))
    base = [rng.getrandbits(63) for _ in range(10)]

    def side(n, name):
        out = []
        for k in range(n):
            x = base[rng.randrange(10)]
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(63)
            out.append((f"{name}{k}", x))
        return out

    left, right = side(sizes[0], "l"), side(sizes[1], "r")
    a, b = (spark.createDataFrame([(i, x, [1] * 48) for i, x in s], "id string, bits long, color array<smallint>") for s in (left, right))
    pairs = similarity.pairs(a, b)
    assert {tuple(r) for r in pairs.collect()} == brute_pairs(left, right)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    if rows == 20 and sizes != (60, 60):
        # the ten rows are sent, never the three hundred
        assert ("BuildRight" if sizes[1] == 10 else "BuildLeft") in plan


def test_many_labels_are_judged_in_blocks(spark, data, monkeypatch):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("path"), "embedding", F.col("label").cast("string").alias("label"))
    want = sorted(map(tuple, vectors.label_suggestions(v.select("path", "embedding"), v.select("path", "label")).collect()))
    monkeypatch.setattr(vectors, "LABEL_BLOCK", 3)
    assert sorted(map(tuple, vectors.label_suggestions(v.select("path", "embedding"), v.select("path", "label")).collect())) == want and want
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 4)
    few = v.where("vec_id % 50 = 0")
    got = {r["path"]: r["similarity"] for r in vectors.best_others(v, few).collect()}
    import numpy as np

    rows = v.collect()
    x = np.array([r["embedding"] for r in rows])
    for r in few.collect():
        s = x @ np.array(r["embedding"])
        s[[k for k, o in enumerate(rows) if o["path"] == r["path"]]] = -9
        assert got[r["path"]] == pytest.approx(s.max(), abs=1e-5)


def test_targets_and_filter(spark):
    rows = spark.createDataFrame([("a/Café.png", "near"), ("b/x.png", "new")], "candidate string, kind string")
    assert [r[0] for r in compare.filtered(rows, text="cafe").collect()] == ["a/Café.png"]
    assert compare.filtered(rows, "near", "x.png").count() == 0 and compare.filtered(rows).count() == 2
