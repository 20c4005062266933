"""Steps of near groups and leakage whose seconds grew faster than the input."""

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from pellucid.operators import findings, similarity
from pellucid.sources.documents import document_records


def test_comparisons_are_dealt_by_their_number(spark, monkeypatch):
    """Blocks are few bytes and much work: no task makes most of the comparisons."""

    def counting(masks, threshold):
        def run(batches):
            for b in batches:
                n = sum(len(p) * len(q) for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))
                yield pa.RecordBatch.from_pydict({"x": pa.array([TaskContext.get().partitionId()], pa.int64()), "y": pa.array([n], pa.int64())})

        return run

    monkeypatch.setattr(similarity, "_compared", counting)
    monkeypatch.setattr(similarity, "TASK", 1 << 18, raising=False)
    hashes = spark.range(8_000).select(F.xxhash64("id").alias("bits"))
    by = similarity.close(hashes, hashes, 8, 64).where("x <> y and y >= 0 and x between 0 and 1000").groupBy("x").agg(F.sum("y").alias("n")).collect()
    n = [r["n"] for r in by]
    assert len(n) == 4 and max(n) < sum(n) / 2


def test_copies_of_a_fingerprint_make_no_edges(spark, monkeypatch):
    """Components have an edge for each two near fingerprints, however many rows have them; labels are the least ids all the same."""
    rows = [(f"i{k:03}", [0, 1, 1 << 40, -1][k % 4], [7] if k % 3 else None) for k in range(240)] + [("a-single", 0x0F0F0F0F0F0F, None), ("none", None, None), ("none too", None, None)]
    edges = []
    monkeypatch.setattr(similarity, "components", lambda e, f=similarity.components: (edges.append(e.count()), f(e))[1])
    for plan in ("broadcast", "bands"):
        edges.clear()
        got = similarity.clusters(spark.createDataFrame(rows, "id string, bits long, color array<smallint>"), plan=plan)
        want = {(i, "i003" if b == -1 else "i000") for i, b, _ in rows[:240]}
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        # 3 near hashes of two colours each, one hash with two colours
        assert edges == [6 * 5 // 2 + 1]


def test_a_text_is_hashed_once_for_its_fingerprints(spark, data):
    """The stand-in's signature isn't worked out anew for the hash, the colours and each branch of it."""
    plan = document_records(spark, data).select("perceptual_hash", "color_signature")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(cast(text") == 1 and plan.count("md5(") <= 4


def test_sorts_compare_keys_and_work_none_out(spark, data, monkeypatch):
    """A sort works out its order for both rows of each comparison, so keys of paths are columns before it."""
    plans = []
    for name in ("ranked", "ranked_within"):
        monkeypatch.setattr(findings, name, lambda *a, f=getattr(findings, name), **k: (plans.append((out := f(*a, **k))._jdf.queryExecution().optimizedPlan().toString()), out)[1])
    records = document_records(spark, data)
    exact = findings.exact_members(records)
    assert exact.columns == [*records.columns, "member_rank", "n_members", "group_id"]
    findings.exact_groups(records), findings.near_groups(records), findings.leakage_groups(records)
    sorts = [line for p in plans for line in p.splitlines() if "Sort [" in line]
    assert len(plans) == 6 and len(sorts) >= 6 and not any("regexp" in line or "split(" in line for line in sorts)
