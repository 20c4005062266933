"""Ranks within groups and the farthest pair of a group, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pellucid.operators import spread, vectors
from pellucid.operators.cache import compacted, latest
from pellucid.operators.ranking import nth_largest, ranked, ranked_within


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("part_rows", [50_000, 40])
def test_ranks_within_groups(spark, part_rows):
    """Small groups, one that holds most rows, and rows with equal keys; in one part and in many."""
    rng = random.Random(4)
    rows = [(k, "hot" if k % 3 else f"g{k % 50}", rng.randrange(40)) for k in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, g string, x int").repartition(5)
    got = {r["id"]: (r["member_rank"], r["n_members"]) for r in ranked_within(df, "g", [F.desc("x"), F.asc("id")], part_rows=part_rows).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    want = {r[0]: (k, len(own)) for own in by.values() for k, r in enumerate(sorted(own, key=lambda r: (-r[2], r[0])), 1)}
    assert got == want
    places = {r["id"]: r["place"] for r in ranked(df, [F.asc("x"), F.asc("id")], part_rows=part_rows).collect()}
    assert places == {r[0]: k for k, r in enumerate(sorted(rows, key=lambda r: (r[2], r[0])), 1)}


@pytest.mark.parametrize("part_rows", [50_000, 16])
def test_ranks_of_one_group_of_all_rows(spark, part_rows):
    df = spark.range(500).select(F.lit("all").alias("g"), F.col("id"))
    out = ranked_within(df, "g", [F.desc("id")], part_rows=part_rows)
    assert sorted((r["member_rank"], r["id"], r["n_members"]) for r in out.collect()) == [(k + 1, 499 - k, 500) for k in range(500)]
    if part_rows < 500:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan and all("part" in line for line in plan.splitlines() if "row_number" in line)  # no window by group alone ranks rows
    assert ranked_within(df.where("false"), "g", [F.desc("id")], part_rows=part_rows).count() == 0


def chain(rng, n, bits=64, step=6):
    """Distinct hashes, each a few bits from the one before, within the lowest bits."""
    x, out = rng.getrandbits(bits), {}
    while len(out) < n:
        for _ in range(rng.randrange(1, step)):
            x ^= 1 << rng.randrange(bits)
        out[x] = True
    return list(out)


def around(rng, centre, n, most):
    out = {}
    while len(out) < n:
        x = centre
        for j in rng.sample(range(64), rng.randrange(most + 1)):
            x ^= 1 << j
        out[x] = True
    return list(out)


def farthest(hashes):
    v, best = np.array(hashes, np.uint64), 0
    for k in range(0, len(v), 500):
        best = max(best, int(np.bitwise_count(v[k : k + 500, None] ^ v[None, :]).max()))
    return best


def test_spreads_against_brute_force(spark):
    """Groups of every kind at once: single, pairs, chains, balls, two balls, few bits, opposite ones; equal hashes and nulls."""
    rng = random.Random(12)
    a, b = rng.getrandbits(64), rng.getrandbits(64)
    groups = {
        "one": [a], "two": [a, a ^ 7], "chain": chain(rng, 800), "ball": around(rng, a, 500, 5), "balls": around(rng, a, 300, 4) + around(rng, b, 200, 4),
        "few bits": chain(rng, 400, 14, 3), "opposite": around(rng, a, 60, 3) + around(rng, ~a & (2**64 - 1), 60, 3), "short": chain(rng, 30), "all": [0, 2**64 - 1] + chain(rng, 100),
    }
    rows = [(g, signed(x)) for g, own in groups.items() for x in own] + [("one", signed(a)), ("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "label string, bits long").repartition(3)
    want = {g: farthest(own) for g, own in groups.items()} | {"none": 0}
    assert {r["label"]: r["spread"] for r in spread.spreads(df).collect()} == want
    assert {r["label"]: r["spread"] for r in spread.spreads(df, small=2).collect()} == want
    assert spread.spreads(df.where("false")).count() == 0


def test_spread_of_a_long_chain_takes_few_comparisons(spark, monkeypatch):
    rng = random.Random(5)
    n, met = 20_000, []
    for hashes in (chain(rng, n), around(rng, rng.getrandbits(64), n, 9)):
        met.clear()
        monkeypatch.setattr(spread, "_farthest", lambda pairs, f=spread._farthest: (met.append(pairs.count()), f(pairs))[1])
        df = spark.createDataFrame([("g", signed(x)) for x in hashes], "label string, bits long")
        assert spread.spreads(df).first()["spread"] == farthest(hashes)
        monkeypatch.undo()
        assert sum(met) < n * (n - 1) / 2 / 10, met


def test_nth_largest_against_a_sort(spark):
    """Wide and narrow ranges, ties, the ends of a long, groups of n rows or fewer."""
    rng = random.Random(6)
    values = {"wide": [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [2**63 - 1, -(2**63)], "dense": list(range(400)), "ties": [7] * 50 + [3] * 100, "few": [1, 2, 3]}
    df = spark.createDataFrame([(g, v) for g, own in values.items() for v in own], "g string, v long").repartition(4)
    for n in (3, 60):
        got = {r["g"]: (r["least"], r["above"]) for r in nth_largest(df, "g", "v", n, digit=5).collect()}
        want = {g: (x := sorted(own, reverse=True)[n - 1], sum(v > x for v in own)) for g, own in values.items() if len(own) > n}
        assert got == want


def test_newest_of_a_provider(spark):
    """As a sort gives them: the newest of each key, the newest cap of a provider, ties by hash; one key has a third of all rows."""
    rng = random.Random(2)
    rows = [(f"h{rng.randrange(90)}" if k % 3 else "hot", [float(k)], k * 10**12, rng.choice(["a", "a", "b"])) for k in range(600)] + [(f"t{k:02}", [0.5], 5, "c") for k in range(40)]
    df = spark.createDataFrame(rows, "content_hash string, embedding array<float>, seq long, provider string").repartition(3)
    newest = {}
    for r in sorted(rows, key=lambda r: r[2]):
        newest[r[3], r[0]] = r
    assert {tuple(map(str, r)) for r in latest(df).collect()} == {tuple(map(str, r)) for r in newest.values()}
    for cap in (1, 17, 1000):
        want = set()
        for p in "abc":
            want |= {r[:1] + r[2:] for r in sorted((r for r in newest.values() if r[3] == p), key=lambda r: (-r[2], r[0]))[:cap]}
        out = compacted(df, cap)
        assert {(r["content_hash"], r["seq"], r["provider"]) for r in out.collect()} == want and out.columns == df.columns
    assert compacted(df.where("false"), 5).count() == 0


def test_clusters_by_one_task_and_by_many_are_the_same(spark):
    """Fifty thousand points with copies, mirror images and points halfway between: every number is the same."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(10_000, 8))
    signs = rng.choice([-1.0, 1.0], size=(10_000, 8))
    halfway = np.repeat(np.eye(8), 2500, 0)[:10_000] + np.roll(np.eye(8), 1, 1)[np.arange(10_000) % 8]
    rows = np.concatenate([x, x, x * signs, halfway, np.repeat(x[:10], 1000, 0)]).astype(np.float32)
    df = spark.createDataFrame([(f"p{k:06}", v) for k, v in enumerate(rows.tolist())], "path string, embedding array<float>").repartition(6).cache()
    here, there = (vectors.cluster(df, 9, iterations=4, one_task=n).select("path", "cluster_id", "member_rank", "score", "n_members") for n in (10**9, 0))
    assert here.count() == 50_000 and here.exceptAll(there).isEmpty() and there.exceptAll(here).isEmpty()
    df.unpersist()
