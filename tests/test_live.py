"""Findings kept up to date against a full analysis after every batch."""

import random

from pyspark.sql import functions as F

from pellucid.operators.similarity import BITS
from pellucid.plans.analysis import Analysis
from pellucid.schema import RECORD
from pellucid.streaming import live
from pellucid.streaming.live import LiveFindings


def record(rng, name, base):
    bits = rng.choice(base)
    for _ in range(rng.randrange(5)):
        bits ^= 1 << rng.randrange(63)
    bits = None if rng.random() < 0.05 else bits
    color = None if rng.random() < 0.1 else [rng.choice([10, 20, 60])] * 48
    content = rng.choice([f"c{rng.randrange(25)}", name, name, None])
    split = rng.choice(["train", "train", "test", "validation", None])
    problem = "truncated" if rng.random() < 0.05 else None
    if content and content.startswith("c"):  # equal contents look alike
        r = random.Random(content)
        bits, color = r.choice(base) ^ (1 << r.randrange(60)), [20] * 48
    return ("file:///d/" + name, name, rng.randrange(10, 99), None, "PNG", None, content, bits, color, problem, "x", split)


def shown(a):
    pick = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    return (
        pick(a.exact_members, "url", "group_id", "member_rank", "n_members"),
        pick(a.exact_groups, "group_id", "n_members", "reclaimable_bytes", "number"),
        pick(a.near[1], "url", "group_id", "member_rank", "spread"),
        pick(a.near[0], "group_id", "n_members", "number", "spread"),
        pick(a.leakage[1], "url", "group_id", "member_rank", "spread"),
        pick(a.leakage[0], "group_id", "splits", "identical", "number"),
    )


class Shown:
    def __init__(self, a):
        self.exact_members, self.exact_groups = a.exact_members, a.exact_groups
        self.near, self.leakage = (a.near_groups, a.near_members), (a.leakage_groups, a.leakage_members)


def test_batches_of_changes_give_the_full_analysis(spark, monkeypatch):
    """Random additions, removals and replacements; a chain that falls apart and meets again."""
    rng = random.Random(17)
    base = [rng.getrandbits(63) for _ in range(9)]
    # a chain whose middle link goes and comes back
    link = lambda k: ("file:///d/chain" + str(k), f"chain{k}", 50, None, "PNG", None, f"chain{k}", (1 << (6 * k)) - 1, [90] * 48, None, "x", "train" if k % 2 else "test")
    have = {}
    for r in [record(rng, f"p{k}.png", base) for k in range(60)] + [link(k) for k in range(7)]:
        have[r[0]] = r
    frame = lambda rows: spark.createDataFrame(list(rows), RECORD)
    now = LiveFindings(frame(have.values()))
    joined = []
    monkeypatch.setattr(live, "pairs", lambda a, b, *c, f=live.pairs, **d: (joined.append(a.count()), f(a, b, *c, **d))[1])
    batches = []
    for n in range(2):
        gone = rng.sample(sorted(u for u in have if "chain" not in u), 8)
        new = [record(rng, f"q{n}-{k}.png", base) for k in range(6)] + [record(rng, u.removeprefix("file:///d/"), base) for u in gone[:3]]
        batches.append((new, gone[3:]))
    batches[0][1].append("file:///d/chain3")
    batches[1][0].append(link(3))
    for new, gone in batches:
        for u in gone:
            have.pop(u, None)
        for r in new:
            have[r[0]] = r
        joined.clear()
        now.apply(frame(new), spark.createDataFrame([(u,) for u in gone], "url string"))
        assert max(joined) <= 2 * len(new) + len(gone)  # no more than what changed is compared with the rest
        assert shown(Shown(now)) == shown(Analysis.make(frame(have.values())))
    assert BITS == 8 and now.records.count() == len(have)


def test_live_from_nothing(spark):
    now = LiveFindings(spark.createDataFrame([], RECORD))
    assert now.near_groups.count() == now.leakage_groups.count() == now.exact_groups.count() == 0
    rng = random.Random(1)
    rows = [record(rng, f"p{k}.png", [5]) for k in range(12)]
    now.apply(spark.createDataFrame(rows, RECORD), spark.createDataFrame([], "url string"))
    assert now.records.count() == 12 and now.near_members.count() > 0
    now.apply(now.records.where("false"), now.records.select("url"))
    assert now.records.count() == 0 and now.near_members.where(F.lit(True)).count() == 0
