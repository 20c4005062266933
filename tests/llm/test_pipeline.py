"""The pipeline's stages, each on what the one before kept, against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import corpus_pipeline
import pytest
from pellucid.llm import lang_rank, pii_bootstrap
from test_operators import ITEM, UPPER, WORD, brute_hits, brute_profile, brute_spans, brute_targets


def brute_languages(rows):
    """The least out-of-place score of each text."""
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None]
    size = lang_rank.PROFILE
    profiles = {x: {g: k for k, g in enumerate(brute_profile([r["text"] or "" for r in train if r["lang"] == x])[:size])} for x in {r["lang"] for r in train}}
    out = {}
    for r in rows:
        own = brute_profile([r["text"] or ""])[:size]
        far = [sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)) for p in profiles.values()]
        out[r["doc_id"]] = 1 - min(far) / (size * len(own)) if own else None
    return out


def brute_near(rows, per_cent):
    """The least doc_id of each document's group."""
    sets = {}
    for r in rows:
        w = WORD.findall((r["text"] or "").translate(UPPER))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= per_cent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_stages_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, data).cache()
        seen[name] = before, {r["doc_id"]: r.asDict() for r in docs.collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert list(seen) == ["language", "near_duplicates", "decontamination", "personal_data", "mixture"]

    before, after = seen["language"]
    score = brute_languages(before)
    assert set(after) == {i for i, s in score.items() if s is not None and s >= corpus_pipeline.LEAST_SCORE}

    before, after = seen["near_duplicates"]
    assert set(after) == {i for i, r in brute_near(before, 80).items() if i == r} and len(after) < len(before)
    assert all(after[r["doc_id"]] == r for r in before if r["doc_id"] in after)

    before, after = seen["decontamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute_hits([(r["doc_id"], r["text"]) for r in before], items)
    assert set(after) == {r["doc_id"] for r in before} and any(hit for _, hit, _ in want.values())
    for r in before:
        n, hit, _ = want[r["doc_id"]]
        left = after[r["doc_id"]]["text"]
        assert len(ITEM.findall(left.translate(UPPER))) == n - hit if hit else left == r["text"]

    before, after = seen["personal_data"]
    assert set(after) == {r["doc_id"] for r in before}
    extra = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string")
    found = {r["doc_id"]: [tuple(x) for x in r["spans"]] for r in pii_bootstrap.spans(extra).collect()}
    for r in before:
        base = brute_spans(r["text"])
        assert set(base) <= set(found[r["doc_id"]])
        t, at, out = r["text"], 0, ""
        for start, kind, stop in found[r["doc_id"]]:
            if start >= at:
                out, at = out + t[at:start] + f"<{pii_bootstrap.KINDS[kind].upper()}>", stop
            at = max(at, stop)
        assert after[r["doc_id"]]["text"] == out + t[at:] and after[r["doc_id"]]["n_chars"] == len(out + t[at:])

    before, after = seen["mixture"]
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in before}
    groups = defaultdict(list)
    for r in before:
        key = hashlib.md5(f"mix:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()
        groups[r["source"]].append((key, r["doc_id"]))
    names = sorted(groups, key=lambda x: (x is None, x or ""))
    total = [sum(size[i] for _, i in groups[x]) for x in names]
    taken = {}
    for name, target, all_ in zip(names, brute_targets(total, [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(total)), total):
        epochs, rest = divmod(math.floor(target + 1e-6), max(1, all_))
        for _, i in sorted(groups[name]):
            taken[i] = epochs * size[i] + max(0, min(size[i], rest))
            rest -= size[i]
            assert i not in after or after[i]["target"] == pytest.approx(target)
    assert {i: r["taken"] for i, r in after.items()} == {i: n for i, n in taken.items() if n}


def test_near_duplicates_from_four_fifths(spark, data):
    rng = random.Random(11)
    texts = []
    for k in range(40):
        w = [f"w{rng.randrange(5000)}" for _ in range(204)]
        near, far = list(w), list(w)
        for i in range(4 + k % 2):  # each change takes five of 200 shingles: 180/220, or 175/225
            near[20 + 40 * i] = f"n{k}x{i}"
        for i in range(9):
            far[10 + 20 * i] = f"f{k}x{i}"
        texts += [" ".join(x) for x in (w, near, far)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    between = 0
    for b in range(len(texts)):
        for a in range(b):
            common, every = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            between += 80 * every <= 100 * common < 85 * every
            if 100 * common >= 80 * every:
                root[b] = root[a]
                break
    assert between == 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, data).collect()}
    assert got == {i for i, r in enumerate(root) if i == r}


def test_language_stage_rejects(spark, data):
    extra = spark.createDataFrame([(10**6, "12345 !!!", "en", "s", 9), (10**6 + 1, None, "en", "s", None), (10**6 + 2, "", None, None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs.unionByName(extra), data)
    assert kept.where("doc_id >= 1000000").count() == 0 and kept.count() == docs.count()


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    assert rows and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
