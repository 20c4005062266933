"""What the third round of findings named, on inputs that showed it."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pellucid import catalogue
from pellucid.llm import url_markov
from pellucid.operators import similarity, vectors


def test_a_webp_of_short_text_is_as_long_as_it_says(spark, tmp_path):
    texts = [None, "", "a", "abc", "abcd", "long enough for any header"]
    rows = [(7 + 14 * k, t) for k, t in enumerate(texts)] + [(k, "") for k in range(7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalogue.file_completeness(spark, str(tmp_path)).select("doc_id", "format", "verdict").collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.execute(catalogue.ORACLES["file_completeness"]).fetchall())


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def some_hashes(n, seed):
    """Hashes of which many lie 0 to 14 bits from another, some differ in neighbouring bits only, and many share most bits."""
    r = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    while len(out) < n:
        x = r.choice(sorted(out)[:50]) if r.random() < 0.8 else r.getrandbits(64) & r.choice([(1 << 64) - 1, 0xFFFF])
        at = r.randrange(52)
        for b in r.sample(range(64), r.randrange(15)) if r.random() < 0.7 else range(at, at + r.randrange(12)):
            x ^= 1 << b
        out.add(x)
    return sorted(map(signed, out))


@pytest.mark.parametrize("threshold", [0, 1, 8, 12])
@pytest.mark.parametrize("block,most", [(512, 2048), (16, 8), (1, 1)])
def test_close_hashes_against_all_pairs(spark, threshold, block, most):
    own, others = some_hashes(150, 1), some_hashes(120, 2) + some_hashes(150, 1)[::9]
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    left, right = (spark.createDataFrame([(x,) for x in side], "bits long") for side in (own, others))
    got = [tuple(r) for r in similarity.close(left, left, threshold, block, most).collect()]
    assert sorted(got) == sorted((a, b) for a in own for b in own if distance(a, b) <= threshold)
    got = [tuple(r) for r in similarity.close(left, right, threshold, block, most).collect()]
    assert sorted(got) == sorted((a, b) for a in own for b in set(others) if distance(a, b) <= threshold)


def test_comparisons_for_a_hash_do_not_grow_with_the_hashes(spark, monkeypatch):
    """Four times the hashes, about four times the comparisons; by equal bands it would be sixteen."""

    def compared(n):
        seen = spark.sparkContext.accumulator(0)

        def counting(masks, threshold):
            def run(batches):
                for b in batches:
                    for p, q in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                        seen.add(len(p) * len(q))
                    yield pa.RecordBatch.from_pydict({"x": pa.array([], pa.int64()), "y": pa.array([], pa.int64())})

            return run

        monkeypatch.setattr(similarity, "_compared", counting)
        similarity.close(hashes := spark.range(n).select(F.xxhash64("id").alias("bits")), hashes, 12, 64).count()
        return seen.value

    few, many = compared(2_000), compared(8_000)
    assert many < 7 * few and many < 8_000 * 8_000


def test_ids_of_one_fingerprint_are_expanded_in_parts(spark, monkeypatch):
    monkeypatch.setattr(similarity, "DEALT", 3)
    rows = [(f"i{k:02}", 5 if k < 20 else 4, [1, 2] if k % 3 else None) for k in range(30)] + [("far", -1, None)]
    side = spark.createDataFrame(rows, "id string, bits long, color array<smallint>")
    got = [tuple(r) for r in similarity.pairs(side, side, ordered=True, plan="bands").collect()]
    assert sorted(got) == sorted((a[0], b[0], int(a[1] != b[1])) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0])


def brute_url_ratio(texts, url):
    """Log-likelihoods of url's bytes and end by contexts of up to five, counted in texts one by one."""
    counts, order = defaultdict(Counter), url_markov.ORDER
    for t in texts:
        x = [*[None] * order, *t.encode(), -1]
        for i in range(order, len(x)):
            for k in range(order + 1):
                counts[tuple(x[i - k : i])][x[i]] += 1
    x, out = [*[None] * order, *url.encode(), -1], []
    for i in range(order, len(x)):
        p = 1 / url_markov.ALPHABET
        for k in range(order + 1):
            if c := counts.get(tuple(x[i - k : i])):
                p = (c[x[i]] + len(c) * p) / (sum(c.values()) + len(c))
        out.append(math.log(p))
    return np.array(out)


@pytest.mark.parametrize("entries", [url_markov.ENTRIES, 0])
def test_url_models_learn_from_every_url(spark, monkeypatch, entries):
    """Models, threshold and verdicts of both ways are those of all URLs that rules judge, however long or many."""
    monkeypatch.setattr(url_markov, "RANGE", 10)
    rng = random.Random(4)
    urls = [f"https://site{rng.randrange(40)}.com/article/{rng.randrange(999)}" for _ in range(120)] + [f"http://spam{rng.randrange(40)}.net/es/win?{rng.randrange(999)}" for _ in range(120)]
    urls += ["https://long.com/" + "xyz" * 2000, None, "", "ftp://other.org/ü", *(f"http://{a}.org/{b}" for a in ("site1", "spam2") for b in ("article/7", "win?5"))]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:30])], "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in url_markov.judged(pages, entries=entries).collect()}
    assert sorted(got) == list(range(len(urls) + 30))
    kept = {r["url"] for r in pages.where("pmod(xxhash64(url), 5) = 0").collect()}
    sides = {v: {r["url"] for r in pages.join(spark.createDataFrame([(i,) for i, r in got.items() if r["rule"] and r["verdict"] == v], "page_id long"), "page_id").collect()} for v in ("allow", "block")}
    ratio = lambda u: np.mean(brute_url_ratio(sides["allow"] - kept, u) - brute_url_ratio(sides["block"] - kept, u))
    for i in (0, 130, 240, 241, 242, 243, 244, 245, 246, 247):
        assert got[i]["ratio"] == pytest.approx(ratio(urls[i] or ""), rel=1e-6)
    by_url = {urls[i]: got[i]["ratio"] for i in range(len(urls))}
    threshold = url_markov.calibrated(*(np.array([by_url[u] for u in sorted(sides[v] & kept)]) for v in ("allow", "block")))
    for i, r in got.items():
        assert r["ratio"] == by_url[(urls + urls[:30])[i]]
        if r["rule"] is None:
            assert r["verdict"] == ("allow" if r["ratio"] >= threshold else "block")


def test_passes_of_k_means_read_packed_points(spark, monkeypatch):
    """The numbers are the one task's whatever the ranges and packed rows; a pass's input is few rows of bytes."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(6, 5)), 40, 0) + rng.normal(0, 0.2, (240, 5))
    points = spark.createDataFrame([(f"p{i:03}", [float(v) for v in r]) for i, r in enumerate(x)], "path string, embedding array<float>")
    rows = lambda df: sorted(tuple(r) for r in df.select("path", "cluster_id", "member_rank", "score").collect())
    want = rows(vectors.cluster(points, 6))
    monkeypatch.setattr(vectors, "RANGE_NUMBERS", 400)
    monkeypatch.setattr(vectors, "PACKED", 32)
    assert rows(vectors.cluster(points, 6, one_task=0)) == want
    packed = vectors._packed(points.withColumn("i", F.xxhash64("path")).coalesce(1))
    assert packed.count() == -(-240 // 32) and packed.schema["x"].dataType.simpleString() == "binary"
