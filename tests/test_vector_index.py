"""Exact search of many queries over cells, against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pellucid.operators import vector_index
from pellucid.operators.vectors import best_others


def brute(vectors, queries, limit, own=False):
    out = {}
    for name, q in queries:
        if name is None or q is None:
            continue
        s = [(-float((np.array(v, np.float32).astype(float) * np.array(q, np.float32).astype(float)).sum()), p) for p, v in vectors if p is not None and v is not None and len(v) == len(q) and (own or p != name)]
        for k, (x, p) in enumerate(sorted(s)[:limit], 1):
            out[name, k] = (p, pytest.approx(-x, abs=1e-9))
    return out


@pytest.fixture(scope="module")
def vectors():
    """Groups around centres, not of length 1, one vector two hundred times, other widths, zero and null vectors."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    rows = [centres[k % 12] + rng.normal(size=16) * rng.choice([0.05, 0.5]) for k in range(900)] + [centres[0]] * 200 + [np.zeros(16)] * 3 + [rng.normal(size=5) for _ in range(30)] + [rng.normal(size=3)]
    named = [(f"p{k:05}", [float(np.float32(x)) for x in v]) for k, v in enumerate(rows)]
    return named + [("none", None), ("empty", [])]


@pytest.mark.parametrize(("limit", "cell_rows"), [(1, 2048), (7, 30), (300, 30)])
def test_most_similar_against_brute_force(spark, vectors, limit, cell_rows, monkeypatch):
    monkeypatch.setattr(vector_index, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 16)
    df = spark.createDataFrame(vectors, "path string, embedding array<float>").repartition(4)
    asked = vectors[::40] + vectors[-3:] + [("stranger", [1.0] * 16), ("lonely", [1.0] * 9)]
    queries = spark.createDataFrame(asked, "path string, embedding array<float>")
    for own in (False, True):
        got = {(r["query"], r["place"]): (r["path"], r["similarity"]) for r in vector_index.most_similar(df, queries, limit, own, cell_rows).collect()}
        assert got == brute(vectors, asked, limit, own)


def test_bounds_leave_most_cells_out(spark, monkeypatch):
    """Groups far apart: a query meets few of the vectors, and copies of one vector are dealt to many blocks."""
    rng = np.random.default_rng(1)
    centres = np.eye(40) * 10
    rows = [(f"p{k:05}", [float(x) for x in (centres[k % 40] + rng.normal(size=40) * 0.01).astype(np.float32)]) for k in range(4000)]
    df = spark.createDataFrame(rows, "path string, embedding array<float>")
    met, blocks = [], []
    real = vector_index._looked_up
    monkeypatch.setattr(vector_index, "VECTOR_BLOCK", 50)

    def looked_up(probes, held, limit, own):
        met.append(probes.join(held.groupBy("width", "cell").count(), ["width", "cell"]).agg(F.sum("count")).first()[0] or 0)
        blocks.append(held.groupBy("cell").count().agg(F.max("count")).first()[0])
        return real(probes, held, limit, own)

    monkeypatch.setattr(vector_index, "_looked_up", looked_up)
    queries = df.where("substring(path, 2, 5) % 20 = 0")
    got = vector_index.most_similar(df, queries, 5, cell_rows=50).collect()
    want = brute(rows, [r for k, r in enumerate(rows) if k % 20 == 0], 5)
    assert {(r["query"], r["place"]): (r["path"], r["similarity"]) for r in got} == want
    assert sum(met) < 200 * 4000 / 8 and max(blocks) > 50


def test_search_of_nothing(spark, vectors):
    df = spark.createDataFrame(vectors[:5], "path string, embedding array<float>")
    for left, right in ((df, df.where("false")), (df.where("false"), df)):
        assert vector_index.most_similar(left, right, 3).count() == 0
    assert vector_index.most_similar(df, df, 0).count() == 0
    one = df.limit(1)
    assert vector_index.most_similar(one, one, 3).count() == 0 and best_others(one, df).count() == 4
