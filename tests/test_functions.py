"""Column functions on small tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pellucid.functions import completeness, fingerprint, layout, ordering, vectors


def one(spark, value, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"x {kind}").select(f(F.col("x"))).collect()]


LAYOUT = {
    "train/tabby/001.jpg": ("tabby", "train"), "tabby/001.jpg": ("tabby", None), "siamese/nested/002.jpg": ("nested", None), "Training/dog/1.png": ("dog", "train"),
    "val/dog/1.png": ("dog", "validation"), "validation/dog/1.png": ("dog", "validation"), "testing/dog/1.png": ("dog", "test"), "holdout/dog/1.png": ("dog", "test"),
    "loose.jpg": (None, None), "train/test/x.png": ("test", "train"), "train/x.png": (None, "train"),
}


def test_layout(spark):
    rows = spark.createDataFrame([(k,) for k in LAYOUT], "p string").select("p", layout.attributes(F.col("p")).alias("a")).collect()
    assert {r["p"]: (r["a"]["label"], r["a"]["split"]) for r in rows} == LAYOUT


def test_relative_path(spark):
    assert one(spark, ["/a/b/c/d.png", "/x/y.png"], "string", lambda x: layout.relative_to(x, "/a/b")) == ["c/d.png", "y.png"]


COPIES = {"photo copy.jpg": True, "photo copy 2.jpg": True, "Copy of photo.jpg": True, "photo (1).png": True, "photo (12).png": True, "photo.jpg": False, "img-2.jpg": False, "cats 3.png": False, "0001.png": False, "copycat.jpg": False, "(1).png": False, "photo copy x.jpg": False}


def test_copy_names(spark):
    assert dict(zip(COPIES, one(spark, list(COPIES), "string", layout.looks_like_copy))) == COPIES


def test_natural_order(spark):
    names = ["img10", "Img1", "img2", "img02", "a/b10/c", "a/b9/z", "x" + "9" * 30, "x" + "1" + "0" * 30]
    rows = spark.createDataFrame([(x,) for x in names], "x string")
    got = [r[0] for r in rows.orderBy(ordering.natural_key(F.col("x")), "x").collect()]
    assert got == ["a/b9/z", "a/b10/c", "Img1", "img02", "img2", "img10", "x" + "9" * 30, "x" + "1" + "0" * 30]


RECORDS = "relative_path string, byte_size long, pixel_size struct<width:int,height:int>, modified_at timestamp, url string"


def records(spark, rows):
    return spark.createDataFrame([(p, b, s, None, p) for p, b, s in rows], RECORDS)


def test_sorting_keeps_missing_last(spark):
    df = records(spark, [("b", 2, (1, 1)), ("a", 1, None), ("c", 2, (3, 3)), ("d", 3, None)])
    keys = ordering.record_keys()
    paths = lambda key, up: [r["relative_path"] for r in ordering.arranged(df, keys[key], ascending=up).collect()]
    assert paths("dimensions", True) == ["b", "c", "a", "d"] and paths("dimensions", False) == ["c", "b", "a", "d"]
    assert paths("size", True) == ["a", "b", "c", "d"] and paths("size", False) == ["d", "c", "b", "a"]
    assert "dimensions" not in ordering.problem_keys() and "similarity" in ordering.group_keys(near=True)


def test_filter_ignores_case_and_accents(spark):
    df = records(spark, [("Holiday/Café.png", 1, None), ("x.png", 1, None)])
    count = lambda text: ordering.arranged(df, ordering.record_keys()["path"], text).count()
    assert (count("cafe"), count("  "), count("zzz")) == (1, 2, 0)
    groups = df.agg(F.collect_list("relative_path").alias("members"), F.first("relative_path").alias("first_path"), F.count("url").alias("n_members"), F.sum("byte_size").alias("reclaimable_bytes"))
    assert ordering.arranged(groups, ordering.group_keys()["count"], "CAFÉ", path="first_path", members="members").count() == 1


def test_hashes(spark):
    rng = random.Random(1)
    gray = [[rng.randrange(256) for _ in range(72)] for _ in range(20)] + [[255 - k % 9 for k in range(72)], [0] * 72]
    got = one(spark, gray, "array<int>", fingerprint.difference_hash)
    want = [sum(1 << (r * 8 + c) for r in range(8) for c in range(8) if g[r * 9 + c] > g[r * 9 + c + 1]) for g in gray]
    assert [x % 2**64 for x in got] == want and got[-2] == -1
    assert one(spark, [-1, 255], "long", fingerprint.hex_bits) == ["f" * 16, "00000000000000ff"]
    assert one(spark, [0, -1], "long", lambda x: fingerprint.hamming(x, F.lit(0).cast("long"))) == [0, 64]


def test_color_distance(spark):
    rows = spark.createDataFrame([([1, 2, 3], [4, 4, 4]), ([], []), ([1], [1, 2])], "a array<smallint>, b array<smallint>")
    assert [r[0] for r in rows.select(fingerprint.color_distance(F.col("a"), F.col("b"))).collect()] == [2, 255, 255]


PNG = b"\x89PNG\r\n\x1a\n" + bytes(20) + b"IEND\xaeB`\x82"
WHOLE = {
    b"\xff\xd8\xff" + bytes(20) + b"\xff\xd9": "complete", b"\xff\xd8\xff" + bytes(20) + b"\xff\xd9" + bytes(16): "complete", b"\xff\xd8\xff" + bytes(20) + b"\xff\xd9x": "truncated", b"\xff\xd8\xff" + b"a" * 20 + b"\x0f\xfd\x90": "truncated",
    PNG: "complete", PNG[:-1]: "truncated", b"GIF89a" + bytes(20) + b";": "complete", b"GIF87a" + bytes(20): "truncated",
    b"RIFF" + (20).to_bytes(4, "little") + b"WEBP" + bytes(16): "complete", b"RIFF" + (21).to_bytes(4, "little") + b"WEBP" + bytes(16): "truncated",
    b"plain text of no kind": "unknown", b"\xff\xd8\xff": "unknown", b"": "unknown",
}


def test_completeness(spark):
    rows = [(bytearray(x[:64]), bytearray(x[-66:]), len(x)) for x in WHOLE]
    df = spark.createDataFrame(rows, "head binary, tail binary, n long")
    got = [r[0] for r in df.select(completeness.completeness(F.col("head"), F.col("tail"), F.col("n"), F.lit(None).cast("string"))).collect()]
    assert got == list(WHOLE.values())


BOXES = [
    (b"\0\0\0\x10ftypheic\0\0\0\0" + b"\0\0\0\x08mdat", "complete"), (b"\0\0\0\x10ftypheic\0\0\0\0" + b"\0\0\0\x09mdat", "truncated"), (b"\0\0\0\x10ftypheic\0\0\0\0" + b"\0\0\0\0mdat123", "complete"),
    (b"\0\0\0\x10ftypheic\0\0\0\0" + b"\0\0\0\x01mdat" + (18).to_bytes(8, "big") + b"ab", "complete"), (b"\0\0\0\x07ftypheic", "unknown"), (b"\0\0\0\x10ftypheic\0\0\0\0x", "truncated"),
]


@pytest.mark.parametrize(("raw", "want"), BOXES)
def test_box_walk(raw, want):
    assert completeness.box_walk(lambda at, n: raw[at : at + n], len(raw)) == want


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = rows.select(vectors.normalized(F.col("a")), vectors.similarity(F.col("a"), F.col("b")), vectors.distance(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[1][0] == [0, 0] and [r[1] for r in got] == [3, 0, 0] and got[2][2] == 1
    assert [vectors.suggested_cluster_count(n) for n in (0, 1, 3, 2 * 4, 50, 500_000)] == [1, 1, 3, 2, 5, 24]
