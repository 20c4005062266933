"""Sizes from headers, and vector logs that are split among tasks."""

import json
import os
import random
import struct

import numpy as np
import pytest

from pellucid.sources import embedding_log
from pellucid.sources.folder import scan_folder
from pellucid.sources.headers import header_size


def reader(raw):
    return lambda at, n: raw[at : at + n]


def size_of(raw):
    return header_size(raw[:64], reader(raw), len(raw))


def tiff(order, entries_by_directory, big=False, gap=0):
    """A TIFF of directories of (tag, type, value); order is < or >."""
    width, count = (8, "Q") if big else (4, "H")
    offset = "Q" if big else "I"
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HH", 8, 0) if big else b"")
    at = len(out) + width + gap
    out += struct.pack(order + offset, at) + b"\0" * gap
    for k, entries in enumerate(entries_by_directory):
        body = struct.pack(order + count, len(entries))
        for tag, kind, value in entries:
            number = struct.pack(order + {3: "H", 4: "I", 16: "Q"}[kind], value)
            body += struct.pack(order + "HH" + offset, tag, kind, 1) + number.ljust(width, b"\0")
        at += len(body) + width
        out += body + struct.pack(order + offset, at if k + 1 < len(entries_by_directory) else 0)
    return out + b"pixels"


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_tiff_in_both_orders(order, big):
    own = [(254, 4, 0), (256, 3, 640), (257, 4, 480), (258, 3, 8)]
    assert size_of(tiff(order, [own], big)) == (640, 480)
    assert size_of(tiff(order, [[(254, 4, 1)], [(256, 4, 70_000)], own], big, gap=5000)) == (640, 480)  # a chain, far from the start
    assert size_of(tiff(order, [[(256, 3, 640)]], big)) is None and size_of(tiff(order, [own], big)[:20]) is None
    if big:
        assert size_of(tiff(order, [[(256, 16, 9), (257, 16, 8)]], big)) == (9, 8)


def test_tiff_whose_directories_go_in_a_circle():
    raw = bytearray(tiff("<", [[(254, 4, 1)], [(254, 4, 1)]]))
    raw[-10:-6] = struct.pack("<I", 8)  # the last one leads back to the first
    assert size_of(bytes(raw)) is None


def riff(kind, body):
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def test_webp_of_each_kind():
    lossy = b"\x10\x02\x00" + b"\x9d\x01\x2a" + struct.pack("<HH", 1 << 14 | 550, 368) + b"data"
    assert size_of(riff(b"VP8 ", lossy)) == (550, 368)
    lossless = b"\x2f" + struct.pack("<I", (1 << 28) | (399 << 14) | 16382) + b"data"
    assert size_of(riff(b"VP8L", lossless)) == (16383, 400)
    extended = b"\x10\0\0\0" + (69_999).to_bytes(3, "little") + (9).to_bytes(3, "little")
    assert size_of(riff(b"VP8X", extended)) == (70_000, 10)
    assert size_of(riff(b"VP8 ", b"\0" * 20)) is None and size_of(riff(b"VP8L", b"\0" * 20)) is None and size_of(riff(b"ICCP", extended)) is None


def box(kind, *parts, long=False):
    body = b"".join(parts)
    return struct.pack(">I", 1) + kind + struct.pack(">Q", 16 + len(body)) + body if long else struct.pack(">I", 8 + len(body)) + kind + body


def picture(brand, sizes, primary=None, owned=None, wide_items=False, wide_index=False, long=False):
    """A file of boxes; sizes are the extents among the properties, owned the properties of items."""
    extents = [box(b"ispe", b"\0" * 4, struct.pack(">II", *s)) if s else box(b"colr", b"nclx") for s in sizes]
    parts = []
    if owned is not None:
        rows = struct.pack(">I", len(owned))
        for item, own in owned.items():
            rows += struct.pack(">I" if wide_items else ">H", item) + bytes([len(own)]) + b"".join(struct.pack(">H", 0x8000 | k) if wide_index else bytes([0x80 | k]) for k in own)
        parts.append(box(b"ipma", bytes([int(wide_items), 0, 0, int(wide_index)]), rows))
    inside = [box(b"hdlr", b"\0" * 20)]
    if primary is not None:
        inside.append(box(b"pitm", b"\1\0\0\0" + struct.pack(">I", primary) if wide_items else b"\0\0\0\0" + struct.pack(">H", primary)))
    inside.append(box(b"iprp", box(b"ipco", *extents), *parts, long=long))
    return box(b"ftyp", brand, b"\0" * 4, b"mif1") + box(b"free", b"\0" * 300) + box(b"meta", b"\0" * 4, *inside, long=long) + box(b"mdat", b"data")


@pytest.mark.parametrize("brand", [b"heic", b"avif", b"mif1"])
@pytest.mark.parametrize("wide", [False, True])
def test_pictures_in_boxes(brand, wide):
    raw = picture(brand, [(160, 120), None, (4032, 3024)], 7, {3: [1], 7: [2, 3]}, wide, wide, wide)
    assert size_of(raw) == (4032, 3024)
    assert size_of(picture(brand, [(160, 120), (4032, 3024)], 3, {3: [1], 7: [2]}, wide, wide)) == (160, 120)
    assert size_of(picture(brand, [(160, 120), (640, 480)])) == (640, 480)  # no primary picture
    assert size_of(picture(brand, [None])) is None and size_of(raw[:200]) is None


def test_no_header_breaks_the_walk():
    """Random bytes behind every start, and whole files with bytes changed, end in a size or none."""
    rng = random.Random(1)
    whole = [tiff("<", [[(256, 3, 64), (257, 3, 48)]]), tiff(">", [[(256, 4, 64), (257, 4, 48)]], True), riff(b"VP8X", b"\0" * 10), picture(b"heic", [(16, 12)], 1, {1: [1]}), b"\xff\xd8\xff\xe0" + b"\0" * 90]
    for raw in whole * 60:
        raw = bytearray(raw)
        for _ in range(rng.randrange(1, 6)):
            raw[rng.randrange(4, len(raw))] = rng.randrange(256)
        got = size_of(bytes(raw[: rng.randrange(12, len(raw) + 1)]))
        assert got is None or min(got) > 0


def test_sizes_reach_the_records(spark, tmp_path):
    for name, raw in {"a.tiff": tiff("<", [[(256, 3, 64), (257, 3, 48)]]), "b.webp": riff(b"VP8L", b"\x2f" + struct.pack("<I", (9 << 14) | 19) + b"\0" * 3), "c.heic": picture(b"heic", [(32, 24)], 1, {1: [1]}), "d.avif": picture(b"avif", [(8, 6)], 1, {1: [1]})}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["relative_path"]: tuple(r["pixel_size"]) if r["pixel_size"] else None for r in scan_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.tiff": (64, 48), "b.webp": (20, 10), "c.heic": (32, 24), "d.avif": (8, 6)}


# vector logs


def test_log_is_read_in_ranges_of_whole_records(spark, tmp_path):
    rng = np.random.default_rng(2)
    entries = [(f"{k:064x}" if k % 5 else f"short{k}", rng.normal(size=24).astype(np.float32).tolist()) for k in range(3000)]
    path = str(tmp_path / "one.log")
    embedding_log.write_log(path, "p", entries)
    with open(path, "ab") as f:
        f.write(b"torn" * 20)
    df = embedding_log.read_log(spark, path, "p", 24, split_bytes=20_000)
    assert df.rdd.getNumPartitions() == -(-3000 // (20_000 // (64 + 96)))
    got = sorted(map(tuple, df.collect()), key=lambda r: r[2])
    assert got == [(k, v, n) for n, (k, v) in enumerate(entries)]


def test_log_written_by_many_tasks(spark, tmp_path):
    """Every task's file, read back in order; replaced at once; empty tasks, an empty log, wrong widths and owners."""
    path = str(tmp_path / "log")
    rows = [(f"k{k:04}", [float(k), 0.5]) for k in range(500)]
    df = spark.createDataFrame(rows, "content_hash string, embedding array<float>").repartitionByRange(6, "content_hash").sortWithinPartitions("content_hash")
    assert embedding_log.read_log(spark, path, "p") is None
    for some, n in ((df, 500), (df.where("content_hash < 'k0007'"), 7)):
        embedding_log.save_log(some, path, "p")
        got = sorted(map(tuple, embedding_log.read_log(spark, path, "p", 2, split_bytes=800).collect()), key=lambda r: r[2])
        assert got == [(k, v, i) for i, (k, v) in enumerate(rows[:n])]
        assert set(os.listdir(path)) == {"CURRENT", *json.loads(open(f"{path}/CURRENT").read())}
    assert embedding_log.read_log(spark, path, "q") is None and embedding_log.read_log(spark, path, "p", 3) is None
    mixed = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], df.schema).repartition(1)
    for bad in (mixed, mixed.repartition(2, "content_hash"), spark.createDataFrame([(None, [1.0])], df.schema)):
        with pytest.raises(Exception, match="one width"):
            embedding_log.save_log(bad, path, "p")
        assert embedding_log.read_log(spark, path, "p").count() == 7  # the old log stays
    embedding_log.save_log(df.where("false"), path, "p")
    assert embedding_log.read_log(spark, path, "p").count() == 0
