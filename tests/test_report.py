"""Reports written by tasks."""

import html
import os
import re

import pytest
from pyspark.sql import functions as F

from pellucid.plans import report
from pellucid.plans.analysis import Analysis
from pellucid.schema import RECORD


def record(path, content, size, problem=None, split="train", label="a", bits=None):
    return ("file:///d/" + path, path, size, None, "PNG", None, content, bits, [9] * 48, problem, label, split)


@pytest.fixture(scope="module")
def analysis(spark):
    """A large exact group, look-alikes over splits, names that need escaping, a problem of every kind."""
    rows = [record(f"g/{k}.png", "same", 1000 + k) for k in range(90)] + [record(f'n/{k} <&"{k}">, x.png', f"c{k}", 10**6 * k, bits=(1 << k) - 1, split="test" if k == 3 else "train", label="b") for k in range(6)]
    rows += [record(f"p/{p}.png", None, 0, problem=p) for p in ("empty", "truncated", "unreadable", "decode_failed")]
    return Analysis.make(spark.createDataFrame(rows, RECORD).repartition(3), "/data/my <set>")


@pytest.mark.parametrize("name", ["r.html", "r.CSV"])
def test_exported_bytes_are_those_of_the_driver(spark, analysis, tmp_path, name, monkeypatch):
    """The same bytes in many ranges and pieces; an old report goes only when the new one is whole."""
    path = tmp_path / name
    path.write_text("old")
    monkeypatch.setattr(report, "PIECE", 50)
    whole = report.contents(name, analysis)
    report.export(str(path), analysis)
    assert path.read_text(encoding="utf-8") == whole and os.listdir(tmp_path) == [name]

    def broken(*_):
        raise OSError("no more room")

    monkeypatch.setattr(report, "store", broken)
    with pytest.raises(OSError):
        report.export(str(path), analysis)
    assert path.read_text(encoding="utf-8") == whole


def test_page_has_every_group_and_what_it_would_free(analysis):
    page = report.html_text(analysis)
    assert page.count("<tr>") == page.count("</tr>") and page.count("<table>") == page.count("</table>") == 5 and "<&" not in page
    row = next(x for x in re.findall(r"<tr>.*?</tr>", page, re.S) if "exact-1" in x)
    files, group, freed = re.findall(r"<td>(.*?)</td>", row, re.S)
    assert len(files.split("<br>")) == 90 and files.count("keeping") == 1 and group == "exact-1"
    assert freed == report.byte_text(sum(1000 + k for k in range(1, 90)))
    chosen = analysis.exact_members.where("member_rank = 90").select("group_id", F.col("url").alias("keeper"))
    again = next(x for x in re.findall(r"<tr>.*?</tr>", report.html_text(analysis, chosen), re.S) if "exact-1" in x)
    assert report.byte_text(sum(1000 + k for k in range(89))) in again
    near = next(x for x in re.findall(r"<tr>.*?</tr>", page, re.S) if "near-1" in x)
    assert html.unescape(near).count('<&"') == 6
    leak = next(x for x in re.findall(r"<tr>.*?</tr>", page, re.S) if "Train ↔ Test" in x)
    assert re.findall(r"<td>(.*?)</td>", leak, re.S)[1:] == ["Train ↔ Test", "similar copy"]
    assert page.index("Won&#x27;t open" if "&#x27;" in page else "Won't open") < page.index("Exact duplicates") < page.index("Folder balance") < page.index("Version")


def test_byte_column(spark):
    sizes = [0, 1, 2, 999, 1000, 1499, 1501, 999_499, 999_501, 1_000_000, 1_260_000, 10_000_000, 999_400_000, 2_340_000_000, 5 * 10**12, 10**15]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r[0] for r in df.select(report.byte_column(F.col("n"))).collect()] == [report.byte_text(n) for n in sizes]


def test_many_findings(spark, tmp_path):
    """Two hundred thousand findings: the driver only copies."""
    none = F.lit(None)
    rows = spark.range(200_000).select(
        F.concat(F.lit("file:///d/"), "id").alias("url"), F.concat(F.lit("d/"), "id").alias("relative_path"), F.lit(5).cast("long").alias("byte_size"), none.cast("timestamp").alias("modified_at"), F.lit("PNG").alias("format"), none.cast("struct<width:int,height:int>").alias("pixel_size"),
        F.lit("x").alias("content_hash"), none.cast("long").alias("perceptual_hash"), none.cast("array<smallint>").alias("color_signature"), F.lit("empty").alias("problem"), none.cast("string").alias("label"), none.cast("string").alias("split"),
    )
    path = tmp_path / "many.csv"
    report.export(str(path), Analysis.make(rows))
    lines = path.read_text().splitlines()
    assert len(lines) == 200_001 and lines[1].startswith("Won't open,d/0,,") and lines[-1].startswith("Won't open,d/199999,,")
