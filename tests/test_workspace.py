"""Recent folders, undo, progress, tokens and pixels."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pellucid.__main__ import main
from pellucid.functions import tokens
from pellucid.plans.progress import ScanProgress
from pellucid.plans.workspace import Bin, FolderTrash, RecentFolders
from pellucid.sources.pixels import DEVIATION, MEAN, Preprocessing, model_pixels

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def test_recent_folders(tmp_path):
    r = RecentFolders(str(tmp_path / "recent.json"), cap=2)
    for name in "abc":
        (tmp_path / name).mkdir()
        r.record(str(tmp_path / name))
    r.record(str(tmp_path / "b"))
    assert [os.path.basename(p) for p in r.load()] == ["b", "c"]
    (tmp_path / "c").rmdir()
    assert [os.path.basename(p) for p in r.load()] == ["b"]
    r.clear()
    assert r.load() == []


def test_undo_and_redo(tmp_path):
    files = [tmp_path / f"{k}.png" for k in range(3)]
    for f in files:
        f.write_text(f.name)
    b = Bin(FolderTrash(str(tmp_path / "trash")), levels=2)
    r = b.remove([str(files[0]), str(tmp_path / "no.png")])
    assert not files[0].exists() and r.failed and "no.png" in r.notice
    b.remove([str(files[1])])
    files[1].write_text("new")
    assert b.undo().failed == [str(files[1])] and files[1].read_text() == "new"
    assert b.undo().moved and files[0].read_text() == "0.png" and b.undo() is None
    assert b.redo().moved and not files[0].exists() and b.redo() is None
    for _ in range(4):
        files[2].write_text("x")
        b.remove([str(files[2])])
    assert len(b.done) == 2


def test_progress():
    assert ScanProgress().fraction is None and ScanProgress("reading", 5, 10).fraction == 0.5 and ScanProgress("reading", 12, 10).fraction == 1


def test_folder_argument(tmp_path, capsys):
    assert main(["--folder", "/", "--folder", str(tmp_path / "none")]) == 2


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_tokens(spark):
    e = tokens.Encoder(VOCABULARY, 6)
    short, long, blank = e.encode(["A  Cat", "a cat " * 50, ""])
    assert short[0] == e.start and short[-1] == e.end and len(short) == 4 and len(long) == 6 and long[-1] == e.end and blank == [e.start, e.end]
    df = spark.createDataFrame([("a cat",), ("A CAT",)], "t string")
    assert [r[0] for r in df.select(tokens.token_ids(F.col("t"), VOCABULARY, 6)).collect()] == [short, short]


def test_pixels():
    x = model_pixels(np.full((40, 80, 3), 255, np.uint8), Preprocessing(size=8))
    assert x.shape == (8, 8, 3) and np.allclose(x[0, 0], (1 - np.array(MEAN)) / np.array(DEVIATION), atol=1e-5)
    assert Preprocessing.read('{"crop_size": {"height": 16}, "image_mean": [0, 0, 0]}') == Preprocessing(16, (0, 0, 0), DEVIATION) and Preprocessing.read("{") == Preprocessing()
