"""What folder and file names say about a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SPLITS

#: Folder names that stand for a split.
SPLIT_NAMES = {
    "train": ("train", "training", "trainval"),
    "validation": ("val", "valid", "validation", "dev"),
    "test": ("test", "testing", "eval", "holdout"),
}


def split_of(folder: Column) -> Column:
    """The split that a folder name stands for, in any case, or null."""
    name = F.lower(folder)
    out = F.lit(None).cast("string")
    for split, names in SPLIT_NAMES.items():
        out = F.when(name.isin(*names), F.lit(split)).otherwise(out)
    return out


def split_ordinal(split: Column) -> Column:
    """Position in the order of splits; null counts as the first."""
    out = F.lit(0)
    for k, name in enumerate(SPLITS):
        out = F.when(split == name, F.lit(k)).otherwise(out)
    return out


def split_title(split: Column) -> Column:
    return F.initcap(split)


def relative_to(url: Column, root: str) -> Column:
    """The path below root; of a file outside, its last component alone."""
    base = root.rstrip("/") + "/"
    return F.when(url.startswith(base), F.substring(url, len(base) + 1, 1 << 20)).otherwise(F.element_at(F.split(url, "/"), -1))


def attributes(relative_path: Column) -> Column:
    """struct(label, split): the first split-named folder is the split, the last other folder the label."""
    parts = F.filter(F.split(relative_path, "/"), lambda x: x != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    splits = F.transform(folders, split_of)
    first = F.coalesce(F.array_position(F.transform(splits, lambda x: x.isNotNull()), True), F.lit(0))
    others = F.filter(folders, lambda _, i: (i + 1) != first)
    return F.struct(
        F.when(F.size(others) > 0, F.element_at(others, -1)).alias("label"),
        F.when(first > 0, F.get(splits, (first - 1).cast("int"))).alias("split"),
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def looks_like_copy(name: Column) -> Column:
    """Names that copying leaves behind: `x copy`, `x copy 2`, `copy of x`, `x (1)`; numbered names alone are none."""
    stem = F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    return stem.endswith(" copy") | stem.startswith("copy of ") | stem.rlike(r"^(?:(?! copy ).)* copy \d*$") | stem.rlike(r"^.+\(\d+\)$")
