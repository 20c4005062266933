"""Total orders: natural path order, keepers, fidelity, and the sort keys of lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import depth, file_name, looks_like_copy, split_ordinal


def natural_key(path: Column) -> Column:
    """An array that orders paths without regard to case and by the value of numbers in them."""
    pieces = F.regexp_extract_all(F.lower(path), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def one(x: Column) -> Column:
        number = F.regexp_replace(x, "^0+(?=[0-9])", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(number).cast("string"), 6, "0"), number)).otherwise(x)

    return F.transform(pieces, one)


def pixel_count(pixel_size: Column) -> Column:
    return pixel_size["width"].cast("long") * pixel_size["height"]


def size_text(pixel_size: Column) -> Column:
    """Width × height, or null."""
    return F.concat(pixel_size["width"].cast("string"), F.lit(" × "), pixel_size["height"].cast("string"))


def keeper_first() -> list[Column]:
    """Of equal files: not named like a copy, nearer to the root, then by path."""
    return [k.asc() for k in keeper_keys()]


def keeper_keys() -> list[Column]:
    p = F.col("relative_path")
    return [looks_like_copy(file_name(p)), depth(p), natural_key(p), p, F.col("url")]


def fidelity_first(natural: Column | None = None) -> list[Column]:
    """Of similar files: more pixels, more bytes, then by path; natural is the path's key if it's there."""
    p = F.col("relative_path")
    return [F.coalesce(pixel_count(F.col("pixel_size")), F.lit(0)).desc(), F.col("byte_size").desc(), *_by_path(natural, p)]


def split_then_path(natural: Column | None = None) -> list[Column]:
    p = F.col("relative_path")
    return [split_ordinal(F.col("split")).asc(), *_by_path(natural, p)]


def _by_path(natural: Column | None, path: Column) -> list[Column]:
    return [(natural_key(path) if natural is None else natural).asc(), path.asc(), F.col("url").asc()]


@dataclass(frozen=True)
class SortKey:
    """A named way to sort a list; optional keys may be missing, and missing ones stand last in both directions."""

    title: str
    value: Column

    def order(self, path: Column, ascending: bool = True) -> list[Column]:
        same = natural_key(path)
        if ascending:
            return [self.value.asc_nulls_last(), same.asc(), path.asc()]
        # rows without a value stay in the order of paths
        none = self.value.isNull()
        return [self.value.desc_nulls_last(), F.when(none, same).asc(), F.when(~none, same).desc(), F.when(none, path).asc(), F.when(~none, path).desc()]


def record_keys() -> dict[str, SortKey]:
    return {
        "path": SortKey("Path", natural_key(F.col("relative_path"))),
        "size": SortKey("Size", F.col("byte_size")),
        "dimensions": SortKey("Dimensions", pixel_count(F.col("pixel_size"))),
        "modified": SortKey("Modified", F.col("modified_at")),
    }


def problem_keys() -> dict[str, SortKey]:
    return {k: v for k, v in record_keys().items() if k != "dimensions"}


def group_keys(near: bool = False) -> dict[str, SortKey]:
    keys = {"path": SortKey("Path", natural_key(F.col("first_path"))), "count": SortKey("Count", F.col("n_members")), "reclaimable": SortKey("Recoverable", F.col("reclaimable_bytes"))}
    return keys | ({"similarity": SortKey("Similarity", F.col("spread"))} if near else {})


def leakage_keys() -> dict[str, SortKey]:
    return {"path": SortKey("Path", natural_key(F.col("first_path"))), "count": SortKey("Count", F.col("n_members")), "spread": SortKey("Spread", F.col("spread"))}


def matches_text(path: Column, text: str) -> Column:
    """Does path contain text, whatever case and accents; blank text matches all."""
    wanted = text.strip()
    if not wanted:
        return F.lit(True)
    return F.contains(F.collate(path, "UNICODE_CI_AI"), F.lit(wanted))


def arranged(df: DataFrame, key: SortKey, text: str = "", ascending: bool = True, path: str = "relative_path", members: str | None = None) -> DataFrame:
    """Filter, then sort; a group matches if any of its members (an array of paths) does."""
    wanted = F.exists(members, lambda x: matches_text(x, text)) if members else matches_text(F.col(path), text)
    return df.where(wanted).orderBy(*key.order(F.col(path), ascending))
