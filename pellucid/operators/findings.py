"""Exact and near duplicates, split leakage, problems, health, and what is found of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.layout import split_ordinal, split_title
from ..functions.ordering import fidelity_first, keeper_keys, matches_text, natural_key, split_then_path
from ..schema import PROBLEMS, SPLITS
from .graph import cut
from .ranking import ranked, ranked_within
from .similarity import BITS, COLOR, clusters
from .spread import spreads


def usable(records: DataFrame) -> DataFrame:
    return records.where("problem is null")


def problem_records(records: DataFrame) -> DataFrame:
    return records.where("problem is not null")


def problem_summary(problem):
    out = F.lit(None).cast("string")
    for name, text in PROBLEMS.items():
        out = F.when(problem == name, F.lit(text)).otherwise(out)
    return out


def exact_members(records: DataFrame) -> DataFrame:
    """Usable records that share their content, with group_id and member_rank; rank 1 is the one to keep."""
    some = usable(records).where("content_hash is not null")
    # partial counts; the rows of one content can be split among tasks in the join and lie in ranges after it
    shared = some.groupBy("content_hash").count().where("count > 1").select("content_hash")
    keys = {f"_key{i}": k for i, k in enumerate(keeper_keys())}
    ranks = ranked_within(some.join(shared, "content_hash", "left_semi").select(*records.columns), "content_hash", [F.col(k).asc() for k in keys], keys=keys)
    return ranks.withColumn("group_id", F.concat(F.lit("exact-"), F.col("content_hash")))


def group_summary(members: DataFrame) -> DataFrame:
    """One row for each group of (group_id, member_rank, byte_size, relative_path)."""
    first = F.col("member_rank") == 1
    return members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_members"),
        F.sum(F.when(first, F.lit(0)).otherwise(F.col("byte_size"))).alias("reclaimable_bytes"),
        F.max(F.when(first, F.col("relative_path"))).alias("first_path"),
    )


def numbered(groups: DataFrame, prefix: str, *order) -> DataFrame:
    """groups with number 1.. and name in the given order."""
    rows = ranked(groups, [*order, F.col("_natural").asc(), F.col("first_path").asc()], "number", keys={"_natural": natural_key(F.col("first_path"))})
    return rows.withColumn("number", F.col("number").cast("int")).withColumn("name", F.concat(F.lit(prefix + "-"), F.col("number")))


def exact_summary(records: DataFrame) -> DataFrame:
    """group_summary of exact_members by partial results of each task; no member is ranked."""
    keys = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keeper_keys())))
    first = F.min_by(F.struct(F.col("byte_size").alias("size"), F.col("relative_path").alias("path")), keys)
    groups = usable(records).where("content_hash is not null").groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_members"), F.sum("byte_size").alias("total"), first.alias("first"))
    return groups.where("n_members > 1").select(F.concat(F.lit("exact-"), "content_hash").alias("group_id"), "n_members", (F.col("total") - F.col("first.size")).alias("reclaimable_bytes"), F.col("first.path").alias("first_path"))


def exact_groups(records: DataFrame) -> DataFrame:
    """Groups of equal files, most recoverable bytes first."""
    return numbered(exact_summary(records), "exact", F.col("reclaimable_bytes").desc())


def representatives(records: DataFrame) -> DataFrame:
    """The first record of each content, and all without one."""
    # a partial result for each task, so that copies of one content needn't meet
    first = F.min_by(F.struct(*records.columns), F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keeper_keys()))))
    return records.groupBy(F.coalesce("content_hash", "url")).agg(first.alias("first")).select("first.*")


def fingerprints(records: DataFrame) -> DataFrame:
    return records.select(F.col("url").alias("id"), F.col("perceptual_hash").alias("bits"), F.col("color_signature").alias("color"))


def _grouped(records: DataFrame, found: DataFrame, order, prefix: str) -> DataFrame:
    """records with component, member_rank, group_id and the group's spread, computed once; found has (id, label), order(natural) are the members' keys."""
    members = records.join(found.select(F.col("id").alias("url"), F.col("label").alias("component")), "url")
    members = cut(ranked_within(members, "component", order(F.col("_natural")), keys={"_natural": natural_key(F.col("relative_path"))}).drop("n_members"))
    first = members.where("member_rank = 1").select("component", F.concat(F.lit(prefix), "relative_path").alias("group_id"))
    far = spreads(members.select(F.col("component").alias("label"), F.col("perceptual_hash").alias("bits"))).withColumnRenamed("label", "component")
    return cut(members.join(first.join(far, "component"), "component"))


def near_members(ones: DataFrame, found: DataFrame) -> DataFrame:
    """Ranked members of look-alikes, from representatives and their components (id, label)."""
    return _grouped(ones, found, fidelity_first, "near-")


def near_summary(members: DataFrame) -> DataFrame:
    """The groups of near_members, largest first."""
    groups = group_summary(members).join(members.where("member_rank = 1").select("group_id", "spread"), "group_id")
    return numbered(groups, "near", F.col("n_members").desc())


def near_groups(records: DataFrame, threshold: int = BITS, color: int = COLOR, plan: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(groups, members) of look-alikes among representatives, largest first."""
    ones = cut(representatives(usable(records)))  # read several times below
    members = near_members(ones, clusters(fingerprints(ones), threshold, color, plan))
    return near_summary(members), members


def divided(records: DataFrame) -> DataFrame:
    """The records among which leakage is looked for."""
    return usable(records).where("split is not null")


def leakage_members(some: DataFrame, found: DataFrame) -> DataFrame:
    """Ranked members of look-alikes that lie in more than one split, from divided records and their components (id, label)."""
    found = cut(found)  # read twice
    splits = found.join(some.select(F.col("url").alias("id"), "split"), "id").groupBy("label").agg(F.count_distinct("split").alias("n")).where("n > 1")
    return _grouped(some, found.join(splits.select("label"), "label", "left_semi"), split_then_path, "leak-")


def leakage_summary(members: DataFrame) -> DataFrame:
    """The groups of leakage_members, certain ones first, then the closest."""
    twin = members.where("content_hash is not null").groupBy("group_id", "content_hash").agg(F.count_distinct("split").alias("n")).groupBy("group_id").agg(F.max(F.col("n") > 1).alias("identical"))
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(split_ordinal(F.col("split")).alias("k"), split_title(F.col("split")).alias("t")))), lambda x: x["t"]), " ↔ ")
    groups = group_summary(members).join(members.groupBy("group_id").agg(names.alias("splits"), F.max("spread").alias("spread")), "group_id").join(twin, "group_id", "left")
    groups = groups.withColumn("identical", F.coalesce("identical", F.lit(False)))
    return numbered(groups, "leak", F.col("identical").desc(), F.col("spread").asc())


def leakage_groups(records: DataFrame, threshold: int = BITS, color: int = COLOR, plan: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(groups, members) of look-alikes that lie in more than one split; certain ones first, then the closest."""
    some = cut(divided(records))
    members = leakage_members(some, clusters(fingerprints(some), threshold, color, plan))
    return leakage_summary(members), members


def leakage_by_split(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id", "split").agg(F.count(F.lit(1)).alias("n"))


def tally(records: DataFrame, column: str, unknown: str) -> DataFrame:
    """(name, n, place): how often each value occurs, most frequent first."""
    counts = records.groupBy(F.coalesce(F.col(column), F.lit(unknown)).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, [F.col("n").desc(), natural_key(F.col("name")).asc(), F.col("name").asc()])


def format_tally(records: DataFrame) -> DataFrame:
    return tally(records, "format", "Unknown")


def label_tally(records: DataFrame) -> DataFrame:
    """Labelled files only, those with problems too."""
    return tally(records.where("label is not null"), "label", "Unlabeled")


def split_tally(records: DataFrame) -> DataFrame:
    title = F.when(F.col("split").isin(*SPLITS), split_title(F.col("split")))
    return tally(records.withColumn("split", title), "split", "Unsplit")


def health(records: DataFrame, near: DataFrame | None = None, leaks: DataFrame | None = None) -> DataFrame:
    """One row of totals; near members and leakage groups are counted if given."""
    groups = exact_summary(records)
    totals = records.agg(
        F.count(F.lit(1)).alias("n_images"),
        F.coalesce(F.sum("byte_size"), F.lit(0)).alias("n_bytes"),
        F.count("problem").alias("n_problems"),
        F.count_if(F.col("label").isNull()).alias("n_unlabelled"),
    )
    copies = groups.agg(F.count(F.lit(1)).alias("n_exact_groups"), F.coalesce(F.sum(F.col("n_members") - 1), F.lit(0)).alias("n_redundant"), F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"))
    labels = records.where("label is not null").groupBy("label").count().agg(
        F.count(F.lit(1)).alias("n_labels"), F.when(F.count(F.lit(1)) >= 2, F.max("count") / F.min("count")).alias("label_imbalance")
    )
    splits = records.groupBy(F.coalesce("split", F.lit(""))).count().agg(F.count(F.lit(1)).alias("n_splits"))
    # each side is one row
    row = totals.join(F.broadcast(copies)).join(F.broadcast(labels)).join(F.broadcast(splits))
    row = row.withColumns({"has_labels": F.col("n_labels") >= 2, "has_splits": F.col("n_splits") >= 2, "imbalance_concerning": F.coalesce(F.col("label_imbalance") >= 3, F.lit(False))}).drop("n_splits")
    if near is not None:
        row = row.join(F.broadcast(near.agg(F.count(F.lit(1)).alias("n_near_images"))))
    if leaks is not None:
        row = row.join(F.broadcast(leaks.agg(F.count(F.lit(1)).alias("n_leaks"))))
    return row


def findings_per_file(records: DataFrame, exact: DataFrame, near: DataFrame, leaks: DataFrame) -> DataFrame:
    """(url, findings): all reasons of each file that has one, in the order problem, exact, near, leakage."""
    rows = records.where("problem is not null").select("url", F.lit(0).alias("k"), problem_summary(F.col("problem")).alias("reason"))
    for k, (name, members) in enumerate((("Exact duplicate", exact), ("Near duplicate", near), ("Split leakage", leaks)), 1):
        rows = rows.unionByName(members.select("url", F.lit(k).alias("k"), F.lit(name).alias("reason")).distinct())
    return rows.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "reason"))), lambda x: x["reason"]).alias("findings"))


def chosen_keepers(members: DataFrame, keepers: DataFrame) -> DataFrame:
    """members with is_keeper: the user's choice (group_id, keeper) while it's a member, else rank 1."""
    chosen = keepers.select("group_id", "keeper").dropDuplicates(["group_id"])
    there = chosen.join(members.select("group_id", F.col("url").alias("keeper")), ["group_id", "keeper"], "left_semi")
    rows = members.join(there, "group_id", "left")
    return rows.withColumn("is_keeper", F.coalesce(F.col("keeper") == F.col("url"), F.col("member_rank") == 1)).drop("keeper")


def redundant_bytes(members: DataFrame) -> DataFrame:
    """(group_id, redundant_bytes): bytes of members that aren't kept."""
    return members.groupBy("group_id").agg(F.sum(F.when(F.col("is_keeper"), F.lit(0)).otherwise(F.col("byte_size"))).alias("redundant_bytes"))


def displayed_bytes(members: DataFrame, text: str = "") -> DataFrame:
    """One row (n_groups, redundant_bytes) over the groups with a member whose path contains text; is_keeper says what is kept."""
    shown = members.where(matches_text(F.col("relative_path"), text)).select("group_id").distinct()
    sums = redundant_bytes(members.join(shown, "group_id", "left_semi"))
    return sums.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("redundant_bytes"), F.lit(0)).alias("redundant_bytes"))


def reconciled_keepers(keepers: DataFrame, members: DataFrame) -> DataFrame:
    """Choices that still hold: in their own group, or for a near group any old near choice that now is a member; the first old id wins."""
    held = members.select("group_id", F.col("url").alias("keeper"))
    own = keepers.join(held, ["group_id", "keeper"], "left_semi")
    moved = keepers.where(F.col("group_id").startswith("near-")).select(F.col("group_id").alias("old_id"), "keeper").join(held.where(F.col("group_id").startswith("near-")), "keeper")
    moved = moved.groupBy("group_id").agg(F.min_by("keeper", "old_id").alias("keeper"))
    return own.unionByName(moved.join(own, "group_id", "left_anti").select("group_id", "keeper"))


def without(records: DataFrame, urls: DataFrame) -> DataFrame:
    """records without those of the given urls."""
    return records.join(urls.select("url").distinct(), "url", "left_anti")
