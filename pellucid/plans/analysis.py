"""All findings of one collection, as lazy DataFrames over its records."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import findings
from ..operators.graph import cut
from ..operators.similarity import BITS, COLOR


@dataclass
class Analysis:
    """A snapshot of findings; each is planned when it's first asked for."""

    records: DataFrame
    root: str = ""
    scanned_at: datetime | None = None
    threshold: int = BITS
    color: int = COLOR
    plan: str = "auto"

    @staticmethod
    def make(records: DataFrame, root: str = "", scanned_at: datetime | None = None, **options) -> Analysis:
        """records are computed once and kept in the checkpoint folder."""
        return Analysis(cut(records), root, scanned_at or datetime.now(UTC), **options)

    @cached_property
    def problems(self) -> DataFrame:
        return findings.problem_records(self.records)

    @cached_property
    def exact_members(self) -> DataFrame:
        return findings.exact_members(self.records)

    @cached_property
    def exact_groups(self) -> DataFrame:
        return findings.exact_groups(self.records)

    @cached_property
    def near(self) -> tuple[DataFrame, DataFrame]:
        return findings.near_groups(self.records, self.threshold, self.color, self.plan)

    @cached_property
    def leakage(self) -> tuple[DataFrame, DataFrame]:
        return findings.leakage_groups(self.records, self.threshold, self.color, self.plan)

    @cached_property
    def health(self) -> DataFrame:
        return findings.health(self.records, self.near[1], self.leakage[0])

    @cached_property
    def findings_per_file(self) -> DataFrame:
        return findings.findings_per_file(self.records, self.exact_members, self.near[1], self.leakage[1])

    @property
    def badge_counts(self) -> DataFrame:
        """(section, n) of the sections that have something."""
        from pyspark.sql import functions as F

        rows = None
        for name, df in (("exact", self.exact_groups), ("near", self.near[0]), ("problems", self.problems), ("leakage", self.leakage[0])):
            one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "n")
            rows = one if rows is None else rows.unionByName(one)
        return rows.where("n > 0")

    def removing(self, urls: DataFrame) -> Analysis:
        """The analysis of what's left without some files, as of the same scan."""
        return Analysis(findings.without(self.records, urls), self.root, self.scanned_at, self.threshold, self.color, self.plan)
