"""How far a scan is."""

from __future__ import annotations

from dataclasses import dataclass

PHASES = ("discovering", "reading", "analysing", "done")


@dataclass(frozen=True)
class ScanProgress:
    phase: str = PHASES[0]
    processed: int = 0
    total: int | None = None

    @property
    def fraction(self) -> float | None:
        """At most 1; None while the total isn't known, 1 when an empty folder is done."""
        if not self.total:
            return 1.0 if self.phase == PHASES[-1] else None
        return min(1.0, self.processed / self.total)
