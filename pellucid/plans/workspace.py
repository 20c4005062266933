"""Side effects around an analysis: recent folders, and moving files away and back."""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import dataclass, field
from typing import Protocol

RECENT = 10
UNDO_LEVELS = 5
NAMED_FAILURES = 3


class RecentFolders:
    """The folders opened last, newest first, in a small file; those that are gone are left out."""

    def __init__(self, path: str, cap: int = RECENT):
        self.path, self.cap = path, cap

    def load(self) -> list[str]:
        try:
            with open(self.path, encoding="utf-8") as f:
                listed = json.load(f)
        except (OSError, ValueError):
            return []
        return [p for p in listed if os.path.isdir(p)][: self.cap]

    def record(self, folder: str) -> list[str]:
        folder = os.path.realpath(folder)
        kept = [folder, *(p for p in self.load() if p != folder)][: self.cap]
        with open(self.path, "w", encoding="utf-8") as f:
            json.dump(kept, f)
        return kept

    def clear(self) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


class Trashing(Protocol):
    def move(self, path: str) -> str:
        """Move a file away; returns where it is now."""

    def restore(self, moved: str, path: str) -> None:
        """Move it back; never over a file that is there again."""


class FolderTrash:
    """Keeps moved files in a folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def move(self, path: str) -> str:
        os.makedirs(self.folder, exist_ok=True)
        target = os.path.join(self.folder, f"{uuid.uuid4().hex}-{os.path.basename(path)}")
        shutil.move(path, target)
        return target

    def restore(self, moved: str, path: str) -> None:
        if os.path.exists(path):
            raise FileExistsError(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        shutil.move(moved, path)


@dataclass
class Removal:
    """What one removal moved: original path to where it is now; and what it couldn't move."""

    moved: dict[str, str] = field(default_factory=dict)
    failed: list[str] = field(default_factory=list)

    @property
    def notice(self) -> str:
        if not self.failed:
            return f"{len(self.moved)} moved"
        named = ", ".join(os.path.basename(p) for p in self.failed[:NAMED_FAILURES])
        return f"{len(self.moved)} moved, {len(self.failed)} failed: {named}" + (", ..." if len(self.failed) > NAMED_FAILURES else "")


class Bin:
    """Moves files away with undo and redo; the findings change by Analysis.removing."""

    def __init__(self, trash: Trashing, levels: int = UNDO_LEVELS):
        self.trash, self.levels = trash, levels
        self.done: list[Removal] = []
        self.undone: list[list[str]] = []

    def remove(self, paths: list[str]) -> Removal:
        self.undone.clear()
        return self._remove(paths)

    def _remove(self, paths: list[str]) -> Removal:
        r = Removal()
        for p in paths:
            try:
                r.moved[p] = self.trash.move(p)
            except OSError:
                r.failed.append(p)
        if r.moved:
            self.done = [*self.done, r][-self.levels :]
        return r

    def forget(self) -> None:
        """Nothing can be undone any more; moved files stay where they are."""
        self.done, self.undone = [], []

    def undo(self) -> Removal | None:
        """Bring back the last removal; files that reappeared are left as they are and reported."""
        if not self.done:
            return None
        last, back = self.done.pop(), Removal()
        for path, moved in last.moved.items():
            try:
                self.trash.restore(moved, path)
                back.moved[path] = moved
            except OSError:
                back.failed.append(path)
        if back.moved:
            self.undone.append(list(back.moved))
        return back

    def redo(self) -> Removal | None:
        return self._remove(self.undone.pop()) if self.undone else None
