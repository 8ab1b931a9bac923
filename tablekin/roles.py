"""Which columns are continuous and which are categorical."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Column roles of one table; ``columns`` keeps the table's own order."""

    columns: tuple[str, ...]
    continuous: tuple[str, ...]

    @property
    def categorical(self) -> tuple[str, ...]:
        return tuple(sorted(set(self.columns) - set(self.continuous)))

    def is_categorical(self, column: str) -> bool:
        return column not in self.continuous

    def features(self, target: str) -> list[str]:
        return [c for c in self.columns if c != target]

    def position(self, column: str) -> int:
        return self.columns.index(column)


def split_roles(columns: Sequence[str], continuous: Iterable[str], drop: Iterable[str] = ()) -> Roles:
    """Continuous columns are named, all others are categorical; names not in the table fall away."""
    gone = set(drop)
    kept = tuple(c for c in columns if c not in gone)
    named = set(continuous)
    return Roles(kept, tuple(c for c in kept if c in named))
