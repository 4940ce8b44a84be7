"""Provenance: an acyclic graph of operations, each named by the digest of what it says."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from ..functions.scalar import canonical_digest


@dataclass(frozen=True)
class Record:
    operation: str
    parents: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    parameters: tuple[tuple[str, object], ...] = ()
    outputs: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return canonical_digest(self)


@dataclass(frozen=True)
class Graph:
    records: tuple[Record, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        known: set[str] = set()
        for r in self.records:
            if r.id in known:
                raise ValueError("a record repeats")
            if missing := set(r.parents) - known:
                raise ValueError(f"parents come first: {sorted(missing)}")
            known.add(r.id)

    def append(self, records: Iterable[Record]) -> Graph:
        known = {r.id for r in self.records}
        return Graph((*self.records, *(r for r in records if r.id not in known)))

    def tips(self) -> list[str]:
        used = {p for r in self.records for p in r.parents}
        return [r.id for r in self.records if r.id not in used]

    def digest(self) -> str:
        return canonical_digest(sorted(r.id for r in self.records))
