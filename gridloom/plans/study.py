"""Collections of frames with one schema, studies of different frames, and filters that follow foreign keys."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.axis import InvalidAxis, key_problems
from ..operators.entities import BrokenRelation, Entity, entity_ids, paths
from ..operators.groups import strict
from .frame import Frame

LINKS = ("derived_from", "mapped_from", "corresponds_to", "aligned_from")


@dataclass(frozen=True)
class Link:
    """From one frame to another; ``pairs``: (from_id, to_id)."""

    source: str
    target: str
    type: str
    pairs: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.type not in LINKS:
            raise ValueError(f"a link is one of {LINKS}")


@dataclass(frozen=True)
class Events:
    """Keyed events with onset and duration in seconds."""

    table: DataFrame
    key: str = "event_id"

    def problems(self) -> DataFrame:
        """One row: events without a key, repeated keys, and onsets or durations that are missing, negative or not finite."""
        empty, repeated = key_problems(self.table, self.key)
        odd = lambda c: F.coalesce(F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) < 0) | (F.col(c) == float("inf"))).cast("long")), F.lit(0))
        return self.table.agg(F.lit(empty).cast("long").alias("empty"), F.lit(repeated).cast("long").alias("repeated"), odd("onset").alias("bad_onset"), odd("duration").alias("bad_duration"))

    def validate(self) -> Events:
        if any(self.problems().first()):
            raise InvalidAxis("the events have bad keys or times")
        return self


def schema_of(frame: Frame) -> tuple:
    """What frames of one collection share."""
    return (
        sorted((n, a.role, a.units, a.source.dtype) for n, a in frame.assays.items()),
        sorted(frame.observations.table.dtypes),
        type(frame.space).__name__,
        sorted((n, e.key, tuple(sorted(e.table.dtypes))) for n, e in frame.entities.items()),
        sorted(frame.relations),
    )


@dataclass(frozen=True)
class Collection:
    frames: Mapping[str, Frame]

    def __post_init__(self) -> None:
        if len({str(schema_of(f)) for f in self.frames.values()}) > 1:
            raise InvalidAxis("frames of a collection need one schema")

    def common_space(self) -> bool:
        return len({f.space.digest for f in self.frames.values()}) == 1


@dataclass(frozen=True)
class Study:
    frames: Mapping[str, Frame | Collection]
    entities: Mapping[str, Entity] = field(default_factory=dict)
    links: Mapping[str, Link] = field(default_factory=dict)
    tables: Mapping[str, DataFrame | Events] = field(default_factory=dict)

    def validate(self) -> Study:
        """Frames' own entities must agree with the shared ones, column by column, for the keys that they have."""
        for f in self._every():
            for n, e in f.entities.items():
                shared = self.entities.get(n)
                if shared is None:
                    continue
                both = [c for c in e.table.columns if c in shared.table.columns and c != e.key]
                theirs = shared.table.select(F.col(shared.key).alias(e.key), *[F.col(c).alias(f"__{c}") for c in both])
                differ = F.lit(False)
                for c in both:
                    differ = differ | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
                if e.table.join(theirs, e.key).where(differ).limit(1).count() or e.table.join(theirs, e.key, "left_anti").limit(1).count():
                    raise BrokenRelation(f"{n} disagrees with the shared table")
        return self

    def _every(self) -> list[Frame]:
        return [g for f in self.frames.values() for g in (f.frames.values() if isinstance(f, Collection) else [f])]

    def frame(self, name: str) -> Frame | Collection:
        """A frame with the shared entities in place of its own."""
        share = lambda f: replace(f, entities={**f.entities, **{n: e for n, e in self.entities.items() if n in f.entities}})
        f = self.frames[name]
        return Collection({n: share(g) for n, g in f.frames.items()}) if isinstance(f, Collection) else share(f)

    def filter_entities(self, entity: str, predicate: Column) -> Study:
        """Rows of one entity for which ``predicate`` holds, and what follows.

        Frames from which keys lead to the entity keep the observations that
        lead to a row kept; links keep pairs whose ends survive; an event table
        is filtered if the entity's key is a column of its own; all else stays.
        """
        e = self.entities[entity]
        kept = strict(e.table, predicate)
        keys = kept.select(F.col(e.key).alias("__kept")).distinct()

        def narrowed(f: Frame) -> Frame:
            known = {**self.entities, **f.entities}
            if entity not in {r.target for r in paths(known, f._keys())}:
                return f
            ids = entity_ids(f.observations.table, f.observations.id, known, f._keys(), check=False)
            hit = ids.join(keys, F.col(f"__{entity}") == F.col("__kept"), "left_semi").select(f.observations.id)
            return f._narrowed(hit, None)

        frames = {n: Collection({k: narrowed(g) for k, g in f.frames.items()}) if isinstance(f, Collection) else narrowed(f) for n, f in self.frames.items()}
        links = {}
        for n, link in self.links.items():
            pairs = link.pairs
            for end, name in (("from_id", link.source), ("to_id", link.target)):
                f = frames.get(name)
                if pairs is not None and isinstance(f, Frame):
                    pairs = pairs.join(f.observations.ids().toDF(end), end, "left_semi")
            links[n] = replace(link, pairs=pairs)
        tables = {
            n: replace(t, table=t.table.join(keys, t.table[e.key] == F.col("__kept"), "left_semi")) if isinstance(t, Events) and e.key in t.table.columns else t
            for n, t in self.tables.items()
        }
        return Study(frames, {**self.entities, entity: replace(e, table=kept)}, links, tables)
