"""A frame: named arrays aligned with one observation axis and one feature axis.

Frames are immutable. A view holds its selected observations as a lazy table;
features are metadata of bounded size, so that a selection of them restricts
the space at once. Nothing of an array is read until its cells are asked for,
and then only the features and observations selected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordinal import ordinals
from ..functions.scalar import canonical_digest
from ..operators.axis import Axis, Block, InvalidAxis
from ..operators.entities import Entity, KeyRelation, SparseRelation, check_relation, resolve
from ..operators.feature_map import FeatureMap, map_rows
from ..operators.groups import strict
from ..operators.source import BROADCAST_POSITIONS, ArraySource, row_sharded
from ..operators.spaces import Space, assert_compatible
from .blocks import within_budget


@dataclass(frozen=True)
class Assay:
    source: ArraySource
    role: str = "estimate"
    units: str | None = None


@dataclass(frozen=True)
class Frame:
    assays: Mapping[str, Assay]
    observations: Axis
    features: Axis
    space: Space
    entities: Mapping[str, Entity] = field(default_factory=dict)
    relations: Mapping[str, KeyRelation | SparseRelation] = field(default_factory=dict)
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    active: str | None = None
    provenance: tuple[str, ...] = ()

    @property
    def active_assay(self) -> str:
        return self.active or next(iter(self.assays))

    def validate(self) -> Frame:
        """Counts of the axes against the arrays' shapes, and keys against entities."""
        shape = (self.observations.count(), self.features.count())
        if not self.assays or any(a.source.shape != shape for a in self.assays.values()) or shape[1] != self.space.n_features:
            raise InvalidAxis(f"arrays and axes differ: {shape}")
        for e in self.entities.values():
            e.validate()
        for r in self.relations.values():
            if isinstance(r, KeyRelation):
                own = self.observations.table if r.source == "observation" else self.entities[r.source].table
                check_relation(own, r, self.entities)
            elif r.problems():
                raise InvalidAxis("edges repeat or have odd weights")
        return self

    def _keys(self) -> list[KeyRelation]:
        return [r for r in self.relations.values() if isinstance(r, KeyRelation)]

    def observation_data(self, resolved: bool = False) -> DataFrame:
        o = self.observations
        return resolve(o.table, o.id, self.entities, self._keys()) if resolved else o.table

    def _edges(self, o: Axis, f: Axis) -> dict[str, KeyRelation | SparseRelation]:
        ends = {"observation": o, "feature": f}
        ids = lambda name: ends[name].ids() if name in ends else None
        return {n: r.restricted(ids(r.source), ids(r.target)) if isinstance(r, SparseRelation) else r for n, r in self.relations.items()}

    def _narrowed(self, obs: DataFrame | None, feat: DataFrame | None) -> Frame:
        o = self.observations if obs is None else self.observations.where(obs)
        if feat is None:
            return replace(self, observations=o, relations=self._edges(o, self.features))
        kept = {r[0] for r in feat.collect()}
        return replace(self, observations=o)._with_features([i for i in self.feature_ids() if i in kept])

    def _with_features(self, ids: Sequence[str]) -> Frame:
        """Features named, in that order; the space is restricted to them."""
        at = {x: i for i, x in enumerate(self.feature_ids(), 1)}
        a = self.features
        f = replace(a.where(_asked(a, ids)), table=_placed(a, ids))
        return replace(self, features=f, space=self.space.restrict([at[i] for i in ids]), relations=self._edges(self.observations, f))

    def feature_ids(self) -> list[str]:
        """In the view's order; as many as the space has, which the driver holds anyway."""
        return [r[0] for r in self.features.table.orderBy(_order(self.features)).select(self.features.id).collect()]

    def filter_obs(self, predicate: Column, resolved: bool = True) -> Frame:
        """Observations for which ``predicate`` holds, on their own columns or `entity.column`; a null is an error."""
        return self._narrowed(strict(self.observation_data(resolved), predicate).select(self.observations.id), None)

    def select_features(self, predicate: Column) -> Frame:
        return self._narrowed(None, strict(self.features.table, predicate).select(self.features.id))

    def take(self, observations: Selector | None = None, features: Selector | None = None) -> Frame:
        """By identifiers or positions, in the order given, without repeats; or all but the positions given as negative; or by one flag for each.

        Positions count from 1 in the view's order; zeros select nothing.
        """
        out = self
        if observations is not None:
            out = replace(out, observations=_taken(out.observations, observations))
            out = replace(out, relations=out._edges(out.observations, out.features))
        if features is not None:
            ids = out.feature_ids()
            out = out._with_features([ids[i - 1] for i in positions(features, ids)])
        return out

    def drop_features(self, ids: Sequence[str]) -> Frame:
        gone = set(ids)
        return self._with_features([i for i in self.feature_ids() if i not in gone])

    def columns(self) -> list[int]:
        """Positions in the arrays of the view's features, in its order."""
        return [r["idx"] for r in self.features.table.orderBy(_order(self.features)).select("idx").collect()]

    def _source(self, name: str) -> ArraySource:
        """An assay's array, the observations of the view alone, numbered as in the array."""
        a = self.assays[name].source
        return a.meeting(self.observations.table.select(F.col("idx").alias("obs_idx")))

    def cells(self, assay: str | None = None) -> DataFrame:
        """(obs_id, feature_id, obs_idx, feat_idx, value) of the selection.

        Pieces meet the observations once, before they are exploded. Few
        features are cut out of the arrays first.
        """
        a = self.assays[assay or self.active_assay].source
        f = self.features.table.select(F.col(self.features.id).alias("feature_id"), F.col("idx").cast("int").alias("feat_idx"))
        o = self.observations.table.select(F.col(self.observations.id).alias("obs_id"), F.col("idx").alias("obs_idx"))
        few = [r["feat_idx"] for r in f.select("feat_idx").limit(a.width + 1).collect()] if a.shape[1] <= a.width else None
        long = a.meeting(o).long(few if few is not None and len(few) < a.shape[1] else None, ["obs_id"])
        return long.join(F.broadcast(f) if few is not None else f, "feat_idx").select("obs_id", "feature_id", "obs_idx", "feat_idx", "value")

    def collect(self, assay: str | None = None, budget: int = 2 << 30, force: bool = False) -> pd.DataFrame:
        """Dense, rows and columns in the view's order; over the budget it fails before any read."""
        o, f = self.observations, self.features
        within_budget(o.count() * f.count(), self.assays[assay or self.active_assay].source.dtype, budget, force)
        order = lambda a: [r[0] for r in a.table.orderBy(_order(a)).select(a.id).collect()]
        cells = self.cells(assay).toPandas()
        return cells.pivot(index="obs_id", columns="feature_id", values="value").reindex(index=order(o), columns=order(f))

    def map_features(self, m: FeatureMap, rules: Mapping[str, str] | str = "linear") -> Frame:
        """All assays of the view mapped; relations of features go, provenance grows. The map begins at the view's space."""
        assert_compatible(self.space, m.source)
        spark = self.features.table.sparkSession
        width, columns = max(1, m.target.n_features), self.columns()
        if not isinstance(rules, str) and set(rules) - set(self.assays):
            raise InvalidAxis("rules name unknown assays")
        out = {}
        for name, a in self.assays.items():
            rule = rules if isinstance(rules, str) else rules.get(name, "linear")
            rows = map_rows(self._source(name), m, rule, columns)
            print_of = canonical_digest([a.source.fingerprint, m.digest(), rule])
            out[name] = replace(a, source=ArraySource(rows.select("obs_idx", F.lit(0).alias("chunk"), "values"), (a.source.shape[0], m.target.n_features), "float64", width, fingerprint=print_of))
        f = m.target.features(spark).withColumn("idx", F.col("feat_idx").cast("long"))
        kept = {n: r for n, r in self.relations.items() if not (isinstance(r, SparseRelation) and "feature" in (r.source, r.target) or isinstance(r, KeyRelation) and r.source == "feature")}
        return replace(self, assays=out, features=Axis(f, "feature_id"), space=m.target, relations=kept, provenance=(*self.provenance, m.digest()))

    def _renumbered(self) -> Frame:
        """A frame whose arrays hold what the view selects alone, in its order; a whole frame is itself."""
        columns, n = self.columns(), self.observations.count()
        if all(a.source.shape == (n, len(columns)) for a in self.assays.values()) and "pos" not in self.observations.table.columns and columns == list(range(1, len(columns) + 1)):
            return self
        order = _order(self.observations)
        table = self.observations.table.join(ordinals(self.observations.table, [order, self.observations.id], "__n").select(self.observations.id, "__n"), self.observations.id)
        at = table.select(F.col("idx").alias("obs_idx"), F.col("__n").alias("__to"))
        assays = {}
        for name, a in self.assays.items():
            held = a.source if len(columns) == a.source.shape[1] and columns == sorted(columns) else a.source.view(None, columns)
            pieces = held.pieces.join(at, "obs_idx").select(F.col("__to").alias("obs_idx"), "chunk", "values")
            assays[name] = replace(a, source=replace(held, pieces=pieces, shape=(n, len(columns)), shards=None, parts=(), fingerprint=canonical_digest([held.fingerprint, n, columns])))
        f = self.features.table.withColumn("idx", F.col("pos").cast("long")).drop("pos") if "pos" in self.features.table.columns else self.features.table
        return replace(self, assays=assays, observations=replace(self.observations, table=table.withColumn("idx", F.col("__n")).drop("__n", "pos")), features=replace(self.features, table=f))

    def explain(self) -> dict[str, object]:
        """What is known without reading any cell."""
        return {"assays": {n: a.source.descriptor() for n, a in self.assays.items()}, "active": self.active_assay, "space": self.space.digest, "entities": sorted(self.entities), "relations": sorted(self.relations), "provenance": list(self.provenance)}


Selector = Sequence[str] | Sequence[int] | Sequence[bool]


def _order(a: Axis) -> str:
    return "pos" if "pos" in a.table.columns else "idx"


def _asked(a: Axis, ids: Sequence[str]) -> DataFrame:
    df = a.table.sparkSession.createDataFrame([(x, i) for i, x in enumerate(ids, 1)], f"{a.id} string, pos long")
    return F.broadcast(df) if len(ids) <= BROADCAST_POSITIONS else df


def _placed(a: Axis, ids: Sequence[str]) -> DataFrame:
    """Rows with these ids, placed in their order."""
    return a.table.drop("pos").join(_asked(a, ids), a.id)


def positions(index: Selector, ids: Sequence[str] | int) -> list[int]:
    """1-based positions that a selector stands for; ``ids`` are the axis' identifiers, or their number where the selector names none."""
    index, n = list(index), ids if isinstance(ids, int) else len(ids)
    if index and all(isinstance(i, bool) for i in index):
        if len(index) != n:
            raise InvalidAxis(f"{len(index)} flags for {n} positions")
        return [i for i, keep in enumerate(index, 1) if keep]
    if index and all(isinstance(i, str) for i in index) and not isinstance(ids, int):
        at = {x: i for i, x in enumerate(ids, 1)}
        if len(set(index)) != len(index) or not set(index) <= set(at):
            raise InvalidAxis("a selection repeats identifiers or names unknown ones")
        return [at[i] for i in index]
    if any(isinstance(i, (bool, str)) or i is None or int(i) != i for i in index):
        raise InvalidAxis("a selection is of identifiers, whole positions or flags")
    numbers = [int(i) for i in index if i]
    if any(i < 0 for i in numbers):
        if any(i > 0 for i in numbers):
            raise InvalidAxis("positions are all to take or all to leave out")
        gone = {-i for i in numbers}
        return [i for i in range(1, n + 1) if i not in gone]
    if any(i > n for i in numbers) or len(set(numbers)) != len(numbers):
        raise InvalidAxis("positions are repeated or out of bounds")
    return numbers


def _taken(a: Axis, index: Selector) -> Axis:
    """Rows of an axis that a selector stands for. Identifiers join; positions are numbered by ranges, and what is left out is an anti-join."""
    index = list(index)
    if index and all(isinstance(i, str) for i in index):
        if len(set(index)) != len(index):
            raise InvalidAxis("a selection repeats identifiers")
        table = _placed(a, index)
        if table.count() != len(index):
            raise InvalidAxis("a selection names unknown identifiers")
        return replace(a.where(_asked(a, index)), table=table)
    spark, order, n = a.table.sparkSession, _order(a), a.count()
    number = ordinals(a.table, [order, a.id], "__n").select(a.id, "__n")
    out = any(not isinstance(i, (bool, str)) and i is not None and i < 0 for i in index)
    wanted = [-int(i) for i in index if i] if out else positions(index, n)
    if out:
        positions(index, n)  # what is not allowed is an error here too
    asked = spark.createDataFrame([(x, i) for i, x in enumerate(wanted, 1)], "__n long, __pos long")
    asked = F.broadcast(asked) if len(wanted) <= BROADCAST_POSITIONS else asked
    if out:
        table = a.table.join(number.join(asked, "__n", "left_anti").select(a.id), a.id, "left_semi")
    else:
        table = a.table.drop("pos").join(number.join(asked, "__n").select(a.id, F.col("__pos").alias("pos")), a.id)
    return replace(a.where(table), table=table)


def _table_digest(df: DataFrame) -> tuple:
    """Columns, rows and a sum over hashed rows: equal tables, in whatever order, have equal ones."""
    columns = sorted(df.columns)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)")).alias("g")).first()
    return (tuple(columns), r["n"], r["h"], r["g"])


def _same_tables(tables: Sequence[DataFrame]) -> bool:
    return all(t is tables[0] for t in tables) or len({_table_digest(t) for t in tables}) == 1


def _bound_blocks(axes: Sequence[Axis]) -> dict[str, Block]:
    first = axes[0].blocks
    if any(set(a.blocks) != set(first) for a in axes):
        raise InvalidAxis("axes differ in their blocks")
    out = {}
    for n, b in first.items():
        every = [a.blocks[n] for a in axes]
        if any((x.role, x.units) != (b.role, b.units) for x in every) or not _same_tables([x.components for x in every]):
            raise InvalidAxis(f"block {n} differs between frames")
        cells = every[0].cells
        for x in every[1:]:
            cells = cells.unionByName(x.cells)
        out[n] = replace(b, cells=cells)
    return out


def _bound_relations(frames: Sequence[Frame]) -> dict[str, KeyRelation | SparseRelation]:
    """Key relations must agree; edges with an end among observations are put together, others must be equal."""
    first = frames[0].relations
    if any(set(f.relations) != set(first) for f in frames):
        raise InvalidAxis("frames differ in relations")
    out: dict[str, KeyRelation | SparseRelation] = {}
    for n, r in first.items():
        every = [f.relations[n] for f in frames]
        kind = lambda x: (type(x), x.source, x.target, getattr(x, "directed", None), getattr(x, "key", None), getattr(x, "allow_missing", None))
        if len({kind(x) for x in every}) > 1:
            raise InvalidAxis(f"relation {n} differs between frames")
        out[n] = r
        if not isinstance(r, SparseRelation):
            continue
        if "observation" in (r.source, r.target):
            edges = r.edges
            for x in every[1:]:
                edges = edges.unionByName(x.edges)
            out[n] = replace(r, edges=edges)
        elif not _same_tables([x.edges for x in every]):
            raise InvalidAxis(f"relation {n} differs between frames")
    return out


def bind_frames(tables: Sequence[DataFrame]) -> DataFrame:
    """Tables one below the other, by name; a column that one lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def bind_observations(frames: Sequence[Frame]) -> Frame:
    """Frames one below the other, with their blocks and edges.

    Space, feature identifiers, assays, entities and relations must agree, and
    identifiers of observations must not meet. Arrays of views are bound as
    what the views select; their rows are numbered anew.
    """
    first = frames[0]
    ids = first.feature_ids()
    for f in frames[1:]:
        assert_compatible(first.space, f.space)
        if set(f.assays) != set(first.assays) or set(f.entities) != set(first.entities) or f.feature_ids() != ids:
            raise InvalidAxis("frames differ in features, assays or entities")
    for n, e in first.entities.items():
        if len({f.entities[n].key for f in frames}) > 1 or not _same_tables([f.entities[n].table for f in frames]):
            raise InvalidAxis(f"entity {n} differs between frames")
    whole = [f._renumbered() for f in frames]
    table, n = [], 0
    for f in whole:
        table.append(f.observations.table.withColumn("idx", F.col("idx") + n))
        n += next(iter(f.assays.values())).source.shape[0] if f.assays else f.observations.count()
    every = bind_frames(table)
    if every.groupBy(first.observations.id).count().where("count > 1").limit(1).count():
        raise InvalidAxis("observation identifiers meet")
    assays = {k: replace(a, source=row_sharded([f.assays[k].source for f in whole])) for k, a in whole[0].assays.items()}
    axis = Axis(every, first.observations.id, _bound_blocks([f.observations for f in frames]))
    return replace(whole[0], assays=assays, observations=axis, relations=_bound_relations(frames))
