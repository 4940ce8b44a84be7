"""Entities (dimension tables), foreign keys among them, and weighted edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .axis import Block, InvalidAxis, key_problems


class BrokenRelation(ValueError):
    """Keys that point nowhere, paths that disagree, edges that repeat."""


@dataclass(frozen=True)
class Entity:
    name: str
    table: DataFrame
    key: str
    blocks: Mapping[str, Block] = field(default_factory=dict)

    def validate(self) -> Entity:
        if any(t.startswith(("array", "map", "struct")) for _, t in self.table.dtypes):
            raise InvalidAxis(f"{self.name} has a column that is no scalar")
        empty, repeated = key_problems(self.table, self.key)
        if empty or repeated:
            raise InvalidAxis(f"{self.name}: {empty} rows without {self.key}, {repeated} repeated")
        return self


@dataclass(frozen=True)
class KeyRelation:
    """``key`` of ``source`` ("observation" or an entity) names rows of ``target``."""

    key: str
    target: str | None = None
    source: str = "observation"
    allow_missing: bool = False

    def resolved(self, entities: Mapping[str, Entity]) -> KeyRelation:
        if self.target is not None:
            return self
        found = [n for n, e in entities.items() if e.key == self.key]
        if len(found) != 1:
            raise BrokenRelation(f"{len(found)} entities have the key {self.key}")
        return KeyRelation(self.key, found[0], self.source, self.allow_missing)


def dealt(df: DataFrame, *keys: str, rows: int = 250_000) -> DataFrame:
    """Rows dealt by ``keys`` to as many tasks as make about ``rows`` rows each, so that what a task groups is the same for more rows. ``df`` is counted first."""
    return df.repartition(max(1, -(-df.count() // rows)), *keys)


@dataclass(frozen=True)
class SparseRelation:
    """Weighted edges (from_id, to_id, weight) between two domains."""

    edges: DataFrame
    source: str
    target: str
    directed: bool = True

    def problems(self) -> int:
        """Pairs that repeat, in either direction if undirected within one domain, and weights that are not finite."""
        a, b = F.col("from_id"), F.col("to_id")
        if not self.directed and self.source == self.target:
            a, b = F.least("from_id", "to_id"), F.greatest("from_id", "to_id")
        w = F.col("weight").cast("double") if "weight" in self.edges.columns else F.lit(1.0)
        odd = F.col("from_id").isNull() | F.col("to_id").isNull() | w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
        pairs = dealt(self.edges.select(a.alias("a"), b.alias("b"), odd.cast("long").alias("odd")), "a", "b").groupBy("a", "b")
        found = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum("odd").alias("odd")).agg(F.sum((F.col("n") > 1).cast("long")).alias("again"), F.sum("odd").alias("odd")).first()
        return (found["again"] or 0) + (found["odd"] or 0)

    def restricted(self, source_ids: DataFrame | None, target_ids: DataFrame | None) -> SparseRelation:
        """Edges whose ends survive."""
        e = self.edges
        for ids, end in ((source_ids, "from_id"), (target_ids, "to_id")):
            if ids is not None:
                e = e.join(ids.select(F.col(ids.columns[0]).alias(end)), end, "left_semi")
        return SparseRelation(e.select(*self.edges.columns), self.source, self.target, self.directed)


def violations(df: DataFrame, relation: KeyRelation, entities: Mapping[str, Entity]) -> DataFrame:
    """One row: keys of ``df`` that are missing and that name no row of the target."""
    r = relation.resolved(entities)
    e = entities[r.target]
    found = e.table.select(F.col(e.key).alias("__key")).distinct().withColumn("__found", F.lit(True))
    joined = df.select(F.col(r.key).alias("__key")).join(found, "__key", "left")
    return joined.agg(
        F.coalesce(F.sum(F.col("__key").isNull().cast("long")), F.lit(0)).alias("missing"),
        F.coalesce(F.sum((F.col("__key").isNotNull() & F.col("__found").isNull()).cast("long")), F.lit(0)).alias("orphans"),
    )


def check_relation(df: DataFrame, relation: KeyRelation, entities: Mapping[str, Entity]) -> None:
    v = violations(df, relation, entities).first()
    if v["orphans"] or v["missing"] and not relation.allow_missing:
        raise BrokenRelation(f"{relation.key}: {v['missing']} missing, {v['orphans']} unknown")


def paths(entities: Mapping[str, Entity], relations: Sequence[KeyRelation]) -> list[KeyRelation]:
    """Relations in the order in which they can be followed from the observations."""
    left, reached, out = [r.resolved(entities) for r in relations], {"observation"}, []
    while step := [r for r in left if r.source in reached]:
        out += step
        left = [r for r in left if r not in step]
        reached |= {r.target for r in step}
    return out


def conflicts(resolved: DataFrame, a: str, b: str) -> DataFrame:
    """Rows whose two paths lead to different rows of one entity."""
    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    return resolved.where(x.isNotNull() & y.isNotNull() & (x != y))


def path_keys(observations: DataFrame, entities: Mapping[str, Entity], relations: Sequence[KeyRelation], target: str) -> DataFrame:
    """Observations with the key of ``target`` by every path of relations that leads to it, as columns named by the path (supplier/nation)."""
    every = [r.resolved(entities) for r in relations]

    def onward(source: str, gone: tuple[str, ...]) -> list[list[KeyRelation]]:
        steps = [r for r in every if r.source == source and r.target not in gone]
        return [[r, *rest] for r in steps for rest in ([[]] if r.target == target else onward(r.target, (*gone, r.target)))]

    out = observations
    for path in onward("observation", ("observation",)):
        name = "/".join(r.target for r in path)
        out = out.withColumn(name, F.col(path[0].key))
        for r in path[1:]:
            e = entities[r.source]
            link = e.table.select(F.col(e.key).alias("__from"), F.col(r.key).alias("__to"))
            out = out.join(link, F.col(f"`{name}`") == F.col("__from"), "left").withColumn(name, F.col("__to")).drop("__from", "__to")
    return out


def entity_ids(observations: DataFrame, id: str, entities: Mapping[str, Entity], relations: Sequence[KeyRelation], check: bool = True) -> DataFrame:
    """Observations with a column for the key of each entity that can be reached.

    Every relation is a left join. Where two paths reach one entity they must
    agree; the first that is not null counts.
    """
    out, known = observations, {}
    for r in paths(entities, relations):
        e = entities[r.target]
        name = f"__{r.target}"
        if r.source == "observation":
            found = F.col(r.key)
        else:
            s = entities[r.source]
            link = s.table.select(F.col(s.key).alias("__from"), F.col(r.key).alias("__to"))
            out = out.join(link, F.col(f"__{r.source}") == F.col("__from"), "left").drop("__from")
            found = F.col("__to")
        if r.target in known:
            out = out.withColumn("__new", found)
            if check and conflicts(out, name, "__new").limit(1).count():
                raise BrokenRelation(f"paths to {r.target} disagree")
            out = out.withColumn(name, F.coalesce(name, "__new")).drop("__new")
        else:
            out = out.withColumn(name, found)
        known[r.target] = e
        out = out.drop("__to")
    return out


def resolve(observations: DataFrame, id: str, entities: Mapping[str, Entity], relations: Sequence[KeyRelation], check: bool = True) -> DataFrame:
    """Observations with ``entity.column`` of every entity that can be reached."""
    out = entity_ids(observations, id, entities, relations, check)
    for c in [c for c in out.columns if c.startswith("__")]:
        e = entities[c[2:]]
        wide = e.table.select(F.col(e.key).alias("__id"), *[F.col(x).alias(f"{e.name}.{x}") for x in e.table.columns if x != e.key])
        if clash := set(wide.columns) & set(out.columns):
            raise BrokenRelation(f"columns clash: {sorted(clash)}")
        out = out.join(wide, F.col(c) == F.col("__id"), "left").drop("__id")
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def lift_block(observation_entity: DataFrame, id: str, entity_id: str, block: Block) -> DataFrame:
    """(id, component_id, value) of an entity's block at the observations; a missing entity gives nulls.

    The block becomes a row an entity first, an array by component, so that
    each observation meets its entity once, and components come out of the row.
    """
    names = [r["component_id"] for r in block.components.select("component_id").collect()]
    held = block.cells.groupBy(F.col("id").alias("__e")).agg(F.map_from_entries(F.collect_list(F.struct("component_id", "value"))).alias("__m"))
    wide = held.select("__e", F.transform(F.array(*map(F.lit, names)), lambda c: F.element_at("__m", c)).alias("__v"))
    met = observation_entity.select(F.col(id).alias("id"), F.col(entity_id).cast("string").alias("__e")).join(wide, "__e", "left")
    each = F.transform(F.array(*map(F.lit, names)), lambda c, i: F.struct(c.alias("component_id"), F.get("__v", i).alias("value")))
    return met.select("id", F.explode(each).alias("x")).select("id", "x.component_id", "x.value")


def hierarchy(observations: DataFrame, id: str, levels: Sequence[str], entities: Mapping[str, Entity], relations: Sequence[KeyRelation], orders: Mapping[str, DataFrame]) -> DataFrame:
    """For each level, from the root on: the entity's id and its code, the position in the whole entity table.

    ``orders``: for each level a table (key, ord). The chain leaf to root must be linked by relations.
    """
    chain = [r.resolved(entities) for r in relations]
    for lower, upper in zip(list(levels)[::-1], list(levels)[::-1][1:], strict=False):
        if sum(r.source == lower and r.target == upper for r in chain) != 1:
            raise BrokenRelation(f"no single relation from {lower} to {upper}")
    out = entity_ids(observations, id, entities, relations, check=False)
    for level in levels:
        ords = orders[level].select(F.col(entities[level].key).alias("__id"), F.col("ord").alias(f"{level}_code"))
        out = out.join(ords, F.col(f"__{level}") == F.col("__id"), "left").drop("__id").withColumn(f"{level}_id", F.col(f"__{level}"))
    complete = F.lit(True)
    for level in levels:
        complete = complete & F.col(f"{level}_id").isNotNull()
    return out.select(id, *[c for level in levels for c in (f"{level}_id", f"{level}_code")], complete.alias("complete"))
