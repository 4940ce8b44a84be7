"""Frames and studies as folders of Parquet tables and a manifest of what they are."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import canonical_digest, canonical_json
from ..operators.axis import Axis, Block
from ..operators.entities import Entity, KeyRelation, SparseRelation
from ..operators.source import ArraySource
from ..operators.spaces import Space, from_plain, to_plain
from ..plans.frame import Assay, Frame
from ..plans.study import Collection, Events, Link, Study

VERSION = "1.1"


def _blocks(blocks: Mapping[str, Block]) -> dict[str, list]:
    return {n: [b.role, b.units] for n, b in blocks.items()}


def manifest(frame: Frame) -> dict[str, object]:
    """Content, never places or chunks: equal frames have equal manifests wherever they are kept."""
    known = {
        "version": VERSION,
        "shape": list(next(iter(frame.assays.values())).source.shape),
        "axes": {"observation": frame.observations.id, "feature": frame.features.id},
        "blocks": {"observation": _blocks(frame.observations.blocks), "feature": _blocks(frame.features.blocks)},
        "assays": {n: {"dtype": a.source.dtype, "role": a.role, "units": a.units, "fingerprint": a.source.fingerprint} for n, a in frame.assays.items()},
        "entities": {n: e.key for n, e in frame.entities.items()},
        "entity_blocks": {n: _blocks(e.blocks) for n, e in frame.entities.items()},
        "relations": {n: [r.key, r.target, r.source, r.allow_missing] for n, r in frame.relations.items() if isinstance(r, KeyRelation)},
        "edges": {n: [r.source, r.target, r.directed] for n, r in frame.relations.items() if isinstance(r, SparseRelation)},
        "tables": sorted(frame.tables),
        "space": frame.space.digest,
        "active": frame.active_assay,
        "provenance": list(frame.provenance),
    }
    return {**known, "digest": canonical_digest(known)}


def study_manifest(study: Study) -> dict[str, object]:
    """Frames' manifests, shared entities, links and tables of a study."""
    one = lambda f: {"collection": {n: manifest(g) for n, g in f.frames.items()}} if isinstance(f, Collection) else {"frame": manifest(f)}
    known = {
        "version": VERSION,
        "frames": {n: one(f) for n, f in study.frames.items()},
        "entities": {n: e.key for n, e in study.entities.items()},
        "entity_blocks": {n: _blocks(e.blocks) for n, e in study.entities.items()},
        "links": {n: [x.source, x.target, x.type, x.pairs is not None] for n, x in study.links.items()},
        "tables": {n: t.key if isinstance(t, Events) else None for n, t in study.tables.items()},
    }
    return {**known, "digest": canonical_digest(known)}


def check_manifest(m: dict[str, object]) -> dict[str, object]:
    known = {k: v for k, v in m.items() if k != "digest"}
    if m.get("version") != VERSION or m.get("digest") != canonical_digest(known):
        raise ValueError("the manifest is of another version or was changed")
    return m


def _write_blocks(blocks: Mapping[str, Block], path: str) -> None:
    for n, b in blocks.items():
        b.cells.write.parquet(f"{path}/{n}/cells")
        b.components.write.parquet(f"{path}/{n}/components")


def _read_blocks(spark: SparkSession, known: Mapping[str, list], path: str) -> dict[str, Block]:
    read = lambda p: spark.read.parquet(f"{path}/{p}")
    return {n: Block(read(f"{n}/cells"), read(f"{n}/components"), role, units) for n, (role, units) in known.items()}


def write_frame(frame: Frame, path: str) -> dict[str, object]:
    """One folder a table, and the manifest, which is returned; pieces of an array are laid out by chunk, so that a read of few features skips the others.

    Of a view, what it selects is written. Blocks of axes and entities, edges
    and tables are written too. The manifest comes last, so that a folder with
    one is whole.
    """
    frame = frame._renumbered()
    spark = frame.observations.table.sparkSession
    for n, a in frame.assays.items():
        a.source.pieces.write.partitionBy("chunk").parquet(f"{path}/assays/{n}")
    for name, axis in (("observations", frame.observations), ("features", frame.features)):
        axis.table.write.parquet(f"{path}/{name}")
        _write_blocks(axis.blocks, f"{path}/{name}-blocks")
    for n, e in frame.entities.items():
        e.table.write.parquet(f"{path}/entities/{n}")
        _write_blocks(e.blocks, f"{path}/entity-blocks/{n}")
    for n, r in frame.relations.items():
        if isinstance(r, SparseRelation):
            r.edges.write.parquet(f"{path}/edges/{n}")
    for n, t in frame.tables.items():
        t.write.parquet(f"{path}/tables/{n}")
    m = manifest(frame)
    widths = {n: a.source.width for n, a in frame.assays.items()}
    space = json.dumps(to_plain(frame.space))
    spark.createDataFrame([(canonical_json(m), json.dumps(widths), space)], "manifest string, widths string, space string").coalesce(1).write.parquet(f"{path}/manifest")
    return m


def open_frame(spark: SparkSession, path: str, space: Space | None = None) -> Frame:
    """The frame of a folder, and the space that is stored with it, unless one is given, which must be the same; no cell is read."""
    row = spark.read.parquet(f"{path}/manifest").first()
    m, widths = check_manifest(json.loads(row["manifest"])), json.loads(row["widths"])
    if space is None:
        if "space" not in row:
            raise ValueError("no space is stored with this frame: give it")
        space = from_plain(json.loads(row["space"]))
    if space.digest != m["space"]:
        raise ValueError("the space is another")
    read = lambda p: spark.read.parquet(f"{path}/{p}")
    assays = {
        n: Assay(ArraySource(read(f"assays/{n}").select("obs_idx", "chunk", "values"), tuple(m["shape"]), a["dtype"], widths[n], fingerprint=a["fingerprint"]), a["role"], a["units"])
        for n, a in m["assays"].items()
    }
    axes = {name: Axis(read(f"{name}s"), m["axes"][name], _read_blocks(spark, m["blocks"][name], f"{path}/{name}s-blocks")) for name in ("observation", "feature")}
    return Frame(
        assays,
        axes["observation"],
        axes["feature"],
        space,
        {n: Entity(n, read(f"entities/{n}"), k, _read_blocks(spark, m["entity_blocks"][n], f"{path}/entity-blocks/{n}")) for n, k in m["entities"].items()},
        {n: KeyRelation(*r) for n, r in m["relations"].items()} | {n: SparseRelation(read(f"edges/{n}"), *r) for n, r in m["edges"].items()},
        {n: read(f"tables/{n}") for n in m["tables"]},
        m["active"],
        tuple(m["provenance"]),
    )


def write_study(study: Study, path: str) -> dict[str, object]:
    """Frames in folders of their own beside the shared tables, links and the study's manifest."""
    spark = None
    frames = {}
    for n, f in study.frames.items():
        if isinstance(f, Collection):
            frames[n] = {"collection": {k: write_frame(g, f"{path}/frames/{n}/{k}") for k, g in f.frames.items()}}
            spark = spark or next(iter(f.frames.values())).observations.table.sparkSession
        else:
            frames[n] = {"frame": write_frame(f, f"{path}/frames/{n}")}
            spark = spark or f.observations.table.sparkSession
    for n, e in study.entities.items():
        e.table.write.parquet(f"{path}/entities/{n}")
        _write_blocks(e.blocks, f"{path}/entity-blocks/{n}")
    for n, x in study.links.items():
        if x.pairs is not None:
            x.pairs.write.parquet(f"{path}/links/{n}")
    for n, t in study.tables.items():
        (t.table if isinstance(t, Events) else t).write.parquet(f"{path}/tables/{n}")
    known = {**{k: v for k, v in study_manifest(study).items() if k != "digest"}, "frames": frames}
    m = {**known, "digest": canonical_digest(known)}
    spark.createDataFrame([(canonical_json(m),)], "manifest string").coalesce(1).write.parquet(f"{path}/manifest")
    return m


def open_study(spark: SparkSession, path: str, spaces: Mapping[str, Space] | None = None) -> Study:
    """The study of a folder; ``spaces`` may tell the space of each frame or collection, which is stored with it."""
    spaces = spaces or {}
    m = check_manifest(json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"]))
    read = lambda p: spark.read.parquet(f"{path}/{p}")
    frames: dict[str, Frame | Collection] = {}
    for n, f in m["frames"].items():
        at = f"{path}/frames/{n}"
        frames[n] = Collection({k: open_frame(spark, f"{at}/{k}", spaces.get(n)) for k in f["collection"]}) if "collection" in f else open_frame(spark, at, spaces.get(n))
    return Study(
        frames,
        {n: Entity(n, read(f"entities/{n}"), k, _read_blocks(spark, m["entity_blocks"][n], f"{path}/entity-blocks/{n}")) for n, k in m["entities"].items()},
        {n: Link(a, b, t, read(f"links/{n}") if pairs else None) for n, (a, b, t, pairs) in m["links"].items()},
        {n: read(f"tables/{n}") if key is None else Events(read(f"tables/{n}"), key) for n, key in m["tables"].items()},
    )


def append_shard(df: DataFrame, path: str, shard_id: str) -> None:
    """Add a shard to a partitioned table; readers prune by shard_id."""
    from pyspark.sql import functions as F

    df.withColumn("shard_id", F.lit(shard_id)).write.mode("append").partitionBy("shard_id").parquet(path)
