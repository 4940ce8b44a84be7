"""Sources, axes, views and frames on small matrices."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import axis as axes
from gridloom.operators import feature_map as fm
from gridloom.operators import source, spaces
from gridloom.operators.entities import BrokenRelation, Entity, KeyRelation, SparseRelation
from gridloom.plans import blocks, spatial, study
from gridloom.plans.frame import Assay, Frame, bind_observations
from gridloom.sources import store
from gridloom.streaming import chunks


def by_columns(n, m, start=1):
    return np.arange(start, start + n * m, dtype=float).reshape(m, n).T


def matrix(df, n, m):
    out = np.full((n, m), np.nan)
    for r in df.collect():
        out[r["obs_pos"] - 1, r["feat_pos"] - 1] = np.nan if r["value"] is None else r["value"]
    return out


def small_frame(spark, n=7, m=6, **options):
    obs = spark.createDataFrame([(f"obs-{i}", i, "AB"[i % 2], f"s{i % 3}") for i in range(1, n + 1)], "obs_id string, idx long, fac string, stimulus_id string")
    space = spaces.VolumeSpace((2, 2, 2), support=tuple(range(1, m + 1)), template="fixture")
    feat = space.features(spark).withColumn("idx", F.col("feat_idx").cast("long")).withColumn("parcel", F.when(F.col("feat_idx") <= 2, "hippocampus").otherwise("rest"))
    stim = spark.createDataFrame([(f"s{i}", "face" if i else "scene") for i in range(3)], "stimulus_id string, category string")
    assays = {"beta": Assay(source.memory_source(spark, by_columns(n, m) / 10)), "variance": Assay(source.memory_source(spark, by_columns(n, m) / 100 + 0.1))}
    return Frame(assays, axes.Axis(obs, "obs_id"), axes.Axis(feat, "feature_id"), space, {"stimulus": Entity("stimulus", stim, "stimulus_id")}, {"stimulus": KeyRelation("stimulus_id")}, **options)


def test_quick_start_view_keeps_the_order_asked_for(spark):
    src = source.memory_source(spark, by_columns(6, 4))
    assert matrix(src.read([6, 1], [4, 2]), 2, 2).tolist() == [[24, 12], [19, 7]]
    view = src.view([6, 1], [4, 2])
    assert view.shape == (2, 2) and matrix(view.read(), 2, 2).tolist() == [[24, 12], [19, 7]]
    assert matrix(view.view([2], None).read(), 1, 2).tolist() == [[19, 7]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 5), max_size=6), st.lists(st.integers(1, 4), max_size=5), st.sampled_from([2, 3, 4096]))
def test_reads_match_numpy(spark, rows, cols, width):
    x = by_columns(5, 4)
    src = source.memory_source(spark, x, width=width)
    want = x[np.ix_([i - 1 for i in rows], [j - 1 for j in cols])]
    assert np.array_equal(matrix(src.read(rows, cols), len(rows), len(cols)), want)


@pytest.mark.parametrize("bad", [[0], [6], [1.5], [None], [True, False]])
def test_positions_are_checked(bad):
    with pytest.raises(IndexError):
        source.checked(bad, 5)


def test_shards_route_rows(spark):
    parts = [source.memory_source(spark, by_columns(n, 4, s)) for n, s in ((3, 1), (2, 21), (3, 41))]
    src = source.row_sharded(parts, ["a", "b", "c"], {"subject": ["s1", "s1", "s2"]})
    assert [(r["start"], r["end"], r["n_observation"]) for r in src.shards.orderBy("start").collect()] == [(1, 3, 3), (4, 5, 2), (6, 8, 3)]
    asked = spark.createDataFrame([(1, 8), (2, 1), (3, 6), (4, 1)], "pos long, obs_idx long")
    got = source.locate_rows(src.shards, asked).orderBy("pos").collect()
    assert [(r["shard_id"], r["local"]) for r in got] == [("c", 3), ("a", 1), ("c", 1), ("a", 1)]
    assert matrix(src.read([8, 1], [1]), 2, 1).tolist() == [[43], [1]]
    more = source.append_shards(src.__class__(**{**src.__dict__, "shards": src.shards.drop("subject")}), [parts[1]], ["d"])
    assert more.shape == (10, 4) and src.shape == (8, 4) and matrix(more.read([9], [1]), 1, 1).tolist() == [[21]]
    with pytest.raises(ValueError):
        source.row_sharded([parts[0], source.memory_source(spark, by_columns(2, 3))])


def test_axes_reject_bad_identifiers(spark):
    for rows in ([("a",), ("a",)], [(None,)], [("",)]):
        with pytest.raises(axes.InvalidAxis):
            axes.axis(spark.createDataFrame(rows, "k string"), "k")
    made = axes.axis(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), "k").table.collect()
    assert {r["k"]: r["idx"] for r in made} == {"a": 1, "b": 2, "c": 3}
    assert axes.axis(spark.range(3), prefix="obs").table.select("obs_id").distinct().count() == 3


def test_frame_dimensions_filters_and_budget(spark):
    f = small_frame(spark).validate()
    assert f.active_assay == "beta" and f.explain()["assays"]["beta"]["shape"] == [7, 6]
    got = f.filter_obs(F.col("`stimulus.category`") == "face").select_features(F.col("parcel") == "hippocampus").collect()
    assert got.index.tolist() == ["obs-1", "obs-2", "obs-4", "obs-5", "obs-7"] and got.columns.tolist() == ["voxel-1", "voxel-2"]
    assert np.allclose(got.to_numpy(), (by_columns(7, 6) / 10)[[0, 1, 3, 4, 6]][:, :2])
    assert f.take(["obs-6", "obs-1"], ["voxel-4", "voxel-2"]).collect().round(9).to_numpy().tolist() == [[2.7, 1.3], [2.2, 0.8]]
    with pytest.raises(blocks.OverBudget):
        f.collect(budget=8)
    for bad in (["obs-1", "obs-1"], ["nobody"]):
        with pytest.raises(axes.InvalidAxis):
            f.take(bad)
    with pytest.raises(PySparkException):
        f.filter_obs(F.when(F.col("fac") == "A", True)).cells().count()


def test_frames_are_checked_against_their_parts(spark):
    f = small_frame(spark)
    with pytest.raises(axes.InvalidAxis):
        Frame({"x": Assay(source.memory_source(spark, by_columns(3, 6)))}, f.observations, f.features, f.space).validate()
    lost = f.observations.table.withColumn("stimulus_id", F.lit("nowhere"))
    with pytest.raises(BrokenRelation):
        Frame(f.assays, axes.Axis(lost, "obs_id"), f.features, f.space, f.entities, f.relations).validate()


def test_edges_follow_views_and_binding_checks_identifiers(spark):
    f = small_frame(spark)
    edges = spark.createDataFrame([("obs-1", "obs-2", 1.0), ("obs-3", "obs-4", 2.0)], "from_id string, to_id string, weight double")
    f = Frame(f.assays, f.observations, f.features, f.space, f.entities, {"near": SparseRelation(edges, "observation", "observation", False)}).validate()
    assert f.filter_obs(F.col("idx") <= 2).relations["near"].edges.count() == 1
    twice = SparseRelation(edges.union(edges.select("to_id", "from_id", "weight")), "observation", "observation", False)
    assert twice.problems() == 2
    with pytest.raises(axes.InvalidAxis):
        bind_observations([f, f])
    renamed = axes.Axis(f.observations.table.withColumn("obs_id", F.concat(F.lit("b-"), "obs_id")), "obs_id")
    theirs = edges.select(F.concat(F.lit("b-"), "from_id").alias("from_id"), F.concat(F.lit("b-"), "to_id").alias("to_id"), "weight")
    other = Frame(f.assays, renamed, f.features, f.space, f.entities, {"near": SparseRelation(theirs, "observation", "observation", False)})
    both = bind_observations([f, other])
    assert both.collect().shape == (14, 6) and both.relations["near"].edges.count() == 4
    for bad in ({}, {"near": SparseRelation(theirs, "observation", "observation", True)}):
        with pytest.raises(axes.InvalidAxis):
            bind_observations([f, Frame(f.assays, renamed, f.features, f.space, f.entities, bad)])


def test_binding_keeps_blocks_and_what_views_select(spark):
    def frame(prefix, shift):
        f = small_frame(spark)
        table = f.observations.table.withColumn("obs_id", F.concat(F.lit(prefix), "obs_id"))
        wide = table.select("obs_id", (F.col("idx") + shift).alias("x"), (F.col("idx") * 2).alias("y"))
        return Frame(f.assays, axes.Axis(table, "obs_id", {"motion": axes.block(wide, "obs_id", ["x", "y"])}), f.features, f.space, f.entities, f.relations)

    a, b = frame("a-", 0), frame("b-", 100)
    both = bind_observations([a, b])
    assert both.observations.blocks["motion"].cells.count() == 28
    x = by_columns(7, 6) / 10
    view = bind_observations([a.take([5, 2], [4, 1]), b.filter_obs(F.col("idx") > 5).take(None, [4, 1])])
    got = view.collect()
    assert got.index.tolist() == ["a-obs-5", "a-obs-2", "b-obs-6", "b-obs-7"] and got.columns.tolist() == ["voxel-4", "voxel-1"]
    assert np.allclose(got.to_numpy(), x[[4, 1, 5, 6]][:, [3, 0]])
    assert view.observations.blocks["motion"].cells.count() == 8
    other = Frame(b.assays, b.observations, b.features, b.space, {"stimulus": Entity("stimulus", b.entities["stimulus"].table.withColumn("category", F.lit("z")), "stimulus_id")}, b.relations)
    with pytest.raises(axes.InvalidAxis):
        bind_observations([a, other])


def test_selectors_by_position_sign_and_flag(spark):
    f = small_frame(spark)
    ids = lambda v: [r["obs_id"] for r in v.observations.table.orderBy("pos" if "pos" in v.observations.table.columns else "idx").collect()]
    assert ids(f.take([6, 1])) == ["obs-6", "obs-1"] and ids(f.take([6, 1, 3]).take([3, 1])) == ["obs-3", "obs-6"]
    assert ids(f.take([-1, -2, -7])) == ["obs-3", "obs-4", "obs-5", "obs-6"]
    assert ids(f.take([True, False] * 3 + [True])) == ["obs-1", "obs-3", "obs-5", "obs-7"]
    assert ids(f.filter_obs(F.col("idx") > 2).take([0, 1, 2])) == ["obs-3", "obs-4"]
    v = f.take(None, [-1, -3])
    assert v.feature_ids() == ["voxel-2", "voxel-4", "voxel-5", "voxel-6"] and v.space.support == (2, 4, 5, 6)
    for bad in ([1, -1], [8], [1, 1], [1.5], [True], [None]):
        with pytest.raises(axes.InvalidAxis):
            f.take(bad)
        with pytest.raises(axes.InvalidAxis):
            f.take(None, bad)


def test_maps_see_the_view_alone(spark):
    f = small_frame(spark)
    v = f.take([7, 2], [6, 2, 4])
    p = spaces.ParcelSpace(v.space, ("a", "b"), ((1, 1, 1.0), (1, 3, 1.0), (2, 2, 1.0)), "toy")
    x = by_columns(7, 6) / 10
    got = v.map_features(fm.map_to(p, spark)).collect()
    assert got.index.tolist() == ["obs-7", "obs-2"]
    assert np.allclose(got.to_numpy(), [[(x[i, 5] + x[i, 3]) / 2, x[i, 1]] for i in (6, 1)])
    with pytest.raises(spaces.IncompatibleSpaces):
        v.map_features(fm.map_to(spaces.ParcelSpace(f.space, ("a",), tuple((1, i, 1.0) for i in range(1, 7)), "toy"), spark))
    # arrays of several chunks map by a join, with the same result
    wide = Frame({"beta": Assay(source.memory_source(spark, x, width=4))}, f.observations, f.features, f.space, f.entities, f.relations).take([7, 2], [6, 2, 4])
    assert np.allclose(wide.map_features(fm.map_to(p, spark)).collect().to_numpy(), got.to_numpy())
    holes = Frame({"beta": Assay(source.memory_source(spark, [[1.0, None, 3.0, 4.0, 5.0, 6.0]]))}, f.take(["obs-1"]).observations, f.features, f.space, f.entities, f.relations).take(None, [6, 2, 4])
    assert holes.map_features(fm.map_to(p, spark)).collect().iloc[0].isna().tolist() == [False, True]


def test_reads_leave_out_shards_that_hold_no_row_asked_for(spark):
    counted = [source.counting(source.memory_source(spark, by_columns(n, 4, s))) for n, s in ((3, 1), (2, 21), (3, 41))]
    src, counts = source.row_sharded([c[0] for c in counted]), [c[1] for c in counted]
    assert src.descriptor()["shape"] == [8, 4] and [c.rows for c in counts] == [0, 0, 0]
    assert matrix(src.read([8, 1], [1, 4]), 2, 2).tolist() == [[43, 52], [1, 10]]
    assert counts[1].rows == counts[1].values == 0 and counts[0].rows and counts[2].rows
    for c in counts:
        c.reset()
    counted, fresh = zip(*[source.counting(source.memory_source(spark, by_columns(2, 3, s))) for s in (1, 11)], strict=True)
    view = source.row_sharded(list(counted)).view([4], [2])
    assert fresh[0].rows == fresh[1].rows == 0
    assert matrix(view.read(), 1, 1).tolist() == [[14]] and fresh[0].rows == 0 and fresh[1].rows == 2 and fresh[1].bytes == 2 * 3 * 8
    more = source.append_shards(source.row_sharded([counted[0]], ["a"]), [source.faulty(counted[1])], ["b"])
    assert matrix(more.read([1], [1]), 1, 1).tolist() == [[1]]
    with pytest.raises(PySparkException, match="injected"):
        more.read([3], [1]).collect()


def test_sources_of_whatever_holds_an_array(spark):
    x = by_columns(3, 2)
    table = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist(), 1)], "obs_idx long, values array<double>")
    for held in (x, table, source.memory_source(spark, x)):
        s = source.as_source(spark, held)
        assert s.shape == (3, 2) and matrix(s.read(), 3, 2).tolist() == x.tolist()


def test_frame_store_round_trip(spark, tmp_path):
    f = small_frame(spark)
    store.write_frame(f, str(tmp_path / "f"))
    again = store.open_frame(spark, str(tmp_path / "f"), f.space)
    assert store.manifest(again) == store.manifest(f) and again.collect().equals(f.collect())
    changed = {**store.manifest(f), "active": "variance"}
    with pytest.raises(ValueError):
        store.check_manifest(changed)
    with pytest.raises(ValueError):
        store.open_frame(spark, str(tmp_path / "f"), spaces.VolumeSpace((2, 2, 2)))


def test_stores_keep_blocks_edges_tables_and_views(spark, tmp_path):
    f = small_frame(spark)
    table = f.observations.table
    motion = axes.block(table.select("obs_id", (F.col("idx") / 10).alias("x")), "obs_id", ["x"], role="confound")
    pca = axes.block(f.entities["stimulus"].table.select("stimulus_id", F.lit(1.5).alias("PC01")), "stimulus_id", ["PC01"])
    edges = spark.createDataFrame([("obs-1", "obs-3", 1.0), ("obs-3", "obs-5", 2.0)], "from_id string, to_id string, weight double")
    f = Frame(
        f.assays, axes.Axis(table, "obs_id", {"motion": motion}), f.features, f.space, {"stimulus": Entity("stimulus", f.entities["stimulus"].table, "stimulus_id", {"pca": pca})},
        {**f.relations, "near": SparseRelation(edges, "observation", "observation", False)}, {"notes": spark.range(3)},
    )
    wrote = store.write_frame(f, str(tmp_path / "f"))
    again = store.open_frame(spark, str(tmp_path / "f"), f.space)
    assert store.manifest(again) == wrote == store.manifest(f)
    rows = lambda df: sorted(map(tuple, df.collect()))
    near = again.relations["near"]
    assert rows(near.edges) == rows(edges) and not near.directed and again.tables["notes"].count() == 3
    assert rows(again.observations.blocks["motion"].cells) == rows(motion.cells) and again.observations.blocks["motion"].role == "confound"
    assert rows(again.entities["stimulus"].blocks["pca"].cells) == rows(pca.cells)
    v = f.take(["obs-5", "obs-3", "obs-2"], [4, 2])
    store.write_frame(v, str(tmp_path / "v"))
    back = store.open_frame(spark, str(tmp_path / "v"), v.space)
    assert back.collect().equals(v.collect()) and back.collect().index.tolist() == ["obs-5", "obs-3", "obs-2"] and rows(back.relations["near"].edges) == [("obs-3", "obs-5", 2.0)]


def test_studies_are_stored_with_links_and_tables(spark, tmp_path):
    f = small_frame(spark)
    pairs = spark.createDataFrame([("obs-1", "obs-2")], "from_id string, to_id string")
    events = study.Events(spark.createDataFrame([("e1", 0.0, 1.0)], "event_id string, onset double, duration double"))
    s = study.Study({"a": f, "many": study.Collection({"x": f, "y": f})}, f.entities, {"l": study.Link("a", "a", "derived_from", pairs)}, {"events": events, "notes": spark.range(2)})
    m = store.write_study(s, str(tmp_path / "s"))
    assert m == store.study_manifest(s)
    back = store.open_study(spark, str(tmp_path / "s"), {"a": f.space, "many": f.space})
    assert store.study_manifest(back) == m and back.links["l"].pairs.count() == 1 and back.tables["events"].validate().key == "event_id"
    assert back.frames["many"].frames["y"].collect().equals(f.collect())


def test_maps_over_the_native_space(spark):
    f = small_frame(spark)
    x = by_columns(7, 6) / 10
    one = {r["place"]: r["value"] for r in spatial.spatial_map(f, "obs-3").collect()}
    assert [one[i] for i in range(1, 9)] == [*x[2].tolist(), None, None]
    assert {r["place"]: r["value"] for r in spatial.spatial_map(f, 3).collect()} == one
    p = spaces.ParcelSpace(f.space, ("a", "b"), tuple((1 if i <= 3 else 2, i, 1.0) for i in range(1, 7)), "toy")
    parcels = f.map_features(fm.map_to(p, spark))
    painted = {r["place"]: r["value"] for r in spatial.spatial_map(parcels, 1).collect()}
    assert painted[1] == painted[3] == pytest.approx(x[0, :3].mean()) and painted[8] is None
    assert spatial.native_cells(p) == 8 and spatial.execution_path(f) == "matrix" and spatial.execution_path(f, "spatial") == "reconstruct"
    for bad in (lambda: spatial.spatial_maps(f, budget=8), lambda: spatial.execute_spatial(f, lambda pdf: pdf, "x int", budget=8)):
        with pytest.raises(blocks.OverBudget):
            bad()
    with pytest.raises(axes.InvalidAxis):
        spatial.execution_path(f, "spatial", path="native")
    mesh = spaces.SurfaceSpace(("v1", "v2", "v3"), ("L", "L", "R"), medial_wall=(2,))
    both = spaces.CompositeSpace((("mesh", mesh), ("index", spaces.IndexSpace(2, namespace="n"))))
    of = spark.createDataFrame([("o",)], "obs_id string")
    v = spark.createDataFrame([("o", i, float(i)) for i in range(1, 5)], "obs_id string, feat_idx int, value double")
    got = sorted((r["part"], r["place"], r["value"]) for r in spatial.reconstruct(both, v, of).collect())
    assert got == [("index", 1, 3.0), ("index", 2, 4.0), ("mesh", 1, 1.0), ("mesh", 2, None), ("mesh", 3, 2.0)]


def test_maps_of_the_fixture(spark):
    src = source.memory_source(spark, np.arange(1, 21, dtype=float).reshape(5, 4))
    op = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 3, 1.0), (3, 1, 0.25), (3, 3, 0.25), (3, 4, 0.5)], spaces.OPERATOR)
    m = fm.FeatureMap(spaces.IndexSpace(4, namespace="a"), spaces.IndexSpace(3, namespace="b"), op).validate()
    rows = lambda df, i: [round(r["value"], 9) for r in df.where(f"obs_idx = {i}").orderBy("feat_idx").collect()]
    out = fm.mapped(src, m)
    assert rows(out, 1) == [1.5, 3, 3] and rows(out, 2) == [5.5, 7, 7]
    small = source.memory_source(spark, np.arange(1, 21, dtype=float).reshape(5, 4) / 100)
    assert rows(fm.mapped(small, m, "independent_variance"), 1) == [0.0075, 0.03, 0.0125]
    assert fm.mapped(src, m, targets=[2]).count() == 5
    holes = source.memory_source(spark, [[1.0, None, 3.0, 4.0]])
    assert [r["value"] for r in fm.mapped(holes, m).orderBy("feat_idx").collect()] == [None, 3.0, 3.0]
    with pytest.raises(ValueError):
        fm.FeatureMap(m.source, m.target, spark.createDataFrame([(9, 1, 1.0)], spaces.OPERATOR)).validate()


def test_frame_maps_and_grows_provenance(spark):
    f = small_frame(spark)
    p = spaces.ParcelSpace(f.space, ("a", "b"), tuple((1 if i <= 3 else 2, i, 1.0) for i in range(1, 7)), "toy")
    g = f.map_features(fm.map_to(p, spark), {"variance": "independent_variance"})
    x = by_columns(7, 6) / 10
    assert np.allclose(g.collect().to_numpy(), np.c_[x[:, :3].mean(1), x[:, 3:].mean(1)]) and len(g.provenance) == 1
    v = by_columns(7, 6) / 100 + 0.1
    assert np.allclose(g.collect("variance").to_numpy(), np.c_[v[:, :3].sum(1), v[:, 3:].sum(1)] / 9)
    with pytest.raises(spaces.IncompatibleSpaces):
        g.map_features(fm.map_to(p, spark))


def test_blocks_fit_and_cover(spark):
    for layout in ("balanced", "imagewise", "featurewise"):
        plan = blocks.plan_blocks((7, 6), layout=layout, budget=64, target=64)
        rows = plan.manifest(spark).collect()
        assert max(r["bytes"] for r in rows) <= 64 and sum(r["cells"] for r in rows) == 42
    with pytest.raises(blocks.OverBudget):
        blocks.plan_blocks((7, 6), layout="imagewise", budget=40)
    with pytest.raises(ValueError):
        blocks.execute(spark.range(1), plan, lambda p: p, "x int", "another")


def test_chunks_are_contiguous_and_complete(spark):
    cells = source.memory_source(spark, by_columns(3, 10)).long()
    got = list(chunks.chunks(cells, chunks.chunk_of(F.col("feat_idx"), 10, 4)))
    assert [sorted(c.cells["feat_idx"].unique()) for c in got] == [[1, 2, 3, 4], [5, 6], [7, 8], [9, 10]] or sum(len(c.cells) for c in got) == 30


def test_scalars():
    assert len(scalar.DTYPES) == 15 and scalar.dtype_bytes("complex128") == 16
    with pytest.raises(ValueError):
        scalar.dtype_bytes("text")
    flags = [True, False, True] * 5
    assert scalar.unpack_bits(scalar.pack_bits(flags), 15) == flags
    assert scalar.canonical_digest({"a": 1, "b": [2]}) == scalar.canonical_digest({"b": [2], "a": 1})
    assert scalar.relative_path("/r/a/b.nii", "/r") == "a/b.nii"
    with pytest.raises(ValueError):
        scalar.relative_path("/x/b", "/r")
