"""Low-rank arrays, components, maps by chunks, gathers, sparse rows, supports, summaries, masks, streams, stored arrays and images against numpy."""

import gzip
import json
import os
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.functions.cache import ReadCache, readable
from gridloom.operators import axis as axes
from gridloom.operators import feature_map as fm
from gridloom.operators import gather, groups, latent, source, spaces, validity
from gridloom.plans import blocks, spatial
from gridloom.plans.frame import Assay, Frame
from gridloom.sources import archive, dataset, nifti, registry, store, zarr
from gridloom.streaming import chunks


def matrix(df, n, m):
    out = np.full((n, m), np.nan)
    for r in df.collect():
        out[r["obs_idx"] - 1, r["feat_idx"] - 1] = np.nan if r["value"] is None else r["value"]
    return out


def same(a, b):
    return np.allclose(a, b, equal_nan=True)


@pytest.fixture(scope="module")
def factors():
    r = np.random.default_rng(5)
    return r.normal(size=(40, 3)).round(3), r.normal(size=(30, 3)).round(3), r.normal(size=30).round(3)


def low_rank(spark, s, w, o=None, width=7):
    offset = None if o is None else spark.createDataFrame([(i, float(x)) for i, x in enumerate(o, 1)], "feat_idx int, offset double")
    return latent.latent_source(source.memory_source(spark, s.tolist()), source.memory_source(spark, w.tolist()), offset, width)


def test_latent_arrays_are_the_product(spark, factors):
    s, w, o = factors
    x, want = low_rank(spark, s, w, o), s @ w.T + o
    assert x.shape == (40, 30) and same(matrix(x.long(), 40, 30), want)
    assert same(matrix(source.whole_rows(x).select("obs_idx", F.posexplode("values").alias("p", "value")).withColumn("feat_idx", F.col("p") + 1), 40, 30), want)
    read = {(r["obs_pos"], r["feat_pos"]): r["value"] for r in x.read([5, 1, 5], [30, 2]).collect()}
    assert len(read) == 6 and all(abs(v - want[(5, 1, 5)[p - 1] - 1, (30, 2)[q - 1] - 1]) < 1e-12 for (p, q), v in read.items())
    view = x.view([9, 3], [10, 28]).view([2], None)
    assert view.shape == (1, 2) and same(matrix(view.long(), 1, 2), want[[2]][:, [9, 27]])
    assert low_rank(spark, s, w).long([]).count() == 0
    with pytest.raises(ValueError, match="components"):
        latent.latent_source(source.memory_source(spark, s.tolist()), source.memory_source(spark, [[1.0]]))


def test_latent_reads_take_the_factors_asked_for_alone(spark, factors):
    s, w, _ = factors
    one, a = source.counting(source.memory_source(spark, s[:20].tolist()))
    two, b = source.counting(source.memory_source(spark, s[20:].tolist()))
    low, c = source.counting(source.memory_source(spark, w[:10].tolist()))
    high, d = source.counting(source.memory_source(spark, w[10:].tolist()))
    x = latent.latent_source(source.row_sharded([one, two]), source.row_sharded([low, high]), None, 7)
    assert (a.rows, b.rows, c.rows, d.rows) == (0, 0, 0, 0)
    got = x.read([25, 30], [3]).collect()
    assert same([r["value"] for r in sorted(got, key=lambda r: r["obs_pos"])], (s @ w.T)[[24, 29], 2])
    # shards that hold nothing asked for are not read, and no cell of the whole array was made
    assert a.rows == 0 and d.rows == 0 and b.rows > 0 and c.rows > 0


def test_latent_nulls_runs_and_frames(spark, factors):
    s, w, o = factors
    with_null = [[None if (i, k) == (2, 1) else float(v) for k, v in enumerate(row)] for i, row in enumerate(s)]
    x = latent.latent_source(source.memory_source(spark, with_null), source.memory_source(spark, w.tolist()))
    got = matrix(x.long(), 40, 30)
    assert np.isnan(got[2]).all() and same(got[3:], (s @ w.T)[3:])
    runs = latent.latent_runs([low_rank(spark, s, w, o), low_rank(spark, s[:10], 2 * w)])
    assert runs.shape == (50, 30) and same(matrix(runs.long(), 50, 30), np.vstack([s @ w.T + o, 2 * s[:10] @ w.T]))
    assert same(matrix(runs.long([4, 29]), 50, 30)[:, [3, 28]], np.vstack([s @ w.T + o, 2 * s[:10] @ w.T])[:, [3, 28]])
    with pytest.raises(ValueError, match="agree"):
        latent.latent_runs([low_rank(spark, s, w), low_rank(spark, s, w[:5])])
    space = spaces.IndexSpace(30, namespace="x")
    obs = spark.createDataFrame([(f"o{i}", i, i % 2) for i in range(1, 41)], "obs_id string, idx long, odd int")
    f = Frame({"v": Assay(low_rank(spark, s, w, o))}, axes.Axis(obs, "obs_id"), axes.Axis(space.features(spark).withColumn("idx", F.col("feat_idx").cast("long")), "feature_id"), space)
    view = f.filter_obs(F.col("odd") == 1).select_features(F.col("feat_idx") <= 2)
    assert same(matrix(view.cells(), 40, 30)[::2, :2], (s @ w.T + o)[::2, :2]) and view.cells().count() == 40
    m = fm.FeatureMap(space, spaces.IndexSpace(1, namespace="y"), spark.createDataFrame([(1, i, 1.0) for i in range(1, 31)], spaces.OPERATOR))
    assert same(matrix(f.map_features(m).cells(), 40, 1), (s @ w.T + o).sum(axis=1)[:, None])


@pytest.mark.parametrize("features, width", [(20, 4096), (20, 6), (600, 128)])
def test_components_are_those_of_the_eigenvectors(spark, features, width):
    r = np.random.default_rng(features)
    a = r.normal(size=(80, 4)) * [9, 6, 4, 2] @ r.normal(size=(4, features)) + 0.01 * r.normal(size=(80, features)) + 3
    found = latent.pca(source.memory_source(spark, a.tolist(), width=width), 3)
    u, size, vt = np.linalg.svd(a - a.mean(axis=0), full_matrices=False)
    assert np.allclose(found.variance, size[:3] ** 2 / 79, rtol=1e-8)
    loadings = np.array([x["loadings"] for x in found.loadings.orderBy("feat_idx").collect()])
    assert np.allclose(np.abs(np.sum(loadings * vt[:3].T, axis=0)), 1, atol=1e-7) and (loadings[np.abs(loadings).argmax(axis=0), range(3)] > 0).all()
    scores = np.array([x["scores"] for x in found.scores.orderBy("obs_idx").collect()])
    assert np.allclose(scores, (a - a.mean(axis=0)) @ loadings, atol=1e-8)
    best = (u[:, :3] * size[:3]) @ vt[:3] + a.mean(axis=0)
    assert np.allclose(matrix(found.source().long(), 80, features), best, atol=1e-6)


def test_components_need_every_cell_and_a_bounded_basis(spark):
    with pytest.raises(PySparkException):
        latent.pca(source.memory_source(spark, [[1.0, None], [2.0, 3.0]]), 1)
    with pytest.raises(ValueError, match="more than"):
        latent.pca(source.memory_source(spark, [[1.0] * 5] * 5), 1, max_entries=10)
    with pytest.raises(ValueError, match="between"):
        latent.pca(source.memory_source(spark, [[1.0, 2.0]]), 2)


@pytest.mark.parametrize("width", [4096, 2])
@pytest.mark.parametrize("entries", [1_000_000, 0])
def test_targets_without_entries_are_zero_whatever_the_width(spark, monkeypatch, width, entries):
    """Entries 0: an operator that is not broadcast."""
    monkeypatch.setattr(fm, "ROW_ENTRIES", entries)
    x = [[1.0, 2.0, 3.0, 5.0], [1.0, None, 3.0, 4.0]]
    op = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (3, 3, 1.0), (3, 4, 1.0), (1, 4, 0.0)], spaces.OPERATOR)
    space = spaces.IndexSpace(4, namespace="a")
    obs = spark.createDataFrame([("o1", 1), ("o2", 2)], "obs_id string, idx long")
    f = Frame({"v": Assay(source.memory_source(spark, x, width=width))}, axes.Axis(obs, "obs_id"), axes.Axis(space.features(spark).withColumn("idx", F.col("feat_idx").cast("long")), "feature_id"), space)
    for rule in fm.RULES:
        got = f.map_features(fm.FeatureMap(space, spaces.IndexSpace(3, namespace="b"), op), rule).cells().collect()
        assert {(r["obs_idx"], r["feat_idx"]): r["value"] for r in got} == {(1, 1): 3.0, (1, 2): 0.0, (1, 3): 8.0, (2, 1): None, (2, 2): 0.0, (2, 3): 7.0}
    view = f.take(None, ["feature-4", "feature-1"])
    two = fm.FeatureMap(view.space, spaces.IndexSpace(2, namespace="c"), spark.createDataFrame([(2, 1, 10.0), (2, 2, 1.0)], spaces.OPERATOR))
    assert {(r["obs_idx"], r["feat_idx"]): r["value"] for r in view.map_features(two).cells().collect()} == {(1, 1): 0.0, (1, 2): 51.0, (2, 1): 0.0, (2, 2): 41.0}


@pytest.mark.parametrize("width", [4096, 3])
def test_summaries_of_parcels(spark, width):
    r = np.random.default_rng(2)
    x = r.normal(size=(6, 11)).round(2)
    data = x.tolist()
    data[4][0] = None
    p = spaces.ParcelSpace(spaces.IndexSpace(11, namespace="i"), ("a", "b", "c"), tuple((1 if f <= 4 else 2 if f <= 10 else 3, f, 1.0) for f in range(1, 12)), "toy")
    src = source.memory_source(spark, data, width=width)
    got = {row["obs_idx"]: row["values"] for row in fm.parcel_summary(src, p).collect()}
    want = [[np.median(v[:4]), np.median(v[4:10]), v[10]] for v in x]
    assert got[5][0] is None and got[5][1:] == pytest.approx(want[4][1:]) and all(got[i + 1] == pytest.approx(want[i]) for i in (0, 1, 2, 3, 5))
    trimmed = {row["obs_idx"]: row["values"] for row in fm.parcel_summary(src, p, fm.trimmed_mean(0.25)).collect()}
    assert trimmed[1] == pytest.approx([np.sort(x[0][:4])[1:3].mean(), np.sort(x[0][4:10])[1:5].mean(), x[0][10]])
    biggest = {row["obs_idx"]: row["values"] for row in fm.parcel_summary(src, p, F.array_max).collect()}
    assert biggest[2] == pytest.approx([x[1][:4].max(), x[1][4:10].max(), x[1][10]])


def test_gathered_rows_are_read_once_and_in_order(spark):
    x = np.arange(1, 31, dtype=float).reshape(5, 6)
    src, counts = source.counting(source.memory_source(spark, x.tolist(), width=4))
    rows = spark.createDataFrame([(1, 4), (2, None), (3, 4), (4, 1), (5, 4)], "pos long, row long")
    out = gather.row_gather(src, rows, 5)
    assert same(matrix(out.long(), 5, 6), [x[3], [np.nan] * 6, x[3], x[0], x[3]])
    assert out.shape == (5, 6) and gather.row_gather(src, rows.limit(0), 0).long().count() == 0
    assert counts.values <= 2 * 30  # no row once for each position: both reads of all pieces at most
    with pytest.raises(PySparkException):
        gather.row_gather(src, spark.createDataFrame([(1, 9)], "pos long, row long"), 1).long().count()


def test_sparse_rows_stay_sparse(spark):
    x = np.array([[0, 2.0, 0, -1], [0, 0, 0, 0], [5, 0, 0, 0]])
    cells = spark.createDataFrame([(i + 1, j + 1, float(x[i, j])) for i in range(3) for j in range(4)], "obs_idx long, feat_idx int, value double")
    s = gather.sparse_source(cells, (3, 4))
    assert {r["obs_idx"]: (list(r["indices"]), list(r["values"])) for r in s.rows.collect()} == {1: ([2, 4], [2.0, -1.0]), 3: ([1], [5.0])}
    assert same(matrix(s.dense().long(), 3, 4), x)
    assert same(matrix(s.view([3, 1], [4, 1]).dense().long(), 2, 2), x[[2, 0]][:, [3, 0]])
    lifted = s.lift(spark.createDataFrame([(1, 3), (2, None), (3, 2), (4, 3)], "pos long, row long"), 4)
    assert same(matrix(lifted.dense().long(), 4, 4), [x[2], [np.nan] * 4, x[1], x[2]])
    assert lifted.long().count() == 2  # what is held, and no more
    space = spaces.IndexSpace(4, namespace="s")
    m = fm.FeatureMap(space, spaces.IndexSpace(2, namespace="t"), spark.createDataFrame([(1, 2, 1.0), (1, 4, 1.0), (2, 1, 2.0), (2, 2, 0.0)], spaces.OPERATOR))
    assert same(matrix(lifted.map(m).dense().long(), 4, 2), [[0, 10], [np.nan] * 2, [0, 0], [0, 10]])
    assert same(matrix(s.map(m).dense().long(), 3, 2), [[1, 0], [0, 0], [0, 10]])
    with pytest.raises(PySparkException):
        gather.sparse_source(cells.unionByName(cells), (3, 4)).rows.collect()
    with pytest.raises(ValueError, match="once"):
        s.view(None, [1, 1])


def test_subjects_meet_on_their_common_support(spark):
    x, y = np.arange(12, dtype=float).reshape(3, 4), 100 + np.arange(8, dtype=float).reshape(2, 4)
    a, b = source.memory_source(spark, x.tolist()), source.memory_source(spark, y.tolist(), width=2)
    both, voxels = gather.common_support([(a, [2, 3, 5, 7]), (b, [7, 5, 3, 9])], ["s1", "s2"], "intersect", least_overlap=0.7)
    assert voxels == [3, 5, 7] and both.shape == (5, 3)
    assert same(matrix(both.long(), 5, 3), np.vstack([x[:, [1, 2, 3]], y[:, [2, 1, 0]]]))
    assert [r["shard_id"] for r in both.shards.orderBy("start").collect()] == ["s1", "s2"]
    equal, voxels = gather.common_support([(a, [1, 2, 3, 4]), (b, [4, 3, 2, 1])])
    assert voxels == [1, 2, 3, 4] and same(matrix(equal.long(), 5, 4), np.vstack([x, y[:, ::-1]]))
    for bad in ({"strict": "identical"}, {"strict": "intersect", "least_overlap": 0.7, "volume": 100}, {"strict": "union"}):
        with pytest.raises(ValueError):
            gather.common_support([(a, [2, 3, 5, 7]), (b, [7, 5, 3, 9])], **bad)
    with pytest.raises(ValueError, match="own"):
        gather.common_support([(a, [1, 1, 2, 3])])


@pytest.mark.parametrize("width", [4096, 4])
def test_masks_apply_by_position(spark, width):
    flags = {"sub-1": "110101", "sub-2": "100111"}
    v = validity.from_flags(spark, {k: [c == "1" for c in f] for k, f in flags.items()})
    x = np.arange(1, 19, dtype=float).reshape(3, 6)
    obs = spark.createDataFrame([(1, "sub-1"), (2, "sub-2"), (3, "sub-1")], "obs_idx long, subject string")
    src = source.memory_source(spark, x.tolist(), width=width)
    want = x.copy()
    for i, s in enumerate(("sub-1", "sub-2", "sub-1")):
        want[i, [c == "0" for c in flags[s]]] = np.nan
    masked = v.masked_source(src, obs, "subject")
    assert same(matrix(masked.long(), 3, 6), want) and masked.dtype == "float64" and masked.fingerprint != src.fingerprint
    assert same(matrix(v.masked(src.long(), obs, "subject"), 3, 6), want)
    with pytest.raises(PySparkException):
        v.masked_source(src, obs.withColumn("subject", F.lit("nobody")), "subject").long().count()


def by_hand(n, k):
    size = max(1, int(n / k + 0.5))
    return sorted((i // size) % k + 1 for i in range(n))


def test_chunk_numbers_are_those_that_go_round(spark):
    for n, k in ((64, 5), (10, 4), (7, 5), (100, 100), (5, 3), (10, 7), (100, 33), (3, 1), (17, 12), (1, 1)):
        got = [r[0] for r in spark.range(1, n + 1).select(chunks.chunk_of(F.col("id"), n, k)).collect()]
        assert got == by_hand(n, k), (n, k)


def test_many_chunks_come_in_order_from_one_scan(spark):
    n = 20_000
    values = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i + F.col("id") * 0.5)
    src, counts = source.counting(source.from_arrays(spark.range(1, 4).select("id", values.alias("v")), "id", "v", (3, n), "wide"))
    seen = 0
    for c in chunks.strategy("voxelwise")(dataset.Dataset(src, (3,), 2.0)):
        seen += 1
        assert c.number == seen and c.cells["feat_idx"].tolist() == [seen] * 3 and c.cells["value"].tolist() == [seen + 0.5, seen + 1, seen + 1.5]
    assert seen == n and counts.values == 3 * n


def test_runs_stream_in_order_and_no_cell_gives_no_chunk(spark):
    d = dataset.Dataset(source.memory_source(spark, np.arange(30, dtype=float).reshape(10, 3).tolist()), (2, 5, 3), 2.0)
    assert [(c.number, sorted(c.cells["obs_idx"].unique())) for c in chunks.strategy("runwise")(d)] == [(1, [1, 2]), (2, [3, 4, 5, 6, 7]), (3, [8, 9, 10])]
    assert list(chunks.chunks(d.source.long().limit(0), F.col("feat_idx"))) == []


@pytest.mark.parametrize("codec", [None, "zlib", "gzip", "zstd"])
@pytest.mark.parametrize("axes", [("observation", "feature"), ("feature", "observation")])
def test_stored_arrays_come_back(spark, tmp_path, codec, axes):
    x = np.arange(1, 78, dtype=float).reshape(11, 7)
    data = x.tolist()
    data[3][5] = None
    x[3, 5] = np.nan
    uri = str(tmp_path / "a.zarr")
    zarr.write_zarr(source.memory_source(spark, data, width=3), uri, 4, codec, axes)
    z = zarr.zarr_source(spark, uri, axes=axes)
    assert z.shape == (11, 7) and z.width == 3 and same(np.nan_to_num(matrix(z.long(), 11, 7), nan=-1), np.nan_to_num(x, nan=-1))
    held, counts = z.counting()
    got = matrix(held.holding([10, 2, 3, 10]).long(), 11, 7)
    assert same(got[[1, 2, 9]], x[[1, 2, 9]]) and np.isnan(got[[0, 3, 10]]).all() and counts.rows == 3 * 3
    if codec is None and axes == zarr.AXES:  # consecutive rows alone, not their chunks
        assert counts.stored == 3 * 3 * 3 * 8
    assert same(matrix(z.long([7]), 11, 7)[:, 6], x[:, 6]) and z.read([2], [1]).first()["value"] == x[1, 0]


def test_stored_arrays_of_others(spark, tmp_path):
    """Format 3, big-endian numbers, an absent chunk; what was changed or is not supported is refused."""
    (tmp_path / "c/0").mkdir(parents=True)
    x = np.arange(6, dtype=">i2").reshape(2, 3)
    (tmp_path / "c/0/0").write_bytes(x[:, :2].tobytes())
    meta = {"zarr_format": 3, "node_type": "array", "shape": [2, 3], "data_type": "int16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [2, 2]}}, "chunk_key_encoding": {"name": "default"}, "codecs": [{"name": "bytes", "configuration": {"endian": "big"}}], "fill_value": 9}
    (tmp_path / "zarr.json").write_text(json.dumps(meta))
    z = zarr.zarr_source(spark, str(tmp_path))
    assert z.dtype == "int16" and same(matrix(z.long(), 2, 3), [[0, 1, 9], [3, 4, 9]])
    told = zarr.zarr_source(spark, str(tmp_path), shape=(2, 3), dtype="int16", chunks=(2, 3))
    with pytest.raises(PySparkException, match="changed"):
        told.long().count()
    (tmp_path / "zarr.json").write_text(json.dumps({**meta, "shape": [2, 2]}))
    with pytest.raises(PySparkException, match="changed"):
        z.long().count()
    with pytest.raises(ValueError, match="codec"):
        zarr.parse_metadata(json.dumps({"zarr_format": 2, "shape": [1, 1], "chunks": [1, 1], "dtype": "<f8", "compressor": {"id": "blosc"}}))
    with pytest.raises(FileNotFoundError):
        zarr.zarr_source(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="together"):
        zarr.zarr_source(spark, str(tmp_path), shape=(2, 3))
    assert zarr.consecutive_runs([5, 1, 2, 2, 3, 9]) == [(1, 3), (5, 5), (9, 9)] and zarr.consecutive_runs([]) == []


@pytest.fixture
def images(tmp_path):
    a, b = np.arange(1, 81, dtype=float).reshape(10, 8), np.arange(101, 125, dtype=float).reshape(3, 8)
    paths = [str(tmp_path / f"run-{i}_bold.nii") for i in (1, 2)]
    for p, x in zip(paths, (a, b), strict=True):
        nifti.write_nifti(p, x, (2, 2, 2))
    return paths, np.vstack([a, b])


def test_volumes_are_read_by_ranges_and_conditions(spark, images):
    paths, x = images
    src, space = nifti.nifti_source(spark, paths, [2, 3, 8], range_bytes=8 * 8 * 4)
    assert same(matrix(src.long(), 13, 3), x[:, [1, 2, 7]])
    assert src.native.rdd.getNumPartitions() == 4  # ten volumes by four, and three
    some = src.holding([12, 3, 4])
    read = spark.read.format("gridloom_nifti")  # noqa: F841
    assert same(matrix(some.long(), 13, 3)[[2, 3, 11]], x[[2, 3, 11]][:, [1, 2, 7]]) and some.long().count() == 9
    files = [{**{c: r[c] for c in ("path", "n_times", "dtype", "size", "changed", "offset", "slope", "intercept", "order", "packed")}, "start": 10 * k} for k, r in enumerate(sorted(nifti.headers(spark, paths).collect(), key=lambda r: r["path"]))]
    every = nifti.volumes(spark, files, 8)
    whole = every.agg(F.sum("read_bytes")).first()[0]
    assert whole == 13 * 8 * 4
    for some, n in ((F.col("obs_idx").isin(3, 4, 12), 3), ((F.col("obs_idx") > 9) & (F.col("obs_idx") <= 11), 2), (F.col("obs_idx") == 13, 1), (F.col("obs_idx") > 99, 0)):
        got = every.where(some)
        assert (got.agg(F.sum("read_bytes")).first()[0] or 0) == n * 8 * 4 and got.count() == n


def test_native_maps_are_those_reconstructed(spark, images):
    paths, x = images
    src, space = nifti.nifti_source(spark, paths, [2, 3, 8])
    obs = spark.createDataFrame([(f"o{i}", i) for i in range(1, 14)], "obs_id string, idx long")
    f = Frame({"v": Assay(src)}, axes.Axis(obs, "obs_id"), axes.Axis(space.features(spark).withColumn("idx", F.col("feat_idx").cast("long")), "feature_id"), space)
    assert spatial.execution_path(f, "spatial") == "native" and spatial.execution_path(f, "spatial", path="reconstruct") == "reconstruct"
    maps = {p: {(r["obs_id"], r["place"]): r["value"] for r in spatial.spatial_maps(f, path=p).collect()} for p in ("native", "reconstruct")}
    assert maps["native"] == maps["reconstruct"] and len(maps["native"]) == 13 * 8 and maps["native"]["o2", 1] is None and maps["native"]["o2", 8] == x[1, 7]
    plans = {p: spatial.image_rows(f, path=p)._jdf.queryExecution().optimizedPlan().toString() for p in ("native", "reconstruct")}
    assert "zip_with" in plans["native"] and "zip_with" not in plans["reconstruct"]
    few = f.take(None, ["voxel-8", "voxel-2"])
    assert spatial.execution_path(few, "spatial") == "reconstruct"
    assert {r["place"]: r["value"] for r in spatial.spatial_map(few, "o1").collect()} == {i: {2: x[0, 1], 8: x[0, 7]}.get(i) for i in range(1, 9)}
    total = spatial.execute_spatial(f, lambda pdf: pd.DataFrame({"obs_id": [pdf["obs_id"].iloc[0]], "total": [pdf["value"].sum()], "n": [len(pdf)]}), "obs_id string, total double, n long")
    assert {r["obs_id"]: (r["total"], r["n"]) for r in total.collect()} == {f"o{i + 1}": (x[i, [1, 2, 7]].sum(), 8) for i in range(13)}


def test_compressed_images_and_quaternions(spark, images, tmp_path):
    paths, x = images
    packed = str(tmp_path / "packed.nii.gz")
    data = bytearray(open(paths[0], "rb").read())
    # a rotation by 90 degrees about the third axis, cells of 2 x 3 x 4, third axis turned
    data[76:92] = struct.pack("<4f", -1, 2, 3, 4)
    data[252:256] = struct.pack("<2h", 1, 0)
    data[256:280] = struct.pack("<6f", 0, 0, float(np.sqrt(0.5)), 10, 20, 30)
    with gzip.open(packed, "wb") as f:
        f.write(bytes(data))
    src, space = nifti.nifti_source(spark, [packed])
    assert same(matrix(src.long(), 10, 8), x[:10]) and same(matrix(src.holding([4]).long(), 10, 8)[3], x[3])
    assert np.allclose(np.array(space.affine).reshape(4, 4), [[0, -3, 0, 10], [2, 0, 0, 20], [0, 0, -4, 30], [0, 0, 0, 1]], atol=1e-6)
    assert np.allclose(np.array(nifti.quaternion_affine((1, 0, 0), (0, 0, 0), (1, 1, 1), 1)).reshape(4, 4), np.diag([1, -1, -1, 1]))
    src, _ = nifti.nifti_source(spark, [paths[0]])
    os.utime(paths[0], (1, 1))
    with pytest.raises(PySparkException, match="changed"):
        src.long().count()


def test_frames_open_by_their_folder_alone(spark, tmp_path):
    grid = spaces.VolumeSpace((2, 2, 2), support=(1, 3, 4), note={"by": "me"})
    mesh = spaces.SurfaceSpace(("v1", "v2"), ("L", "R"), ((1, 2, 1),))
    parcels = spaces.ParcelSpace(grid, ("a", "b"), ((1, 1, 1.0), (2, 3, 0.5)), "toy", "sum")
    basis = spaces.basis_from_decoder(grid, ("c",), np.array([[1.0], [2.0], [0.0]]))
    for k, space in enumerate((grid, mesh, parcels, basis, spaces.IndexSpace(2, ("x", "y"), "n"), spaces.CompositeSpace((("g", grid), ("m", mesh))))):
        assert spaces.from_plain(json.loads(json.dumps(spaces.to_plain(space)))) == space
        obs = spark.createDataFrame([("o1", 1)], "obs_id string, idx long")
        feat = axes.Axis(space.features(spark).withColumn("idx", F.col("feat_idx").cast("long")), "feature_id")
        f = Frame({"v": Assay(source.memory_source(spark, [[float(i) for i in range(space.n_features)]]))}, axes.Axis(obs, "obs_id"), feat, space)
        store.write_frame(f, str(tmp_path / str(k)))
        back = store.open_frame(spark, str(tmp_path / str(k)))
        assert back.space == space and same(matrix(back.cells(), 1, space.n_features), matrix(f.cells(), 1, space.n_features))
    with pytest.raises(ValueError, match="another"):
        store.open_frame(spark, str(tmp_path / "0"), mesh)


def test_kinds_are_there_from_the_start(monkeypatch):
    # as after import, whatever other tests took away
    monkeypatch.setattr(registry, "_KINDS", {})
    monkeypatch.setattr(registry, "_STATE", {"builtin": False})
    assert set(registry.names()) >= {"frame", "latent", "matrix", "nifti", "study", "zarr"} and registry.registered("zarr")


def test_archives_of_scores_reconstruct_by_run(spark):
    s = spark.createDataFrame([("r1", 1, 1, 2.0), ("r1", 1, 2, 1.0), ("r2", 1, 1, 1.0), ("r2", 2, 2, 4.0)], "scan_name string, timepoint int, feature int, value double")
    own = spark.createDataFrame([("r1", 1, 1, 1.0), ("r1", 1, 2, 3.0), ("r1", 2, 1, 5.0), ("r2", 1, 1, 7.0), ("r2", 2, 2, 2.0)], "run_id string, v int, k int, loading double")
    a = archive.Archive(s, s, s, s, s)
    got = {(r["run_id"], r["t"], r["v"]): r["value"] for r in a.reconstruct(own).collect()}
    assert got == {("r1", 1, 1): 5.0, ("r1", 1, 2): 10.0, ("r2", 1, 1): 7.0, ("r2", 1, 2): 0.0, ("r2", 2, 1): 0.0, ("r2", 2, 2): 8.0}
    shared = own.where("run_id = 'r1'").drop("run_id")
    got = {(r["run_id"], r["t"], r["v"]): r["value"] for r in a.reconstruct(shared, spark.createDataFrame([(2, 100.0)], "v int, offset double")).collect()}
    assert got == {("r1", 1, 1): 5.0, ("r1", 1, 2): 110.0, ("r2", 1, 1): 1.0, ("r2", 1, 2): 105.0, ("r2", 2, 1): 12.0, ("r2", 2, 2): 100.0}


def test_configurations_in_plain_text():
    text = "# a comment\nscans:\n  - a.nii\n  - 'b.nii'\nTR: 2.5\nmask = \"m: x\"\nrun_length: 10, 20\nflag: TRUE\nlist: [1, two, 'x']\nempty:\nname: v1-2,x\nodd line\n"
    assert dataset.plain_config(text) == {"scans": ["a.nii", "b.nii"], "TR": 2.5, "mask": "m: x", "run_length": [10.0, 20.0], "flag": True, "list": [1.0, "two", "x"], "empty": [], "name": "v1-2,x"}


def test_cache_keeps_what_was_used_last_within_its_bound(spark):
    made = []

    def table(n):
        def make():
            made.append(n)
            return spark.range(n).withColumn("x", F.col("id") * 2)

        return make

    c = ReadCache(64 << 20)
    assert c.get("a", table(5000)).count() == 5000 and c.get("a", table(5000)).count() == 5000 and made == [5000]
    size = c.current_bytes
    assert size > 0 and c.info()["hits"] == 1 and c.info()["misses"] == 1 and c.info()["n_objects"] == 1
    c.get("b", table(5001))
    c.get("a", table(5000))
    c.resize(int(size * 1.5))  # room for one
    assert c.keys() == ["a"] and c.info()["evicted"] == 1 and c.info()["utilization_pct"] > 50
    assert c.get("big", table(2_000_000)).count() == 2_000_000 and c.keys() == ["a"]  # given, not kept
    assert c.drop("a") and not c.drop("a") and c.info()["n_objects"] == 0
    c.get("c", table(10))
    c.clear()
    assert c.current_bytes == 0
    for bad in (0, -1, "1", True):
        with pytest.raises(ValueError, match="positive"):
            c.resize(bad)
    assert readable(0) == "0.0 B" and readable(1536) == "1.5 KB" and readable(3 << 30) == "3.0 GB"


@pytest.mark.parametrize("layout", ["balanced", "imagewise", "featurewise"])
@pytest.mark.parametrize("width", [4096, 4])
def test_blocks_come_as_matrices(spark, layout, width):
    x = np.arange(1, 78, dtype=float).reshape(7, 11)
    data = x.tolist()
    data[2][3] = None
    x[2, 3] = np.nan
    src = source.memory_source(spark, data, width=width)
    plan = blocks.plan_blocks(src.shape, layout=layout, budget=8 * 22, target=8 * 22, chunks=(3, 3))
    run = lambda b: pd.DataFrame({"id": [b.block_id], "obs": [b.observations.tolist()], "first": [b.first_feature], "values": [b.values.ravel().tolist()]})
    got = {r["id"]: r for r in blocks.execute_arrays(src, plan, run, "id long, obs array<long>, first long, values array<double>", plan.fingerprint).collect()}
    manifest = plan.manifest(spark).collect()
    assert sorted(got) == sorted(b["block_id"] for b in manifest)
    for b in manifest:
        r = got[b["block_id"]]
        assert r["obs"] == list(range(b["obs_start"], b["obs_end"] + 1)) and r["first"] == b["feat_start"]
        part = x[b["obs_start"] - 1 : b["obs_end"], b["feat_start"] - 1 : b["feat_end"]]
        assert same(np.array(r["values"], float).reshape(part.shape), part)
    for bad in ((src, "another"), (source.memory_source(spark, [[1.0]]), None)):
        with pytest.raises(ValueError, match="plan"):
            blocks.execute_arrays(bad[0], plan, run, "id long", bad[1])


def test_strata_are_numbered_by_ranges_and_samples_do_not_change(spark):
    rows = [(f"s{i}", None if i % 10 == 0 else "big" if i % 7 else "small") for i in range(400)]
    people = spark.createDataFrame(rows, "subject_id string, site string").repartition(7)
    one, two = (sorted(r["subject_id"] for r in groups.sample_subjects(people, {"big": 50, "small": 5, None: 3}, 4, "site").collect()) for _ in range(2))
    site = dict(rows)
    assert one == two and len(set(one)) == 58 and [sum(site[i] == s for i in one) for s in ("big", "small", None)] == [50, 5, 3]
    other = groups.sample_subjects(people, {"big": 50, "small": 5, None: 3}, 5, "site")
    assert sorted(r["subject_id"] for r in other.collect()) != one


def test_archives_of_components_give_their_scans_back(spark, tmp_path):
    r = np.random.default_rng(1)
    x = {n: r.normal(size=(t, 2)) @ r.normal(size=(2, 5)) + 7 for n, t in (("a", 6), ("b", 9))}
    scans = spark.createDataFrame([(n, n, "s", "t", "1") for n in x], "scan_name string, subject string, session string, task string, run string")
    none = spark.createDataFrame([], "scan_name string, onset double")
    archive.write_components({n: source.memory_source(spark, v.tolist()) for n, v in x.items()}, 2, scans, none, none, str(tmp_path / "c"))
    got = archive.read(spark, str(tmp_path / "c"))
    assert {r["scan_name"]: (r["n_time"], r["n_features"]) for r in got.scan_index.collect()} == {"a": (6, 2), "b": (9, 2)}
    back = got.reconstruct(*archive.read_components(spark, str(tmp_path / "c"))).collect()
    assert len(back) == 15 * 5 and all(abs(c["value"] - x[c["run_id"]][c["t"] - 1, c["v"] - 1]) < 1e-9 for c in back)
    with pytest.raises(ValueError, match="no scan"):
        archive.write_components({}, 2, scans, none, none, str(tmp_path / "d"))


def test_datasets_of_volumes_and_files(spark, images):
    paths, x = images
    d = dataset.file_dataset(spark, paths, mask=[i in (2, 3, 8) for i in range(1, 9)])
    assert d.run_lengths == (10, 3) and d.tr == 2.0 and same(matrix(d.source.long(), 13, 3), x[:, [1, 2, 7]])
    assert dataset.file_dataset(spark, paths, 1.5, run_lengths=[6, 4, 3]).run_lengths == (6, 4, 3)
    for bad in ([3, 10], [5]):
        with pytest.raises(ValueError, match="lengths"):
            dataset.file_dataset(spark, paths, run_lengths=bad)
    volumes = [x[:10].T.reshape(2, 2, 2, 10, order="F"), x[10:].T.reshape(2, 2, 2, 3, order="F")]
    mask = np.zeros(8)
    mask[[1, 2, 7]] = 1
    m = dataset.mem_dataset(spark, volumes, mask.reshape(2, 2, 2, order="F"), 2.0, events=spark.createDataFrame([("face", 1.0)], "trial_type string, onset double"), censor=[1] + [0] * 12)
    assert same(matrix(m.source.long(), 13, 3), x[:, [1, 2, 7]]) and dataset.described(m)["censored"] == 1
    assert dataset.described(d) == {"n_runs": 2, "run_lengths": [10, 3], "n_timepoints": 13, "n_features": 3, "TR": 2.0, "duration": 26.0, "censored": 0, "event_columns": [], "dtype": "float32"}
    with pytest.raises(ValueError, match="dimensions"):
        dataset.mem_dataset(spark, volumes, np.ones((2, 2)), 2.0)
    told = spark.createDataFrame([(2, 1, "x")], "run_id int, timepoint int, note string")
    assert {(r["obs_idx"], r["note"]) for r in dataset.with_row_data(m, told, ["run_id", "timepoint"]).collect()} == {(i, "x" if i == 11 else None) for i in range(1, 14)}
    f = dataset.as_frame(m).validate()
    assert dataset.as_frame(f) is f and f.filter_obs(F.col("run_id") == 2).cells().count() == 9 and f.tables["events"].count() == 1
    assert same(matrix(dataset.as_frame(d.source).cells(), 13, 3), x[:, [1, 2, 7]])
    with pytest.raises(TypeError):
        dataset.as_frame([1, 2])


def test_events_of_a_study_name_their_run(spark):
    events = spark.createDataFrame([("face",)], "trial_type string")
    one = dataset.Dataset(source.memory_source(spark, [[1.0], [2.0]]), (2,), 2.0, events)
    two = dataset.Dataset(source.memory_source(spark, [[1.0], [2.0]]), (1, 1), 2.0, events)
    with pytest.warns(UserWarning, match="s2"):
        whole, _ = dataset.study([one, two], ["s1", "s2"])
    assert {(r["subject_id"], r["run_id"]) for r in whole.events.collect()} == {("s1", 1), ("s2", None)}
