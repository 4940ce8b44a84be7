"""Archives, datasets and provenance."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import source, validity
from gridloom.plans.provenance import Graph, Record
from gridloom.sources import archive, dataset
from gridloom.streaming import chunks


def test_archive_round_trip(spark, tmp_path):
    scans = spark.createDataFrame([("sub-1_task-a_run-1", "1", "s", "a", "1"), ("sub-2_task-b_run-1", "2", "s", "b", "1")], "scan_name string, subject string, session string, task string, run string")
    lengths = {"sub-1_task-a_run-1": 3, "sub-2_task-b_run-1": 2}
    cells = spark.createDataFrame([(s, t, v, float(t * v)) for s, n in lengths.items() for t in range(1, n + 1) for v in range(1, 5)], "scan_name string, timepoint int, voxel int, value double")
    parcels = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "voxel int, feature int")
    events = spark.createDataFrame([("sub-1_task-a_run-1", 0.0)], "scan_name string, onset double")
    confounds = spark.createDataFrame([], "scan_name string, motion double")
    censor = spark.createDataFrame([("sub-1_task-a_run-1", 2, 1)], "scan_name string, timepoint int, censor int")
    archive.write(archive.parcel_cells(cells, parcels), scans, events, confounds, str(tmp_path / "a"), censor)
    a = archive.read(spark, str(tmp_path / "a"))
    index = {r["scan_name"]: (r["n_time"], r["time_offset"], r["has_events"], r["has_confounds"]) for r in a.scan_index.collect()}
    assert index == {"sub-1_task-a_run-1": (3, 0, True, False), "sub-2_task-b_run-1": (2, 3, False, False)}
    b = a.subset(task=["a"])
    assert sorted((r["timepoint"], r["feature"], r["value"]) for r in b.assay.collect()) == [(t, f, t * v) for t in (1, 2, 3) for f, v in ((1, 1.5), (2, 3.5))]
    assert b.censor.agg(F.sum("censor")).first()[0] == 1 and a.subset(subject=["2"]).events.count() == 0
    assert [r["task"] for r in a.distinct("task").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        a.subset(colour=["red"])


def test_template_scores_reconstruct_what_they_span(spark):
    r = np.random.default_rng(1)
    w, s = r.normal(size=(6, 2)), r.normal(size=(4, 2))
    x = s @ w.T
    cells = spark.createDataFrame([("scan", t, v, float(x[t, v])) for t in range(4) for v in range(6)], "scan_name string, timepoint int, voxel long, value double")
    loadings = spark.createDataFrame([(v, k, float(w[v, k])) for v in range(6) for k in range(2)], "v long, k long, loading double")
    got = archive.template_cells(cells, loadings).collect()
    assert all(abs(g["value"] - s[g["timepoint"], g["feature"]]) < 1e-9 for g in got) and len(got) == 8


def test_datasets_stack_and_split(spark):
    x = np.arange(12, dtype=float).reshape(4, 3)
    one = dataset.Dataset(source.memory_source(spark, x), (3, 1), 2.0, spark.createDataFrame([("face",), ("face",), ("scene",)], "trial_type string"), censor=(0, 1, 0, 0))
    two = dataset.Dataset(source.memory_source(spark, x + 100), (4,), 2.0)
    assert [(r["start"], r["end"], r["duration"]) for r in one.runs().orderBy("run_id").collect()] == [(1, 3, 6.0), (4, 4, 2.0)]
    assert {r["trial_type"]: r["n"] for r in one.condition_counts().collect()} == {"face": 2, "scene": 1}
    whole, spans = dataset.study([one, two], ["s1", "s2"])
    assert whole.source.shape == (8, 3) and whole.times().agg(F.sum("censor")).first()[0] == 1
    again = dataset.subject_of(whole, spans, "s2", (4,))
    assert sorted(r["value"] for r in again.cells().collect()) == sorted((x + 100).ravel().tolist())
    for bad in ({"run_lengths": (3,)}, {"tr": 0}, {"mask": (True, False)}):
        with pytest.raises(ValueError):
            dataset.Dataset(**{"source": one.source, "run_lengths": (3, 1), "tr": 2.0, **bad})
    masks = spark.createDataFrame([(1, True), (1, False), (2, True), (2, True)], "feat_idx int, valid boolean")
    assert validity.combined(masks).where("valid").count() == 1
    known = {"scans": ["a.nii", "b.nii"], "TR": 2.5, "mask": "m.nii", "run_length": [10.0, 20.0], "event_model": "hrf(x)", "event_table": "e.txt", "block_column": "run", "baseline_model": "poly", "verbose": True}
    for text in (json.dumps(known), dataset.write_config({**known, "design": 1})):
        assert dataset.read_config(text, base_path="/d") == {**known, "cmd_flags": "", "jobs": 1, "base_path": "/d", "output_dir": "stat_out"}
    assert dataset.read_config("# old\nscans = a.nii\nTR: 2\nrun_length = 10,20\nok = TRUE\n", ["scans"], {}) == {"scans": "a.nii", "TR": 2.0, "run_length": [10.0, 20.0], "ok": True}
    with pytest.raises(ValueError):
        dataset.read_config("{}")


def test_provenance_is_acyclic_and_named_by_content():
    a = Record("read", inputs=("x",))
    b = Record("map", parents=(a.id,), parameters=(("rule", "linear"),))
    g = Graph((a,)).append([b, a])
    assert g.tips() == [b.id] and g.digest() == Graph((a, b)).digest() and a.id != b.id
    with pytest.raises(ValueError):
        Graph((b, a))
    with pytest.raises(ValueError):
        Graph((a, a))


def test_strategies_go_through_a_dataset(spark):
    x = np.arange(24, dtype=float).reshape(6, 4)
    d = dataset.Dataset(source.memory_source(spark, x), (2, 4), 2.0)
    sizes = lambda name, n=None: [len(c.cells) for c in chunks.strategy(name, n)(d)]
    assert sizes("runwise") == [8, 16] and sizes("voxelwise") == [6] * 4 and sum(sizes("chunkwise", 9)) == 24 and len(sizes("chunkwise", 2)) == 2
    with pytest.raises(ValueError):
        chunks.strategy("chunkwise")
