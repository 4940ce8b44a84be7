"""Entities, hierarchies, spaces, validity, studies, subjects, series, images."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridloom.operators import axis as axes
from gridloom.operators import entities as ent
from gridloom.operators import groups, series, spaces, validity
from gridloom.plans import study
from gridloom.plans.frame import Frame
from gridloom.sources import bids, nifti, registry


@pytest.fixture
def people(spark):
    obs = spark.createDataFrame([("obs-1", "run-02a", "face1"), ("obs-2", "run-01b", "scene1"), ("obs-3", "run-02a", "face1"), ("obs-4", "run-01a", "object1"), ("obs-5", "run-02a", "scene1")], "obs_id string, run_id string, stimulus_id string")
    e = {
        "subject": ent.Entity("subject", spark.createDataFrame([("sub-02", 63.0), ("sub-01", 71.0)], "subject_id string, age double"), "subject_id"),
        "session": ent.Entity("session", spark.createDataFrame([("ses-01b", "sub-01"), ("ses-02a", "sub-02"), ("ses-01a", "sub-01")], "session_id string, subject_id string"), "session_id"),
        "run": ent.Entity("run", spark.createDataFrame([("run-02a", "ses-02a"), ("run-01b", "ses-01b"), ("run-01a", "ses-01a")], "run_id string, session_id string"), "run_id"),
        "stimulus": ent.Entity("stimulus", spark.createDataFrame([("face1", "face"), ("scene1", "scene"), ("object1", "object")], "stimulus_id string, category string"), "stimulus_id"),
    }
    keys = [ent.KeyRelation("run_id"), ent.KeyRelation("session_id", source="run"), ent.KeyRelation("subject_id", source="session"), ent.KeyRelation("stimulus_id")]
    return obs, e, keys


def test_entities_resolve_along_keys(people):
    obs, e, keys = people
    got = {r["obs_id"]: (r["subject.age"], r["stimulus.category"]) for r in ent.resolve(obs, "obs_id", e, keys).collect()}
    assert got["obs-1"] == (63.0, "face") and got["obs-2"] == (71.0, "scene") and got["obs-4"] == (71.0, "object")


def test_missing_keys_give_nulls_and_unknown_keys_fail(spark, people):
    obs, e, keys = people
    holes = obs.withColumn("stimulus_id", F.when(F.col("obs_id") != "obs-1", F.col("stimulus_id")))
    assert {r["obs_id"]: r["stimulus.category"] for r in ent.resolve(holes, "obs_id", e, keys).collect()}["obs-1"] is None
    with pytest.raises(ent.BrokenRelation):
        ent.check_relation(holes, ent.KeyRelation("stimulus_id"), e)
    ent.check_relation(holes, ent.KeyRelation("stimulus_id", allow_missing=True), e)
    with pytest.raises(ent.BrokenRelation):
        ent.check_relation(obs.withColumn("stimulus_id", F.lit("x")), ent.KeyRelation("stimulus_id"), e)
    with pytest.raises(ent.BrokenRelation):
        ent.KeyRelation("nobody").resolved(e)


def test_second_paths_must_agree(people):
    obs, e, keys = people
    agreeing = obs.withColumn("subject_id", F.when(F.col("run_id") == "run-02a", "sub-02").otherwise("sub-01"))
    more = [*keys, ent.KeyRelation("subject_id", "subject")]
    assert ent.resolve(agreeing, "obs_id", e, more).count() == 5
    with pytest.raises(ent.BrokenRelation):
        ent.resolve(obs.withColumn("subject_id", F.lit("sub-01")), "obs_id", e, more)
    with pytest.raises(ent.BrokenRelation):
        ent.resolve(obs.withColumn("stimulus.category", F.lit(1)), "obs_id", e, keys)


def test_hierarchy_codes_are_places_in_whole_tables(spark, people):
    obs, e, keys = people
    ords = {n: spark.createDataFrame([(r[0], i) for i, r in enumerate(e[n].table.collect(), 1)], f"{e[n].key} string, ord int") for n in ("subject", "session", "run")}
    got = {r["obs_id"]: (r["subject_code"], r["session_code"], r["run_code"], r["complete"]) for r in ent.hierarchy(obs, "obs_id", ["subject", "session", "run"], e, keys, ords).collect()}
    assert got == {"obs-1": (1, 2, 1, True), "obs-2": (2, 1, 2, True), "obs-3": (1, 2, 1, True), "obs-4": (2, 3, 3, True), "obs-5": (1, 2, 1, True)}
    with pytest.raises(ent.BrokenRelation):
        ent.hierarchy(obs, "obs_id", ["stimulus", "run"], e, keys, ords)


def test_blocks_lift_with_nulls_for_missing_entities(spark):
    block = axes.block(spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "k string, PC1 double, PC2 double"), "k", ["PC1", "PC2"])
    of = spark.createDataFrame([("o1", "b"), ("o2", None)], "o string, k string")
    got = sorted((r["id"], r["component_id"], r["value"]) for r in ent.lift_block(of, "o", "k", block).collect())
    assert got == [("o1", "PC1", 3.0), ("o1", "PC2", 4.0), ("o2", "PC1", None), ("o2", "PC2", None)]


def values(df):
    return [r["value"] for r in df.orderBy(df.columns[0]).collect()]


def test_parcels_aggregate_paint_and_touch(spark):
    from gridloom.operators import feature_map as fm

    parent = spaces.VolumeSpace((3, 2, 1))
    members = tuple((1 if i <= 3 else 2, i, 1.0) for i in range(1, 7))
    cells = spark.createDataFrame([(1, i, float(i)) for i in range(1, 7)], "obs_idx int, feat_idx int, value double")
    mean = spaces.ParcelSpace(parent, ("10", "20"), members, "toy-atlas")
    total = spaces.ParcelSpace(parent, ("10", "20"), members, "toy-atlas", "sum")
    in_order = lambda df: [r["value"] for r in df.orderBy("feat_idx").collect()]
    assert in_order(fm.apply_map(cells, mean.encoder(spark))) == pytest.approx([2, 5]) and in_order(fm.apply_map(cells, total.encoder(spark))) == [6, 15]
    painted = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "obs_idx int, feat_idx int, value double")
    assert in_order(fm.apply_map(painted, mean.decoder(spark))) == [10] * 3 + [20] * 3
    assert sorted(map(tuple, mean.adjacency(spark).collect())) == [(1, 2), (2, 1)]
    assert [r["feature_id"] for r in mean.features(spark).orderBy("feat_idx").collect()] == ["toy-atlas:10", "toy-atlas:20"]
    assert mean.restrict([2]).n_features == 1
    with pytest.raises(ValueError):
        spaces.ParcelSpace(parent, ("10", "20"), members[:3], "toy")


def test_volumes_reconstruct_with_nulls_outside(spark):
    v = spaces.VolumeSpace((2, 2, 1), support=(4, 1))
    vec = spark.createDataFrame([(1, 9.0), (2, 5.0)], "feat_idx int, value double")
    assert values(v.reconstruct(vec)) == [5.0, None, None, 9.0]
    grid = spark.createDataFrame([(i, float(i)) for i in range(1, 5)], "linear long, value double")
    assert values(v.vectorize(grid)) == [4.0, 1.0]
    assert v.restrict([2]).support == (1,)
    with pytest.raises(ValueError):
        spaces.VolumeSpace((2, 2, 1), support=(5,))


def test_surfaces_and_composites(spark):
    s = spaces.SurfaceSpace(("a", "b", "c", "d"), ("L", "L", "R", "R"), ((1, 2, 3),), medial_wall=(4,))
    assert s.n_features == 3 and [r["within"] for r in s.features(spark).orderBy("feat_idx").collect()] == [1, 2, 1]
    assert s.adjacency(spark).count() == 6
    c = spaces.CompositeSpace((("left", s), ("vol", spaces.VolumeSpace((2, 1, 1)))))
    ids = [r["feature_id"] for r in c.features(spark).orderBy("feat_idx").collect()]
    assert ids == ["left::a", "left::b", "left::c", "vol::voxel-1", "vol::voxel-2"]
    one = lambda xs: spark.createDataFrame(list(enumerate(xs, 1)), "feat_idx int, value double")
    assert values(c.pack({"vol": one([70.0, 80.0]), "left": one([10.0, 20.0, 30.0])})) == [10, 20, 30, 70, 80]
    assert c.adjacency(spark).count() == 8 and c.restrict([1, 5]).n_features == 2


def test_bases_invert_their_decoder():
    parent = spaces.VolumeSpace((2, 2, 1))
    d = np.array([[1.0, 0], [0, 1], [1, 1], [0, 2]])
    b = spaces.basis_from_decoder(parent, ["u", "v"], d)
    assert np.allclose(np.array(b.encode) @ d, np.eye(2))
    r = b.restrict([2])
    assert np.allclose(np.array(r.encode) @ d[:, 1:], 1)
    with pytest.raises(ValueError):
        spaces.basis_from_decoder(parent, ["u", "v"], np.c_[d[:, 0], d[:, 0]])


def test_digests_leave_notes_out():
    a, b = spaces.VolumeSpace((2, 2, 2), note={"x": 1}), spaces.VolumeSpace((2, 2, 2))
    assert spaces.compatible(a, b) and not spaces.compatible(a, spaces.VolumeSpace((2, 2, 2), units="cm"))
    assert not spaces.compatible(spaces.IndexSpace(3), spaces.IndexSpace(3))


def test_validity_of_the_fixture(spark):
    flags = {"sub-1": "110101", "sub-2": "100111", "sub-3": "110101"}
    v = validity.from_flags(spark, {k: [c == "1" for c in f] for k, f in flags.items()})
    assert v.n_masks() == 2
    share = lambda df: [r["coverage"] for r in df.orderBy("feat_idx").collect()]
    assert share(v.coverage()) == pytest.approx([1, 2 / 3, 0, 1, 1 / 3, 1])
    obs = spark.createDataFrame([(1, "sub-1"), (2, "sub-1"), (3, "sub-2"), (4, "sub-3"), (5, "sub-3")], "obs_idx long, subject string")
    assert share(v.observation_coverage(obs, "subject")) == pytest.approx([1, 4 / 5, 0, 1, 1 / 5, 1])
    cells = spark.createDataFrame([(o, f, float(f)) for o in range(1, 6) for f in range(1, 7)], "obs_idx long, feat_idx int, value double")
    got = {(r["obs_idx"], r["feat_idx"]): r["value"] for r in v.masked(cells, obs, "subject").collect()}
    assert len(got) == 30 and all((got[o, f] is not None) == (flags[s][f - 1] == "1") for o, s in ((1, "sub-1"), (3, "sub-2")) for f in range(1, 7))
    with pytest.raises(PySparkException):
        v.of_observations(spark.createDataFrame([(1, "nobody")], "obs_idx long, subject string"), "subject").collect()
    same = validity.from_long(v.matrix())
    assert same.n_masks() == 2 and share(same.coverage()) == pytest.approx(share(v.coverage()))
    assert validity.combined(v.matrix()).where("valid").count() == 3


def frame_of(spark, rows, schema, id, relations, entities):
    one = spaces.IndexSpace(1, namespace="none")
    return Frame({}, axes.Axis(spark.createDataFrame(rows, schema), id), axes.Axis(one.features(spark), "feature_id"), one, entities, relations)


def test_study_filters_cascade(spark):
    subject = ent.Entity("subject", spark.createDataFrame([("s1", 60.0), ("s2", 70.0)], "subject_id string, age double"), "subject_id")
    key = {"subject": ent.KeyRelation("subject_id")}
    bold = frame_of(spark, [(f"bold-{i}", s) for i, s in ((1, "s1"), (2, "s1"), (3, "s2"), (4, "s2"))], "obs_id string, subject_id string", "obs_id", key, {"subject": subject})
    other = frame_of(spark, [("x",)], "obs_id string", "obs_id", {}, {})
    pairs = spark.createDataFrame([("beta-1", "bold-1"), ("beta-2", "bold-3"), ("beta-3", "bold-4")], "from_id string, to_id string")
    events = study.Events(spark.createDataFrame([("e1", "r1", 0.0, 1.0)], "event_id string, run_id string, onset double, duration double")).validate()
    s = study.Study({"bold": bold, "other": other}, {"subject": subject}, {"l": study.Link("betas", "bold", "derived_from", pairs)}, {"events": events}).validate()
    got = s.filter_entities("subject", F.col("age") >= 65)
    assert got.frames["bold"].observations.count() == 2 and got.frames["other"].observations.count() == 1
    assert sorted(r["from_id"] for r in got.links["l"].pairs.collect()) == ["beta-2", "beta-3"] and got.tables["events"].table.count() == 1
    with pytest.raises(PySparkException):
        s.filter_entities("subject", F.lit(None).cast("boolean")).frames["bold"].observations.count()
    wrong = ent.Entity("subject", subject.table.withColumn("age", F.lit(1.0)), "subject_id")
    with pytest.raises(ent.BrokenRelation):
        study.Study({"bold": bold}, {"subject": wrong}).validate()
    with pytest.raises(axes.InvalidAxis):
        study.Events(spark.createDataFrame([("e", -1.0, 1.0)], "event_id string, onset double, duration double")).validate()
    with pytest.raises(axes.InvalidAxis):
        study.Collection({"a": bold, "b": other})
    assert study.Collection({"a": bold, "b": bold}).common_space()


def test_subject_verbs(spark):
    g = spark.createDataFrame([(f"sub-0{i}", 30 + i) for i in range(1, 4)], "sub string, age int")
    assert groups.filter_subjects(g, F.col("age") > 31).count() == 2
    m = groups.mutate_subjects(g, old=F.col("age") > 31, cohort=F.when(F.col("old"), "older").otherwise("younger"))
    assert [r["cohort"] for r in m.orderBy("sub").collect()] == ["younger", "older", "older"]
    y = spark.createDataFrame([("sub-01", "a"), ("sub-01", "b")], "sub string, site string")
    assert groups.left_join_subjects(g, y, "sub").count() == 4
    with pytest.raises(PySparkException):
        groups.filter_subjects(g, F.when(F.col("age") > 31, True)).count()
    assert groups.sample_subjects(g, 2, 1, id="sub").count() == 2 and groups.sample_subjects(g, 5, 1, id="sub", replace=True).count() == 5
    assert [r["sub"] for r in groups.iterate(g.withColumn("o", F.when(F.col("age") != 31, -F.col("age"))), "o")] == ["sub-03", "sub-02", "sub-01"]

    def f(pdf):
        if pdf["age"].iloc[0] == 32:
            raise ValueError("no")
        return pd.DataFrame({"sub": pdf["sub"], "twice": pdf["age"] * 2})

    assert groups.group_map(g, "sub", f, "sub string, twice long", "skip").count() == 2
    with pytest.raises(PySparkException):
        groups.group_map(g, "sub", f, "sub string, twice long").count()
    words = spark.createDataFrame([(i, c) for i, c in enumerate("spark")], "i int, c string")
    assert groups.group_reduce(words, "c", lambda a, b: F.concat(a, b), F.lit(""), "i", 2).first()["c"] == "spark"


def test_selectors(spark):
    v = spaces.VolumeSpace((3, 3, 3))
    assert series.sphere(v, spark, (2, 2, 2), 1).count() == 7
    assert [r["feat_idx"] for r in series.voxels(v, spark, [(1, 1, 1), (9, 9, 9)]).collect()] == [1]
    with pytest.raises(series.NothingSelected):
        series.voxels(v, spark, [(9, 9, 9)])
    with pytest.raises(ValueError):
        series.masked(v, spark, [True] * 5)


def test_latent_scores_project_back(spark):
    r = np.random.default_rng(0)
    scores, loadings = r.normal(size=(6, 3)), r.normal(size=(10, 3))
    long = lambda a, names: spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])], names)
    s, w = long(scores, "t long, k long, score double"), long(loadings, "v long, k long, loading double")
    data = series.reconstruct_latent(s, w)
    back = {(x["t"], x["k"]): x["score"] for x in series.project(data, w).collect()}
    assert all(abs(back[t, k] - scores[t, k]) < 1e-9 for t in range(6) for k in range(3))


def test_images_become_a_source(spark, tmp_path):
    a, b = np.arange(1, 25, dtype=float).reshape(3, 8), np.arange(101, 125, dtype=float).reshape(3, 8)
    paths = [str(tmp_path / f"sub-01_task-memory_run-{i}_bold.nii") for i in (1, 2)]
    for p, x in zip(paths, (a, b), strict=True):
        nifti.write_nifti(p, x, (2, 2, 2))
    src, space = nifti.nifti_source(spark, paths, [2, 3, 4])
    assert src.shape == (6, 3) and space.n_features == 3
    got = {(r["obs_idx"], r["feat_idx"]): r["value"] for r in src.long().collect()}
    want = np.r_[a, b][:, 1:4]
    assert all(got[i + 1, j + 1] == want[i, j] for i in range(6) for j in range(3))
    found = bids.scans(spark, str(tmp_path), "01", task="memory")
    assert [r["run"] for r in found.collect()] == ["1", "2"]
    with pytest.raises(bids.NoSingleMatch):
        bids.scans(spark, str(tmp_path), "02")
    with pytest.raises(ValueError):
        nifti.parse_header(b"\0" * 400)


def bids_study(root, runs=(1, 2), space="MNI"):
    x = {}
    for i in runs:
        name = f"sub-01_task-memory_run-{i}_space-{space}"
        folder = root / "derivatives" / "sub-01" / "func"
        folder.mkdir(parents=True, exist_ok=True)
        x[i] = np.arange(100 * i, 100 * i + 8 * (2 + i), dtype=float).reshape(2 + i, 8)
        nifti.write_nifti(str(folder / f"{name}_desc-preproc_bold.nii"), x[i], (2, 2, 2))
        flags = np.ones((1, 8))
        flags[0, i] = 0
        nifti.write_nifti(str(folder / f"{name}_desc-brain_mask.nii"), flags, (2, 2, 2))
        nifti.write_nifti(str(folder / f"{name}_label-GM_mask.nii"), np.zeros((1, 8)), (2, 2, 2))
        raw = root / "sub-01" / "func"
        raw.mkdir(parents=True, exist_ok=True)
        (raw / f"sub-01_task-memory_run-0{i}_events.tsv").write_text("onset\tduration\ttrial_type\n0.5\t1\tface\n2.5\tn/a\tscene\n")
    return x


def test_a_study_folder_becomes_a_frame(spark, tmp_path):
    x = bids_study(tmp_path)
    f = bids.read_bold(spark, str(tmp_path), "sub-01", task="memory").validate()
    assert f.space.support == (1, 4, 5, 6, 7, 8) and f.space.template == "MNI"
    got = f.collect()
    assert np.allclose(got.to_numpy(), np.r_[x[1], x[2]][:, [0, 3, 4, 5, 6, 7]])
    scan = "derivatives/sub-01/func/sub-01_task-memory_run-1_space-MNI_desc-preproc_bold"
    assert got.index[0] == f"{scan}::volume-000000" and len(got) == 7
    second = f.filter_obs(F.col("`run.run_id`") == "run-2")
    assert second.collect().shape == (4, 6)
    events = f.tables["events"].orderBy("event_id").collect()
    assert [(r["event_id"][-14:], r["scan_id"][-33:-28], r["trial_type"]) for r in events] == [("::event-000000", "run-1", "face"), ("::event-000001", "run-1", "scene"), ("::event-000000", "run-2", "face"), ("::event-000001", "run-2", "scene")] or len(events) == 4
    assert {r["scan_id"].split("_")[2] for r in events} == {"run-1", "run-2"}
    whole = bids.read_bold(spark, str(tmp_path), "01", run="1", mask=spaces.VolumeSpace((2, 2, 2)), events=False)
    assert whole.collect().shape == (3, 8) and not whole.tables
    mask = str(tmp_path / "derivatives" / "sub-01" / "func" / "sub-01_task-memory_run-1_space-MNI_desc-brain_mask.nii")
    assert bids.read_bold(spark, str(tmp_path), "01", mask=mask).space.n_features == 7
    bids_study(tmp_path, (1,), "native2")
    with pytest.raises(bids.NoSingleMatch):
        bids.read_bold(spark, str(tmp_path), "01")
    with pytest.raises(bids.NoSingleMatch):
        bids.read_bold(spark, str(tmp_path), "09")


def test_matching_tells_acquisitions_and_directions_apart(spark):
    names = lambda *xs: bids.parsed(spark.createDataFrame([(x,) for x in xs], "path string"))
    scans_ = names("/d/sub-1_task-a_acq-x_dir-AP_run-1_bold.nii", "/d/sub-1_task-a_acq-y_dir-AP_run-1_bold.nii")
    masks = names("/d/sub-1_task-a_acq-x_dir-AP_mask.nii", "/d/sub-1_task-a_acq-y_dir-AP_mask.nii", "/d/sub-1_task-a_acq-y_dir-PA_mask.nii")
    got = {r["path"][20]: r["match"] for r in bids.best_match(scans_, masks).collect()}
    assert got == {"x": "/d/sub-1_task-a_acq-x_dir-AP_mask.nii", "y": "/d/sub-1_task-a_acq-y_dir-AP_mask.nii"}


def test_names_of_scans_and_labels(spark):
    files = spark.createDataFrame([("/d/sub-01_ses-a_task-x_acq-hi_run-02_desc-preproc_bold.nii.gz",), ("/d/sub-02_bold.nii",)], "path string")
    got = {r["subid"]: r for r in bids.scan_name(bids.parsed(files)).collect()}
    assert got["01"]["scan_name"] == "sub-01_ses-a_task-x_run-02" and got["02"]["scan_name"] == "sub-02"
    assert (got["01"]["acq"], got["01"]["dir"], got["01"]["desc"], got["01"]["kind"], got["02"]["kind"]) == ("hi", None, "preproc", "bold", "bold")


def test_made_identifiers_stay_as_they_were_made(spark):
    a = axes.axis(spark.range(50).select(F.col("id").alias("v")), prefix="obs")
    first, again = ({r["v"]: (r["obs_id"], r["idx"]) for r in a.table.collect()} for _ in range(2))
    assert first == again and len({i for i, _ in first.values()}) == 50 and sorted(n for _, n in first.values()) == list(range(1, 51))


def test_samples_are_exact_or_refused(spark):
    people = spark.createDataFrame([(f"s{i}", "ab"[i % 3 == 0]) for i in range(30)], "subject_id string, site string")
    assert groups.sample_subjects(people, 7, 1).count() == 7 and groups.sample_subjects(people, 50, 1, replace=True).count() == 50
    by = {r["site"]: r["n"] for r in groups.sample_subjects(people, {"a": 3, "b": 15}, 1, "site", replace=True).groupBy("site").agg(F.count("*").alias("n")).collect()}
    assert by == {"a": 3, "b": 15}
    for bad in (lambda: groups.sample_subjects(people, 31, 1), lambda: groups.sample_subjects(people, {"a": 3, "b": 11}, 1, "site"), lambda: groups.sample_subjects(people, {"c": 1}, 1, "site", replace=True)):
        with pytest.raises(ValueError):
            bad()


def test_folds_keep_the_order(spark):
    words = spark.createDataFrame([(i, f"w{i};") for i in range(3000)], "i long, w string").repartition(7)
    got = groups.group_reduce(words, "w", lambda a, b: F.concat(a, b), F.lit(""), "i", run_rows=20).first()["w"]
    assert got == "".join(f"w{i};" for i in range(3000))
    assert groups.group_reduce(words.limit(0), "w", lambda a, b: F.concat(a, b), F.lit("none"), "i").first()["w"] == "none"


def test_a_changed_image_is_refused(spark, tmp_path):
    import os

    p = str(tmp_path / "sub-1_bold.nii")
    nifti.write_nifti(p, np.ones((2, 8)), (2, 2, 2))
    src, _ = nifti.nifti_source(spark, [p])
    os.utime(p, (1, 1))
    with pytest.raises(PySparkException):
        src.long().count()


def test_subjects_reach_python_in_batches_as_they_would_alone(spark):
    """Against Spark's own grouping, with subjects over several batches, null ids, and nulls of whole numbers and booleans in some subjects only."""
    big = 2**53 + 1
    rows = [(None if i % 11 == 0 else float("nan") if i % 11 == 1 else i % 11 - 3.0, big + i if i % 7 or i % 11 < 5 else None, i % 2 == 0 if i % 5 else None, f"t{i}" if i % 3 else None, i) for i in range(120)]
    df = spark.createDataFrame(rows, "sub double, a long, bc boolean, __first string, __null_0 int").withColumn("at", F.timestamp_seconds("__null_0"))

    def f(pdf):
        if pdf["sub"].iloc[0] == 2:
            return None
        pdf = pdf.sort_values("__null_0")
        cells = [[str(t), *("null" if pd.isna(x) else repr(x) for x in pdf[c])] for c, t in pdf.dtypes.items()]
        return pd.DataFrame({"said": [str(cells)], "n": [len(pdf)]})

    def alone(pdf):
        out = f(pdf)
        return pd.DataFrame(columns=["said", "n"]) if out is None else out

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = groups.group_map(df, "sub", f, "said string, n long")
        want = df.groupBy("sub").applyInPandas(alone, "said string, n long")
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() == 10
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
        assert groups.group_map(df.where("at is null"), "sub", f, "said string, n long").count() == 0
        assert groups.group_map(df.limit(1), "sub", lambda p: pd.DataFrame([[1, "x"]]), "n long, s string").first()["s"] == "x"
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_task_on_edges_groups_no_more_for_more_edges(spark):
    """Peak memory of the tasks that look for pairs that repeat, in a session of one shuffle partition."""

    def largest(n):
        rows = spark.range(n).selectExpr("id div 3 as from_id", "id % 3 as to_id", "1.0D as weight").union(spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "from_id long, to_id long, weight double"))
        known = {x.stageId() for x in stages()}
        assert ent.SparseRelation(rows, "x", "y").problems() == 2
        return max(peak(x) for x in stages() if x.stageId() not in known)

    store = spark._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    def peak(stage):
        tasks = store.taskList(stage.stageId(), stage.attemptId(), 10_000)
        metrics = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
        return max([0, *(m.get().peakExecutionMemory() for m in metrics if m.isDefined())])

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert largest(2_000_000) < 150_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_edges_need_finite_weights(spark):
    rows = [("a", "b", 1.0), ("a", "c", float("inf")), ("b", "c", None), ("c", "d", float("nan")), (None, "d", 1.0)]
    assert ent.SparseRelation(spark.createDataFrame(rows, "from_id string, to_id string, weight double"), "x", "y").problems() == 4


def test_kinds_that_come_with_the_package(spark):
    registry.register_builtin()
    assert set(registry.names()) >= {"frame", "latent", "matrix", "nifti", "study"}
    assert registry.create("matrix", spark, [[1.0, 2.0]]).shape == (1, 2)
    for n in registry.names():
        registry.unregister(n)


def test_masks_are_combined_strictly_if_asked(spark):
    rows = [(e, i, not (e == "b" and i == 1) and not (e == "c" and i in (2, 3))) for e in "abc" for i in range(1, 41)]
    df = spark.createDataFrame(rows, "entity_id string, feat_idx int, valid boolean")
    assert validity.combined(df).where("valid").count() == 37
    assert validity.combined(df, "intersect").where("valid").count() == 37
    for bad in (("intersect", None, 0.97), ("identical",)):
        with pytest.raises(PySparkException):
            validity.combined(df, *bad).count()


def test_best_match_uses_keys_both_sides_have(spark):
    names = lambda *xs: bids.parsed(spark.createDataFrame([(x,) for x in xs], "path string"))
    scans_ = names("/d/sub-1_task-a_run-01_bold.nii", "/d/sub-1_task-b_run-1_bold.nii")
    masks = names("/d/sub-1_mask.nii", "/d/sub-1_task-a_run-1_mask.nii", "/d/sub-2_mask.nii")
    got = {r["path"]: r["match"] for r in bids.best_match(scans_, masks).collect()}
    assert got == {"/d/sub-1_task-a_run-01_bold.nii": "/d/sub-1_task-a_run-1_mask.nii", "/d/sub-1_task-b_run-1_bold.nii": "/d/sub-1_mask.nii"}
    with pytest.raises(PySparkException):
        bids.best_match(scans_, names("/d/sub-2_mask.nii")).collect()


def test_registry():
    registry.register("toy", lambda n: n, validate=lambda x: x > 0)
    assert registry.create("toy", 3) == 3 and "toy" in registry.names()
    with pytest.raises(ValueError):
        registry.create("toy", -1)
    with pytest.raises(ValueError):
        registry.register("toy", int)
    assert registry.unregister("toy") and not registry.unregister("toy")
    with pytest.raises(KeyError):
        registry.create("toy")
