"""Scans, masks and events of a study folder, matched by the entities in their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import canonical_digest
from ..functions.storage import written
from ..operators.axis import Axis
from ..operators.entities import Entity, KeyRelation
from ..operators.spaces import VolumeSpace
from ..plans.frame import Assay, Frame
from .nifti import headers, nifti_source

#: Entities of a file name, and the column of each.
ENTITIES = {"sub": "subid", "ses": "session", "task": "task", "acq": "acq", "dir": "dir", "run": "run", "echo": "echo", "space": "space", "res": "res", "label": "label", "desc": "desc"}
NUMBERS = ("run", "echo")
MATCHED = ("subid", "session", "task", "run", "space", "res", "acq", "dir")
EVENT_KEYS = ("subid", "session", "task", "run")
BRAIN = ("brain", "brainmask")


class NoSingleMatch(ValueError):
    """A scan or event that fits none or more than one."""


def parsed(files: DataFrame, path: str = "path") -> DataFrame:
    """Entity columns of file names, null where absent, and the kind (the last part of the name)."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    value = lambda e: F.nullif(F.regexp_extract(name, rf"(?:^|_){e}-([^_.]+)", 1), F.lit(""))
    return files.withColumns({**{c: value(e) for e, c in ENTITIES.items()}, "kind": F.regexp_extract(name, r"_([A-Za-z0-9]+)\.[^/]*$", 1)})


def _same(a: Column, b: Column, number: bool) -> Column:
    if number:  # whole numbers without leading zeros; other labels as they are
        a, b = (F.when(x.rlike(r"^[0-9]+$"), F.regexp_replace(x, r"^0+(?=[0-9])", "")).otherwise(x) for x in (a, b))
    return a.isNull() | b.isNull() | (a == b)


def matches(left: DataFrame, right: DataFrame, keys: Sequence[str] = MATCHED) -> DataFrame:
    """Pairs whose keys agree wherever both sides have them, with how many do; subject, which all have, makes it an equi-join."""
    cond = F.col("l.subid") == F.col("r.subid")
    score = F.lit(0)
    for k in keys:
        cond = cond & _same(F.col(f"l.{k}"), F.col(f"r.{k}"), k in NUMBERS)
        score = score + (F.col(f"l.{k}").isNotNull() & F.col(f"r.{k}").isNotNull()).cast("int")
    return left.alias("l").join(right.alias("r"), cond).select(F.col("l.path").alias("path"), F.col("r.path").alias("match"), score.alias("score"))


def best_match(left: DataFrame, right: DataFrame, keys: Sequence[str] = MATCHED) -> DataFrame:
    """(path, match): of the fitting candidates the one that agrees in most keys; none or a tie is an error."""
    pairs = left.select("path").join(matches(left, right, keys), "path", "left")
    ranked = pairs.withColumn("rank", F.rank().over(Window.partitionBy("path").orderBy(F.desc_nulls_last("score")))).where("rank = 1")
    one = ranked.groupBy("path").agg(F.count("match").alias("n"), F.min("match").alias("match"))
    return one.select("path", F.when(F.col("n") == 1, F.col("match")).otherwise(F.raise_error(F.concat(F.col("n").cast("string"), F.lit(" best matches for "), F.col("path")))).alias("match"))


def scans(spark: SparkSession, root: str, subject: str, task: str | None = None, session: str | None = None, run: str | None = None, space: str | None = None) -> DataFrame:
    """(path, scan_id, entities) of the subject's images that fit exactly, in order of scan_id; more than one space is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*_bold.nii*").load(root).select("path")
    found = parsed(files).where(F.col("subid") == subject)
    for c, v in (("task", task), ("session", session), ("run", run), ("space", space)):
        if v is not None:
            found = found.where(F.col(c) == v)
    kinds = found.select("space", "res", "echo").distinct().limit(3).collect()
    if not kinds:
        raise NoSingleMatch("no image fits")
    if len({(k["space"], k["res"]) for k in kinds}) > 1 or any(k["echo"] is not None for k in kinds):
        raise NoSingleMatch("images of one space and resolution, without echoes, are needed")
    return found.withColumn("scan_id", F.regexp_extract("path", r"([^/]*)$", 1)).orderBy("scan_id")


def expand_observations(scans_with_times: DataFrame) -> DataFrame:
    """A row for each volume: `<scan>::volume-%06d` from 0, volume_index from 1, run_time in seconds."""
    rows = scans_with_times.select("*", F.explode(F.sequence(F.lit(1), F.col("n_times"))).alias("volume_index"))
    return rows.withColumns({"obs_id": F.format_string("%s::volume-%06d", "scan_id", F.col("volume_index") - 1), "run_time": (F.col("volume_index") - 1) * F.col("tr")})


def event_ids(rows: DataFrame, file: str = "file", order: str = "input_pos") -> DataFrame:
    """`<file>::event-%06d`, numbered within its file from 0."""
    n = F.row_number().over(Window.partitionBy(file).orderBy(order)) - 1
    return rows.withColumn("event_id", F.format_string("%s::event-%06d", file, n))


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, relative_path) of files below ``root``; listed, not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    return files.withColumn("relative_path", F.substring_index("path", root.rstrip("/").split(":", 1)[-1] + "/", -1))


def manifest(spark: SparkSession, root: str, subject: str, task: str | None = None, session: str | None = None, run: str | None = None, space: str | None = None) -> DataFrame:
    """One row a preprocessed image of the subject: scan_id (its path below the root, without the ending), the entities, their labels, n_times and tr.

    Selectors match exactly, with or without their prefix. More than one space
    or resolution, or any echo, is an error.
    """
    plain = lambda e, v: v.removeprefix(f"{e}-")
    found = parsed(_files(spark, root, "*_bold.nii*")).where((F.col("subid") == plain("sub", subject)) & (F.coalesce("desc", F.lit("preproc")) == "preproc"))
    for e, c, v in (("task", "task", task), ("ses", "session", session), ("run", "run", run), ("space", "space", space)):
        if v is not None:
            found = found.where(F.col(c) == plain(e, v))
    kinds = found.select("space", "res", "echo").distinct().collect()
    if not kinds:
        raise NoSingleMatch("no image fits")
    if len({(k["space"], k["res"]) for k in kinds}) > 1 or any(k["echo"] is not None for k in kinds):
        raise NoSingleMatch("images of one space and resolution, without echoes, are needed")
    label = lambda e, c: F.concat(F.lit(f"{e}-"), F.coalesce(c, F.lit("none")))
    paths = [r["path"] for r in found.select("path").collect()]
    heads = headers(spark, paths).select("path", "n_times", "tr", "dims", "affine")
    rows = found.join(heads, "path").withColumns(
        {"scan_id": F.regexp_replace("relative_path", r"(?i)\.nii(\.gz)?$", ""), "subject_id": label("sub", "subid"), "session_id": label("ses", "session"), "task_id": label("task", "task"), "run_id": label("run", "run")}
    )
    checked = F.when((F.col("n_times") > 0) & (F.col("tr") > 0) & (F.col("tr") < float("inf")), F.col("tr")).otherwise(F.raise_error(F.concat(F.lit("no volumes or no repetition time in "), "path")).cast("double"))
    return rows.withColumn("tr", checked)


def brain_masks(spark: SparkSession, root: str, subject: str, native: bool) -> DataFrame:
    """Brain masks of the subject; where images have no space, masks without one."""
    masks = parsed(_files(spark, root, "*mask.nii*")).where(F.col("subid") == subject.removeprefix("sub-"))
    plain = F.col("relative_path").rlike(r"(?i)_(brain_)?mask\.nii(\.gz)?$") & F.col("desc").isNull() & F.col("label").isNull()
    brain = F.lower("desc").isin(*BRAIN) | (F.lower("kind") == "brainmask") | plain
    return masks.where(F.coalesce(brain, F.lit(False)) & (F.col("space").isNull() if native else F.lit(True)))


def common_support(spark: SparkSession, scans_table: DataFrame, masks: DataFrame, dims: Sequence[int], affine: Sequence[float]) -> list[int]:
    """Linear indices that every image's best mask has; masks must have the images' grid. As many as the grid at most, which a space holds anyway."""
    chosen = [r["match"] for r in best_match(scans_table, masks).select("match").distinct().collect()]
    for r in headers(spark, chosen).collect():
        if list(r["dims"]) != list(dims) or max(abs(a - b) for a, b in zip(r["affine"], affine, strict=True)) > 1e-7:
            raise NoSingleMatch(f"{r['path']} is on another grid")
    cells = nifti_source(spark, chosen)[0].long()
    support = cells.groupBy("feat_idx").agg(F.bool_and(F.col("value") != 0).alias("in")).where("in")
    found = sorted(r["feat_idx"] for r in support.select("feat_idx").collect())
    if not found:
        raise NoSingleMatch("the masks have no cell in common")
    return found


def event_table(spark: SparkSession, root: str, scans_table: DataFrame) -> DataFrame | None:
    """Rows of the events files, each with the one scan that its file fits and an event_id numbered within its file; None without files."""
    files = parsed(_files(spark, root, "*_events.tsv"))
    fit = matches(files, scans_table, EVENT_KEYS).join(scans_table.select(F.col("path").alias("match"), "scan_id"), "match")
    known = files.select("path", "relative_path").join(fit.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("scan_id").alias("scan_id")), "path")
    paths = [r["path"] for r in known.select("path").collect()]
    if not paths:
        return None
    rows = spark.read.option("sep", "\t").option("header", "true").option("inferSchema", "true").option("nullValue", "n/a").csv(paths)
    rows = written(rows.withColumns({"path": F.input_file_name(), "input_pos": F.monotonically_increasing_id()}))
    place = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    one = F.when(F.col("n") == 1, F.col("scan_id")).otherwise(F.raise_error(F.concat("n", F.lit(" images fit "), "relative_path")))
    of = known.select(place("path").alias("__at"), F.col("relative_path").alias("file"), one.alias("scan_id"))
    placed = rows.withColumn("__at", place("path")).join(F.broadcast(of), "__at").drop("__at", "path")
    return event_ids(placed).drop("input_pos")


def read_bold(
    spark: SparkSession, root: str, subject: str, task: str | None = None, session: str | None = None, run: str | None = None, space: str | None = None,
    mask: str | VolumeSpace = "intersection", events: bool = True,
) -> Frame:
    """One subject's preprocessed images as a frame with the array ``signal``; headers and masks are read, images are not.

    ``mask``: "intersection" of the images' brain masks, the path of a mask, or
    a volume space on the images' grid. Observations are the volumes, in order
    of scan_id; they lead to the run and the subject. Events become a keyed table.
    """
    scans_table = written(manifest(spark, root, subject, task, session, run, space))
    rows = scans_table.orderBy("scan_id").select("path", "scan_id", "n_times", "space", "dims", "affine").collect()
    dims, affine, template = tuple(rows[0]["dims"]), tuple(rows[0]["affine"]), rows[0]["space"] or "native"
    if isinstance(mask, VolumeSpace):
        if mask.dim != dims or max(abs(a - b) for a, b in zip(mask.affine, affine, strict=True)) > 1e-7 or mask.template not in (None, template):
            raise NoSingleMatch("the space given is on another grid or of another template")
        support, policy = list(mask.support or range(1, dims[0] * dims[1] * dims[2] + 1)), "explicit-space"
    elif mask == "intersection":
        support, policy = common_support(spark, scans_table, brain_masks(spark, root, subject, template == "native"), dims, affine), "intersection"
    else:
        one = scans_table.limit(1).select("path", *MATCHED)
        support, policy = common_support(spark, one, one.withColumn("path", F.lit(mask)), dims, affine), "explicit-path"
    source, _ = nifti_source(spark, [r["path"] for r in rows], support)
    domain = VolumeSpace(dims, affine, tuple(support), template, note={"mask_policy": policy})
    starts, n = [], 0
    for r in rows:
        starts.append((r["scan_id"], n))
        n += r["n_times"]
    before = F.broadcast(spark.createDataFrame(starts, "scan_id string, __before long"))
    volumes = expand_observations(scans_table.select("scan_id", "subject_id", "session_id", "task_id", "run_id", "n_times", "tr").join(before, "scan_id"))
    table = volumes.withColumn("idx", F.col("__before") + F.col("volume_index")).drop("__before", "n_times")
    runs = scans_table.select("scan_id", "subject_id", "session_id", "task_id", "run_id", "relative_path", F.col("n_times").alias("n_volume"), "tr")
    features = domain.features(spark).withColumn("idx", F.col("feat_idx").cast("long"))
    found = event_table(spark, root, scans_table) if events else None
    return Frame(
        {"signal": Assay(source, "signal")},
        Axis(table, "obs_id"),
        Axis(features, "feature_id"),
        domain,
        {"subject": Entity("subject", runs.select("subject_id").distinct(), "subject_id"), "run": Entity("run", runs, "scan_id")},
        {"observation_run": KeyRelation("scan_id", "run"), "run_subject": KeyRelation("subject_id", "subject", "run")},
        {} if found is None else {"events": found},
        "signal",
        (canonical_digest(["read_bold", sorted(r["scan_id"] for r in rows), policy, template]),),
    )


def scan_name(scans_table: DataFrame) -> DataFrame:
    part = lambda e, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{e}-"), F.col(c)))
    return scans_table.withColumn("scan_name", F.concat_ws("_", part("sub", "subid"), part("ses", "session"), part("task", "task"), part("run", "run")))
