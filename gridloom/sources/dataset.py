"""Time by voxel datasets: runs, a mask, events and a matrix as long cells."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.source import ArraySource, memory_source, row_sharded

if TYPE_CHECKING:
    from ..plans.frame import Frame


@dataclass(frozen=True)
class Dataset:
    source: ArraySource
    run_lengths: tuple[int, ...]
    tr: float
    events: DataFrame | None = None
    mask: tuple[bool, ...] | None = None
    censor: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        if sum(self.run_lengths) != self.source.shape[0] or self.tr <= 0:
            raise ValueError("run lengths must sum to the time points, TR must be positive")
        if self.mask is not None and sum(self.mask) != self.source.shape[1]:
            raise ValueError("the mask must have a true cell for each feature")

    def runs(self) -> DataFrame:
        spark, rows, n = self.source.pieces.sparkSession, [], 0
        for i, length in enumerate(self.run_lengths, 1):
            rows.append((i, n + 1, n + length, length, self.tr, length * self.tr))
            n += length
        return spark.createDataFrame(rows, "run_id int, start long, end long, length long, TR double, duration double")

    def times(self) -> DataFrame:
        """(obs_idx, run_id, timepoint, censor) of every time point."""
        t = self.runs().select("run_id", "start", F.explode(F.sequence("start", "end")).alias("obs_idx")).select("obs_idx", "run_id", (F.col("obs_idx") - F.col("start") + 1).alias("timepoint"))
        if self.censor is None:
            return t.withColumn("censor", F.lit(0))
        c = t.sparkSession.createDataFrame(list(enumerate(self.censor, 1)), "obs_idx long, censor int")
        return t.join(c, "obs_idx")

    def cells(self) -> DataFrame:
        return self.source.long().join(self.times(), "obs_idx")

    def condition_counts(self, by: str = "trial_type") -> DataFrame:
        return self.events.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def mem_dataset(spark: SparkSession, scans: Sequence[np.ndarray], mask: np.ndarray, tr: float, run_lengths: Sequence[int] | None = None, events: DataFrame | None = None, censor: Sequence[int] | None = None) -> Dataset:
    """A dataset of volumes that the caller holds, (x, y, z, time) each and one a run, over the cells of a mask (x, y, z), the first axis fastest."""
    mask = np.asarray(mask) != 0
    if mask.ndim != 3 or not len(scans) or any(np.ndim(s) != 4 or np.shape(s)[:3] != mask.shape for s in scans):
        raise ValueError("scans have four dimensions, the first three those of the mask")
    lengths = tuple(int(np.shape(s)[3]) for s in scans)
    own = lengths if run_lengths is None else tuple(run_lengths)
    if sum(own) != sum(lengths):
        raise ValueError("run lengths must sum to the scans' time points")
    flat = mask.ravel(order="F")
    rows = np.concatenate([np.asarray(s, float).reshape(-1, np.shape(s)[3], order="F")[flat].T for s in scans])
    return Dataset(memory_source(spark, rows.tolist()), own, tr, events, (True,) * int(flat.sum()), None if censor is None else tuple(censor))


def file_dataset(spark: SparkSession, paths: Sequence[str], tr: float | None = None, mask: Sequence[bool] | None = None, run_lengths: Sequence[int] | None = None, events: DataFrame | None = None, censor: Sequence[int] | None = None) -> Dataset:
    """A dataset of image files, one a run. Run lengths are the files' own; where they are given, each must agree with its file, or all of them with the sum of all files. Without ``tr`` it is the files' own, which must agree. No image is read."""
    from .nifti import headers, nifti_source

    found = {r["path"].split(":", 1)[-1].lstrip("/"): r for r in headers(spark, paths).collect()}
    rows = [found[p.split(":", 1)[-1].lstrip("/")] for p in paths]
    lengths = tuple(r["n_times"] for r in rows)
    own = lengths if run_lengths is None else tuple(run_lengths)
    if sum(own) != sum(lengths) or len(own) == len(lengths) and own != lengths:
        raise ValueError(f"run lengths {own} are not those of the files, {lengths}")
    if tr is None:
        if len({round(r["tr"], 6) for r in rows}) > 1:
            raise ValueError("the files differ in TR: give it")
        tr = rows[0]["tr"]
    cells = None if mask is None else [i for i, m in enumerate(mask, 1) if m]
    source, _ = nifti_source(spark, paths, cells)
    return Dataset(source, own, tr, events, (True,) * source.shape[1], None if censor is None else tuple(censor))


def described(d: Dataset) -> dict[str, object]:
    """What a dataset is, without reading a cell."""
    return {"n_runs": len(d.run_lengths), "run_lengths": list(d.run_lengths), "n_timepoints": d.source.shape[0], "n_features": d.source.shape[1], "TR": d.tr, "duration": d.tr * d.source.shape[0], "censored": sum(d.censor or ()), "event_columns": [] if d.events is None else d.events.columns, "dtype": d.source.dtype}


def with_row_data(d: Dataset, row_data: DataFrame, by: Sequence[str] = ("obs_idx",)) -> DataFrame:
    """The dataset's long cells with metadata of their rows, found by their index or by run and time point; rows without any keep nulls."""
    return d.cells().join(row_data, list(by), "left")


def as_frame(x: object, observation_prefix: str = "obs") -> Frame:
    """A frame of whatever holds an array: a frame as it is, a dataset with its runs and time points, or an array by itself."""
    from ..operators.axis import Axis
    from ..operators.spaces import IndexSpace
    from ..plans.frame import Assay, Frame

    if isinstance(x, Frame):
        return x
    if not isinstance(x, (Dataset, ArraySource)):
        raise TypeError(f"{type(x).__name__} holds no array that a frame could be made of")
    source = x.source if isinstance(x, Dataset) else x
    spark = source.pieces.sparkSession
    space = IndexSpace(source.shape[1], namespace=source.fingerprint)
    rows = x.times() if isinstance(x, Dataset) else spark.range(1, source.shape[0] + 1).select(F.col("id").alias("obs_idx"))
    named = rows.withColumnRenamed("obs_idx", "idx").withColumn("obs_id", F.concat(F.lit(f"{observation_prefix}-"), F.col("idx")))
    tables = {"events": x.events} if isinstance(x, Dataset) and x.events is not None else {}
    return Frame({"signal": Assay(source, "signal")}, Axis(named, "obs_id"), Axis(space.features(spark).withColumn("idx", F.col("feat_idx").cast("long")), "feature_id"), space, {}, {}, tables)


def study(datasets: Sequence[Dataset], subjects: Sequence[str]) -> tuple[Dataset, DataFrame]:
    """Subjects one below the other, with (subject_id, start, end); TR must agree. Censors are kept.

    Events are told apart by subject. Those without a run_id get 1 where the
    subject has one run, null and a warning where it has several.
    """
    if len({d.tr for d in datasets}) != 1 or len(set(subjects)) != len(datasets):
        raise ValueError("subjects need one TR and names of their own")
    src = row_sharded([d.source for d in datasets], list(subjects))
    events = None
    for d, s in zip(datasets, subjects, strict=True):
        if d.events is not None:
            if "run_id" not in d.events.columns and len(d.run_lengths) > 1:
                warnings.warn(f"events of {s} name no run, of which there are {len(d.run_lengths)}", stacklevel=2)
            run = F.col("run_id") if "run_id" in d.events.columns else F.lit(1 if len(d.run_lengths) == 1 else None).cast("int")
            own = d.events.withColumns({"run_id": run, "subject_id": F.lit(s)})
            events = own if events is None else events.unionByName(own, allowMissingColumns=True)
    censor = tuple(c for d in datasets for c in (d.censor or (0,) * d.source.shape[0])) if any(d.censor for d in datasets) else None
    return Dataset(src, tuple(n for d in datasets for n in d.run_lengths), datasets[0].tr, events, None, censor), src.shards.select(F.col("shard_id").alias("subject_id"), "start", "end")


def subject_of(whole: Dataset, spans: DataFrame, subject: str, run_lengths: Sequence[int]) -> Dataset:
    """One subject of a study again, its censor included."""
    s = spans.where(F.col("subject_id") == subject).first()
    own = whole.source.pieces.where(F.col("obs_idx").between(s["start"], s["end"])).withColumn("obs_idx", F.col("obs_idx") - (s["start"] - 1))
    n = s["end"] - s["start"] + 1
    censor = None if whole.censor is None else whole.censor[s["start"] - 1 : s["end"]]
    events = None if whole.events is None else whole.events.where(F.col("subject_id") == subject)
    return Dataset(replace(whole.source, pieces=own, shape=(n, whole.source.shape[1]), shards=None), tuple(run_lengths), whole.tr, events, None, censor)


#: What a configuration has unless it says otherwise, and what it must have.
DEFAULTS = {"cmd_flags": "", "jobs": 1, "base_path": ".", "output_dir": "stat_out"}
REQUIRED = ("scans", "TR", "mask", "run_length", "event_model", "event_table", "block_column", "baseline_model")


def _numbers(text: str) -> list[float] | None:
    """What commas separate, if each part is a number in digits."""
    try:
        return [float(x) for x in text.split(",")] if any(c.isdigit() for c in text) else None
    except ValueError:
        return None


def _value(text: str) -> object:
    """Text in a pair of quotes as it is; else a bracketed list, a truth value, one number or several, or text."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if len(text) > 1 and (text[0], text[-1]) == ("[", "]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    if (found := _numbers(text)) is not None:
        return found[0] if len(found) == 1 else found
    return {"true": True, "false": False}.get(text.lower(), text)


def plain_config(text: str) -> dict[str, object]:
    """Flat YAML or DCF: a key and its value on each line, with : or = between; items behind dashes below a key without a value; # begins a comment line."""
    out: dict[str, object] = {}
    key = ""
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] == "#":
            continue
        dash, _, item = line.partition(" ")
        if dash == "-" and key:
            if not isinstance(out[key], list):
                out[key] = []
            out[key].append(_value(item))
            continue
        at = min((line.find(c) for c in ":=" if c in line), default=-1)
        name = line[:at].rstrip()
        if at > 0 and name.replace("_", "a").isalnum():
            key, value = name, line[at + 1 :].strip()
            out[key] = _value(value) if value else []
    return out


def read_config(text: str, required: Sequence[str] = REQUIRED, defaults: Mapping[str, object] = DEFAULTS, base_path: str | None = None) -> dict[str, object]:
    """A configuration in JSON, flat YAML or DCF over the defaults; missing fields are an error."""
    own = json.loads(text) if text.lstrip().startswith("{") else plain_config(text)
    config = {**defaults, **own, **({} if base_path is None else {"base_path": base_path})}
    if missing := [k for k in required if k not in config]:
        raise ValueError(f"missing {missing}")
    return config


def write_config(config: Mapping[str, object], computed: Sequence[str] = ("design", "class")) -> str:
    """Flat YAML of a configuration, without what was computed."""
    plain = lambda x: ("true" if x else "false") if isinstance(x, bool) else json.dumps(x) if isinstance(x, str) else repr(x)
    lines = []
    for k, v in config.items():
        if k in computed:
            continue
        lines += [f"{k}:", *(f"  - {plain(x)}" for x in v)] if isinstance(v, (list, tuple)) else [f"{k}: {plain(v)}"]
    return "\n".join(lines) + "\n"
