"""Selectors and the slices they give, against plain indexing of small matrices."""

import numpy as np
import pytest

from gridloom.operators import selection as sel
from gridloom.operators import source, spaces
from gridloom.operators.series import NothingSelected

DIM, SUPPORT = (3, 4, 2), (1, 2, 5, 7, 8, 12, 13, 20, 24)
SPACE = spaces.VolumeSpace(DIM, support=SUPPORT)
X = np.arange(1.0, 6 * 9 + 1).reshape(6, 9)
X[2, 4] = np.nan


def resolved(x, spark, space=SPACE):
    return [r["feat_idx"] for r in sel.selector_of(x).resolve(space, spark).orderBy("pos").collect()]


def places():
    """Coordinates of every feature, from 1, the first axis fastest."""
    return np.stack(np.unravel_index(np.array(SUPPORT) - 1, DIM, order="F"), axis=1) + 1


@pytest.fixture(params=[2, 9])
def array(spark, request):
    df = spark.createDataFrame([(i, row) for i, row in enumerate(X.tolist(), 1)], "obs_idx long, values array<double>")
    return source.from_arrays(df, "obs_idx", "values", X.shape, f"small {request.param}", width=request.param)


def test_positions_keep_order_and_repeats(spark):
    assert resolved(None, spark) == list(range(1, 10))
    assert resolved([4, 2, 4], spark) == [4, 2, 4]
    assert resolved(np.array([9, 1]), spark, spaces.IndexSpace(9)) == [9, 1]
    for wrong in ([10], [0], [-1], [1.5]):
        with pytest.raises(IndexError):
            resolved(wrong, spark)
    with pytest.raises(TypeError):
        sel.selector_of("voxels")


def test_coordinates_outside_the_support_are_left_out_and_outside_the_grid_an_error(spark):
    p = places()
    assert resolved(p[[5, 0, 5]], spark) == [6, 1, 6]
    with pytest.warns(UserWarning, match="1 cells"):
        assert resolved(np.array([[3, 1, 1], p[3], p[0]]), spark) == [4, 1]
    with pytest.warns(UserWarning), pytest.raises(NothingSelected):
        resolved(np.array([[3, 1, 1]]), spark)
    for wrong in ([4, 1, 1], [0, 1, 1], [1, 1, 3]):
        with pytest.raises(IndexError):
            resolved(np.array([wrong]), spark)
    with pytest.raises(TypeError):
        resolved(p[:1], spark, spaces.IndexSpace(9))


@pytest.mark.parametrize(("center", "radius"), [((1, 1, 1), 1), ((2, 2.5, 1.5), 1.6), ((3, 4, 2), 10)])
def test_balls(spark, center, radius):
    near = np.sqrt(((places() - center) ** 2).sum(axis=1)) <= radius
    assert resolved(sel.Ball(center, radius), spark) == (np.flatnonzero(near) + 1).tolist()


def test_balls_and_regions_that_meet_nothing(spark):
    with pytest.raises(NothingSelected):
        resolved(sel.Ball((90, 90, 90), 2), spark)
    with pytest.raises(NothingSelected):
        resolved(np.zeros(DIM), spark)
    with pytest.raises(NothingSelected):
        resolved([False] * 9, spark)
    for wrong in (lambda: sel.Ball((1, 1), 2), lambda: sel.Ball((1, 1, 1), 0)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(ValueError):
        resolved(np.zeros((2, 2, 2)), spark)
    with pytest.raises(ValueError):
        resolved([True] * 10, spark)


def test_regions_and_flags(spark):
    cells = np.zeros(DIM)
    cells[1:, :, 0], cells[0, 0, 0] = 2, np.nan
    want = [n for n, (i, _, k) in enumerate(places(), 1) if i > 1 and k == 1]
    assert resolved(cells, spark) == want
    assert resolved((np.nan_to_num(cells) > 0).ravel(order="F"), spark) == want
    assert resolved([n in (2, 9) for n in range(1, 10)], spark) == [2, 9]
    assert resolved([n in (2, 9) for n in range(1, 10)], spark, spaces.IndexSpace(9)) == [2, 9]


@pytest.mark.parametrize("times", [None, [6, 1, 6], [True, False, True, False, False, False], np.array([2, 3]), []])
@pytest.mark.parametrize("features", [None, [9, 2, 9, 5], [3]])
def test_slices_are_plain_indexing(array, times, features):
    rows = range(6) if times is None else np.flatnonzero(times) if len(times) and times[0] is True else [t - 1 for t in times]
    cols = range(9) if features is None else [f - 1 for f in features]
    want = X[np.ix_([int(r) for r in rows], list(cols))] if len(list(rows)) else np.empty((0, len(list(cols))))
    got = sel.sliced(array, spaces.IndexSpace(9), features, times)
    np.testing.assert_array_equal(got.matrix(), want)
    cells = {(r["time_pos"], r["pos"]): r["signal"] for r in got.long().collect()} if times is not None else None
    if cells is not None:
        assert len(cells) == want.size
        assert all(np.isnan(want[t - 1, p - 1]) if v is None or np.isnan(v) else v == want[t - 1, p - 1] for (t, p), v in cells.items())


def test_slices_carry_labels_and_refuse_what_does_not_fit(spark, array):
    labels = spark.createDataFrame([(i, (i - 1) // 3 + 1, (i - 1) % 3 + 1) for i in range(1, 7)], "obs_idx long, run_id int, timepoint int")
    got = sel.sliced(array, SPACE, sel.Ball((1, 1, 1), 1), [5, 2], labels)
    assert got.rows().columns == ["time_pos", "obs_idx", "run_id", "timepoint", "values"]
    assert [(r["obs_idx"], r["run_id"], r["timepoint"], r["values"]) for r in got.rows().orderBy("time_pos").collect()] == [(5, 2, 2, X[4, [0, 1, 6]].tolist()), (2, 1, 2, X[1, [0, 1, 6]].tolist())]
    for wrong in ([7], [0], [True] * 5):
        with pytest.raises(IndexError):
            sel.sliced(array, SPACE, None, wrong)
    with pytest.raises(ValueError):
        sel.sliced(array, spaces.IndexSpace(8))
    with pytest.raises(ValueError):
        sel.sliced(array, SPACE).matrix(max_cells=53)
