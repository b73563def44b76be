"""What a task holds is bounded: rows are dealt to parts of a bounded size, equal tables are read and grouped once, and
what may be large is not broadcast."""

import numpy as np
import pytest

import gridloom as g
from gridloom import MapProjection, queries
from gridloom.plans import layer as layers
from gridloom.plans.geometry import Window

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows", [0, 1, 2**18, 2**18 + 1, 36_000_000, 216_000_000, 10**10])
def test_parts_hold_a_bounded_number_of_rows(rows):
    parts = queries.parts_of(rows)
    assert parts >= 1 and rows / parts <= 2**21
    assert parts <= 200 or rows > 200 * 2**21


def test_the_tall_grid_is_grouped_once_in_bounded_parts(spark, monkeypatch):
    assert queries.Grids(spark, SF).tall.key == queries.Grids(spark, SF).tall.key
    monkeypatch.setattr(queries, "parts_of", lambda rows: 7)
    out = queries.QUERIES["tall_mask_sum"](spark, SF)
    plan = plan_of(out)
    assert plan.count("Aggregate [") == 2 and "Union" not in plan  # by pixel, and the sum
    assert plan.count("RepartitionByExpression") == 1 and "], 7" in plan
    own = spark.read.parquet(f"{SF}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg({"l_quantity": "sum"})
    assert out.first()[0] == own.filter("`sum(l_quantity)` > 50").agg({"sum(l_quantity)": "sum"}).first()[0]


P, HALF, DOUBLE = (MapProjection("ESRI:54009", step, -step) for step in (1.0, 0.5, 2.0))


@pytest.mark.parametrize("name", ["rescale_nearest_up", "rescale_nearest_down", "rescale_avg", "rescale_med", "rescale_sum", "rescale_sum_up"])
def test_a_rescaled_layer_that_fills_its_area_is_not_joined(spark, name):
    assert "Join" not in plan_of(queries.QUERIES[name](spark, SF))


@pytest.mark.parametrize("method", [g.ResamplingMethod.Nearest, g.ResamplingMethod.Sum])
@pytest.mark.parametrize("step", [0.3, 0.5, 0.7, 1.5, 2.0, 3.0])
@pytest.mark.parametrize(("x0", "y0"), [(0, 0), (1, -1), (-4, 5)])
def test_every_pixel_of_a_rescaled_layer_has_one_row(spark, method, step, x0, y0):
    x = np.arange(1.0, 13).reshape(3, 4)
    out = g.from_array(x, (x0, y0), P).as_projection(MapProjection("ESRI:54009", step, -step), method)
    w = out.window
    rows = out.frame().collect()
    assert sorted((r["y"], r["x"]) for r in rows) == [(y, x) for y in range(w.yoff, w.yend) for x in range(w.xoff, w.xend)]
    if method is g.ResamplingMethod.Sum:
        assert sum(r["v"] for r in rows) == pytest.approx(x.sum())
    else:
        centre = lambda n, edge: np.floor((n + 0.5) * step + 1e-9).astype(int) - edge
        for r in rows:
            i, j = centre(r["y"], -y0), centre(r["x"], x0)
            assert r["v"] == (x[i, j] if 0 <= i < 3 and 0 <= j < 4 else 0)


def test_beyond_its_area_a_rescaled_layer_is_zero(spark):
    half = g.from_array(np.ones((2, 2)), (0, 0), P).as_projection(HALF)
    assert half.dense and half.read_array(-1, -1, 6, 6).tolist() == np.pad(np.ones((4, 4)), 1).tolist()


@pytest.mark.parametrize("what", ["lattice", "spine", "warp"])
def test_large_windows_are_not_broadcast(spark, monkeypatch, what):
    monkeypatch.setattr(layers, "MOST_BROADCAST", 15)
    a = g.from_array(np.arange(16.0).reshape(4, 4), (0, 0), P)
    rows = spark.createDataFrame([(0, 1, 5.0)], "y long, x long, v double")
    sparse = g.from_table(rows, "v", Window(0, 0, 4, 4), P)
    out = {"lattice": sparse, "spine": a * sparse, "warp": a.as_projection(MapProjection("EPSG:4326", 1e-5, -1e-5))}[what]
    plan = out.frame()._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan
    assert out.sum() == {"lattice": 5, "spine": 5, "warp": pytest.approx(out.array().sum())}[what]


@pytest.mark.parametrize("method", list(g.ResamplingMethod))
@pytest.mark.parametrize(("across", "down"), [(2, 2), (3, 1), (1, 5), (10, 4)])
def test_targets_inside_one_source_pixel_need_no_aggregate(spark, method, across, down):
    x = np.array([[1.5, -2.0, np.nan], [0.0, 7.25, -1e9]])
    out = g.from_array(x, (-2, 5), P).as_projection(MapProjection("ESRI:54009", 1 / across, -1 / down), method)
    assert "Aggregate" not in plan_of(out.frame())
    value = {"Sum": x / (across * down), "RootMeanSquare": abs(x)}.get(method.name, x)
    np.testing.assert_allclose(out.array(), np.kron(value, np.ones((down, across))), rtol=1e-12)


@pytest.mark.parametrize("step", [0.4, 0.5 + 1e-6, 1.0 / 3 + 1e-4, 1.5])
def test_targets_across_source_pixels_are_aggregated(spark, step):
    x = np.arange(1.0, 7).reshape(2, 3)
    from gridloom.operators.regrid import Reprojected

    target = MapProjection("ESRI:54009", step, -step)
    layer = g.from_array(x, (300, -700), P)
    out = Reprojected(layer, target, g.ResamplingMethod.Sum)
    assert "Aggregate" in plan_of(out.frame())
    assert out.sum() == pytest.approx(x.sum())
    assert out.frame().count() == out.window.xsize * out.window.ysize
