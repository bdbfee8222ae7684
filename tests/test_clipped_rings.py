"""Clipping takes rings one by one, whatever the size of the shape they are of."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from understory.operators import polygons


def test_rings_are_clipped_as_one_by_one():
    r = random.Random(3)
    windows = [[(2.0, 2.0), (9.0, 2.5), (7.0, 9.0)], [(0.0, 0.0), (6.0, 0.0), (6.0, 6.0), (0.0, 6.0)]]
    rings = [[(x + a, y + b) for a, b in ((0, 0), (s, 0), (s, s), (0, s))][:: r.choice([1, -1])] for x, y, s in [(r.uniform(-3, 10), r.uniform(-3, 10), r.choice([0.5, 2.0, 20.0])) for _ in range(200)]]
    rings += [[], [(3.0, 3.0)], [(3.0, 3.0), (4.0, 4.0)], [(6.0, 1.0), (7.0, 1.0), (7.0, 2.0), (6.0, 2.0)]]
    at = [windows[k % 2] for k in range(len(rings))]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    listed = lambda v: pa.array([[{"x": x, "y": y} for x, y in g] for g in v], kind)
    kept, areas = polygons.clip_rings(listed(rings), listed(at))
    for ring, window, got, area in zip(rings, at, kept, areas, strict=True):
        want = polygons.clip_ring(np.array(ring, float).reshape(-1, 2), np.array(window))
        assert area == pytest.approx(polygons.ring_area(want) if len(want) > 2 else 0)
        assert got is None if len(want) < 3 else np.array_equal(got, want)


def test_python_sees_rings_not_shapes(spark):
    """A shape of very many rings is no row of its own on the way to Python."""
    square = lambda x: [{"x": x + a, "y": b} for a, b in ((0.0, 0.0), (0.5, 0.0), (0.5, 0.5), (0.0, 0.5))]
    found = spark.createDataFrame([(1, 7, [square(float(x)) for x in range(300)], 75.0), (1, 8, [], 0.0)], f"dataset_id int, id long, rings {polygons.RINGS}, area double")
    windows = spark.createDataFrame([(1, [{"x": 10.25, "y": -1.0}, {"x": 20.0, "y": -1.0}, {"x": 20.0, "y": 1.0}, {"x": 10.25, "y": 1.0}])], "dataset_id int, window array<struct<x:double,y:double>>")
    got = polygons.clipped(found, windows)
    assert [(x.id, x.area, len(x.rings)) for x in got.collect()] == [(7, 2.375, 10)]
    assert polygons.clipped(found, windows, least=0.0).count() == 2
    below = got._jdf.queryExecution().executedPlan().toString().split("MapInArrow")
    assert "Generate" in below[-1]
