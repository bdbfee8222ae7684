"""Queries against their SQL on small tables with repeated ids and crowded places."""

from __future__ import annotations

import os
import shutil

import duckdb
import numpy as np
import pandas as pd
import pytest

from understory.operators import kernels, spatial, votes
from understory.plans import catalog

from test_oracles import FOLDER, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def lines(n: int, seed: int, suppliers: int, **fixed) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    columns = {
        "l_orderkey": np.arange(n, dtype=np.int64), "l_linenumber": r.integers(1, 8, n), "l_partkey": r.integers(0, 2000, n), "l_suppkey": r.integers(0, suppliers, n),
        "l_quantity": r.integers(1, 51, n).astype(float), "l_extendedprice": np.round(r.uniform(900, 105000, n), 2), "l_discount": r.integers(0, 11, n) / 100, "l_tax": r.integers(0, 9, n) / 100,
        "l_returnflag": r.choice(list("ANR"), n), "l_linestatus": r.choice(list("OF"), n),
    }
    return pd.DataFrame(columns).assign(**fixed)


def folder(to, lineitem: pd.DataFrame) -> str:
    shutil.copytree(FOLDER, to, copy_function=shutil.copyfile)
    os.chmod(to, 0o755)
    lineitem.to_parquet(f"{to}/lineitem.parquet")
    return str(to)


def same(spark, name: str, d: str) -> None:
    con = duckdb.connect()
    for n in os.listdir(d):
        con.execute(f"CREATE VIEW {n.removesuffix('.parquet')} AS SELECT * FROM '{d}/{n}'")
    assert plain(catalog.queries()[name](spark, d).toPandas()) == plain(con.execute(catalog.oracles()[name]).fetchdf())


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Points of other plots and labels under ids that are taken, and predictions whose ids are used in two plots."""
    first = lines(3000, 1, 60)
    again = first.assign(l_suppkey=first["l_suppkey"] + 1, l_returnflag="N")
    far = lines(2000, 2, 60).assign(l_orderkey=lambda t: t["l_orderkey"] + 5000, l_suppkey=lambda t: t["l_suppkey"] + 990)
    return folder(tmp_path_factory.mktemp("tables") / "repeated", pd.concat([first, again, far]))


@pytest.mark.parametrize("name", ["mask_overlaps", "dataset_copy", "footprint_overlap"])
def test_repeated_ids(spark, repeated, name):
    same(spark, name, repeated)


@pytest.mark.parametrize("n, width, digits, k, axes", [(400, 4.0, 6, 6, 3), (300, 2.0, 0, 6, 3), (500, 0.4, 1, 6, 3), (200, 30.0, 3, 4, 2), (300, 9.0, 1, 3, 1), (1, 1.0, 1, 6, 3)])
def test_nearest_pairs(n, width, digits, k, axes):
    """Also where many points share a place, more of them than neighbours are asked for."""
    r = np.random.default_rng(n)
    at, ids = np.round(r.uniform(0, width, (n, axes)), digits), r.permutation(n) + 10
    at[: n // 4] = at[n // 4 : n // 4 + 1] if n > 4 else at[: n // 4]
    own = at[:, 0] < width / 2
    want = set()
    for i in np.flatnonzero(own):
        d2 = sum((at[i, j] - at[:, j]) * (at[i, j] - at[:, j]) for j in range(axes))
        near = sorted((d2[j], ids[j]) for j in range(n) if j != i and d2[j] <= 1)
        want |= {(ids[i], b) for _, b in near[: k - 1]}
    a, b = kernels.nearest_pairs(ids, at, own, 1.0, k, most=500)
    assert len(a) == len(want) and set(zip(a, b, strict=True)) == want


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """Many points in few cubic metres, twenty to a place."""
    few = lines(150, 3, 40, l_quantity=1.0).assign(l_extendedprice=lambda t: np.round(900 + t["l_extendedprice"] / 100, 2), l_partkey=lambda t: t["l_partkey"] % 20)
    copies = [few.assign(l_orderkey=few["l_orderkey"] + 1000 * i, l_suppkey=few["l_suppkey"] + 40 * i) for i in range(20)]
    loose = lines(2500, 4, 40, l_quantity=9.0).assign(l_orderkey=lambda t: t["l_orderkey"] + 90000, l_extendedprice=lambda t: np.round(900 + t["l_extendedprice"] / 20, 2), l_partkey=lambda t: t["l_partkey"] % 30)
    return folder(tmp_path_factory.mktemp("tables") / "crowded", pd.concat([*copies, loose]))


@pytest.mark.parametrize("name", ["neighbour_graph", "edge_kinds"])
def test_crowded_places(spark, crowded, name):
    same(spark, name, crowded)


@pytest.mark.parametrize("name", ["nearest_top", "nearest_top_with_margin"])
def test_crowded_tops(spark, crowded, repeated, name):
    for d in (crowded, repeated):
        same(spark, name, d)


def test_crowded_votes(spark, crowded):
    same(spark, "vote_instances", crowded)


def test_lists_of_cells_are_short(spark):
    """Of five hundred places around a cell few can be the nearest of a point in it: pairs are not those of all points and places."""
    at = spark.createDataFrame([(0, i, float(i % 25) / 4, float(i // 25) / 4) for i in range(500)], "dataset_id int, t long, x double, y double")
    points = spark.range(20000).selectExpr("0 AS dataset_id", "id AS pid", "3 + (id % 100) / 1000 AS x", "2 + (id % 7) / 1000 AS y")
    found = spatial.nearest(points, at, 6.0, "pid", "t")
    assert found.count() == 20000 and {r.t for r in found.select("t").distinct().collect()} == {8 * 25 + 12}
    listed = spatial._closest(points.limit(1), at, 6.0, 1, "pid", "t")
    assert [len(r.c) for r in listed.collect()] == [1]


def test_crops_combine_before_they_sort(spark):
    """A voxel's least id is hashed, not sorted: windows that overlap take a point many times. Repeated ids keep their own place."""
    points = spark.createDataFrame([(0, 1, 0.1, 0.1, 0.0), (0, 1, 3.1, 0.1, 0.0), (0, 2, 0.2, 0.2, 0.1), (0, 3, -1.5, 0.0, 0.0), (0, 4, 9.0, 0.0, 0.0)], "dataset_id int, pid long, x double, y double, z double")
    anchors = spark.createDataFrame([(0, 7, 0.0, 0.0)], "dataset_id int, anchor long, ax double, ay double")
    got = votes.crop(points, anchors, 8.0, 9, 1.0)
    assert sorted((r.pid, r.x) for r in got.collect()) == [(1, 0.1), (1, 3.1), (3, -1.5)]
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()


def test_polygons_test_each_place_once(spark, crowded, monkeypatch):
    """Points that lie in one place, and trees with tops in one place, meet once, however many they are."""
    met = []
    monkeypatch.setattr(spatial, "in_boxes", lambda points, boxes, size, f=spatial.in_boxes: met.extend([points, boxes]) or f(points, boxes, size))
    same(spark, "points_in_polygons", crowded)
    points, boxes = met
    assert points.count() == points.select("dataset_id", "x", "y").distinct().count() and boxes.count() == boxes.select("dataset_id", "ring").distinct().count()
