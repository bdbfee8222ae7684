"""What is known of a cell or a box is worked out once, and not for each point or copy."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from understory.operators import raster, spatial
from understory.plans import campaigns

FOLDER = "/root/testdata/sf0.001"


def test_ground_joins_cells_only(spark, monkeypatch):
    rows = [(i, d, float(i % 9), float(i // 9), 3.0 + i % 5, 2 if d == 1 and i % 2 else 5) for d in (1, 2, 3) for i in range(81)]
    p = spark.createDataFrame(rows, "pid long, dataset_id int, x double, y double, z double, classification int")
    joined, plain = [], type(p).join
    monkeypatch.setattr(type(p), "join", lambda self, *a, **k: joined.append("x" in self.columns) or plain(self, *a, **k))
    got = raster.ground(p, 2.0)
    assert joined and not any(joined)
    assert {(r.dataset_id, r.method) for r in got.collect()} == {(1, "class2"), (2, "envelope"), (3, "envelope")}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_boxes_of_the_same_cells_are_asked_once(spark, tmp_path, monkeypatch):
    one = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    copies = one.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).withColumn("l_suppkey", F.col("l_suppkey") + F.col("k") * 8000).drop("k")
    copies.write.parquet(str(tmp_path / "lineitem.parquet"))
    asked, plain = [], spatial.in_boxes
    monkeypatch.setattr(spatial, "in_boxes", lambda points, boxes, *a, **k: asked.append(boxes.count()) or plain(points, boxes, *a, **k))
    single = campaigns.detector_scene(spark, FOLDER).count()
    assert campaigns.detector_scene(spark, str(tmp_path)).count() > 2 * single
    assert asked[1] <= asked[0] <= single
