"""Files, and the rows that make them, are held in pieces; background is no key of a join."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from understory.operators import labels
from understory.sources import readers, sinks


def test_files_of_bounded_rows(spark, tmp_path):
    df = spark.range(2500).select(F.col("id").cast("double").alias("x")).coalesce(1)
    got = sinks.binary_files(df, str(tmp_path / "b"), lambda t: t["x"].to_numpy().tobytes() + b"rest", ".bin", most=1000).collect()
    assert sorted(r.n for r in got) == [500, 1000, 1000]
    back = readers.binary_points(spark, str(tmp_path / "b"), "<d", ("x",))
    assert sorted(r.x for r in back.collect()) == list(map(float, range(2500)))


def test_inventory_reads_no_content(spark, tmp_path):
    data = np.random.default_rng(1).bytes(3_000_000)
    (tmp_path / "a.bin").write_bytes(data)
    (tmp_path / "b c.bin").write_bytes(b"x")
    got = readers.inventory(spark, str(tmp_path))
    assert {(r.length, r.sha256) for r in got.collect()} == {(len(d), hashlib.sha256(d).hexdigest()) for d in (data, b"x")}
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()


def test_background_is_not_joined(spark, monkeypatch):
    p = spark.createDataFrame([(1, 0, 5.0, 5.0, t) for t in (0, -1, 7, None)] + [(1, 0, 0.0, 5.0, t) for t in (8, 0)], "pid long, dataset_id int, x double, y double, t long")
    seen, plain = [], type(p).join
    monkeypatch.setattr(type(p), "join", lambda self, *a, **k: seen.append(self.where("t <= 0").count()) or plain(self, *a, **k))
    got = labels.without_cut_instances(p, "t", (0.0, 0.0, 10.0, 10.0), 1.0)
    assert seen == [0] and got.columns == p.columns
    assert sorted((r.x, str(r.t)) for r in got.collect()) == sorted([(5.0, "0"), (5.0, "-1"), (5.0, "7"), (5.0, "None"), (0.0, "-1"), (0.0, "0")])
