"""Readers, writers and streams."""

from __future__ import annotations

import os
import struct

import pytest
from conftest import rows
from pyspark.sql import functions as F

from understory.sources import readers, sinks
from understory.streaming import folds


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('dataset_id,model_split,bounds,extra\na,train,"[1,2,3,4]",x\nb,val,"[0,0,1,1]",y\n')
    got = readers.manifest(spark, str(tmp_path / "m.csv"), "train").first()
    assert got.dataset_id == "a" and got.bounds == [1, 2, 3, 4] and got.extra == "x" and got.collection is None
    (tmp_path / "n.csv").write_text("dataset_id\na\n")
    with pytest.raises(ValueError, match="model_split"):
        readers.manifest(spark, str(tmp_path / "n.csv"))


def test_text_and_binary_points(spark, tmp_path):
    (tmp_path / "tree_7.xyz").write_text("# x y z\n1 2 3\n 4.5  5 6e0\n")
    assert rows(readers.text_points(spark, str(tmp_path / "tree_7.xyz"), ("x", "y", "z"), r"tree_(\d+)")) == [(1.0, 2.0, 3.0, 7), (4.5, 5.0, 6.0, 7)]
    (tmp_path / "c.pcd").write_text("VERSION .7\nFIELDS x y z label\nDATA ascii\n1 2 3 4\n")
    assert rows(readers.ascii_cloud(spark, str(tmp_path / "c.pcd"))) == [(1.0, 2.0, 3.0, 4.0)]
    (tmp_path / "b.bin").write_bytes(struct.pack("<3d2Id", 1, 2, 3, 4, 5, 6) * 2 + b"tail")
    assert rows(readers.binary_points(spark, str(tmp_path / "b.bin"))) == [(1.0, 2.0, 3.0, 4, 5, 6.0)] * 2


def test_inventory_and_pairs(spark, tmp_path):
    for d, names in (("a", ("x.tif", "y.tif")), ("b", ("y.gpkg",))):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text(n)
    assert rows(readers.same_stems(spark, str(tmp_path / "a"), str(tmp_path / "b"))) == [("x", "left"), ("y", "both")]
    assert readers.inventory(spark, str(tmp_path / "a")).where("length(sha256) = 64").count() == 2


def test_points_push_the_box_down(spark, tmp_path):
    df = spark.range(100).select(*(F.col("id").cast("double").alias(c) for c in ("x", "y", "z")), F.lit(1.0).alias("intensity"), F.lit(2).alias("classification"), F.lit("unused").alias("other"))
    df.write.parquet(str(tmp_path / "p"))
    got = readers.points(spark, str(tmp_path / "p"), box=(10, 10, 20, 20))
    plan = got._jdf.queryExecution().toString()
    assert got.count() == 10 and "GreaterThanOrEqual(x,10" in plan and "other" not in plan.split("ReadSchema")[1]


def test_shards_and_verified_write(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "pid")
    assert sinks.verified(df, str(tmp_path / "v")).count() == 5
    sinks.shard(df.limit(3), str(tmp_path / "s"), "abc", 0)
    jobs = spark.createDataFrame([(0,), (1,)], "stripe int")
    assert rows(sinks.pending(jobs, spark, str(tmp_path / "s"), "abc")) == [(1,)]
    assert sinks.pending(jobs, spark, str(tmp_path / "s"), "other").count() == 2
    with pytest.raises(ValueError):
        readers.shards(spark, [str(tmp_path / "v"), str(tmp_path / "v")])
    sinks.manifests([spark.sql("select 'a' as id, 'train' as model_split, double('nan') as v"), spark.sql("select 'b' as id, 'val' as model_split, 1 as n")], str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    events = spark.sql("select id as event_id, id % 3 as user_id, id * 1.5D as value, if(id % 5 = 0, 'error', 'view') as event_type from range(40)")
    events.repartition(4).write.parquet(str(tmp_path / "e"))
    got = folds.run_fold(spark, str(tmp_path / "e"), events.schema.simpleString()[7:-1].replace(":", " "), str(tmp_path / "cp"), "folded")
    assert rows(got) == rows(folds.fold(events))


def test_label_lines(spark):
    r = spark.sql("select array(struct(1D as x, 2D as y), struct(5D as x, 10D as y)) as ring").select(sinks.label_line(F.col("ring"), F.lit(10), F.lit(20)).alias("l")).first()
    assert r.l == "0 0.100000 0.100000 0.500000 0.500000"


def las(points, kind=1, scale=0.01, version=2):
    width = 28 if kind == 1 else 30
    head = bytearray(375)
    head[:4], head[24], head[25] = b"LASF", 1, version
    struct.pack_into("<HI", head, 94, 375, 375)
    head[104] = kind
    struct.pack_into("<HI", head, 105, width, len(points))
    struct.pack_into("<6d", head, 131, scale, scale, scale, 100.0, 200.0, 0.0)
    x, y, z = zip(*(p[:3] for p in points), strict=True)
    struct.pack_into("<6d", head, 179, max(x), min(x), max(y), min(y), max(z), min(z))
    body = b""
    for px, py, pz, i, c in points:
        r = bytearray(width)
        struct.pack_into("<3iH", r, 0, round((px - 100) / scale), round((py - 200) / scale), round(pz / scale), i)
        r[16 if kind > 5 else 15] = c
        body += bytes(r)
    return bytes(head) + body


def test_las_files(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las([(101.5, 202.25, 3.0, 7, 2), (150, 260, 9.5, 65535, 5 | 0x20)]))
    (tmp_path / "b.las").write_bytes(las([(900.0, 900.0, 1.0, 1, 200)], kind=6, version=4))
    got = readers.las_points(spark, str(tmp_path))
    assert rows(got.drop("file")) == [(101.5, 202.25, 3.0, 7, 2), (150.0, 260.0, 9.5, 65535, 5), (900.0, 900.0, 1.0, 1, 200)]
    assert rows(readers.las_points(spark, str(tmp_path), (100, 200, 120, 220)), "x", "classification") == [(101.5, 2)]
    with pytest.raises(ValueError, match="compressed"):
        readers.las_header(las([(101, 201, 1, 1, 1)])[:104] + b"\x81" + bytes(300))


def test_ply_files(spark, tmp_path):
    head = "ply\nformat {}\nelement vertex 2\nproperty float x\nproperty double y\nproperty uchar label\nelement face 0\nproperty list uchar int v\nend_header\n"
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian 1.0").encode() + struct.pack("<fdB", 1.5, 2.5, 3) + struct.pack("<fdB", 4, 5, 6))
    (tmp_path / "t.ply").write_text(head.format("ascii 1.0") + "1.5 2.5 3\n4 5 6\n")
    for name in ("b.ply", "t.ply"):
        assert rows(readers.ply_points(spark, str(tmp_path / name)), "x", "y", "label") == [(1.5, 2.5, 3.0), (4.0, 5.0, 6.0)]


def test_las_by_ranges_and_round_trip(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") * 0.25).alias("x"), (F.col("id") % 7 + 0.5).alias("y"), (F.col("id") * 0.01).alias("z"), (F.col("id") % 300).cast("int").alias("intensity"), (F.col("id") % 9).cast("int").alias("classification"), F.col("id").alias("tree"))
    out = rows(sinks.binary_files(df.repartition(3), str(tmp_path / "las"), lambda t: sinks.las_bytes(t, extra=("tree",)), ".las"))
    assert len(out) == 3 and sum(n for _, n in out) == 1000
    want = rows(df.drop("tree"))
    got = readers.las_ranges(spark, str(tmp_path / "las"), points=77).select(*(F.round(c, 3).alias(c) for c in "xyz"), "intensity", "classification")
    assert sorted(tuple(map(float, r)) for r in rows(got)) == sorted(tuple(round(float(v), 3) for v in r) for r in want)
    assert readers.las_points(spark, str(tmp_path / "las")).count() == 1000
    box = readers.las_ranges(spark, str(tmp_path / "las"), (10, 0, 20, 4), points=50)
    assert {(10 <= r.x < 20, r.y < 4) for r in box.collect()} == {(True, True)}
    assert readers.las_ranges(spark, str(tmp_path / "las"), (9000, 0, 9001, 4)).count() == 0


def test_wkb_rings(spark):
    ring = [(0.5, -2.0), (3.25, 1e-9), (-1e6, 7.0), (0.5, -2.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (1.0, 1.0)]
    wkb = struct.pack("<BII", 1, 3, 2) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r) for r in (ring, hole))
    got = spark.createDataFrame([(bytearray(wkb),)], "g binary").select(readers.wkb_rings(F.col("g")).alias("r")).first().r
    assert [[tuple(p) for p in r] for r in got] == [ring, hole]


def test_published_tables_are_whole(spark, tmp_path):
    to, df = str(tmp_path / "t"), spark.range(10).withColumn("v", F.when(F.col("id") == 3, float("nan")).otherwise(1.0))
    for n in (10, 4):
        sinks.atomic(df.limit(n), to)
        assert spark.read.json(to).count() == n
    assert spark.read.json(to).where("v IS NULL").count() <= 1
    sinks.pair(df, to + "a", df.limit(2), to + "b")
    with pytest.raises(ZeroDivisionError):
        sinks.aside(df, to + "a", lambda d, p: 1 / 0)
    assert spark.read.parquet(to + "a").count() == 10 and spark.read.parquet(to + "b").count() == 2
    with pytest.raises(FileNotFoundError):
        sinks.publish(spark, (to + "a", to + "c"), (to + "missing", to + "d"))
    assert spark.read.parquet(to + "a").count() == 10
    log = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, s string, at int")
    sinks.upsert(log, to + "log", "id", "at")
    assert rows(sinks.upsert(log.where("id = 2").withColumn("s", F.lit("z")).withColumn("at", F.lit(2)), to + "log", "id", "at")) == [(1, "x", 1), (2, "z", 2)]
    with sinks.locked(spark, to), pytest.raises(TimeoutError), sinks.locked(spark, to, wait=0.2):
        pass


def test_sources_and_pairs(spark, tmp_path):
    m = spark.createDataFrame([("a", "train", "a.las"), ("b", "odd", "b.las"), ("a", "val", "a.las"), ("c", None, "x.las")], "dataset_id string, model_split string, source_las string")
    files = spark.createDataFrame([("a.las",), ("b.las",)], "f string")
    assert rows(readers.sources_of(m, files, ("train", "val"))) == [("a", "ambiguous id"), ("b", "unexpected split"), ("c", "missing file"), ("c", "unexpected split")]
    with pytest.raises(ValueError, match="y"):
        readers.all_paired(spark.createDataFrame([("x", "both"), ("y", "left")], "stem string, status string"))


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.stdout.strip() == "True", out.stderr
