"""Every source and sink over data derived from the given tables: written in the shared folder, read again, compared.

The SQL beside each query works on the tables themselves, so equal rows show that nothing was lost on the way.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.checkpoint import scratch
from ..operators import raster
from ..sources import readers, sinks, views
from .gridding import canopy
from .registry import query
from .scoring import rounded

EXTENT = "b AS (SELECT dataset_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY 1)"


def written_manifest(spark, d):
    """A manifest by split in the shared folder, of two parts with different columns."""
    p = views.points(spark, d).groupBy("dataset_id").agg(*(f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))))
    bounds = F.to_json(F.array("x0", "y0", "x1", "y1")).alias("bounds")
    rows = views.plots(spark, d).join(p, "dataset_id").select(F.col("dataset_id").cast("string").alias("dataset_id"), F.col("source").alias("source_dataset"), "collection", "model_split", bounds, F.concat(F.lit("plot_"), F.col("dataset_id").cast("string"), F.lit(".las")).alias("source_las"))
    even = F.col("dataset_id").cast("int") % 2 == 0
    to = scratch(spark, "manifest")
    sinks.manifests([rows.where(even), rows.where(~even).drop("collection").withColumn("weight", F.lit(float("nan")))], to)
    return to


@query("WITH {points}, {plots}, " + EXTENT + """ SELECT CAST(p.dataset_id AS VARCHAR) AS dataset_id, source AS source_dataset, CASE WHEN p.dataset_id % 2 = 0 THEN collection END AS collection, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, CAST(NULL AS VARCHAR) AS weight
FROM plots p JOIN b USING (dataset_id) WHERE model_split = 'train'""")
def manifest_scan(spark, d):
    m = readers.manifest(spark, written_manifest(spark, d), split="train")
    return rounded(m.select("dataset_id", "source_dataset", "collection", *(F.col("bounds")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))), "weight"))


@query("WITH {plots} SELECT CAST(dataset_id AS VARCHAR) AS dataset_id, unnest(list_filter([CASE WHEN model_split = 'val' THEN 'unexpected split' END, CASE WHEN dataset_id % 4 = 3 THEN 'missing file' END, CASE WHEN dataset_id = 1 THEN 'ambiguous id' END], lambda x: x IS NOT NULL)) AS problem FROM plots")
def source_problems(spark, d):
    m = readers.manifest(spark, written_manifest(spark, d))
    files = m.where("CAST(dataset_id AS INT) % 4 <> 3").select("source_las")
    return readers.sources_of(m.unionByName(m.where("dataset_id = '1'")), files, ("train", "test"))


@query("WITH {points} SELECT dataset_id, count(*) AS n, round(sum(x), 4) AS x, round(sum(z), 4) AS z FROM points WHERE x >= 20 AND x < 60 AND y >= 10 AND y < 30 GROUP BY 1")
def point_scan(spark, d):
    to = scratch(spark, "points")
    views.points(spark, d).write.partitionBy("dataset_id").parquet(to)
    got = readers.points(spark, to, ("dataset_id", "x", "y", "z"), (20, 10, 60, 30))
    return got.groupBy("dataset_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"), F.round(F.sum("z"), 4).alias("z"))


def line(*names: str):
    return F.concat_ws(" ", *(F.col(n).cast("string") for n in names)).alias("value")


@query("WITH {points} SELECT pid, round(x, 6) AS x, y + 0.0::DOUBLE AS y, z, truth AS tree_id FROM points WHERE truth > 0")
def text_tree_scan(spark, d):
    to = scratch(spark, "trees")
    views.points(spark, d).where("truth > 0").select("truth", line("pid", "x", "y", "z")).repartition("truth").write.partitionBy("truth").text(to)
    return rounded(readers.text_points(spark, to, ("pid", "x", "y", "z"), r"truth=(\d+)").withColumn("pid", F.col("pid").cast("bigint")), "x")


@query("WITH {points} SELECT dataset_id, count(*) AS n, round(sum(x * z), 3) AS xz FROM points GROUP BY 1")
def ascii_cloud_scan(spark, d):
    to = scratch(spark, "cloud")
    head = spark.createDataFrame([("VERSION .7\nFIELDS x z dataset_id\nDATA ascii",)], "value string").coalesce(1)
    head.write.text(to)
    views.points(spark, d).select(line("x", "z", "dataset_id")).write.mode("append").text(to)
    got = readers.ascii_cloud(spark, to).withColumn("dataset_id", F.col("dataset_id").cast("int"))
    return got.groupBy("dataset_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("z")), 3).alias("xz"))


def records_of(table: pa.Table) -> bytes:
    kinds = np.dtype([("x", "<f8"), ("y", "<f8"), ("z", "<f8"), ("a", "<u4"), ("b", "<u4"), ("t", "<f8")])
    out = np.zeros(table.num_rows, kinds)
    for n in out.dtype.names:
        out[n] = table[n].to_numpy()
    return out.tobytes() + b"rest"


@query("WITH {points} SELECT x, CAST(y AS DOUBLE) AS y, z, CAST(dataset_id AS BIGINT) AS a, CAST(supp AS BIGINT) AS b, discount AS t FROM points WHERE truth > 0")
def binary_scan(spark, d):
    to = scratch(spark, "binary")
    p = views.points(spark, d).where("truth > 0").select("x", F.col("y").cast("double").alias("y"), "z", F.col("dataset_id").alias("a"), F.col("supp").alias("b"), F.col("discount").alias("t"))
    sinks.binary_files(p, to, records_of, ".bin").count()
    return readers.binary_points(spark, to)


@query("WITH {points} SELECT round(x, 5) AS x, CAST(y AS DOUBLE) AS y, z, CAST(round(intensity * 1000) AS INT) AS intensity, CAST(classification AS INT) AS classification FROM points WHERE x >= 20 AND x < 60 AND y >= 10 AND y < 30")
def las_scan(spark, d):
    """Labelled LAS files, one a partition and plot half, read by ranges of points; files outside the box are skipped by header."""
    to = scratch(spark, "las")
    p = views.points(spark, d).select("x", F.col("y").cast("double").alias("y"), "z", F.round(F.col("intensity") * 1000).cast("int").alias("intensity"), "classification", F.greatest("truth", F.lit(0)).alias("tree_id"), F.floor(F.col("x") / 20).alias("strip"))
    parts = p.repartitionByRange(16, "strip", "y").drop("strip")
    sinks.binary_files(parts, to, lambda t: sinks.las_bytes(t, 1e-5, ("tree_id",)), ".las").count()
    got = readers.las_ranges(spark, to, (19.999995, 9.999995, 60.000005, 30.000005), points=5000)
    exact = got.select(F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("z", 5).alias("z"), "intensity", "classification")
    return exact.where("x >= 20 AND x < 60 AND y >= 10 AND y < 30")


def ply_bytes(table: pa.Table) -> bytes:
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {table.num_rows}\nproperty double x\nproperty double y\nproperty float z\nproperty int tree\nend_header\n"
    out = np.zeros(table.num_rows, np.dtype([("x", "<f8"), ("y", "<f8"), ("z", "<f4"), ("tree", "<i4")]))
    for n in out.dtype.names:
        out[n] = table[n].to_numpy()
    return head.encode() + out.tobytes()


@query("WITH {points} SELECT x, CAST(y AS DOUBLE) AS y, round(z, 4) AS z, CAST(truth AS DOUBLE) AS tree FROM points WHERE truth > 0")
def ply_scan(spark, d):
    to = scratch(spark, "ply")
    p = views.points(spark, d).where("truth > 0").select("x", F.col("y").cast("double").alias("y"), "z", F.col("truth").alias("tree"))
    sinks.binary_files(p, to, ply_bytes, ".ply").count()
    return readers.ply_points(spark, to).withColumn("z", F.round("z", 4))


def wkb_polygon(x0: float, y0: float, x1: float, y1: float) -> bytes:
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<2d", *c) for c in ring)


@query("WITH {points}, t AS (SELECT truth, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points WHERE truth > 0 GROUP BY 1) SELECT truth, round((x1 - x0) * (y1 - y0), 6) AS area, round(x0, 6) AS left, CAST(y1 AS DOUBLE) AS top FROM t")
def wkb_masks(spark, d):
    """Boxes as WKB polygons in a binary column, read back by byte arithmetic."""
    from ..operators import spatial

    t = views.points(spark, d).where("truth > 0").groupBy("truth").agg(*(f(c).cast("double").alias(n) for n, c, f in (("x0", "x", F.min), ("y0", "y", F.min), ("x1", "x", F.max), ("y1", "y", F.max))))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([wkb_polygon(*r) for r in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)], pa.binary())], ["truth", "shape"])

    to = scratch(spark, "wkb")
    t.mapInArrow(run, "truth bigint, shape binary").write.parquet(to)
    ring = F.element_at(readers.wkb_rings(F.col("shape")), 1)
    got = spark.read.parquet(to).select("truth", ring.alias("ring"))
    return rounded(got.select("truth", spatial.ring_area(F.col("ring")).alias("area"), F.array_min(F.transform("ring", lambda p: p["x"])).alias("left"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("top")))


@query("WITH {points} SELECT dataset_id, count(*) AS n, count(DISTINCT pred) AS labels, round(avg(z), 6) AS z FROM points GROUP BY 1")
def json_records(spark, d):
    to = scratch(spark, "runs")
    runs = views.points(spark, d).groupBy("dataset_id").agg(F.count("*").alias("n"), F.countDistinct("pred").alias("labels"), F.avg("z").alias("z"))
    runs.select(F.col("dataset_id").alias("plot"), F.to_json(F.struct("dataset_id", "n", F.struct("labels", "z").alias("result"))).alias("value")).repartition(8, "plot").write.partitionBy("plot").text(to)
    got = readers.records(spark, to + "/plot=*", "dataset_id int, n bigint, result struct<labels: bigint, z: double>")
    return rounded(got.select("dataset_id", "n", "result.labels", "result.z"))


@query("WITH {points}, l AS (SELECT dataset_id, CAST(pid AS VARCHAR) || ' ' || CAST(truth AS VARCHAR) AS line, pid FROM points) SELECT dataset_id, sha256(string_agg(line, chr(10) ORDER BY pid) || chr(10)) AS sha256, CAST(sum(length(line) + 1) AS BIGINT) AS length FROM l GROUP BY 1")
def file_inventory(spark, d):
    to = scratch(spark, "files")
    lines = views.points(spark, d).select("dataset_id", "pid", line("pid", "truth"))
    lines.repartition(8, "dataset_id").sortWithinPartitions("dataset_id", "pid").drop("pid").write.partitionBy("dataset_id").text(to)
    return readers.inventory(spark, to + "/dataset_id=*").select(F.regexp_extract("path", r"dataset_id=(\d+)", 1).cast("int").alias("dataset_id"), "sha256", "length")


@query("WITH {plots} SELECT CAST(dataset_id AS VARCHAR) AS stem, CASE WHEN model_split = 'train' AND dataset_id < 6 THEN 'both' WHEN model_split = 'train' THEN 'left' ELSE 'right' END AS status FROM plots WHERE model_split = 'train' OR dataset_id < 6")
def paired_files(spark, d):
    a, b = scratch(spark, "left"), scratch(spark, "right")
    p = views.plots(spark, d).select("dataset_id", "model_split", F.col("collection").alias("value"))
    p.where("model_split = 'train'").drop("model_split").write.partitionBy("dataset_id").text(a)
    p.where("dataset_id < 6").drop("model_split").write.partitionBy("dataset_id").text(b)
    return readers.same_stems(spark, a, b, r"dataset_id=(\d+)")


@query("WITH {points} SELECT pid, CAST(floor(x / 36) AS INT) AS stripe, pred FROM points WHERE pred > 0")
def shard_scan(spark, d):
    """Three stripes of a run: one is written, the pending ones follow, and every point comes from one shard only."""
    to, jobs = scratch(spark, "shards"), spark.createDataFrame([(0,), (1,), (2,)], "stripe int")
    p = views.points(spark, d).where("pred > 0").select("pid", F.floor(F.col("x") / 36).cast("int").alias("stripe"), "pred")
    sinks.shard(p.where("stripe = 1").drop("stripe"), to, "run", 1)
    for job in sinks.pending(jobs, spark, to, "run").collect():
        sinks.shard(p.where(F.col("stripe") == job["stripe"]).drop("stripe"), to, "run", job["stripe"])
    return readers.shards(spark, [f"{to}/signature=run"]).select("pid", F.col("stripe").cast("int").alias("stripe"), "pred")


@query("WITH {points} SELECT dataset_id, truth, count(*) AS n, max(z) AS top FROM points WHERE truth > 0 GROUP BY ALL")
def verified_write(spark, d):
    p = views.points(spark, d).where("truth > 0").groupBy("dataset_id", "truth").agg(F.count("*").alias("n"), F.max("z").alias("top"))
    return sinks.verified(p, scratch(spark, "verified"))


@query("WITH {points}, t AS (SELECT dataset_id, count(*) FILTER (truth > 0) AS n, count(*) FILTER (pred >= 2000) AS k FROM points GROUP BY 1) SELECT CAST(dataset_id AS BIGINT) AS dataset_id, round(k / n, 6) AS share, CASE WHEN dataset_id % 2 = 1 THEN round(n / 7.0::DOUBLE, 6) END AS score FROM t")
def atomic_records(spark, d):
    to = scratch(spark, "atomic")
    p = views.points(spark, d).groupBy("dataset_id").agg(F.count_if(F.col("truth") > 0).alias("n"), F.count_if(F.col("pred") >= 2000).alias("k"))
    score = F.when(F.col("dataset_id") % 2 == 1, F.col("n") / 7.0).otherwise(float("nan")).alias("score")
    for _ in range(2):  # the second one replaces the first
        sinks.atomic(p.select("dataset_id", (F.col("k") / F.col("n")).alias("share"), score), to)
    return rounded(spark.read.schema("dataset_id bigint, share double, score double").json(to))


@query("WITH {points}, t AS (SELECT truth, CAST(floor(avg(x) / 20) AS BIGINT) AS tile, max(z) AS height, count(*) AS n FROM points WHERE truth > 0 GROUP BY 1) SELECT tile, count(*) AS crowns, CAST(sum(n) AS BIGINT) AS points, count(*) AS tops, max(height) AS highest FROM t GROUP BY 1")
def paired_tiles(spark, d):
    """Crowns and treetops of each tile, published together."""
    a, b = scratch(spark, "crowns"), scratch(spark, "tops")
    t = views.points(spark, d).where("truth > 0").groupBy("truth").agg(F.floor(F.avg("x") / 20).alias("tile"), F.max("z").alias("height"), F.count("*").alias("n"))
    sinks.pair(t.select("tile", "truth", "n"), a, t.select("tile", "truth", "height"), b, by="tile")
    crowns = spark.read.parquet(a).groupBy("tile").agg(F.count("*").alias("crowns"), F.sum("n").alias("points"))
    tops = spark.read.parquet(b).groupBy("tile").agg(F.count("*").alias("tops"), F.max("height").alias("highest"))
    return crowns.join(tops, "tile").withColumn("tile", F.col("tile").cast("bigint"))


@query("WITH {plots} SELECT dataset_id AS run, CASE WHEN dataset_id % 2 = 0 THEN 'again' ELSE 'first' END AS status, CAST(CASE WHEN dataset_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS at FROM plots")
def record_upsert(spark, d):
    to = scratch(spark, "log")
    p = views.plots(spark, d).select(F.col("dataset_id").alias("run"), F.lit("first").alias("status"), F.lit(1).alias("at"))
    sinks.upsert(p, to, "run", "at")
    return sinks.upsert(p.where("run % 2 = 0").select("run", F.lit("again").alias("status"), F.lit(2).alias("at")), to, "run", "at")


@query("WITH {points}, {plots}, {masks} SELECT m.mask_id, count(*) AS n FROM mask_points m JOIN plots USING (dataset_id) WHERE model_split <> 'test' AND truth > 0 GROUP BY 1")
def dataset_copy(spark, d):
    p = views.points(spark, d).where("truth > 0")
    _, _, links = sinks.copy_without(views.plots(spark, d), p, views.mask_points(spark, d), "dataset_id", ["dataset_id", "pid", "truth"], F.col("model_split") != "test")
    return links.groupBy("mask_id").agg(F.count("*").alias("n"))


@query("""WITH {points}, c AS (SELECT dataset_id, CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col, max(CASE WHEN classification <> 2 THEN greatest(z, 0) END) AS chm FROM points GROUP BY ALL HAVING chm IS NOT NULL),
o AS (SELECT DISTINCT dataset_id, row // 16 AS tr, col // 16 AS tc FROM c), r AS (SELECT *, unnest(range(tr * 16 - 3, tr * 16 + 19)) AS row FROM o), g AS (SELECT *, unnest(range(tc * 16 - 3, tc * 16 + 19)) AS col FROM r)
SELECT g.dataset_id, tr AS tile_row, tc AS tile_col, count(*) AS cells, count(*) FILTER (chm IS NULL) AS empty, round(sum(coalesce(chm, -1)), 6) AS total, count(*) FILTER (g.row // 16 = tr AND g.col // 16 = tc AND g.row >= 0 AND g.col >= 0 AND chm IS NOT NULL) AS own
FROM g LEFT JOIN c USING (dataset_id, row, col) GROUP BY ALL""")
def raster_windows(spark, d):
    """A raster as Parquet cells, read in tiles with a halo of three cells, no data where nothing is."""
    to = scratch(spark, "raster")
    canopy(spark, d).select("dataset_id", "row", "col", "chm").write.parquet(to)
    t = raster.padded_tiles(spark.read.parquet(to).where("chm IS NOT NULL"), 16, 3, "chm", -1.0)
    return rounded(t.groupBy("dataset_id", "tile_row", "tile_col").agg(F.count("*").alias("cells"), F.count_if(F.col("chm") == -1).alias("empty"), F.sum("chm").alias("total"), F.count_if(F.col("core") & (F.col("chm") != -1)).alias("own")), "total")


@query("""WITH {points}, c AS (SELECT dataset_id, CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col, CAST(max(truth) AS BIGINT) AS label FROM points WHERE truth > 0 GROUP BY ALL) SELECT * FROM c""")
def label_mosaic(spark, d):
    """Label rasters a tile, with a column that overlaps the next tile, pasted to one grid by whole offsets."""
    to = scratch(spark, "tiles")
    c = raster.cells(views.points(spark, d).where("truth > 0"), 1.0).groupBy("dataset_id", "row", "col").agg(F.max("truth").alias("label"))
    own = c.withColumn("tile_row", F.floor(F.col("row") / 10)).withColumn("tile_col", F.floor(F.col("col") / 10))
    more = own.where("col % 10 = 0 AND col > 0").withColumn("tile_col", F.col("tile_col") - 1).withColumn("label", F.lit(-5).cast("bigint"))
    tiles = own.union(more).select("dataset_id", (F.col("tile_row") * 1000 + F.col("tile_col")).alias("tile"), "tile_row", "tile_col", (F.col("row") - F.col("tile_row") * 10).alias("row"), (F.col("col") - F.col("tile_col") * 10).alias("col"), "label")
    tiles.write.partitionBy("dataset_id").parquet(to)
    return raster.mosaic(spark.read.parquet(to), "label", 10, 10)
