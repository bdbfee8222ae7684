"""Queries over polygons of footprints: rings and holes, overlap and clipping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import polygons, raster
from ..sources import views
from .registry import query
from .scoring import rounded

#: Cells of every label's footprint, and from every two by two block of places how often the boundary turns there.
CELLS = """c AS (SELECT DISTINCT dataset_id, {of} AS label, CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col FROM points WHERE {of} > 0)"""
EULER = """q AS (SELECT dataset_id, label, row + i AS r, col + j AS k, sum(1 << CAST(i * 2 + j AS INT)) AS bits FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j) GROUP BY ALL),
e AS (SELECT dataset_id, label, count(*) FILTER (bit_count(CAST(bits AS BIGINT)) = 1) AS n1, count(*) FILTER (bit_count(CAST(bits AS BIGINT)) = 3) AS n3, count(*) FILTER (bits IN (6, 9)) AS nd FROM q GROUP BY ALL),
s AS (SELECT dataset_id, label, 4 * count(*) - 2 * count(*) FILTER (right_of) - 2 * count(*) FILTER (above) AS sides, count(*) AS area FROM
 (SELECT c.*, EXISTS (SELECT 1 FROM c d WHERE d.dataset_id = c.dataset_id AND d.label = c.label AND d.row = c.row AND d.col = c.col + 1) AS right_of, EXISTS (SELECT 1 FROM c d WHERE d.dataset_id = c.dataset_id AND d.label = c.label AND d.col = c.col AND d.row = c.row + 1) AS above FROM c) GROUP BY ALL)"""


def footprints(spark, d, label):
    return raster.cells(views.points(spark, d).where(F.col(label) > 0), 1.0).select("dataset_id", label, "row", "col").distinct()


def summary(found, label):
    n = found.groupBy("dataset_id", label).agg(F.sum("area").cast("bigint").alias("area"), F.sum("sides").cast("bigint").alias("sides"), F.sum(F.when(F.col("hole"), -1).otherwise(1)).cast("bigint").alias("euler"), F.sum(F.size("corners")).cast("bigint").alias("corners"))
    return n.withColumnRenamed(label, "label")


@query("WITH {points}, " + CELLS.replace("{of}", "truth") + ", " + EULER + " SELECT dataset_id, label, area, sides, (n1 - n3 + 2 * nd) // 4 AS euler, n1 + n3 + 2 * nd AS corners FROM s JOIN e USING (dataset_id, label)")
def footprint_rings(spark, d):
    """Polygons of footprints whose parts are connected over sides: area, length of the boundary, parts without holes, corners."""
    return summary(polygons.rings(footprints(spark, d, "truth"), "truth"), "truth")


@query("WITH {points}, " + CELLS.replace("{of}", "pred") + ", " + EULER + " SELECT dataset_id, label, area, sides, (n1 - n3 - 2 * nd) // 4 AS euler, n1 + n3 + 2 * nd AS corners FROM s JOIN e USING (dataset_id, label)")
def footprint_rings_eight(spark, d):
    """The same for parts that are connected over corners too."""
    return summary(polygons.rings(footprints(spark, d, "pred"), "pred", eight=True), "pred")


def shaped(spark, d, label):
    return polygons.shapes(polygons.rings(footprints(spark, d, label), label), label)


@query("WITH {points}, " + CELLS.replace("{of}", "truth").replace("c AS", "t AS") + ", " + CELLS.replace("{of}", "pred").replace("c AS", "p AS") + """, nt AS (SELECT dataset_id, label, count(*) AS n FROM t GROUP BY ALL), np AS (SELECT dataset_id, label, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT t.dataset_id, t.label AS a, p.label AS b, count(*) AS n FROM t JOIN p USING (dataset_id, row, col) GROUP BY ALL)
SELECT m.dataset_id, a, b, round(CAST(m.n AS DOUBLE), 6) AS shared_area, round(m.n / (nt.n + np.n - m.n)::DOUBLE, 6) AS iou, round(m.n / least(nt.n, np.n)::DOUBLE, 6) AS containment FROM m JOIN nt ON nt.dataset_id = m.dataset_id AND nt.label = a JOIN np ON np.dataset_id = m.dataset_id AND np.label = b""")
def polygon_overlap(spark, d):
    """Overlap of true and predicted crowns as polygons with holes."""
    return rounded(polygons.overlaps(shaped(spark, d, "truth"), shaped(spark, d, "pred"), 16.0))


@query("WITH {points}, " + CELLS.replace("{of}", "truth") + """, w AS (SELECT dataset_id, avg(x) - 20.25 AS x0, avg(x) + 10.5 AS x1, 5.75::DOUBLE AS y0, 40.125::DOUBLE AS y1 FROM (SELECT dataset_id, floor(avg(x)) AS x FROM points GROUP BY 1) GROUP BY 1)
SELECT dataset_id, label, round(sum(greatest(0, least(col + 1, x1) - greatest(col, x0)) * greatest(0, least(row + 1, y1) - greatest(row, y0))), 6) AS area FROM c JOIN w USING (dataset_id) GROUP BY ALL HAVING area >= 0.25""")
def clipped_crowns(spark, d):
    """True crowns cut to a window of their plot, without those of which less than a quarter of a square metre is left."""
    mid = views.points(spark, d).groupBy("dataset_id").agg(F.floor(F.avg("x")).alias("x"))
    at = lambda x, y: F.struct((F.col("x") + x).alias("x"), F.lit(y).alias("y"))
    windows = mid.select("dataset_id", F.array(at(-20.25, 5.75), at(10.5, 5.75), at(10.5, 40.125), at(-20.25, 40.125)).alias("window"))
    found = polygons.clipped(polygons.rings(footprints(spark, d, "truth"), "truth").withColumnRenamed("truth", "id"), windows)
    return rounded(found.select("dataset_id", F.col("id").alias("label"), "area"))
