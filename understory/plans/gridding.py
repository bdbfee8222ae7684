"""Grid, raster and tile queries."""

from __future__ import annotations

from pyspark.sql import functions as F, Window

from ..operators import grid, raster
from ..sources import views
from .registry import query
from .scoring import rounded

CELLS = "c AS (SELECT *, CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col FROM points)"


@query("""WITH {points}, m AS (SELECT dataset_id, min(x) AS mx, min(y) AS my, min(z) AS mz FROM points GROUP BY 1),
v AS (SELECT p.*, CAST(floor(x - mx) AS INT) AS gx, CAST(floor(y - my) AS INT) AS gy, CAST(floor(z - mz) AS INT) AS gz FROM points p JOIN m USING (dataset_id))
SELECT dataset_id, gx, gy, gz, pid, truth FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, gx, gy, gz ORDER BY pid) AS k FROM v) WHERE k = 1""")
def voxel_first(spark, d):
    return grid.voxel_dedup(views.points(spark, d), 1.0).select("dataset_id", "gx", "gy", "gz", "pid", "truth")


@query("""WITH {points}, m AS (SELECT dataset_id, floor(min(x)) AS mx, floor(min(y)) AS my, floor(min(z)) AS mz FROM points GROUP BY 1),
v AS (SELECT p.*, CAST(floor(x - mx) AS INT) AS gx, CAST(floor(y - my) AS INT) AS gy, CAST(floor(z - mz) AS INT) AS gz FROM points p JOIN m USING (dataset_id))
SELECT dataset_id, gx, gy, gz, pid, truth FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, gx, gy, gz ORDER BY truth <= 0, pid) AS k FROM v) WHERE k = 1""")
def voxel_labelled_first(spark, d):
    return grid.voxel_dedup(views.points(spark, d), 1.0, first=F.col("truth") > 0, snapped=True).select("dataset_id", "gx", "gy", "gz", "pid", "truth")


@query("""WITH {points}, c AS (SELECT *, CAST(floor(y) AS BIGINT) AS row, CAST(floor(x) AS BIGINT) AS col FROM points)
SELECT dataset_id, row, col, max(CASE WHEN classification <> 2 THEN greatest(z, 0) END) AS chm, min(z) AS low, count(*) FILTER (classification <> 2 AND z >= 2) AS density,
round(avg(CASE WHEN classification <> 2 AND z >= 2 THEN intensity END), 6) AS intensity, bool_or(classification <> 3) AS covered FROM c GROUP BY ALL""")
def canopy_rasters(spark, d):
    return rounded(raster.rasters(views.points(spark, d), 1.0), "intensity")


@query("WITH {points}, " + CELLS + " SELECT dataset_id, row, col, round(avg(z), 6) AS dtm FROM c WHERE classification = 2 GROUP BY ALL")
def terrain_model(spark, d):
    return rounded(raster.terrain(views.points(spark, d), 1.0))


FILLED = "WITH {points}, " + CELLS + """, k AS (SELECT dataset_id, row, col, avg(z) AS dtm FROM c WHERE classification = 2 GROUP BY ALL),
h AS (SELECT DISTINCT dataset_id, row, col FROM c WHERE (dataset_id, row, col) NOT IN (SELECT (dataset_id, row, col) FROM k)),
f AS (SELECT h.dataset_id, h.row, h.col, first(k.dtm ORDER BY (h.row - k.row) * (h.row - k.row) + (h.col - k.col) * (h.col - k.col), k.row, k.col) AS dtm
  FROM h JOIN k ON h.dataset_id = k.dataset_id AND abs(h.row - k.row) <= 64 AND abs(h.col - k.col) <= 64 GROUP BY 1, 2, 3)"""


@query(FILLED + " SELECT dataset_id, row, col, round(dtm, 6) AS dtm FROM f")
def terrain_filled(spark, d):
    p = views.points(spark, d)
    known = raster.terrain(p, 1.0)
    holes = raster.cells(p, 1.0).select("dataset_id", "row", "col").distinct().join(known, ["dataset_id", "row", "col"], "left_anti")
    return rounded(raster.fill_nearest(holes, known, "dtm"))


@query(FILLED + """, t AS (SELECT * FROM k UNION ALL SELECT * FROM f) SELECT dataset_id, row, col, round(max(greatest(c.z - t.dtm, 0)), 6) AS height
FROM c JOIN t USING (dataset_id, row, col) WHERE classification <> 2 GROUP BY ALL""")
def normalised_canopy(spark, d):
    p = views.points(spark, d)
    known = raster.terrain(p, 1.0)
    at = raster.cells(p, 1.0)
    holes = at.select("dataset_id", "row", "col").distinct().join(known, ["dataset_id", "row", "col"], "left_anti")
    ground = known.unionByName(raster.fill_nearest(holes, known, "dtm"))
    return rounded(at.where("classification <> 2").join(ground, ["dataset_id", "row", "col"]).groupBy("dataset_id", "row", "col").agg(F.max(F.greatest(F.col("z") - F.col("dtm"), F.lit(0.0))).alias("height")))


@query("WITH {points}, " + CELLS + " SELECT dataset_id, row, col, truth, z FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id, row, col ORDER BY z DESC, truth) AS k FROM c WHERE truth > 0) WHERE k = 1")
def topmost_label(spark, d):
    return raster.topmost(views.points(spark, d), 1.0).select("dataset_id", "row", "col", "truth", "z")


@query("WITH {points}, " + CELLS + " SELECT dataset_id, row, col FROM c GROUP BY ALL HAVING bool_or(classification = 3 OR truth < 0) AND NOT bool_or(truth >= 0 AND classification NOT IN (2, 3))")
def ignore_cells(spark, d):
    return raster.ignore_mask(views.points(spark, d), 1.0)


CHM = "WITH {points}, " + CELLS + ", m AS (SELECT dataset_id, row, col, max(greatest(z, 0)) AS chm FROM c WHERE classification <> 2 GROUP BY ALL)"


def canopy(spark, d):
    return raster.rasters(views.points(spark, d), 1.0).where("chm IS NOT NULL").select("dataset_id", "row", "col", "chm")


@query(CHM + """ SELECT a.dataset_id, a.row, a.col, median(b.chm) AS median, min(b.chm) AS low, max(b.chm) AS high, count(*) AS n FROM m a JOIN m b
ON a.dataset_id = b.dataset_id AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY ALL""")
def focal_statistics(spark, d):
    v = F.col("chm")
    return raster.neighbourhood(canopy(spark, d), 1, F.median(v).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("n"), value="chm")


@query(CHM + """ SELECT a.dataset_id, a.row, a.col, round(sum(b.chm * exp(-((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) / 2.0::DOUBLE) / pow((SELECT sum(exp(-i * i / 2.0::DOUBLE)) FROM range(-4, 5) t(i)), 2)), 6) AS smooth
FROM m a JOIN m b ON a.dataset_id = b.dataset_id AND b.row BETWEEN a.row - 4 AND a.row + 4 AND b.col BETWEEN a.col - 4 AND a.col + 4 GROUP BY ALL""")
def gaussian_smoothing(spark, d):
    return rounded(raster.smoothed(canopy(spark, d), 1.0, "chm").withColumnRenamed("chm", "smooth"))


@query(CHM + """, h AS (SELECT dataset_id, row, col, chm AS h, (CASE WHEN chm < 3 THEN 2.0::DOUBLE ELSE chm * 0.1::DOUBLE + 2 END) / 2 AS r FROM m WHERE chm >= 2)
SELECT a.dataset_id, a.row, a.col, a.h FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.dataset_id = b.dataset_id AND b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3
AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= a.r * a.r + 1e-9 AND b.h > a.h)""")
def local_maxima(spark, d):
    return raster.highest_within(canopy(spark, d), 1.0, 2.0, raster.window_size(F.col("h")), 5.0)


@query("WITH RECURSIVE" + CHM.removeprefix("WITH") + """, h AS (SELECT dataset_id, row, col, chm AS h, (CASE WHEN chm < 3 THEN 2.0::DOUBLE ELSE chm * 0.1::DOUBLE + 2 END) / 2 AS r FROM m WHERE chm >= 2),
t AS (SELECT a.* FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.dataset_id = b.dataset_id AND b.row BETWEEN a.row - 3 AND a.row + 3 AND b.col BETWEEN a.col - 3 AND a.col + 3 AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= a.r * a.r + 1e-9 AND b.h > a.h)),
o AS (SELECT *, row * 100000 + col AS id, row_number() OVER (PARTITION BY dataset_id ORDER BY row, col) AS k FROM t),
n AS (SELECT a.dataset_id, a.k, a.id, list(b.id) FILTER (b.id IS NOT NULL) AS near FROM o a LEFT JOIN o b ON a.dataset_id = b.dataset_id AND a.h = b.h AND b.k < a.k AND (a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col) <= a.r * a.r + 1e-9 GROUP BY ALL),
g AS (SELECT DISTINCT dataset_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM o UNION ALL SELECT g.dataset_id, n.k, CASE WHEN list_has_any(coalesce(n.near, []), g.kept) THEN g.kept ELSE list_append(g.kept, n.id) END FROM g JOIN n ON n.dataset_id = g.dataset_id AND n.k = g.k + 1),
f AS (SELECT dataset_id, unnest(arg_max(kept, k)) AS id FROM g GROUP BY 1)
SELECT dataset_id, o.row, o.col, o.h, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY o.row DESC, o.col) AS INT) AS tree_id FROM f JOIN o USING (dataset_id, id)""")
def variable_window_treetops(spark, d):
    return raster.numbered(raster.treetops(canopy(spark, d), 1.0, 2.0, raster.window_size(F.col("h")), 5.0))


@query("""WITH {points}, q AS (SELECT dataset_id, quantile_cont(z, 0.01) AS a, quantile_cont(z, 0.99) AS b0 FROM points GROUP BY 1), w AS (SELECT *, CASE WHEN b0 = a THEN a + 1 ELSE b0 END AS b FROM q)
SELECT pid, dataset_id, round(least(greatest((z - a) / (b - a), 0), 1), 6) AS value FROM points JOIN w USING (dataset_id)""")
def percentile_normalisation(spark, d):
    p = views.points(spark, d)
    q = p.groupBy("dataset_id").agg(F.percentile("z", F.array(F.lit(0.01), F.lit(0.99))).alias("q")).select("dataset_id", F.col("q")[0].alias("a"), F.col("q")[1].alias("b0"))
    q = q.withColumn("b", F.when(F.col("b0") == F.col("a"), F.col("a") + 1).otherwise(F.col("b0")))
    return p.join(grid.small(q), "dataset_id").select("pid", "dataset_id", F.round(F.least(F.greatest((F.col("z") - F.col("a")) / (F.col("b") - F.col("a")), F.lit(0)), F.lit(1)), 6).alias("value"))


@query("""WITH {points} SELECT dataset_id, floor(min(x) / 0.5) * 0.5 AS "left", floor(min(y) / 0.5) * 0.5 AS bottom, ceil(max(x) / 0.5) * 0.5 AS "right", ceil(max(y) / 0.5) * 0.5 AS top,
CAST(greatest(round((ceil(max(x) / 0.5) - floor(min(x) / 0.5))), 1) AS BIGINT) AS width, CAST(greatest(round(ceil(max(y) / 0.5) - floor(min(y) / 0.5)), 1) AS BIGINT) AS height FROM points GROUP BY 1""")
def snapped_extent(spark, d):
    return grid.extent(views.points(spark, d), 0.5, "dataset_id")


@query("""WITH {points}, t AS (SELECT p.*, tx, ty FROM points p, LATERAL (SELECT unnest(range(CAST(floor((x - 8) / 20) AS BIGINT), CAST(floor((x + 8) / 20) AS BIGINT) + 1)) AS tx) a, LATERAL (SELECT unnest(range(CAST(floor((y - 8) / 20) AS BIGINT), CAST(floor((y + 8) / 20) AS BIGINT) + 1)) AS ty) b)
SELECT dataset_id, tx AS tile_x, ty AS tile_y, count(*) AS context, count(*) FILTER (tx = floor(x / 20) AND ty = floor(y / 20)) AS owned FROM t GROUP BY ALL""")
def halo_tiles(spark, d):
    t = grid.tiles(views.points(spark, d), 20.0, 8.0)
    return t.groupBy("dataset_id", "tile_x", "tile_y").agg(F.count("*").alias("context"), F.count_if("owner").alias("owned"))


STARTS = "s AS (SELECT i AS win, least(0 + i * 12.0, 86.0)::DOUBLE AS a FROM range(0, 9) t(i)), o AS (SELECT *, CASE WHEN win = 0 THEN 0 ELSE (a + lag(a) OVER (ORDER BY win)) / 2 + 10 END AS lo, CASE WHEN win = 8 THEN 106 ELSE (a + lead(a) OVER (ORDER BY win)) / 2 + 10 END AS hi FROM s)"


@query("WITH {points}, " + STARTS + " SELECT CAST(o.win AS INT) AS win, count(*) AS context, count(*) FILTER (x >= lo AND (x < hi OR (o.win = 8 AND x <= hi))) AS owned, min(pid) AS first_pid FROM points JOIN o ON x >= a AND x <= a + 20 GROUP BY 1")
def owned_windows(spark, d):
    w = grid.windows(views.points(spark, d), "x", 20.0, 12.0, 0.0, 106.0, "win")
    return w.groupBy("win").agg(F.count("*").alias("context"), F.count_if("owner").alias("owned"), F.min("pid").alias("first_pid"))


@query("WITH {points}, " + STARTS + ", n AS (SELECT pid, count(*) FILTER (x >= lo AND (x < hi OR (o.win = 8 AND x <= hi))) AS owners FROM points JOIN o ON x >= a AND x <= a + 20 GROUP BY pid) SELECT owners, count(*) AS points FROM n GROUP BY 1")
def ownership_is_exact(spark, d):
    w = grid.windows(views.points(spark, d), "x", 20.0, 12.0, 0.0, 106.0, "win")
    return w.groupBy("pid").agg(F.count_if("owner").alias("owners")).groupBy("owners").agg(F.count("*").alias("points"))


@query("""WITH {points} SELECT dataset_id, CAST(count(*) FILTER (isfinite(x) AND isfinite(z)) AS BIGINT) AS finite, count(*) FILTER (x >= 10 AND x < 60 AND y >= 5 AND y < 40) AS inside,
count(*) FILTER (x >= 10 AND x <= 60 AND y >= 5 AND y <= 40) AS closed_inside, count(*) FILTER (least(greatest(floor(x / 10), 0), 4) = 4) AS clipped_last, count(*) FILTER (floor(x / 10) BETWEEN 0 AND 4) AS kept FROM points GROUP BY 1""")
def boxes_and_policies(spark, d):
    p = grid.finite(views.points(spark, d), "x", "z")
    x, y = F.col("x"), F.col("y")
    i = grid.cell(x, 0.0, 10.0)
    return p.groupBy("dataset_id").agg(F.count("*").alias("finite"), F.count_if(grid.inside(x, y, 10, 5, 60, 40)).alias("inside"), F.count_if(grid.inside(x, y, 10, 5, 60, 40, closed=True)).alias("closed_inside"), F.count_if(grid.fit(i, 5) == 4).alias("clipped_last"), F.count(grid.fit(i, 5, "drop")).alias("kept"))


@query("""WITH {points}, v AS (SELECT dataset_id, CAST(floor(x / 5) AS INT) AS gx, CAST(floor(y / 5) AS INT) AS gy, CAST(floor(z / 5) AS INT) AS gz, count(*) AS n FROM points GROUP BY ALL)
SELECT dataset_id, gx, gy, gz, n, CAST(dense_rank() OVER (PARTITION BY dataset_id ORDER BY gx, gy, gz) - 1 AS BIGINT) AS group_id FROM v""")
def cell_partition(spark, d):
    c = lambda a: F.floor(F.col(a) / 5).cast("int").alias(f"g{a}")
    v = views.points(spark, d).groupBy("dataset_id", c("x"), c("y"), c("z")).agg(F.count("*").alias("n"))
    return v.withColumn("group_id", (F.dense_rank().over(Window.partitionBy("dataset_id").orderBy("gx", "gy", "gz")) - 1).cast("bigint"))
