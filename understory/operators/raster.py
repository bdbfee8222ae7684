"""Rasters as sparse cell tables (by, row, col, ...); a missing cell is no data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window

from ..functions.checkpoint import cut
from .graph import components


def cells(points: DataFrame, size: float) -> DataFrame:
    """``points`` with row and col, counted from the world's origin."""
    return points.withColumn("row", F.floor(F.col("y") / size)).withColumn("col", F.floor(F.col("x") / size))


def terrain(points: DataFrame, size: float, by: str = "dataset_id", ground: int = 2) -> DataFrame:
    """Mean height of ground points per cell."""
    return cells(points.where(F.col("classification") == ground), size).groupBy(by, "row", "col").agg(F.avg("z").alias("dtm"))


def rasters(points: DataFrame, size: float, by: str = "dataset_id", ground: int = 2, outside: int = 3, canopy: float = 2.0) -> DataFrame:
    """One pass: chm (highest non-ground point), low (lowest point), density and mean intensity of the canopy, coverage."""
    high = F.col("classification") != ground
    leaf = high & (F.col("z") >= canopy)
    agg = [
        F.max(F.when(high, F.greatest(F.col("z"), F.lit(0.0)))).alias("chm"), F.min("z").alias("low"), F.count_if(leaf).alias("density"),
        F.avg(F.when(leaf, F.col("intensity"))).alias("intensity"), F.bool_or(F.col("classification") != outside).alias("covered"),
    ]
    return cells(points, size).groupBy(by, "row", "col").agg(*agg)


def topmost(points: DataFrame, size: float, by: str = "dataset_id", label: str = "truth") -> DataFrame:
    """Label of the highest labelled point of each cell; of equal heights the smaller label."""
    top = F.max_by(F.col(label), F.struct(F.col("z"), -F.col(label)))
    return cells(points.where(F.col(label) > 0), size).groupBy(by, "row", "col").agg(top.alias(label), F.max("z").alias("z"))


def ignore_mask(points: DataFrame, size: float, by: str = "dataset_id", label: str = "truth", outside: int = 3, ground: int = 2) -> DataFrame:
    """Cells that hold outside or unknown points and no known point above ground."""
    odd = (F.col("classification") == outside) | (F.col(label) < 0)
    sure = (F.col(label) >= 0) & ~F.col("classification").isin(ground, outside)
    return cells(points, size).groupBy(by, "row", "col").agg(F.bool_or(odd).alias("_o"), F.bool_or(sure).alias("_s")).where("_o AND NOT _s").drop("_o", "_s")


def neighbourhood(raster: DataFrame, radius: int, *agg: Column, value: str, by: str = "dataset_id", disc: float | None = None) -> DataFrame:
    """``agg`` over ``value`` (and dr, dc) of the cells around each known cell; no join: cells are sent to their neighbours.

    disc: only neighbours within that distance in cells, else the whole square.
    """
    steps = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if disc is None or r * r + c * c <= disc * disc + 1e-9]
    offsets = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in steps)))
    sent = raster.withColumn("_d", offsets).select(by, (F.col("row") + F.col("_d.dr")).alias("row"), (F.col("col") + F.col("_d.dc")).alias("col"), F.col("_d.dr").alias("dr"), F.col("_d.dc").alias("dc"), F.col(value).alias(value))
    here = F.bool_or((F.col("dr") == 0) & (F.col("dc") == 0)).alias("_here")
    return sent.groupBy(by, "row", "col").agg(*agg, here).where("_here").drop("_here")


def by_lines(raster: DataFrame, radius: int, combine, value: str, by: str = "dataset_id") -> DataFrame:
    """``combine(value, offset)``, an aggregate, over the square around each known cell, first along rows, then columns.

    For aggregates that divide into lines (sums of products, maxima): 2 (2r + 1) copies of a cell, not (2r + 1)^2.
    """
    out = raster.select(by, "row", "col", value, F.lit(True).alias("_k"))
    for axis in ("row", "col"):
        sent_ = out.withColumn("_d", F.explode(F.sequence(F.lit(-radius), F.lit(radius)))).withColumn(axis, F.col(axis) + F.col("_d"))
        out = sent_.groupBy(by, "row", "col").agg(combine(F.col(value), F.col("_d")).alias(value), F.bool_or(F.col("_k") & (F.col("_d") == 0)).alias("_k"))
    return out.where("_k").drop("_k")


def smoothed(raster: DataFrame, sigma: float, value: str, by: str = "dataset_id") -> DataFrame:
    """Gaussian smoothing of known cells, missing ones counting as zero; the kernel is cut at four sigma and sums to one."""
    radius = int(4 * sigma + 0.5)
    total = sum(math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1))
    return by_lines(raster, radius, lambda v, o: F.sum(v * F.exp(-(o * o) / (2 * sigma * sigma)) / total), value, by)


def fill_nearest(holes: DataFrame, known: DataFrame, value: str, by: str = "dataset_id", reach: int = 4) -> DataFrame:
    """``holes`` (by, row, col) with ``value`` of the nearest known cell; ties to the smaller row, then column.

    Rings grow: holes meet known cells in buckets of the reach, and only those still open go on with twice the reach.
    """
    done, left = None, cut(holes.select(by, "row", "col"))
    known = cut(known.select(by, F.col("row").alias("kr"), F.col("col").alias("kc"), value))
    open_by = known.select(by).distinct()
    left = left.join(open_by, by, "left_semi")  # groups without a known cell stay empty
    while not left.isEmpty():
        side = F.sequence(F.lit(-1), F.lit(1))
        near = known.withColumn("br", F.floor(F.col("kr") / reach)).withColumn("bc", F.floor(F.col("kc") / reach))
        asked = left.withColumn("br", F.explode(F.transform(side, lambda i: F.floor(F.col("row") / reach) + i))).withColumn("bc", F.explode(F.transform(side, lambda i: F.floor(F.col("col") / reach) + i)))
        d2 = (F.col("row") - F.col("kr")) * (F.col("row") - F.col("kr")) + (F.col("col") - F.col("kc")) * (F.col("col") - F.col("kc"))
        met = asked.join(near, [by, "br", "bc"]).withColumn("d2", d2).where(F.col("d2") <= reach * reach)
        got = cut(met.groupBy(by, "row", "col").agg(F.min_by(value, F.struct("d2", "kr", "kc")).alias(value)))
        done = got if done is None else done.unionByName(got)
        left, reach = cut(left.join(got, [by, "row", "col"], "left_anti")), reach * 2
    return done if done is not None else holes.select(by, "row", "col").withColumn(value, F.lit(None).cast("double")).limit(0)


def mosaic(tiles: DataFrame, value: str, height: int, width: int, by: str = "dataset_id", order: str = "tile") -> DataFrame:
    """One grid of tiles (by, tile, tile_row, tile_col, row, col, value), cells counted within each tile.

    Where tiles overlap the one that comes last in ``order`` is pasted last. Cells that no tile has are missing.
    """
    at = tiles.select(by, (F.col("tile_row") * height + F.col("row")).alias("row"), (F.col("tile_col") * width + F.col("col")).alias("col"), F.struct(order, value).alias("_v"))
    return at.groupBy(by, "row", "col").agg(F.max("_v").alias("_v")).select(by, "row", "col", F.col(f"_v.{value}").alias(value))


def padded_tiles(raster: DataFrame, size: int, halo: int, value: str, nodata: float, by: str = "dataset_id") -> DataFrame:
    """(by, tile_row, tile_col, row, col, value, core): every tile that holds a cell, with its halo, whole.

    Cells are sent to the tiles whose halo they lie in; cells that are missing get ``nodata``. A tile has a bounded
    number of cells, so the padding is written out by a sequence.
    """
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))
    sent_ = raster.withColumn("tile_row", F.explode(span("row"))).withColumn("tile_col", F.explode(span("col"))).select(by, "tile_row", "tile_col", "row", "col", value)
    own = raster.select(by, F.floor(F.col("row") / size).alias("tile_row"), F.floor(F.col("col") / size).alias("tile_col")).distinct()
    line = lambda c: F.explode(F.sequence(F.col(c) * size - halo, F.col(c) * size + size - 1 + halo))
    grid = own.withColumn("row", line("tile_row")).withColumn("col", line("tile_col"))
    core = (F.floor(F.col("row") / size) == F.col("tile_row")) & (F.floor(F.col("col") / size) == F.col("tile_col"))
    return grid.join(sent_, [by, "tile_row", "tile_col", "row", "col"], "left").withColumn(value, F.coalesce(value, F.lit(nodata))).withColumn("core", core)


def window_size(height: Column, low: float = 3.0, slope: float = 0.1, intercept: float = 2.0, floor: float = 2.0) -> Column:
    """Diameter of the local-maximum window at a height: constant below ``low``, then linear."""
    return F.when(height < low, floor).otherwise(height * slope + intercept)


def highest_within(raster: DataFrame, size: float, least: float, window: Column, most: float, value: str = "chm", by: str = "dataset_id") -> DataFrame:
    """Cells of ``least`` height that have no higher cell within half their window; ``most``: the widest window."""
    reach = max(1, math.ceil(most / 2 / size))
    high = raster.where(F.col(value) >= least).select(by, "row", "col", F.col(value).alias("h")).withColumn("r", window / 2 / size)
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1)]
    offsets = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps))
    reached = F.filter(offsets, lambda o: o["dr"] * o["dr"] + o["dc"] * o["dc"] <= F.col("r") * F.col("r") + 1e-9)
    asked = high.withColumn("_o", F.explode(reached)).select(by, "row", "col", "h", (F.col("row") + F.col("_o.dr")).alias("nr"), (F.col("col") + F.col("_o.dc")).alias("nc"))
    around = high.select(by, F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("h").alias("nh"))
    return asked.join(around, [by, "nr", "nc"]).groupBy(by, "row", "col").agg(F.first("h").alias("h"), F.max("nh").alias("_m")).where("h >= _m").drop("_m")


def treetops(raster: DataFrame, size: float, least: float, window: Column, most: float, value: str = "chm", by: str = "dataset_id") -> DataFrame:
    """Local maxima in windows that grow with height: (by, row, col, h).

    Cells of equal height in one another's window are taken in row-major order, an accepted one rejecting later ones;
    such chains are resolved in order within each connected group of ties, everything else by joins.
    """
    top = cut(highest_within(raster, size, least, window, most, value, by).withColumn("r", window / 2 / size).withColumn("id", F.xxhash64(by, "row", "col")))
    reach = max(1, math.ceil(most / 2 / size))
    a = top.select(by, "h", F.col("row").alias("r1"), F.col("col").alias("c1"), F.col("id").alias("a"), F.floor(F.col("row") / reach).alias("br"), F.floor(F.col("col") / reach).alias("bc"), F.col("r").alias("_r"))
    side = F.sequence(F.lit(-1), F.lit(1))
    b = top.select(by, "h", F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("id").alias("b"), F.explode(F.transform(side, lambda i: F.floor(F.col("row") / reach) + i)).alias("br"), "r").withColumn("bc", F.explode(F.transform(side, lambda i: F.floor(F.col("c2") / reach) + i)))
    d2 = (F.col("r1") - F.col("r2")) * (F.col("r1") - F.col("r2")) + (F.col("c1") - F.col("c2")) * (F.col("c1") - F.col("c2"))
    ties = cut(a.join(b, [by, "h", "br", "bc"]).where((F.col("a") != F.col("b")) & (d2 <= F.col("_r") * F.col("_r") + 1e-9)).select("a", "b"))
    groups = components(ties, "a", "b")
    tied = ties.select(F.col("a").alias("node")).distinct().join(groups, "node", "left").select(F.col("node").alias("id"), F.coalesce("root", "node").alias("tie"))
    marked = top.join(tied, "id", "left")

    def in_order(pdf):
        taken = []
        for row in pdf.sort_values(["row", "col"]).itertuples():
            if not any((row.row - r) ** 2 + (row.col - c) ** 2 <= row.r * row.r + 1e-9 for r, c in taken):
                taken.append((row.row, row.col))
        return pdf[[(r, c) in set(taken) for r, c in zip(pdf["row"], pdf["col"], strict=True)]][[by, "row", "col", "h"]]

    plain = marked.where("tie IS NULL").select(by, "row", "col", "h")
    return plain.unionByName(marked.where("tie IS NOT NULL").groupBy("tie").applyInPandas(in_order, plain.schema))


def numbered(tops: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Tree ids from north to south, then west to east, within each group."""
    return tops.withColumn("tree_id", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("row"), "col")))


def mirrored(raster: DataFrame, radius: int, by: str = "dataset_id") -> DataFrame:
    """Whole grids with ``radius`` more cells at each side, mirrored at the edge (the edge cell twice); one mirroring only."""
    for axis in ("row", "col"):
        ends = raster.groupBy(by).agg(F.min(axis).alias("_a"), F.max(axis).alias("_b"))
        at = F.col(axis)
        places = F.array_compact(F.array(at, F.when(at < F.col("_a") + radius, 2 * F.col("_a") - 1 - at), F.when(at > F.col("_b") - radius, 2 * F.col("_b") + 1 - at)))
        raster = raster.join(F.broadcast(ends), by).withColumn(axis, F.explode(places)).drop("_a", "_b")
    return raster


def lowest(points: DataFrame, size: float, by: str = "dataset_id") -> DataFrame:
    """(by, row, col, dtm): the lowest point of each cell."""
    return cells(points, size).groupBy(by, "row", "col").agg(F.min("z").alias("dtm"))


def envelope(points: DataFrame, size: float, by: str = "dataset_id") -> DataFrame:
    """(by, row, col, dtm): the lower envelope of plots without ground, over their whole grids."""
    return enveloped(lowest(points, size, by), by)


def enveloped(low: DataFrame, by: str = "dataset_id") -> DataFrame:
    """The envelope over the ``lowest`` points: holes filled from the nearest cell, least of five by five, median of nine by nine."""
    box = low.groupBy(by).agg(*(f(c).alias(f"_{c}{i}") for c in ("row", "col") for i, f in ((0, F.min), (1, F.max))))
    grid = box.withColumn("row", F.explode(F.sequence("_row0", "_row1"))).withColumn("col", F.explode(F.sequence("_col0", "_col1"))).select(by, "row", "col")
    full = low.unionByName(fill_nearest(grid.join(low, [by, "row", "col"], "left_anti"), low, "dtm", by))
    least = cut(by_lines(full, 2, lambda v, _: F.min(v), "dtm", by))
    wide = neighbourhood(mirrored(least, 4, by), 4, F.median("dtm").alias("dtm"), value="dtm", by=by)
    return wide.join(least.select(by, "row", "col"), [by, "row", "col"], "left_semi")


def ground(points: DataFrame, size: float, zero_first: bool = False, low: float = 2.0, by: str = "dataset_id", ground_class: int = 2) -> DataFrame:
    """(by, row, col, dtm, method) of every cell that holds points.

    Plots with ground points have their mean per cell, holes from the nearest cell (``class2``); others whose lowest
    point is at most ``low`` are normalised already (``zero``); the rest get the lower ``envelope``. ``zero_first``
    asks for the lowest point before it asks for ground.
    """
    is_ground = F.col("classification") == ground_class
    stats = points.groupBy(by).agg(F.bool_or(is_ground).alias("_g"), F.min("z").alias("_z"))
    flat, has = F.when(F.col("_z") <= low, "zero"), F.when(F.col("_g"), "class2")
    kind = cut(stats.select(by, F.coalesce(*((flat, has) if zero_first else (has, flat)), F.lit("envelope")).alias("method")))
    low_ = cut(lowest(points, size, by))  # cells, not points, meet the methods
    own = cut(low_.select(by, "row", "col").join(kind, by))
    known = cut(terrain(points, size, by, ground_class).join(kind.where("method = 'class2'"), by, "left_semi"))
    asked = own.where("method = 'class2'").join(known, [by, "row", "col"], "left_anti")
    filled = known.unionByName(fill_nearest(asked, known, "dtm", by))
    under = enveloped(low_.join(kind.where("method = 'envelope'"), by, "left_semi"), by)
    found = own.join(filled.unionByName(under), [by, "row", "col"], "left")
    return found.select(by, "row", "col", F.when(F.col("method") == "zero", 0.0).otherwise(F.col("dtm")).alias("dtm"), "method")
