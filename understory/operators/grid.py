"""Grid arithmetic, voxel deduplication and tiles with single owners."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checkpoint import cut


SENT = 1_000_000  # rows of a table of groups that may be broadcast


def small(groups: DataFrame, most: int = SENT) -> DataFrame:
    """A table of one row a group, counted: broadcast if it is small, so that points need not be shuffled by a few keys."""
    held = cut(groups)
    return F.broadcast(held) if held.count() <= most else held


def finite(df: DataFrame, *names: str) -> DataFrame:
    """Rows whose named columns are all finite numbers."""
    for n in names:
        df = df.where(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")))
    return df


def inside(x: Column, y: Column, left: float, bottom: float, right: float, top: float, closed: bool = False) -> Column:
    """Whether a point is in a box that holds its lower edges, and its upper ones if ``closed``."""
    below = (x <= right) & (y <= top) if closed else (x < right) & (y < top)
    return (x >= left) & (y >= bottom) & below


def cell(value: Column, origin: Column | float, size: float) -> Column:
    """Index of the cell of a coordinate."""
    return F.floor((value - origin) / size)


def fit(index: Column, count: int, policy: str = "clip") -> Column:
    """An index kept within 0..count-1: clipped to the edge, or null outside (``drop``)."""
    if policy == "clip":
        return F.least(F.greatest(index, F.lit(0)), F.lit(count - 1))
    if policy != "drop":
        raise ValueError(f"policy must be clip or drop, not {policy}")
    return F.when((index >= 0) & (index < count), index)


def extent(points: DataFrame, size: float, *by: str) -> DataFrame:
    """Bounds of the points of each group, snapped outwards to whole cells, and the cell counts."""
    down, up = (lambda c: F.floor(F.min(c) / size) * size), (lambda c: F.ceil(F.max(c) / size) * size)
    e = points.groupBy(*by).agg(down("x").alias("left"), down("y").alias("bottom"), up("x").alias("right"), up("y").alias("top"))
    n = lambda a, b: F.greatest(F.round((F.col(b) - F.col(a)) / size), F.lit(1)).cast("bigint")
    return e.withColumn("width", n("left", "right")).withColumn("height", n("bottom", "top"))


def voxels(points: DataFrame, size: float, by: str = "dataset_id", snapped: bool = False) -> DataFrame:
    """``points`` with gx, gy, gz counted from each group's least coordinates (snapped down to whole voxels if asked)."""
    least = points.groupBy(by).agg(*(F.min(c).alias(f"_{c}") for c in "xyz"))
    start = (lambda c: F.floor(F.col(f"_{c}") / size) * size) if snapped else (lambda c: F.col(f"_{c}"))
    joined = points.join(small(least), by)
    return joined.withColumns({f"g{c}": cell(F.col(c), start(c), size).cast("int") for c in "xyz"}).drop("_x", "_y", "_z")


def voxel_dedup(points: DataFrame, size: float, by: str = "dataset_id", order: str = "pid", first: Column | None = None, snapped: bool = False) -> DataFrame:
    """One point for each voxel: that for which ``first`` is true, if given, and of equals the least ``order``.

    A minimum of structs: map-side combining keeps one row a voxel and task, so a crowded voxel is no hot group.
    """
    keyed = voxels(points, size, by, snapped)
    rank = F.struct(F.when(first, 0).otherwise(1) if first is not None else F.lit(0), F.col(order))
    row = F.struct(*(c for c in keyed.columns if c not in (by, "gx", "gy", "gz")))
    return keyed.groupBy(by, "gx", "gy", "gz").agg(F.min_by(row, rank).alias("_r")).select(by, "gx", "gy", "gz", "_r.*")


def starts(low: float, high: float, size: float, overlap: float) -> list[float]:
    """Window starts along an axis at a stride of size - overlap, the last flush with the end."""
    if high - low <= size:
        return [low]
    stride = size - overlap
    out = [low + i * stride for i in range(int(math.floor((high - low - size + 1e-6) / stride)) + 1)]
    return out if abs(out[-1] - (high - size)) <= 1e-6 else [*out, high - size]


def owners(begin: Sequence[float], size: float, low: float, high: float) -> list[tuple[float, float]]:
    """The interval that each window owns: from midpoint to midpoint of the centres, the ends open to the bounds."""
    mid = [(a + b) / 2 + size / 2 for a, b in zip(begin, begin[1:])]
    return list(zip([low, *mid], [*mid, high], strict=True))


def windows(df: DataFrame, axis: str, size: float, stride: float, low: float, high: float, name: str = "window") -> DataFrame:
    """Each row once for every window whose closed span holds it, with ``owner``: whether the window owns it.

    Windows are found by arithmetic, so there is no join; the last window is the one flush with the end.
    """
    begin = starts(low, high, size, size - stride)
    spans = [F.struct(F.lit(i).alias("i"), F.lit(a).alias("a"), F.lit(o[0]).alias("low"), F.lit(o[1]).alias("high")) for i, (a, o) in enumerate(zip(begin, owners(begin, size, low, high), strict=True))]
    v, last = F.col(axis), len(begin) - 1
    held = df.withColumn("_w", F.explode(F.filter(F.array(*spans), lambda s: (v >= s["a"]) & (v <= s["a"] + size))))
    own = (v >= F.col("_w.low")) & ((v < F.col("_w.high")) | ((F.col("_w.i") == last) & (v <= F.col("_w.high"))))
    return held.withColumn(name, F.col("_w.i")).withColumn("owner", own).drop("_w")


def tiles(df: DataFrame, size: float, halo: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each row in its own world-aligned core tile and in those whose halo it lies in; ``owner`` marks the former."""

    def span(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))

    out = df.withColumn("tile_x", F.explode(span(x))).withColumn("tile_y", F.explode(span(y)))
    return out.withColumn("owner", (F.col("tile_x") == F.floor(F.col(x) / size)) & (F.col("tile_y") == F.floor(F.col(y) / size)))
