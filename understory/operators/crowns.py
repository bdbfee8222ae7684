"""Outlines of merged crowns: the hull of what supports them, the cells that a head predicts for them, or both together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.checkpoint import cut
from .kernels import cleaned_footprints, outlines
from .polygons import RINGS, overlaps, rings, shapes


def hull_shapes(points: DataFrame, label: str, by: str = "dataset_id") -> DataFrame:
    """(by, id, rings, area) of each label's convex hull; labels whose points lie on one line have none."""
    after = F.concat(F.slice("corners", 2, F.size("corners") - 1), F.slice("corners", 1, 1))
    parts = F.zip_with("corners", after, lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]) / 2)
    area = F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)
    return outlines(points, label, by).select(by, F.col(label).alias("id"), F.array("corners").cast(RINGS).alias("rings"), area.alias("area"))


def head_shapes(cells: DataFrame, label: str, size: float, by: str = "dataset_id") -> DataFrame:
    """(by, id, rings, area) of each label's cells (row, col) of ``size``, closed and filled, the largest part; no holes are left."""
    return shapes(rings(cleaned_footprints(cells, label, by=by), label, eight=True, by=by), label, by, size)


def crown_areas(points: DataFrame, cells: DataFrame, label: str, size: float, by: str = "dataset_id", bucket: float = 16.0) -> DataFrame:
    """(by, label, support_hull, head, head_union_support): the area of each label's crown under the three modes.

    ``points``: by, label, x, y, those that the merge gave to a label; ``cells``: by, label, row, col, of the proposals of
    the label's group, repeats allowed. Labels are unique within a plot. The union's area is exact: both areas without
    what they share; where they share nothing the larger one is the crown. Where one shape is missing the other serves
    for all three; labels with neither have no row. A gap that hull and cells enclose together stays open.
    """
    hull = hull_shapes(points, label, by).withColumn("_crown", F.xxhash64(by, "id"))
    head = head_shapes(cells.select(by, label, "row", "col").distinct(), label, size, by).withColumn("_crown", F.xxhash64(by, "id"))
    hull, head = cut(hull), cut(head)
    shared = overlaps(hull, head, bucket, "_crown").where("a = b").select("_crown", "shared_area")
    one = lambda df, n: df.select(by, F.col("id").alias(label), "_crown", F.col("area").alias(n))
    both = one(hull, "_hull").join(one(head, "_head"), [by, label, "_crown"], "full").join(shared, "_crown", "left")
    union = F.when(F.col("shared_area").isNull(), F.greatest("_hull", "_head")).otherwise(F.col("_hull") + F.col("_head") - F.col("shared_area"))
    return both.select(by, label, F.coalesce("_hull", "_head").alias("support_hull"), F.coalesce("_head", "_hull").alias("head"), union.alias("head_union_support"))
