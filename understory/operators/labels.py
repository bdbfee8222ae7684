"""Label columns: tri-state targets, exclusions, majorities and partition diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.checkpoint import cut
from .graph import components


def annotation_targets(ids: Column, classes: Column, partial_zero: bool = False, bush_ids: Sequence[int] = (), height: Column | None = None) -> tuple[Column, Column]:
    """Instance (-1 unknown, 0 background, above: tree) and semantic (-1, 0, 1) targets.

    Later rules win: trees, then background (ground classes, bushes, flat zeros), then outside (class 3).
    """
    tree = (ids > 0) & ~classes.isin(1, 2, 3)
    ground = classes.isin(1, 2)
    if partial_zero and height is not None:
        ground = ground | ((ids == 0) & (F.abs(height) <= 0.05))
    if bush_ids:
        ground = ground | ids.isin(*bush_ids)
    outside = classes == 3
    instance = F.when(outside, -1).when(ground, 0).when(tree, ids).otherwise(-1)
    semantic = F.when(outside, -1).when(ground, 0).when(tree | classes.isin(4, 5, 6), 1).otherwise(-1)
    return instance, semantic


def whole_number(value: Column) -> Column:
    """Whether a stored float is a whole number within 1e-6."""
    return F.abs(value - F.rint(value)) <= 1e-6


def without_cut_instances(points: DataFrame, label: str, box: tuple[float, float, float, float], margin: float, by: str = "dataset_id") -> DataFrame:
    """Labels of instances that touch the margin of the box become -1: unknown, not background."""
    left, bottom, right, top = box
    edge = points.where(F.col(label) > 0).groupBy(by, label).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("e"))
    out = edge.where((F.col("a") <= left + margin) | (F.col("b") >= right - margin) | (F.col("c") <= bottom + margin) | (F.col("e") >= top - margin)).select(by, label, F.lit(True).alias("_cut"))
    # background and unknown points are no instance: as one key each they would be one task's
    held = points.where(F.col(label) > 0).join(out, [by, label], "left").withColumn(label, F.when(F.col("_cut"), -1).otherwise(F.col(label))).select(*points.columns)
    return held.unionByName(points.where(F.coalesce(F.col(label) <= 0, F.lit(True))))


def majority(points: DataFrame, group: str, label: str = "truth") -> DataFrame:
    """(group, label): the most frequent known label, ties to the smaller; a group without one gets 0."""
    known = points.groupBy(group, label).agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col(label) >= 0, F.struct("n", (-F.col(label)).alias("m"))))
    return known.groupBy(group).agg(best.alias("_b")).select(group, F.coalesce(-F.col("_b.m"), F.lit(0)).alias(label))


def partition_diagnostics(points: DataFrame, group: str, edges: DataFrame, label: str = "truth") -> DataFrame:
    """One row: how well groups of points keep instances apart.

    ``edges``: src, dst of neighbouring points. A boundary is an edge between two trees; it is recalled if its ends are
    in different groups. Unknown labels count for sizes only.
    """
    sizes = points.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col(label) >= 0, F.col(label))).alias("labels"))
    s = sizes.agg(F.sum("n").alias("points"), F.count("*").alias("groups"), F.median("n").alias("median_points"), F.percentile("n", F.lit(0.95)).alias("p95_points"), F.try_divide(F.count_if(F.expr("labels > 1")), F.count_if(F.expr("labels > 0"))).alias("mixed_share"))
    best = majority(points, group, label).withColumnRenamed(label, "_m")
    known = points.where(F.col(label) >= 0).join(best, group)
    purity = known.agg(F.try_divide(F.count_if(F.col(label) == F.col("_m")), F.count("*")).alias("purity"))
    side = lambda k: points.select(F.col("pid").alias(k), F.col(label).alias(f"{k}_l"), F.col(group).alias(f"{k}_g"))
    cross = edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst").where("src_l > 0 AND dst_l > 0 AND src_l <> dst_l")
    b = cross.agg(F.count("*").alias("boundary_pairs"), F.try_divide(F.count_if(F.col("src_g") != F.col("dst_g")), F.count("*")).alias("boundary_recall"))
    return s.withColumn("compression", F.col("points") / F.col("groups")).join(F.broadcast(purity)).join(F.broadcast(b))


def split_instances(points: DataFrame, group: str, edges: DataFrame, label: str = "truth") -> DataFrame:
    """(label, groups, parts): of each instance's groups by majority, how many parts neighbouring groups fall into."""
    best = majority(points, group, label)
    at = points.select("pid", F.col(group).alias("g"))
    near = edges.select("src", "dst").join(at.select(F.col("pid").alias("src"), F.col("g").alias("a")), "src").join(at.select(F.col("pid").alias("dst"), F.col("g").alias("b")), "dst").select("a", "b").where("a <> b").distinct()
    l1, l2 = best.select(F.col(group).alias("a"), F.col(label).alias("la")), best.select(F.col(group).alias("b"), F.col(label).alias("lb"))
    same = near.join(l1, "a").join(l2, "b").where("la = lb AND la > 0").select("a", "b")
    roots = components(cut(same), "a", "b")
    placed = best.where(F.col(label) > 0).join(roots, F.col(group) == F.col("node"), "left").select(label, group, F.coalesce("root", group).alias("part"))
    return placed.groupBy(label).agg(F.count("*").alias("groups"), F.countDistinct("part").alias("parts"))
