"""Running a model over windows of points, every point being written once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.checkpoint import cut
from . import grid


def by_windows(points: DataFrame, size: float, halo: float, scorer: Callable[[pd.DataFrame], pd.Series], columns: Sequence[str], by: str = "dataset_id", id: str = "pid") -> DataFrame:
    """(by, id, score): ``scorer`` sees each window with its halo, and the window's own points keep their scores.

    A window is one task's frame: its size bounds what a task holds, and points that crowd into one window make it
    smaller. Every point must come out exactly once, else this fails.
    """
    held = grid.tiles(points.select(by, id, "x", "y", *(c for c in columns if c not in ("x", "y"))), size, halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["owner"].to_numpy()
        return pd.DataFrame({by: pdf[by][own], id: pdf[id][own], "score": scorer(pdf[list(columns)])[own].astype(float)})

    kinds = dict(points.dtypes)
    out = cut(held.groupBy(by, "tile_x", "tile_y").applyInPandas(run, f"{by} {kinds[by]}, {id} {kinds[id]}, score double"))
    once = out.groupBy(by, id).agg(F.count("*").alias("n")).agg(F.count("*").alias("k"), F.coalesce(F.max("n"), F.lit(1)).alias("most")).first()
    if once["most"] != 1 or once["k"] != points.count():
        raise ValueError("some points were written more or less than once")
    return out
