"""Crowns by marker-controlled watershed, also of scenes in tiles whose seams are checked.

Within one grid the flood follows a fixed contract: the heap's order among equal heights, markers column by column
from the west and in each from the north, the nearest marker of the flooded neighbours, sides before corners. Cells
below the least height are flooded at height zero and then dropped, so canopy apart from any marker is reached over them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.checkpoint import cut
from . import grid


class Heap:
    """Cells by height. Equal heights come out as they lie in a binary heap in an array, whose moves the contract fixes.

    A new cell rises past strictly lower ones. When the highest leaves, the last cell sinks from the top: it counts in
    single precision, gives way to strictly higher children, and of two equal ones to the right one.
    """

    def __init__(self) -> None:
        self.heights: list[float] = []
        self.cells: list[int] = []

    def __bool__(self) -> bool:
        return bool(self.cells)

    def put(self, height: float, cell: int) -> None:
        self.heights.append(height)
        self.cells.append(cell)
        at = len(self.cells) - 1
        while at and self.heights[(at - 1) // 2] < height:
            self._copy((at - 1) // 2, at)
            at = (at - 1) // 2
        self.heights[at], self.cells[at] = height, cell

    def take(self) -> int:
        found, height, cell = self.cells[0], self.heights.pop(), self.cells.pop()
        n, at, weight = len(self.cells), 0, float(np.float32(height))
        while (child := 2 * at + 1) < n:
            right = child + 1
            if right < n and self.heights[right] > weight:
                child = child if self.heights[child] > self.heights[right] else right
            elif self.heights[child] <= weight:
                break
            self._copy(child, at)
            at = child
        if n:
            self.heights[at], self.cells[at] = height, cell
        return found

    def _copy(self, source: int, target: int) -> None:
        self.heights[target], self.cells[target] = self.heights[source], self.cells[source]


def flooded(height: np.ndarray, markers: Sequence[tuple[int, int]]) -> np.ndarray:
    """For every cell of a grid (rows from the north) the number of its marker in their order here, or -1 without markers."""
    rows, cols = height.shape
    wide = cols + 2  # with a border that is never free, so cells are numbers and neighbours differences
    around = (-wide, wide, -1, 1, -wide - 1, wide - 1, -wide + 1, wide + 1)
    value = np.pad(height.astype(float), 1).ravel().tolist()
    free = np.pad(np.ones(height.shape, bool), 1).ravel().tolist()  # neither a marker nor queued yet
    owner = [-1] * len(value)
    at = [((r + 1) * wide + c + 1, i) for i, (r, c) in enumerate(markers)]
    for cell, i in at:
        owner[cell], free[cell] = i, False
    heap = Heap()

    def queue(cell: int) -> None:
        for step in around:
            if free[cell + step]:
                free[cell + step] = False
                heap.put(value[cell + step], cell + step)

    for cell, _ in sorted(at, key=lambda x: (x[0] % wide, x[0])):
        queue(cell)
    while heap:
        cell = heap.take()
        r, c = cell // wide - 1, cell % wide - 1
        met = [i for step in around if (i := owner[cell + step]) >= 0]
        queue(cell)
        owner[cell] = min(met, key=lambda i: (r - markers[i][0]) ** 2 + (c - markers[i][1]) ** 2)  # the first of equals
    return np.array(owner).reshape(rows + 2, wide)[1:-1, 1:-1]


def watershed(raster: DataFrame, tops: DataFrame, least: float, value: str = "chm", by: str = "dataset_id") -> DataFrame:
    """(by, row, col, tree_id): crowns that grow from the tops (by, row, col, tree_id) over the grid of each ``by``.

    Rows count to the north. A group of ``by`` is one task: for scenes see ``scene``. Cells that are not given count as
    empty; a group without tops or without cells of ``least`` height gives no rows.
    """
    return _labelled(raster, tops, least, value, by).where("tree_id IS NOT NULL")


def _labelled(raster: DataFrame, tops: DataFrame, least: float, value: str, by: str) -> DataFrame:
    """All cells of ``least`` height; tree_id is null where the group has no top."""

    def run(cells: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or seeds.empty:
            high = cells[cells[value] >= least]
            return high[[by, "row", "col"]].assign(tree_id=pd.array([None] * len(high), "Int64"))
        r, c = (np.concatenate([cells[a], seeds[f"top_{a}"]]).astype(int) for a in ("row", "col"))
        north, west = r.max(), c.min()
        height = np.zeros((north - r.min() + 1, c.max() - west + 1))
        high = cells[cells[value] >= least]
        height[north - high["row"], high["col"] - west] = high[value]
        owner = flooded(height, list(zip((north - seeds["top_row"]).tolist(), (seeds["top_col"] - west).tolist(), strict=True)))
        mine = owner[north - high["row"], high["col"] - west]
        return pd.DataFrame({by: cells[by].iloc[0], "row": high["row"], "col": high["col"], "tree_id": seeds["tree_id"].to_numpy()[mine]})

    kind = dict(raster.dtypes)[by]
    # the tops' columns are new ones: tops found in the raster itself may share its columns, which a cogroup mixes up
    asked = tops.select(F.col(by).alias(by), F.col("row").alias("top_row"), F.col("col").alias("top_col"), F.col("tree_id").alias("tree_id"))
    return raster.select(by, "row", "col", value).groupBy(by).cogroup(asked.groupBy(by)).applyInPandas(run, f"{by} {kind}, row bigint, col bigint, tree_id bigint")


def _dealt(cells: DataFrame, size: float, halo: float, by: str) -> DataFrame:
    t = grid.tiles(cells, size, halo, "col", "row").withColumn("tile", F.concat_ws(":", by, "tile_x", "tile_y"))
    return t.drop("tile_x", "tile_y", "owner", by)


def seams(labels: DataFrame, size: float, by: str = "dataset_id") -> DataFrame:
    """(by, a, b, cells, differ): for tiles a and b, how many cells of a's core b has labelled too, and how many otherwise.

    ``labels``: by, tile, halo, row, col, tree_id. The outer half of a halo is not asked: what grows there may have
    its top outside.
    """
    place = lambda c: F.floor(F.col(c) / size).cast("string")
    core = F.concat_ws(":", by, place("col"), place("row"))
    tx, ty = (F.split("tile", ":")[i].cast("bigint") * size for i in (1, 2))
    half = F.col("halo") / 2
    near = (F.col("col") >= tx - half) & (F.col("col") < tx + size + half) & (F.col("row") >= ty - half) & (F.col("row") < ty + size + half)
    asked = labels.withColumn("core", core).where(near)
    own = asked.where("tile = core").select(by, "row", "col", F.col("tile").alias("a"), F.col("tree_id").alias("mine"))
    other = asked.where("tile <> core").select(by, "row", "col", F.col("tile").alias("b"), F.col("tree_id").alias("theirs"))
    return own.join(other, [by, "row", "col"]).groupBy(by, "a", "b").agg(F.count("*").alias("cells"), F.sum(F.when(F.col("mine").eqNullSafe(F.col("theirs")), 0).otherwise(1)).alias("differ"))


def scene(raster: DataFrame, tops: DataFrame, size: float, halo: float, least: float, value: str = "chm", by: str = "dataset_id") -> tuple[DataFrame, DataFrame]:
    """(by, row, col, tree_id) of whole scenes flooded in tiles, and the seams (by, a, b, cells, differ) at the end.

    Every tile is flooded with its halo by itself, and each cell has the label of the tile in whose core it lies;
    tree_id is unique within ``by``, so crowns join over tile edges by themselves. Where two tiles label a cell of
    their seam otherwise, both are flooded again with twice the halo, until all seams agree. A task holds a tile and
    its halo, which grows only beside seams that differ; once it covers the scene, seams agree.
    """
    settled, wide = None, halo
    todo = None
    while True:
        cells, seeds = _dealt(raster.select(by, "row", "col", value), size, wide, by), _dealt(tops.select(by, "row", "col", "tree_id"), size, wide, by)
        if todo is not None:
            cells, seeds = cells.join(todo, "tile", "left_semi"), seeds.join(todo, "tile", "left_semi")
        found = _labelled(cells, seeds, least, value, "tile").withColumn("halo", F.lit(wide))
        found = found.withColumn(by, F.split("tile", ":")[0].cast(dict(raster.dtypes)[by]))
        if todo is not None:
            found = found.unionByName(settled.join(todo, "tile", "left_anti"))
        settled = cut(found)
        edge = cut(seams(settled, size, by))
        differ = edge.where("differ > 0")
        if differ.isEmpty():
            core = (F.split("tile", ":")[1].cast("bigint") == F.floor(F.col("col") / size)) & (F.split("tile", ":")[2].cast("bigint") == F.floor(F.col("row") / size))
            return settled.where(core & F.col("tree_id").isNotNull()).select(by, "row", "col", "tree_id"), edge
        todo = cut(differ.select(F.explode(F.array("a", "b")).alias("tile")).distinct())
        wide *= 2
