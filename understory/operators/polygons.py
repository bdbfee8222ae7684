"""Polygons: rings of cell sets with their holes, overlap areas of any polygons, and clipping.

A cell (row, col) is the square from (col, row) to (col + 1, row + 1). Rings run with the inside on their left, so
outer rings turn to the left and have positive areas, holes negative ones. A side of a cell is on the boundary if no
other cell of the set has it, and every boundary side knows the one that follows it. Sides are followed in blocks of
cells, a group each; only paths that leave a block find each other by pointer doubling: joins of all rings at once, in
as many rounds as the number of pieces of the longest ring has binary digits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.checkpoint import cut
from .greedy import followed
from .grid import small

WIDE = 4096  # widths between upright sides that are compared at once
BLOCK = 128  # cells on a side of a block whose paths are followed in one group
HALF = 1 << 28  # places are packed as if they began at -HALF
STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))  # east, north, west, south
RINGS = "array<array<struct<x:double,y:double>>>"


def _number(x: np.ndarray, y: np.ndarray, way: np.ndarray | int) -> np.ndarray:
    return ((y + HALF) << 33) + ((x + HALF) << 2) + way


def paths(row: np.ndarray, col: np.ndarray, bottom: int, left: int, eight: bool, block: int) -> pa.Table:
    """The boundary of the cells of one block, as paths that close in it or leave it.

    A side has its inside on its left. It and the one after it depend on the cells around its end only, so a block of
    ``block`` by ``block`` cells from (``bottom``, ``left``) needs one row and column of cells more all round. A path
    is named by its ``first`` side; ``next`` is the side after its last one, null if the path closes. ``held``: the
    path at whose side the run of cells begins that lies west of the westmost side, null if it begins outside;
    ``part``: the outer ring around, if it is all in the block; ``runs``: rows in which a run begins at the path and
    goes on east of the block.
    """
    grid = np.zeros((block + 2, block + 2), bool)
    grid[row - bottom + 1, col - left + 1] = True
    own_r, own_c = np.nonzero(grid[1:-1, 1:-1])
    dx, dy = np.array(STEPS).T
    sides = [(own_r[free] + 1, own_c[free] + 1, np.full(free.sum(), w)) for w in range(4) for free in [~grid[own_r + 1 + dy[w - 1], own_c + 1 + dx[w - 1]]]]
    r, c, way = map(np.concatenate, zip(*sides, strict=True))
    x, y = c + left - 1 + np.isin(way, (1, 2)), r + bottom - 1 + np.isin(way, (2, 3))
    number = _number(x, y, way)
    order = np.argsort(number)
    r, c, way, x, y, number = (v[order] for v in (r, c, way, x, y, number))
    right = (way + 3) % 4
    ahead, aslant = grid[r + dy[way], c + dx[way]], grid[r + dy[way] + dy[right], c + dx[way] + dx[right]]
    over = aslant if eight else ahead & aslant  # on to the cell ahead on the right, else straight on, else round the own cell
    on = (ahead | over) * 1
    next_r, next_c = r + dy[way] * on + dy[right] * over, c + dx[way] * on + dx[right] * over
    next_way = np.where(over, right, np.where(ahead, way, (way + 1) % 4))
    turn, after = next_way != way, _number(x + dx[way], y + dy[way], next_way)
    inside = (next_r >= 1) & (next_r <= block) & (next_c >= 1) & (next_c <= block)
    follow = np.where(inside, np.searchsorted(number, after), -1)
    led = np.zeros(len(way), bool)
    led[follow[inside]] = True
    steps, path_of, places, begins = follow.tolist(), [-1] * len(way), [], []
    for first in [*np.flatnonzero(~led).tolist(), *range(len(way))]:  # in order of numbers, so a closed path begins with its least side
        if path_of[first] < 0:
            begins.append(len(places))
            at = first
            while at >= 0 and path_of[at] < 0:
                path_of[at] = len(begins) - 1
                places.append(at)
                at = steps[at]
    place, cuts = np.array(places, np.int64), np.array(begins, np.int64)
    if not len(cuts):
        return pa.Table.from_pylist([], PATH)
    ends = np.append(cuts[1:], len(place)) - 1
    closed = follow[place[ends]] >= 0
    area = np.add.reduceat(np.where(way == 1, x, np.where(way == 3, -x, 0))[place], cuts)
    least = np.minimum.reduceat(number[place], cuts)
    bent = np.concatenate([[0], np.cumsum(turn[place])])
    skip = np.zeros(len(cuts), np.int64)
    for p in np.flatnonzero(~closed).tolist():
        skip[p] = bent[cuts[p] + number[place[cuts[p] : ends[p] + 1]].argmin()] - bent[cuts[p]]
    turns = place[turn[place]]
    west = np.minimum.reduceat(np.where(way == 1, ((x + HALF) << 30) + y + HALF, np.iinfo(np.int64).max)[place], cuts)

    def begun(at_r: int, at_c: int) -> int | None:
        """The path at whose side the run of cells begins that ends at a cell."""
        gap = np.flatnonzero(~grid[at_r, : at_c + 1])
        return path_of[np.searchsorted(number, _number(gap[-1] + left, at_r + bottom, 3))] if len(gap) else None

    n = len(cuts)
    around: list[int | None] = [None] * n
    known = west < np.iinfo(np.int64).max
    wx, wy = (west >> 30) - HALF, (west & ((1 << 30) - 1)) - HALF
    for p in np.flatnonzero(known & (~closed | (area < 0))).tolist():
        around[p] = begun(int(wy[p]) - bottom + 1, int(wx[p]) - left)
    first = number[place[cuts]]
    part: list[int | None] = first.tolist()
    head = first.tolist()
    for p in np.flatnonzero(~closed | (area < 0)).tolist():
        q: int | None = p
        while q is not None and closed[q] and area[q] < 0:
            q = around[q]
        part[p] = head[q] if q is not None and closed[q] else None
        head[p] = head[p] if part[p] is None else part[p]
    runs: list[list[int]] = [[] for _ in range(n)]
    for at_r in (np.flatnonzero(grid[1:-1, -2] & grid[1:-1, -1]) + 1).tolist():
        if (p := begun(at_r, block)) is not None:
            runs[p].append(at_r + bottom - 1)
    corners = pa.ListArray.from_arrays(pa.array(np.append(bent[cuts], bent[-1]), pa.int32()), pa.array(_number(x[turns] + dx[way[turns]], y[turns] + dy[way[turns]], 0)))
    held = [None if q is None else head[q] for q in around]
    columns = [first, pa.array(after[place[ends]], mask=closed), least, ends - cuts + 1, area, skip, corners, pa.array(wx, mask=~known), pa.array(wy, mask=~known), pa.array(held, pa.int64()), pa.array(part, pa.int64()), pa.array(runs, pa.list_(pa.int64()))]
    return pa.Table.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in columns], schema=PATH)


PATH = pa.schema([*((n, pa.int64()) for n in ("first", "next", "least", "sides", "area", "skip")), ("corners", pa.list_(pa.int64())), *((n, pa.int64()) for n in ("wx", "wy", "held", "part")), ("runs", pa.list_(pa.int64()))])


def traced(cells: DataFrame, label: str, eight: bool, by: str, block: int) -> DataFrame:
    """(by, label, bc, ...): the ``paths`` of each label's blocks; ``bc`` is the block's place among columns."""
    dealt = cells.select(by, label, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"))
    for axis, key in (("row", "_br"), ("col", "_bc")):
        dealt = dealt.withColumn(key, F.explode(F.sequence(F.floor((F.col(axis) - 1) / block), F.floor((F.col(axis) + 1) / block))))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        plot, name, br, bc = key
        found = paths(t.column("row").to_numpy(), t.column("col").to_numpy(), br.as_py() * block, bc.as_py() * block, eight, block)
        same = lambda v, kind: pa.array([v.as_py()] * len(found), kind)
        return pa.table([same(plot, plot.type), same(name, name.type), same(bc, pa.int64()), *found.columns], names=[by, label, "bc", *PATH.names])

    kinds = dict(cells.dtypes)
    own = ", ".join(f"{f.name} {'array<bigint>' if pa.types.is_list(f.type) else 'bigint'}" for f in PATH)
    return dealt.groupBy(by, label, "_br", "_bc").applyInArrow(run, f"{by} {kinds[by]}, {label} {kinds[label]}, bc bigint, {own}")


def placed(pieces: DataFrame, label: str, by: str) -> DataFrame:
    """(by, label, first, ring, place): the ring that pieces (first, next, least) make, and their places in it from the least side on."""
    now = pieces.select(by, label, "first", F.col("next").alias("jump"), F.col("least").alias("ring"), F.lit(0).cast("bigint").alias("ahead"))
    now, length = cut(now), 1
    while True:
        far = now.select(by, label, F.col("first").alias("jump"), F.col("jump").alias("_j"), F.col("ring").alias("_r"), F.col("ahead").alias("_a"))
        lower = F.col("_r") < F.col("ring")
        now = cut(now.join(far, [by, label, "jump"]).select(by, label, "first", F.col("_j").alias("jump"), F.least("ring", "_r").alias("ring"), F.when(lower, F.col("_a") + length).otherwise(F.col("ahead")).alias("ahead"), lower.alias("moved")))
        if now.where("moved").isEmpty():
            break
        now, length = now.drop("moved"), length * 2
    sizes = now.groupBy(by, label, "ring").agg(F.count("*").alias("_n"))
    return cut(now.join(sizes, [by, label, "ring"]).select(by, label, "first", "ring", F.pmod(F.col("_n") - F.col("ahead"), F.col("_n")).alias("place")))


def rings(cells: DataFrame, label: str, eight: bool = False, by: str = "dataset_id", block: int = BLOCK) -> DataFrame:
    """(by, label, part, ring, hole, area, sides, corners) of the polygons of each label's cells.

    Parts are cells connected over sides (or also corners, if ``eight``); ``part`` is the id of its outer ring.
    ``area`` counts cells, holes negatively. Repeated cells count once; no cells give no rings.
    Sides are followed in blocks of ``block`` by ``block`` cells.
    """
    found = cut(traced(cells, label, eight, by, block))
    pieces = found.where("next IS NOT NULL")
    own = placed(pieces, label, by)
    west = F.when(F.col("wx").isNotNull(), F.struct("wx", "wy", "bc", "held"))
    whole = found.where("next IS NULL").select(by, label, F.col("least").alias("ring"), "area", "sides", "corners", west.alias("west"), "part")
    made = pieces.join(own, [by, label, "first"]).groupBy(by, label, "ring").agg(F.sum("area").alias("area"), F.sum("sides").alias("sides"), F.array_sort(F.collect_list(F.struct("place", "skip", "corners"))).alias("_p"), F.min(west).alias("west"))
    all_, skip = F.flatten(F.col("_p.corners")), F.get("_p", F.lit(0))["skip"].cast("int")
    turned = F.concat(F.slice(all_, skip + 1, F.size(all_)), F.slice(all_, F.lit(1), skip))  # from the least side on
    joined = cut(made.select(by, label, "ring", "area", "sides", turned.alias("corners"), "west", F.when(F.col("area") > 0, F.col("ring")).alias("part")))
    both = whole.unionByName(joined)
    # west of a hole's westmost cell side lies a run of cells, and its first side is of the ring around, or of a hole farther west
    lost = both.where("part IS NULL").select(by, label, "ring", "west.*")
    runs = found.select(by, label, F.col("bc").alias("rc"), F.coalesce("part", "first").alias("head"), F.explode("runs").alias("wy"))
    beyond = lost.where("held IS NULL").join(runs, [by, label, "wy"]).where("rc < bc").groupBy(by, label, "ring").agg(F.max_by("head", "rc").alias("held"))
    hooks = lost.where("held IS NOT NULL").select(by, label, "ring", "held").unionByName(beyond).withColumnRenamed("ring", "child")
    hooks = hooks.join(own.select(by, label, F.col("first").alias("held"), "ring"), [by, label, "held"], "left").select(by, label, "child", F.coalesce("ring", "held").alias("parent"))
    parts = followed(hooks, by, label).select(by, label, F.col("child").alias("ring"), F.col("parent").alias("part"))
    known = both.where("part IS NOT NULL").drop("west").unionByName(both.where("part IS NULL").drop("west", "part").join(parts, [by, label, "ring"]))
    at = lambda v: F.struct((F.shiftright(v, 2).bitwiseAND((1 << 31) - 1) - HALF).cast("double").alias("x"), (F.shiftright(v, 33) - HALF).cast("double").alias("y"))
    return known.select(by, label, "part", "ring", (F.col("area") < 0).alias("hole"), "area", "sides", F.transform("corners", at).alias("corners"))


def shapes(found: DataFrame, label: str, by: str = "dataset_id", size: float = 1.0) -> DataFrame:
    """(by, id, rings, area): one shape a label of all its rings, in map units of ``size`` a cell."""
    scaled = F.transform("corners", lambda c: F.struct((c["x"] * size).alias("x"), (c["y"] * size).alias("y")))
    return found.groupBy(by, F.col(label).alias("id")).agg(F.collect_list(scaled).cast(RINGS).alias("rings"), (F.sum("area") * size * size).alias("area"))


# geometry of any rings, in Arrow batches


def edges(rings_: Sequence[Sequence[dict]]) -> np.ndarray:
    """Rows (x1, y1, x2, y2) of the sides of all rings; level ones bound no area and are left out."""
    out = [np.concatenate([p, np.roll(p, -1, axis=0)], axis=1) for r in rings_ if len(r) > 2 for p in [np.array([(c["x"], c["y"]) for c in r], float)]]
    all_ = np.concatenate(out) if out else np.zeros((0, 4))
    return all_[all_[:, 1] != all_[:, 3]]


def _spans(e: np.ndarray, y: float) -> np.ndarray:
    """Where a level line enters and leaves the shape, in pairs."""
    cut_ = e[(e[:, 1] > y) != (e[:, 3] > y)]
    return np.sort(cut_[:, 0] + (y - cut_[:, 1]) * (cut_[:, 2] - cut_[:, 0]) / (cut_[:, 3] - cut_[:, 1]))


def _meetings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which a side of one shape crosses a side of the other. Two upright sides never do."""
    upright = a[:, 0] == a[:, 2]
    return np.concatenate([_crossings(a[~upright], b), _crossings(a[upright], b[b[:, 0] != b[:, 2]])])


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros(0)
    p, q = a[:, None, :], b[None, :, :]
    slope_p, slope_q = (p[..., 2] - p[..., 0]) / (p[..., 3] - p[..., 1]), (q[..., 2] - q[..., 0]) / (q[..., 3] - q[..., 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        y = (q[..., 0] - p[..., 0] + slope_p * p[..., 1] - slope_q * q[..., 1]) / (slope_p - slope_q)
    low = np.maximum(np.minimum(p[..., 1], p[..., 3]), np.minimum(q[..., 1], q[..., 3]))
    high = np.minimum(np.maximum(p[..., 1], p[..., 3]), np.maximum(q[..., 1], q[..., 3]))
    return y[np.isfinite(y) & (y > low) & (y < high)]


def shared_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area inside both shapes, given by their sides; even-odd, so holes and several parts are part of a shape.

    Between two heights where a side begins, ends or crosses one of the other shape, widths are linear in the height:
    the width half-way up is the mean one.
    """
    if not len(a) or not len(b):
        return 0.0
    low, high = max(a[:, [1, 3]].min(), b[:, [1, 3]].min()), min(a[:, [1, 3]].max(), b[:, [1, 3]].max())
    if low >= high:
        return 0.0
    levels = np.unique(np.concatenate([a[:, [1, 3]].ravel(), b[:, [1, 3]].ravel(), _meetings(a, b)]))
    levels = levels[(levels >= low) & (levels <= high)]
    total = 0.0
    for y0, y1 in zip(levels[:-1], levels[1:]):
        u, v = _spans(a, (y0 + y1) / 2).reshape(-1, 2), _spans(b, (y0 + y1) / 2).reshape(-1, 2)
        wide = np.minimum(u[:, None, 1], v[None, :, 1]) - np.maximum(u[:, None, 0], v[None, :, 0])
        total += float(np.maximum(wide, 0).sum()) * (y1 - y0)
    return total


def boxed(found: DataFrame) -> DataFrame:
    """``found`` with left, bottom, right and top of its ``rings``."""
    corners = F.flatten("rings")
    ends = {"left": ("x", F.array_min), "bottom": ("y", F.array_min), "right": ("x", F.array_max), "top": ("y", F.array_max)}
    return found.withColumns({n: f(corners[axis]) for n, (axis, f) in ends.items()})


def drawn(found: DataFrame, by: str = "dataset_id") -> DataFrame:
    """(by, id, area, left, bottom, right, top, sides) of shapes with corners: their sides as compressed numbers, as they are sent more than once."""
    kind = dict(found.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            sides, of = ring_sides(t.column("rings"))
            first = np.searchsorted(of, np.arange(len(t) + 1))
            thin = pa.array([zlib.compress(np.ascontiguousarray(sides[i:j].T).tobytes(), 1) for i, j in zip(first[:-1], first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (by, "id", "area", "left", "bottom", "right", "top")), thin], names=[by, "id", "area", "left", "bottom", "right", "top", "sides"])

    boxes = boxed(found).where("left IS NOT NULL").withColumn("area", F.col("area").cast("double"))
    return boxes.mapInArrow(run, f"{by} {kind[by]}, id {kind['id']}, area double, left double, bottom double, right double, top double, sides binary")


def meeting(a: DataFrame, b: DataFrame, size: float, by: str = "dataset_id", crowd: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Both sides' shapes with the pairs of crowds (by, ca, cb) in which they may meet, each pair of shapes in one of them.

    A crowd is up to about ``crowd`` shapes of one side whose boxes begin in the same bucket of ``size``. Crowds are
    joined where their own boxes overlap, on buckets again, and a shape is sent once for each crowd that its own meets:
    not once for each shape, as it would be where many lie in one place.
    """
    ends = ("left", "bottom", "right", "top")
    begin = lambda c: F.floor(F.col(c) / size)
    at = [by, "_bx", "_by"]

    def crowds(t: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        boxes = t if "left" in t.columns else boxed(t).where("left IS NOT NULL")
        placed_ = boxes.withColumn("_bx", begin("left")).withColumn("_by", begin("bottom"))
        n = small(placed_.groupBy(*at).agg(F.count("*").alias("_n")))
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / crowd)).alias("_k")
        own = placed_.join(n, at).select("*", F.struct("_bx", "_by", part).alias(name)).drop("_bx", "_by", "_n")
        box = own.groupBy(by, name).agg(*(f(c).alias(c) for c, f in zip(ends, (F.min, F.min, F.max, F.max), strict=True)))
        span = lambda lo, hi: F.explode(F.sequence(begin(lo), begin(hi)))
        return own, box.withColumn("_bx", span("left", "right")).withColumn("_by", span("bottom", "top")).select(*at, name, F.struct(*ends).alias(f"_{name}"))

    (la, ba), (lb, bb) = crowds(a, "ca"), crowds(b, "cb")
    met = small(ba.join(bb, at).where("_ca.left < _cb.right AND _cb.left < _ca.right AND _ca.bottom < _cb.top AND _cb.bottom < _ca.top").select(by, "ca", "cb").distinct())
    return la.join(met, [by, "ca"]), lb.join(met, [by, "cb"])


def ring_sides(rings_: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x1, y1, x2, y2) of the sides of all shapes' rings, as of ``edges``, in order of the shape each is of, and the places of these."""
    rings_ = rings_.combine_chunks()
    rings_ = rings_.chunk(0) if isinstance(rings_, pa.ChunkedArray) else rings_
    outer, inner = rings_.offsets.to_numpy(), rings_.values.offsets.to_numpy()
    x, y = (rings_.values.values.field(c).to_numpy(zero_copy_only=False) for c in "xy")
    size = np.diff(inner)
    after = np.arange(1, len(x) + 1)
    after[inner[1:][size > 0] - 1] = inner[:-1][size > 0]
    of_ring = np.full(len(size), -1)
    of_ring[outer[0] : outer[-1]] = np.repeat(np.arange(len(rings_)), np.diff(outer))
    at = np.arange(inner[0], inner[-1])
    of = np.repeat(of_ring, size)
    kept = (of >= 0) & np.repeat(size > 2, size) & (y[at] != y[after[at]])
    at, of = at[kept], of[kept]
    order = np.argsort(of, kind="stable")
    at = at[order]
    return np.stack([x[at], y[at], x[after[at]], y[after[at]]], axis=1), of[order]


class Drawn:
    """The shapes of an Arrow table of ``drawn`` ones as arrays: ``sides`` of all, the shape each is ``of``, boxes, and which shapes have upright sides only."""

    def __init__(self, t: pa.Table) -> None:
        each = [np.frombuffer(zlib.decompress(v.as_py())).reshape(4, -1).T for v in t.column("sides")]
        n = len(t)
        self.sides = np.concatenate([np.zeros((0, 4)), *each])
        self.of = np.repeat(np.arange(n), [len(e) for e in each])
        self.first = np.searchsorted(self.of, np.arange(n + 1))
        self.upright = np.bincount(self.of, self.sides[:, 0] != self.sides[:, 2], n) == 0
        self.left, self.bottom, self.right, self.top = (t.column(c).to_numpy() for c in ("left", "bottom", "right", "top"))

    def shape(self, i: int) -> np.ndarray:
        return self.sides[self.first[i] : self.first[i + 1]]

    def standing(self) -> tuple[np.ndarray, ...]:
        """x, lower and upper end, and shape of the sides of the shapes with upright sides only."""
        s, of = self.sides[self.upright[self.of]], self.of[self.upright[self.of]]
        return s[:, 0], np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3]), of


def upright_areas(a: Drawn, b: Drawn) -> np.ndarray:
    """Shared area of every shape of ``a`` with every one of ``b`` that has upright sides only: products of their widths between all levels."""
    out = np.zeros((len(a.left), len(b.left)))
    both = a.standing(), b.standing()
    levels = np.unique(np.concatenate([v for t in both for v in t[1:3]]))
    for low, high in zip(levels[:-1], levels[1:]):
        cut_ = [(t[0][on], t[3][on]) for t in both for on in [(t[1] <= low) & (t[2] >= high)]]
        if not all(len(x) for x, _ in cut_):
            continue
        xs = np.unique(np.concatenate([x for x, _ in cut_]))
        shapes_ = [np.unique(of, return_inverse=True) for _, of in cut_]
        rows = np.ix_(shapes_[0][0], shapes_[1][0])
        held = [np.zeros((len(u), 1)) for u, _ in shapes_]
        for k in range(0, len(xs) - 1, WIDE):
            wide = np.diff(xs[k : k + WIDE + 1])
            covers = []
            for side, ((x, _), (u, row)) in enumerate(zip(cut_, shapes_, strict=True)):
                place = np.searchsorted(xs, x) - k
                on = (place >= 0) & (place < len(wide))
                met = np.bincount(row[on] * len(wide) + place[on], minlength=len(u) * len(wide)).reshape(len(u), len(wide))
                within = (held[side] + np.cumsum(met, axis=1)) % 2
                held[side] = within[:, -1:]
                covers.append(within)
            out[rows] += (covers[0] * wide) @ covers[1].T * (high - low)
    return out


def overlaps(a: DataFrame, b: DataFrame, size: float, by: str = "dataset_id", crowd: int = 1024) -> DataFrame:
    """(by, a, b, shared_area, iou, containment) of all shapes (by, id, rings, area) that share area; exact up to rounding.

    Shapes with upright and level sides only are compared all at once in each pair of crowds, others pair by pair.
    """
    kinds = dict(a.dtypes), dict(b.dtypes)
    left, right = meeting(cut(drawn(a, by)), cut(drawn(b, by)), size, by, crowd)

    def run(s: pa.Table, t: pa.Table) -> pa.Table:
        p, q = Drawn(s), Drawn(t)
        shared = upright_areas(p, q)
        near = (p.left[:, None] < q.right) & (q.left < p.right[:, None]) & (p.bottom[:, None] < q.top) & (q.bottom < p.top[:, None])
        for i, j in zip(*np.nonzero(near & ~(p.upright[:, None] & q.upright))):
            shared[i, j] = shared_area(p.shape(i), q.shape(j))
        i, j = np.nonzero(shared > 0)
        t_ = pa.table([s.column(by).take(pa.array(i)), s.column("id").take(pa.array(i)), t.column("id").take(pa.array(j)), s.column("area").take(pa.array(i)), t.column("area").take(pa.array(j)), pa.array(shared[i, j])], names=[by, "a", "b", "aa", "ab", "shared_area"])
        return pa.concat_tables([t_.slice(k, 100_000) for k in range(0, max(len(t_), 1), 100_000)])  # in batches

    keys = [by, "ca", "cb"]
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, as few bytes are much work here
    dealt = lambda t: t.repartition(parts, *keys).groupBy(*keys)
    found = dealt(left).cogroup(dealt(right)).applyInArrow(run, f"{by} {kinds[0][by]}, a {kinds[0]['id']}, b {kinds[1]['id']}, aa double, ab double, shared_area double")
    s = F.col("shared_area")
    return found.select(by, "a", "b", "shared_area", (s / (F.col("aa") + F.col("ab") - s)).alias("iou"), (s / F.least("aa", "ab")).alias("containment"))


def clip_ring(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex window whose corners turn to the left.

    A ring that leaves the window and comes back elsewhere stays one ring, whose parts are joined along the window's
    side: the area is right, and no area lies between them.
    """
    out = ring
    for p, q in zip(window, np.roll(window, -1, axis=0)):
        if not len(out):
            break
        side = (q[0] - p[0]) * (out[:, 1] - p[1]) - (q[1] - p[1]) * (out[:, 0] - p[0])
        after, after_side = np.roll(out, -1, axis=0), np.roll(side, -1)
        kept = []
        for c, d, s, t in zip(out, after, side, after_side, strict=True):
            if s >= 0:
                kept.append(c)
            if (s > 0 > t) or (s < 0 < t):
                kept.append(c + (d - c) * (s / (s - t)))
        out = np.array(kept).reshape(-1, 2)
    return out


def ring_area(ring: np.ndarray) -> float:
    """Signed area: positive if the corners turn to the left."""
    if len(ring) < 3:
        return 0.0
    after = np.roll(ring, -1, axis=0)
    return float((ring[:, 0] * after[:, 1] - ring[:, 1] * after[:, 0]).sum()) / 2


def clip_rings(rings_: pa.ListArray, windows: pa.ListArray) -> tuple[list[np.ndarray | None], np.ndarray]:
    """The part of each ring in its convex window, None if nothing is left, and the signed areas. Only rings that a side of the window crosses are followed."""
    size, most = np.diff(rings_.offsets.to_numpy()), np.diff(windows.offsets.to_numpy())
    flat = np.stack([rings_.flatten().field(c).to_numpy() for c in "xy"], axis=1)
    edge = np.stack([windows.flatten().field(c).to_numpy() for c in "xy"], axis=1)
    first, begin = np.cumsum(size) - size, np.cumsum(most) - most
    of = np.repeat(np.arange(len(size)), size)
    inside, outside = np.ones(len(size), bool), np.zeros(len(size), bool)
    for k in range(most.max(initial=0)):
        p, q = edge[begin + k % np.maximum(most, 1)], edge[begin + (k + 1) % np.maximum(most, 1)]
        side = ((q - p)[of, 0]) * (flat[:, 1] - p[of, 1]) - ((q - p)[of, 1]) * (flat[:, 0] - p[of, 0])
        left = np.bincount(of, side >= 0, len(size))
        inside &= left == size
        outside |= left == 0
    after = np.arange(1, len(flat) + 1)
    after[(first + size - 1)[size > 0]] = first[size > 0]
    area = np.bincount(of, flat[:, 0] * flat[after, 1] - flat[after, 0] * flat[:, 1], len(size)) / 2
    area[size < 3] = 0.0
    out: list[np.ndarray | None] = [None] * len(size)
    for i in np.flatnonzero(~outside & (size > 2)).tolist():
        ring = flat[first[i] : first[i] + size[i]]
        out[i] = ring
        if not inside[i]:
            ring = clip_ring(ring, edge[begin[i] : begin[i] + most[i]])
            out[i], area[i] = (ring if len(ring) > 2 else None), ring_area(ring)
    area[outside] = 0.0
    return out, area


def clipped(found: DataFrame, windows: DataFrame, least: float = 0.25, by: str = "dataset_id") -> DataFrame:
    """Shapes (by, id, rings, area) inside their plot's convex window (by, window), without those below ``least`` area.

    ``found`` has shapes with ``rings``, or a row a ring with its ``corners``. ``window`` is an array of struct(x, y)
    whose corners turn to the left, one row for each ``by``. Rings are clipped one by one, so no shape is held whole.
    Outer rings and holes keep their turn, so a shape's area is the sum over its rings.
    """
    kind = dict(found.dtypes)
    corner = pa.struct([("x", pa.float64()), ("y", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, areas = clip_rings(batch.column("corners"), batch.column("window"))
            n = np.array([0 if r is None else len(r) for r in kept], np.int64)
            xy = np.concatenate([np.zeros((0, 2)), *(r for r in kept if r is not None)])
            offsets = pa.array(np.append(0, np.cumsum(n)), pa.int32(), mask=np.append(n == 0, False))
            rings_ = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=list(corner)))
            yield pa.RecordBatch.from_arrays([batch.column(by), batch.column("id"), rings_, pa.array(areas)], [by, "id", "ring", "area"])

    each = found.select(by, "id", F.explode_outer("rings").alias("corners")) if "rings" in found.columns else found.select(by, "id", "corners")
    joined = each.withColumn("corners", F.coalesce("corners", F.array().cast(RINGS[6:-1]))).join(small(windows.select(by, "window")), by)
    parts = joined.mapInArrow(run, f"{by} {kind[by]}, id {kind['id']}, ring {RINGS[6:-1]}, area double")
    return parts.groupBy(by, "id").agg(F.collect_list("ring").alias("rings"), F.sum("area").alias("area")).where(F.col("area") >= least)
