"""Floods and polygons against literal passes, hand-made shapes and fine grids."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from understory.operators import flooding, polygons


def literal(height, markers):
    """The contract read word for word: a heap of [height, cell] that moves by exchanges, marks beside the grid."""
    rows_, cols = height.shape
    label, marked, heap = -np.ones(height.shape, int), np.zeros(height.shape, bool), []
    near = [(-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1)]

    def inside(r, c):
        return [(r + a, c + b) for a, b in near if 0 <= r + a < rows_ and 0 <= c + b < cols]

    def swap(i, j):
        heap[i], heap[j] = heap[j], heap[i]

    def push(q):
        if marked[q] or label[q] >= 0:
            return
        marked[q] = True
        heap.append((float(height[q]), q))
        i = len(heap) - 1
        while i > 0 and heap[i][0] > heap[(i - 1) // 2][0]:
            swap(i, (i - 1) // 2)
            i = (i - 1) // 2

    def pop():
        first = heap[0]
        swap(0, len(heap) - 1)
        heap.pop()
        i = 0
        narrow = float(np.float32(heap[0][0])) if heap else 0
        while True:
            a, b = 2 * i + 1, 2 * i + 2
            if b < len(heap) and narrow < heap[b][0]:
                j = a if heap[a][0] > heap[b][0] else b
            elif a < len(heap) and narrow < heap[a][0]:
                j = a
            else:
                return first[1]
            swap(i, j)
            i = j

    for i, m in enumerate(markers):
        label[m] = i
    for m in sorted(markers, key=lambda m: (m[1], m[0])):
        for q in inside(*m):
            push(q)
    while heap:
        cell = pop()
        around = [label[q] for q in inside(*cell) if label[q] >= 0]
        for q in inside(*cell):
            push(q)
        d = [(cell[0] - markers[i][0]) ** 2 + (cell[1] - markers[i][1]) ** 2 for i in around]
        label[cell] = around[d.index(min(d))]
    return label


def test_floods_equal_a_literal_pass_on_plateaus():
    r = random.Random(3)
    for k in range(300):
        rows_, cols = r.randint(1, 14), r.randint(1, 14)
        levels = [1, 2, 5, 1000][k % 4]
        height = np.array([[r.randint(0, levels) + (1e-9 * r.random() if k % 3 == 0 else 0) for _ in range(cols)] for _ in range(rows_)])
        cells = [(a, b) for a in range(rows_) for b in range(cols)]
        markers = r.sample(cells, min(len(cells), r.randint(1, 6)))
        assert (flooding.flooded(height, markers) == literal(height, markers)).all()


def bumps(seed, side):
    """Hills of different heights on a square, no two cells alike, with their tops."""
    r = random.Random(seed)
    tops = [(r.uniform(0, side), r.uniform(0, side), r.uniform(6, 12)) for _ in range(side * side // 40)]
    return {(a, b): max(h - 1.6 * math.hypot(a - x, b - y) for x, y, h in tops) + 1e-6 * r.random() for a in range(side) for b in range(side)}


@pytest.mark.parametrize("halo", [2.0, 6.0])
def test_a_scene_in_tiles_equals_one_piece(spark, halo):
    height = bumps(5, 40)
    peak = [q for q, h in height.items() if h >= 2 and all(h >= height.get((q[0] + a, q[1] + b), 0) for a in (-1, 0, 1) for b in (-1, 0, 1))]
    cells = spark.createDataFrame([(7, r, c, h) for (r, c), h in height.items()], "dataset_id int, row long, col long, chm double")
    tops = spark.createDataFrame([(7, r, c, i) for i, (r, c) in enumerate(peak)], "dataset_id int, row long, col long, tree_id long")
    whole = rows(flooding.watershed(cells, tops, 2.0))
    got, edge = flooding.scene(cells, tops, 10.0, halo, 2.0)
    assert rows(got, *("dataset_id", "row", "col", "tree_id")) == whole and len(peak) > 20
    assert edge.agg(F.sum("differ")).first()[0] == 0 and edge.count() > 20
    assert len({r[3] for r in whole}) == len(peak)


def test_a_scene_without_tops_or_cells(spark):
    cells = spark.createDataFrame([(1, 0, c, 5.0) for c in range(30)], "dataset_id int, row long, col long, chm double")
    tops = spark.createDataFrame([(1, 0, 2, 4)], "dataset_id int, row long, col long, tree_id long")
    got, _ = flooding.scene(cells, tops, 10.0, 2.0, 2.0)  # two of three tiles see no top at first
    assert rows(got) == sorted([(1, 0, c, 4) for c in range(30)], key=str)
    assert flooding.scene(cells, tops.limit(0), 10.0, 2.0, 2.0)[0].count() == 0
    assert flooding.scene(cells.limit(0), tops, 10.0, 2.0, 2.0)[0].count() == 0


def cell_table(spark, shapes):
    data = [(1, k, r, c) for k, text in shapes.items() for r, line in enumerate(text.split("/")) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(data, "dataset_id int, label long, row long, col long")


SHAPES = {1: "#", 2: "###/#.#/###", 3: "#./.#", 4: "#####/#...#/#.#.#/#...#/#####", 5: "##/##", 6: "#.#/.#./#.#", 7: "######/#.##.#/######/#.####/######", 8: "####/#..#/#.##/####"}
#: parts, holes and corners of each, with parts over sides and over corners
SIDES = {1: (1, 0, 4), 2: (1, 1, 8), 3: (2, 0, 8), 4: (2, 1, 12), 5: (1, 0, 4), 6: (5, 0, 20), 7: (1, 3, 16), 8: (1, 1, 10)}
CORNERS = SIDES | {3: (1, 0, 8), 6: (1, 0, 20)}


@pytest.mark.parametrize("eight", [False, True])
def test_rings_of_known_shapes(spark, eight):
    cells = cell_table(spark, SHAPES)
    found = [r.asDict(recursive=True) for r in polygons.rings(cells.union(cells), "label", eight).collect()]
    for label, text in SHAPES.items():
        mine = [r for r in found if r["label"] == label]
        want = (CORNERS if eight else SIDES)[label]
        assert (sum(not r["hole"] for r in mine), sum(r["hole"] for r in mine), sum(len(r["corners"]) for r in mine)) == want, label
        assert sum(r["area"] for r in mine) == text.count("#")
        for r in mine:
            assert polygons.ring_area(np.array([(c["x"], c["y"]) for c in r["corners"]])) == r["area"]
        assert {r["part"] for r in mine} == {r["ring"] for r in mine if not r["hole"]}
    # the island in the ring is a part of its own; the ring's hole belongs to the ring
    ring = [r for r in found if r["label"] == 4 and r["hole"]][0]
    assert next(r["area"] for r in found if r["ring"] == ring["part"] and r["label"] == 4) == 25
    assert polygons.rings(cells.limit(0), "label", eight).count() == 0


def test_rings_of_random_cells_keep_area_and_turn(spark):
    r = random.Random(9)
    shapes = {k: "/".join("".join(r.choice("##.") for _ in range(12)) for _ in range(12)) for k in range(8)}
    for eight in (False, True):
        got = polygons.rings(cell_table(spark, shapes), "label", eight).groupBy("label").agg(F.sum("area").alias("n"), F.sum("sides").alias("s")).collect()
        for label, n, s in got:
            on = {(i, j) for i, line in enumerate(shapes[label].split("/")) for j, x in enumerate(line) if x == "#"}
            assert n == len(on) and s == sum((i + a, j + b) not in on for i, j in on for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))


@pytest.mark.parametrize("eight", [False, True])
def test_rings_over_several_blocks(spark, eight):
    r = random.Random(3)
    shapes = SHAPES | {k: "/".join("".join(r.choice("###.") for _ in range(23)) for _ in range(19)) for k in range(20, 26)}
    shapes[30] = "/".join(["#" * 23, *["#" + "." * 21 + "#"] * 3, "#...." + "#" * 13 + "....#", "#...#" + "." * 12 + "##...#", *["#" + "." * 21 + "#"] * 8, "#" * 23])
    cells = cell_table(spark, shapes).select("dataset_id", "label", (F.col("row") - 7).alias("row"), (F.col("col") - 9).alias("col"))
    whole = [tuple(x) for x in polygons.rings(cells, "label", eight).collect()]
    assert len(whole) > 100
    for block in (3, 4, 11):
        assert sorted(tuple(x) for x in polygons.rings(cells, "label", eight, block=block).collect()) == sorted(whole)


def test_a_long_ring_takes_no_more_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(polygons, "cut", lambda df, cut=polygons.cut: rounds.append(1) or cut(df))
    cells = cell_table(spark, {1: "/".join("#.#" * 20 if i % 2 else "#" * 60 for i in range(30))})
    assert polygons.rings(cells, "label").agg(F.sum("area")).first()[0] == cells.count() and len(rounds) <= 5


def star(r, x, y, n=9, far=8.0):
    """A concave ring around (x, y), turning to the left."""
    return [{"x": x + d * math.cos(2 * math.pi * i / n), "y": y + d * math.sin(2 * math.pi * i / n)} for i in range(n) for d in [r.uniform(far / 4, far)]]


def grid_area(test, low, high, n=700):
    step = (high - low) / n
    at = low + (np.arange(n) + 0.5) * step
    return test(*np.meshgrid(at, at)).sum() * step * step


def inside(rings, x, y):
    out = np.zeros(x.shape, bool)
    for ring in rings:
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if p["y"] != q["y"]:
                out ^= ((p["y"] > y) != (q["y"] > y)) & (x < p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]))
    return out


def test_overlap_of_concave_rings_with_holes_by_a_fine_grid(spark):
    r = random.Random(4)
    a = [[star(r, 10, 10), star(r, 10, 10, 5, 1.5)[::-1]] for _ in range(6)]
    b = [[star(r, 10 + r.uniform(-4, 4), 10 + r.uniform(-4, 4), 12)] for _ in range(6)]
    areas = lambda rings: sum(polygons.ring_area(np.array([(c["x"], c["y"]) for c in g])) for g in rings)
    table = lambda t: spark.createDataFrame([(1, i, g, areas(g)) for i, g in enumerate(t)], f"dataset_id int, id long, rings {polygons.RINGS}, area double")
    got = {(x.a, x.b): x for x in polygons.overlaps(table(a), table(b), 3.0).collect()}
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            want = grid_area(lambda x, y: inside(p, x, y) & inside(q, x, y), -3, 23)
            assert abs(got[i, j].shared_area - want) < 0.15
            assert got[i, j].iou == pytest.approx(got[i, j].shared_area / (areas(p) + areas(q) - got[i, j].shared_area))
    same = polygons.overlaps(table(a), table(a), 50.0).where("a = b").collect()
    assert len(same) == 6 and all(x.iou == pytest.approx(1) and x.containment == pytest.approx(1) for x in same)


def test_clipping_to_a_convex_window_by_a_fine_grid(spark):
    r = random.Random(8)
    shapes = [[star(r, 10, 10, 14), star(r, 10, 10, 5, 1.5)[::-1]] for _ in range(5)] + [[star(r, 40, 40)]]
    window = [{"x": 6.0, "y": 5.0}, {"x": 13.0, "y": 7.5}, {"x": 14.0, "y": 13.0}, {"x": 8.0, "y": 14.0}]
    found = spark.createDataFrame([(1, i, g, 0.0) for i, g in enumerate(shapes)], f"dataset_id int, id long, rings {polygons.RINGS}, area double")
    windows = spark.createDataFrame([(1, window)], "dataset_id int, window array<struct<x:double,y:double>>")
    got = {x.id: x for x in polygons.clipped(found, windows).collect()}
    assert set(got) == set(range(5))
    for i, g in enumerate(shapes[:5]):
        want = grid_area(lambda x, y: inside(g, x, y) & inside([window], x, y), -3, 23)
        assert abs(got[i].area - want) < 0.15
        # clipping and measuring agree
        assert polygons.shared_area(polygons.edges(g), polygons.edges([window])) == pytest.approx(got[i].area)


def test_first_come_labels_equal_a_pass_in_order(spark):
    from understory.operators import grid, votes

    r = random.Random(12)
    data = [(1, i, r.randint(1, 9), r.uniform(0, 60), r.uniform(0, 60), float(r.randint(0, 20))) for i in range(900)]
    p = spark.createDataFrame(data, "dataset_id int, pid long, label long, x double, y double, z double")
    got = {x.pid: (x.tile_x, x.tile_y, x.label) for x in votes.first_come(grid.tiles(p, 20.0, 5.0).drop("owner"), 20.0).collect()}
    want = {}
    for ty in range(-1, 4):
        for tx in range(-1, 4):
            near = [d for d in data if 20 * tx - 5 <= d[3] < 20 * tx + 25 and 20 * ty - 5 <= d[4] < 20 * ty + 25]
            found = []
            for label in {d[2] for d in near}:
                mine = [d for d in near if d[2] == label]
                top = max(mine, key=lambda d: (d[5], -d[1]))
                if len(mine) >= 8 and top[5] >= 2 and 20 * tx <= top[3] < 20 * tx + 20 and 20 * ty <= top[4] < 20 * ty + 20:
                    found.append((-top[4], top[3], label, mine))
            for _, _, label, mine in sorted(found, key=lambda f: f[:3]):
                for d in mine:
                    want.setdefault(d[1], (tx, ty, label))
    assert got == want and len(set(want.values())) > 20


def test_overlap_of_crowds(spark):
    """Upright and slanting shapes in one place: each is sent once for a crowd it meets, and all pairs have the area of the pairwise sweep."""
    r = random.Random(5)
    cells = cell_table(spark, {k: "/".join("".join(r.choice("#..") for _ in range(14)) for _ in range(9)) for k in range(1, 31)})
    upright = [(x.dataset_id, x.id, x.rings, x.area) for x in polygons.shapes(polygons.rings(cells, "label"), "label").collect()]
    shapes = [*upright, *((1, i, [star(r, r.uniform(0, 40), 5.0)], 1.0) for i in range(40, 46)), (1, 50, [[{"x": 30.5, "y": 0.25}, {"x": 33.0, "y": 0.25}, {"x": 33.0, "y": 9.5}, {"x": 30.5, "y": 9.5}]], 23.125)]
    t = spark.createDataFrame(shapes, f"dataset_id int, id long, rings {polygons.RINGS}, area double").cache()
    drawn = {x.id: polygons.edges([[c.asDict() for c in g] for g in x.rings]) for x in t.collect()}
    want = {(a, b): w for a, p in drawn.items() for b, q in drawn.items() if (w := polygons.shared_area(p, q)) > 1e-9}
    for crowd in (4, 512):
        got = {(x.a, x.b): x.shared_area for x in polygons.overlaps(t, t, 16.0, crowd=crowd).where("shared_area > 1e-9").collect()}
        assert got == pytest.approx(want)
    assert max(len(side.where("id < 40").collect()) for side in polygons.meeting(t.where("id < 40"), t.where("id < 40"), 16.0)) == 30
